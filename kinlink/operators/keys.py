"""Integer keys, hash folds and samples. All are column expressions that stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDS = 20
HOLDOUT = 5
ID_PATTERN = "^S[123]-(0|[1-9][0-9]{0,8})$"
SOURCE_STEP = 1_000_000_000


def eid_encode(text: Column, strict: bool = False) -> Column:
    """``S<source>-<number>`` to ``source * 10^9 + number``; anything else is null, or an error if ``strict``."""
    good = F.substring(text, 2, 1).cast("long") * SOURCE_STEP + F.substring(text, 4, 9).cast("long")
    bad = F.raise_error(F.concat(F.lit("bad entity id: "), F.coalesce(text, F.lit("null")))).cast("long") if strict else F.lit(None).cast("long")
    return F.when(text.rlike(ID_PATTERN), good).otherwise(bad)


def source_of(eid: Column) -> Column:
    return F.floor(eid / SOURCE_STEP).cast("long")


def eid_decode(eid: Column, strict: bool = False) -> Column:
    """The id string; of a source other than 1 to 3 null, or an error if ``strict``."""
    bad = F.raise_error(F.concat(F.lit("bad eid: "), F.coalesce(eid.cast("string"), F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(source_of(eid).between(1, 3), F.concat(F.lit("S"), source_of(eid).cast("string"), F.lit("-"), F.pmod(eid, F.lit(SOURCE_STEP)).cast("string"))).otherwise(bad)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _add(a: Column, b: int) -> Column:
    """Sum modulo 2^64 by halves, so that ANSI overflow never raises."""
    mask = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(mask) + F.lit(b & 0xFFFFFFFF)
    high = (F.shiftrightunsigned(a, 32) + F.lit(b >> 32) + F.shiftrightunsigned(low, 32)).bitwiseAND(mask)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))


def _multiply(a: Column, b: int) -> Column:
    """Product modulo 2^64 from 16-bit limbs of both; every partial sum stays below 2^36."""
    limb = [F.shiftrightunsigned(a, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    fixed = [F.lit(b >> (16 * k) & 0xFFFF).cast("long") for k in range(4)]

    def column(k: int, carry: Column) -> Column:
        """Limb k of the product and all above it, in place."""
        total = carry
        for i in range(k + 1):
            total = total + limb[i] * fixed[k - i]
        here = lambda t: F.shiftleft(t.bitwiseAND(F.lit(0xFFFF)), 16 * k)
        return _let(total, lambda t: here(t) if k == 3 else here(t).bitwiseOR(column(k + 1, F.shiftrightunsigned(t, 16))))

    return column(0, F.lit(0).cast("long"))


def splitmix64(key: Column) -> Column:
    """The 64-bit SplitMix finaliser, as a signed long with the same bits."""
    stir = lambda bits, factor: lambda z: _let(z.bitwiseXOR(F.shiftrightunsigned(z, bits)), lambda x: _multiply(x, factor))
    return _let(_let(_let(_add(key, 0x9E3779B97F4A7C15), stir(30, 0xBF58476D1CE4E5B9)), stir(27, 0x94D049BB133111EB)), lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 31)))


def unsigned_mod(z: Column, n: int) -> Column:
    return _let(z, lambda x: ((F.shiftrightunsigned(x, 1) % n) * 2 + x.bitwiseAND(F.lit(1).cast("long"))) % n)


def fold_of(key: Column) -> Column:
    return unsigned_mod(splitmix64(key), FOLDS)


def is_holdout(key: Column) -> Column:
    return fold_of(key) < HOLDOUT


def oof_group(key: Column) -> Column:
    """-1 in the holdout, otherwise the third of the remaining folds."""
    fold = fold_of(key)
    return F.when(fold < HOLDOUT, F.lit(-1).cast("long")).otherwise(F.floor((fold - HOLDOUT) / 5))


def dev_sample(key: Column) -> Column:
    """A quarter of every fifth fold, by the next digit (unsigned quotient by the folds) of the same hash."""
    z = splitmix64(key)
    quotient = F.floor(F.shiftrightunsigned(z, 1).cast("decimal(20,0)") / (FOLDS // 2)).cast("long")
    return (unsigned_mod(z, FOLDS) % 5 == 0) & (quotient % 4 == 0)


def hash_slice(key: Column, salt: int, mod: int) -> Column:
    return unsigned_mod(splitmix64(key.bitwiseXOR(F.lit(salt))), mod) == 0
