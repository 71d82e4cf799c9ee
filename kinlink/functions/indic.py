"""Indic scripts to Latin, in two spellings. Arrow UDFs that get only the rows with Indic letters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import text as T

# What letters at the offsets of the nine blocks are written as.
BLOCKS = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "ri", 0x0C: "li", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au"}
CONSONANTS = "k kh g gh ng ch chh j jh ny t th d dh n t th d dh n n p ph b bh m y r r l l zh v sh sh s h".split()
SIGNS = {0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x62: "li", 0x63: "li"}
MARKS = {0x01: "n", 0x02: "n", 0x03: "h"}
LEGAL_SKELETONS = "prvt prbt prvr pr l lmt lmtd lmrd elp sr".split()
#: The other spelling: long vowels doubled the English way, no letters but these.
PLAIN_VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ee", 0x09: "u", 0x0A: "oo", 0x0B: "ri", 0x0F: "e", 0x10: "ai", 0x13: "o", 0x14: "au"}
PLAIN_MISSING = {0x29, 0x31, 0x33, 0x34}
PLAIN_SIGNS = {0x3E: "aa", 0x3F: "i", 0x40: "ee", 0x41: "u", 0x42: "oo", 0x43: "ri", 0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au"}
TAMIL_VOWELS = PLAIN_VOWELS | {0x0E: "e", 0x12: "o"}
TAMIL_CONSONANTS = {0x15: "k", 0x19: "ng", 0x1A: "ch", 0x1C: "j", 0x1E: "ny", 0x1F: "t", 0x23: "n", 0x24: "t", 0x28: "n", 0x29: "n", 0x2A: "p", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x34: "zh", 0x35: "v", 0x37: "sh", 0x38: "s", 0x39: "h"}
TAMIL_SIGNS = PLAIN_SIGNS | {0x46: "e", 0x4A: "o"}

INDIC = "[\\u0900-\\u0d7f]"
_VIRAMA, _NUKTA = 0x4D, 0x3C


def _place(c: str) -> tuple[int, int] | None:
    block = ord(c) & ~0x7F
    return (block, ord(c) - block) if block in BLOCKS else None


def transliterate(text: str) -> str:
    """A consonant carries an "a" unless a vowel sign or a virama follows, or nothing that is a Latin letter does."""
    out: list[str] = []
    open_a = False  # the last consonant's "a" is still to be decided

    def put(piece: str) -> None:
        nonlocal open_a
        if open_a and "a" <= piece[:1] <= "z":
            out.append("a")
        open_a = False
        out.append(piece)

    for c in text:
        if c in "‌‍":
            continue
        at = _place(c)
        k = at[1] if at else -1
        if at is None:
            put(c)
        elif 0 <= k - 0x15 < len(CONSONANTS):
            put(CONSONANTS[k - 0x15])
            open_a = True
        elif k in SIGNS:
            open_a = False
            out.append(SIGNS[k])
        elif k == _VIRAMA:
            open_a = False
        elif k in VOWELS or k in MARKS:
            put(VOWELS.get(k) or MARKS[k])
        elif 0x66 <= k <= 0x6F:
            put(str(k - 0x66))
        elif k != _NUKTA:
            put(c)
    return "".join(out)


def romanise(text: str) -> str:
    """The other spelling: the "a" is always written, anusvara is "m", unknown signs go."""
    out: list[str] = []
    for c in text:
        at = _place(c)
        if at is None:
            out.append(c)
            continue
        tamil, k = at[0] == 0x0B80, at[1]
        vowels, signs = (TAMIL_VOWELS, TAMIL_SIGNS) if tamil else (PLAIN_VOWELS, PLAIN_SIGNS)
        if tamil:
            consonant = TAMIL_CONSONANTS.get(k)
        else:
            consonant = CONSONANTS[k - 0x15] if 0 <= k - 0x15 < len(CONSONANTS) and k not in PLAIN_MISSING else None
        if consonant:
            out.append(consonant + "a")
        elif k in vowels:
            out.append(vowels[k])
        elif k in signs or k == _VIRAMA:
            if out and out[-1].endswith("a"):
                out[-1] = out[-1][:-1]
            out.append(signs.get(k, ""))
        elif k in (0x02, 0x03):
            out.append("m" if tamil or k == 0x02 else "h")
        elif not tamil and 0x66 <= k <= 0x6F:
            out.append(str(k - 0x66))
    return "".join(out)


def _udf(f):
    @F.pandas_udf(StringType())
    def over(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")
    return over


def has_indic(text: Column) -> Column:
    return F.coalesce(text.rlike(INDIC), F.lit(False))


def _where_indic(udf, text: Column) -> Column:
    return F.coalesce(udf(F.when(has_indic(text), text)), text)


def translit_block(text: Column) -> Column:
    return _where_indic(_udf(transliterate), text)


def translit_norm(text: Column) -> Column:
    return _where_indic(_udf(romanise), text)


def indic_name_tokens(text: Column, mapping: dict[str, str] | None = None) -> Column:
    """Name tokens after transliteration; in Indic names legal forms (by their skeletons) go and ``mapping`` is applied."""
    tokens = T.name_tokens(translit_block(text))
    legal = F.array(*map(F.lit, LEGAL_SKELETONS))
    own = F.filter(tokens, lambda t: ~F.array_contains(legal, T.skeleton(t)))
    own = T.dict_map_tokens(own, mapping) if mapping else own
    return F.when(has_indic(text), own).otherwise(tokens)


def plain_words(text: str) -> list[str]:
    """Words of a text with any script: composed, romanised, without marks, case folded, signs for "and" spelt out."""
    import re

    flat = unicodedata.normalize("NFKD", romanise(unicodedata.normalize("NFKC", text)))
    flat = "".join(c for c in flat if not unicodedata.combining(c)).casefold()
    return re.findall("[a-z0-9]+", re.sub("[&+]", " and ", flat))


@F.pandas_udf(ArrayType(StringType()))
def _plain_words(s: pd.Series) -> pd.Series:
    return s.map(plain_words, na_action="ignore")


def ascii_words(text: Column) -> Column:
    """As ``plain_words``: built-ins for ASCII rows, the UDF for the others only."""
    text = F.coalesce(text, F.lit(""))
    odd = text.rlike("[^\\x00-\\x7F]")
    native = F.regexp_extract_all(F.regexp_replace(F.lower(text), "[&+]", " and "), F.lit("[a-z0-9]+"), F.lit(0))
    return F.coalesce(_plain_words(F.when(odd, text)), native)
