"""Literal cases and brute force for keys, text and comparisons."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from kinlink.functions import pairs as P
from kinlink.functions import text as T
from kinlink.operators import keys as K


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("text, eid, fold", [("S1-965667", 1000965667, 7), ("S1-55344266", 1055344266, 12), ("S1-343815751", 1343815751, 17), ("S2-681193310", 2681193310, None)])
def test_eid_and_fold(spark, text, eid, fold):
    assert one(spark, text, K.eid_encode) == eid
    assert one(spark, text, lambda v: K.eid_decode(K.eid_encode(v))) == text
    if fold is not None:
        assert one(spark, text, lambda v: K.fold_of(K.eid_encode(v))) == fold


@pytest.mark.parametrize("text", ["S4-1", "X1-5", "S1-01", "S1-1234567890", "S1-", "S1-12a", "s1-5"])
def test_bad_eid(spark, text):
    assert one(spark, text, K.eid_encode) is None


@pytest.mark.parametrize("text, f, want", [
    ("Café Lumière SARL", T.name_tokens, ["cafe", "lumiere"]), ("Shri Ganesh Traders", T.name_tokens, ["ganesh", "traders"]), ("0054 RUE Negrier, Lille", T.address_words, ["rue", "negrier", "lille"]),
    ("0054 RUE Negrier, Lille", T.address_numbers, ["54"]), ("H.No 12-3-45, MG Road", T.address_words, ["mg", "rd"]), ("H.No 12-3-45, MG Road", T.address_numbers, ["12", "3", "45"]), ("8444b Main Street", T.address_words, ["main", "st"]),
    ("35 Twentieth Ave, Queens", T.address_numbers, ["35", "20"]), ("2 Second Floor, 9 Thirty Second Street", T.address_numbers, ["2", "2", "9", "32"]),
    ("32 Rue André Maginot, Mérignac", T.numstreet_key, "32|andre"), ("PA, AVELLA CITY, 972 OLD RIDGE RD", T.numstreet_key, "972|old"), ("0020718 ADAMS MILL PLACE, VA", T.numstreet_key, "20718|adams"), ("no number", T.numstreet_key, ""),
    ("marketing", T.skeleton, "mrktng"), ("maarketing", T.skeleton, "mrktng"), ("builders", T.skeleton, "bldrs"), ("bildars", T.skeleton, "bldrs"), ("software", T.skeleton, "sftvr"), ("sophtaveyar", T.skeleton, "sftvr"),
])
def test_text(spark, text, f, want):
    assert one(spark, text, f) == want


def test_alignments():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert P.lcs_length(a, b) == table[-1][-1]
    assert P.osa_distance("ab", "ba") == 1 and P.osa_distance("ca", "abc") == 3


def test_best_prefix_is_best():
    rng = random.Random(9)
    for _ in range(40):
        p = sorted((rng.random() for _ in range(rng.randint(1, 7))), reverse=True)

        def value(k):
            total = 0.0
            for world in itertools.product((0, 1), repeat=len(p)):
                w = 1.0
                for q, y in zip(p, world):
                    w *= q if y else 1 - q
                true, hit = sum(world), sum(world[:k])
                total += w * (1.0 if not true and not k else 1.25 * hit / (0.25 * true + k))
            return total

        assert value(P.best_prefix(p)) == pytest.approx(max(map(value, range(len(p) + 1))))


def test_char_cosine(spark):
    """Literal cases; the time grows with the length of the texts, not with its square."""
    long = "".join(random.Random(5).choices("abcdefgh", k=20_000))
    rows = [("abcd", "abcd", 1.0), ("abcabc", "abc", 2 / 6 ** 0.5), ("ab", "abc", 0.0), ("", "", 0.0), (None, "abc", 0.0), ("ééé", "ééé", 1.0), (long, long[::-1], None)]
    start = time.monotonic()
    got = [r["x"] for r in spark.createDataFrame(rows, "a string, b string, w double").coalesce(1).select(P.char_cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[:-1] == pytest.approx([w for *_, w in rows[:-1]]) and 0 < got[-1] < 1 and time.monotonic() - start < 20
