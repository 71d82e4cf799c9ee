"""Brute force and literal cases of edits, decisions, scripts, addresses and similarities that have no SQL."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from kinlink.functions import addresses as A
from kinlink.functions import businesses as B
from kinlink.functions import indic as I
from kinlink.functions import pairs as P
from kinlink.operators import decide as D
from kinlink.operators import dictionaries as L
from kinlink.operators import edits as X
from kinlink.operators import graph as G
from kinlink.operators import models as M


def test_best_set_is_best():
    rng = random.Random(2)
    for _ in range(40):
        q = sorted((rng.random() for _ in range(rng.randint(1, 7))), reverse=True)
        own, phantom = [rng.random() < 0.6 for _ in q], rng.choice([0.0, 0.1])
        every = q + ([phantom] if phantom else [])

        def value(k):
            kept, total = [i for i, o in enumerate(own) if o][:k], 0.0
            for world in itertools.product((0, 1), repeat=len(every)):
                p = 1.0
                for x, y in zip(every, world):
                    p *= x if y else 1 - x
                hit, true = sum(world[i] for i in kept), sum(world)
                total += p * ((0.0 if true else 1.0) if not kept else 1.25 * hit / (0.25 * true + len(kept)))
            return total

        k, best = X.best_set(q, own, phantom)
        assert value(k) == pytest.approx(best) == pytest.approx(max(map(value, range(sum(own) + 1))))


def test_best_set_without_candidates():
    assert X.best_set([], []) == (0, 1.0) and X.best_set([0.9], [False])[0] == 0


@pytest.mark.parametrize("a, b, want", [
    ("red river mills ltd", "red river mills", ("same", "", "", "")), ("red river mills", "red rivr mills", ("same", "", "", "")), ("red river mills ltd", "red river mills groupe ltd", ("add", "end", "groupe", "")),
    ("red river mills ltd", "red river mills ltd groupe", ("add", "after_legal", "groupe", "")), ("red river mills ltd", "red ocean mills ltd", ("swap", "before_legal", "ocean", "river")), ("red river mills ltd", "rrm", ("acr", "", "rrm", "")),
    ("red river mills", "blue ocean mills", ("", "", "", "")), ("ltd", "red", ("", "", "", "")), ("red river", "red ocean", ("swap", "end_same_slot", "ocean", "river")),
])
def test_name_edit(a, b, want):
    assert P.edit_of_names(a, b) == want


def test_swapped_words():
    real = {"harvest", "harbour"}
    assert X.looks_swapped(["green", "harvard"], ["green", "harvest"], real)
    assert not X.looks_swapped(["green", "harvard"], ["green", "harvest"], set())
    assert not X.looks_swapped(["green", "harvard"], ["gh"], real) and not X.looks_swapped(["green"], ["green"], real) and not X.looks_swapped(["green", "harvard"], ["greenh"], real)


@pytest.mark.parametrize("text, block, norm", [("कमल", "kamal", "kamala"), ("बैंक", "baink", "baimka"), ("शक्ति", "shakti", "shakti"), ("१२", "12", "12"), ("தமிழ்", "tamizh", "tamizh"), ("abc", "abc", "abc")])
def test_scripts(text, block, norm):
    assert I.transliterate(text) == block and I.romanise(text) == norm


def test_words_of_any_script():
    assert I.plain_words("Café & Fils ＡＢＣ") == ["cafe", "and", "fils", "abc"]
    assert I.plain_words("Nguyễn ﬁlms") == ["nguyen", "films"] and I.plain_words("a+b") == ["a", "and", "b"]


def test_addresses():
    got = dict(zip(A._FIELDS.names, A.parts_of("Flat 7, 0042bis Long Lane, Springfield, Texas")))
    assert (got["a_state"], got["a_city"], got["a_num1"], got["a_num1_sfx"], got["a_unit"], got["a_nums"]) == ("tx", "springfield", 42, "bis", 7, [7, 42])
    assert A.parts_of("")[4] is None and A.state_of("somewhere in New Mexico") == "nm" and A.state_of("Paris 75001") == "" and A.city_score("12 Long Road") < 0 < A.city_score("Springfield")
    assert B.street_of("12bis rue des lilas, ville") == ("12", ["lilas"]) and B.street_of("ville, 0054 aveune victor hugo") == ("54", ["hugo", "victor"]) and B.street_of("ville") == ("", [])


def test_similarities():
    assert P.token_set_similarity("a b c", "c b a d") == 1.0 and P.token_set_similarity("", "x") is None
    rng = random.Random(3)
    for _ in range(100):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        best = max(P.indel_similarity(short, long[i:j]) or 0 for i in range(len(long)) for j in range(i + 1, len(long) + 1) if j - i == len(short) or i == 0 or j == len(long) if j - i <= len(short))
        assert P.partial_similarity(a, b) == pytest.approx(best)
        assert P.levenshtein(a, b) >= abs(len(a) - len(b)) and P.osa_distance(a, b) <= P.levenshtein(a, b)


def test_best_split_is_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))): rng.random() + 0.1 for _ in range(8)}
        token = "".join(rng.choice("ab") for _ in range(6))
        cuts = [[token[i:j] for i, j in zip((0, *c), (*c, 6))] for n in (1, 2, 3) for c in itertools.combinations(range(1, 6), n)]
        costs = [sum(words[w] for w in cut) for cut in cuts if all(w in words for w in cut)]
        found = L.best_split(token, words)
        assert bool(found) == bool(costs) and (not costs or sum(words[w] for w in found) == pytest.approx(min(costs)))


def test_index_bootstrap_draws_all(spark):
    """Every draw takes n of n, in blocks too, and there is no most number of entities."""
    d = spark.range(500).select(F.col("id").alias("s1"), F.pmod(F.col("id") * 7, F.lit(11)).cast("double").alias("d"))
    rows = D._index_draws(d, 200, 0, 32).groupBy("draw").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m")).collect()
    values = [k * 7 % 11 for k in range(500)]
    mean, deviation = statistics.mean(values), statistics.pstdev(values) / 500 ** 0.5
    assert len(rows) == 200 and all(r["n"] == 500 for r in rows)
    assert statistics.mean(r["m"] for r in rows) == pytest.approx(mean, abs=deviation / 3) and statistics.pstdev(r["m"] for r in rows) == pytest.approx(deviation, rel=0.2)
    many = spark.range((1 << 20) + 1).select(F.col("id").alias("s1"), F.lit(0.0).alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    got = D.paired_bootstrap(many, 20, poisson=False).first()
    assert got["n"] == (1 << 20) + 1 and got["delta"] == 0.5 and 0.49 < got["ci_low"] < 0.5 < got["ci_high"] < 0.51


def test_nearest_s1_broadcasts_nothing(spark):
    """Large sides whose statistics look small are not gathered in the driver."""
    keys = lambda a, b: spark.range(a, b).select(F.col("id").alias("eid"), F.concat(F.lit("n:"), (F.col("id") % 50).cast("string")).alias("key"))
    got = L.nearest_s1(keys(0, 100), keys(1000, 1060))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["s1"], r["r"]) for r in got.collect()) == sorted((k % 50, 1000 + k) for k in range(60))


def test_predict_train_test_scores_once(spark):
    """Scores out of fold are computed once, however often calibration reads them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(k):
        seen.add(1)
        return (k * 37 % 100) / 100

    rows = spark.range(300).select(F.col("id").alias("s1"), F.col("id").alias("r"), (F.col("id") % 5).cast("double").alias("line__a"), (F.col("id") % 2).cast("int").alias("y"))
    known = rows.where("s1 % 4 > 0")
    got = M.predict_train_test(known.withColumn("p", score("s1")), rows, M.fit_trees(known, depth=2, rounds=2, stop_share=0.0)).collect()
    assert sorted(r["s1"] for r in got) == list(range(300)) and all(0 < r["p"] < 1 for r in got) and seen.value == 225


def test_equal_keys_make_no_pair_rows(spark):
    """Counts equal those of the pairs, also of repeated ids and nulls; 60,000 copies a side would be 3.6e9 pairs."""
    rows = [(k, f"t{k % 5}") for k in range(40)] + [(2, "t1"), (2, "t2"), (7, "t1"), (7, "t2"), (50, None), (51, None), (52, "alone"), (3, "t3")]
    t = spark.createDataFrame(rows, "eid long, key string")
    e, r = t.where("eid % 2 = 0"), t.where("eid % 2 = 1")
    pred = spark.createDataFrame([(2, 7), (2, 7), (2, 1), (10, 15), (10, 16), (50, 51), (99, 1)], "s1 long, r long")
    pairs = e.select(F.col("eid").alias("s1"), "key").join(r.select(F.col("eid").alias("r"), "key"), "key").select("s1", "r")
    want, got = G.per_entity_f05(e.select(F.col("eid").alias("s1")), pairs, pred), G.equal_key_f05(e, r, pred)
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(got.collect()) == sorted(want.collect())
    many = spark.range(120_000).select(F.col("id").alias("eid"), F.lit("copy").alias("key"))
    got = G.equal_key_f05(many.where("eid % 2 = 0"), many.where("eid % 2 = 1"), pred).agg(F.sum("n_true"), F.sum("n_hit")).first()
    assert tuple(got) == (60_000 * 60_000, 4)
