"""Queries of parsed addresses and of whole stages on the business records and the candidate graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses as A
from ..operators import stages as S
from ..operators.tables import saved, spread
from . import businesses as Z
from .catalogue import GRID, _EDGES, _MATCHES, edges, matches, truth, universe
from .decisions import scores
from .edits import country, decided, scored, texts
from .learnt import keys_of, with_parts
from .registry import query


def one(name, f, sql=None):
    query(name, sql)(lambda spark, d: f(Z.biz(spark, d)))


one("parse_address", lambda b: b.select("k", A.parse_address("address").alias("a")).select("k", "a.a_norm", "a.a_street", "a.a_city", "a.a_state", "a.a_num1", "a.a_num1_sfx", F.array_join(F.transform("a.a_nums", lambda x: x.cast("string")), " ").alias("a_nums"), "a.a_unit"))
one("state_lookup", lambda b: b.select("k", A.state_lookup(F.substring_index("address", ",", -1)).alias("state")), f"WITH {Z._B} SELECT k, CASE WHEN address LIKE '%Texas' THEN 'tx' ELSE '' END AS state FROM biz")
one("city_score", lambda b: b.select("k", A.city_scores(F.substring_index("address", ",", 1)).alias("score")), f"WITH {Z._B}, w AS (SELECT k, regexp_extract_all(lower(strip_accents(split_part(address, ',', 1))), '[a-z0-9]+') AS w FROM biz) SELECT k, CAST(CASE WHEN len(w) = 0 THEN -100 ELSE 1 + CASE WHEN len(w) <= 4 THEN 2 ELSE 0 END - 4 - CASE WHEN list_has_any(w, ['street', 'avenue', 'road', 'boulevard', 'ave', 'rd', 'bd']) THEN 3 ELSE 0 END - 0 END AS BIGINT) AS score FROM w")
one("normalize_stage", lambda b: A.normalised(b.select(F.col("k").alias("eid"), (F.col("v") + 1).alias("source"), "country", "name", "address")).drop("a_nums"))


def sides(spark, d):
    n = A.normalised(Z.biz(spark, d).select(F.col("k").alias("eid"), F.col("v").alias("source"), "country", "name", "address"))
    t = saved(n)
    left, right = (t.select(F.col("eid").alias(k), *(F.col(c).alias(f"{p}_{c}") for c in t.columns if c != "eid")) for k, p in (("s1", "l"), ("r", "r")))
    return texts(spark, d).select("s1", "r").join(left, "s1").join(right, "r")


query("addr_equalities")(lambda spark, d: S.address_equalities(sides(spark, d)))
query("number_features")(lambda spark, d: sides(spark, d).select("s1", "r", *(c.alias(n) for n, c in S.number_features(F.col("l_a_num1"), F.col("r_a_num1"), F.col("l_a_unit"), F.col("r_a_unit")).items())))
_NUM = f"WITH {Z._PAIRS}, x AS (SELECT s1, r, CAST(regexp_extract(aa, '[0-9]+') AS BIGINT) AS a, CAST(regexp_extract(ab, '[0-9]+') AS BIGINT) AS b FROM pairs WHERE ab <> ''), y AS (SELECT *, CAST(a AS VARCHAR) AS p, CAST(b AS VARCHAR) AS q FROM x)"
query("signed_numbers", _NUM + " SELECT s1, r, greatest(least(b - a, 50), -50) AS d, b - a IN (1, 2, 3, 4, 5, 7, 9, 11, 13, 21) AS nudge, length(p) = length(q) AND levenshtein(p, q) = 1 AS one_digit, length(p) = length(q) AND levenshtein(p, q) = 2 AND damerau_levenshtein(p, q) = 1 AND b - a NOT IN (1, 2, 3, 4, 5, 7, 9, 11, 13, 21, -1, -2) AS swap, p <> q AND (suffix(p, q) OR suffix(q, p)) AS suffix, CAST(length(q) - length(p) AS INTEGER) AS length FROM y")(
    lambda spark, d: texts(spark, d).where("ab != ''").select("s1", "r", F.regexp_extract("aa", "[0-9]+", 0).cast("long").alias("a"), F.regexp_extract("ab", "[0-9]+", 0).cast("long").alias("b")).select("s1", "r", *(c.alias(n) for n, c in S.signed_numbers(F.col("a"), F.col("b")).items())))
query("fuzzy_scores_v1")(lambda spark, d: S.fuzzy_scores(texts(spark, d)))
query("baseline_pair_features")(lambda spark, d: S.baseline_pair_features(texts(spark, d)))


def blocked(spark, d):
    parts = with_parts(spread(Z.biz(spark, d)))
    k = saved(parts.select(F.lit("all").alias("part"), "v", F.col("k").alias("eid"), keys_of().alias("keys"), (F.size("a_") + F.size("d_")).alias("n_address"), F.size("n_").alias("n_name")))
    names = k.withColumn("keys", F.filter("keys", lambda x: x.startswith("n:")))
    sizes = k.select("eid", "n_address", "n_name", F.lit(0).alias("longest"))
    pick = lambda t, w: t.where(w).select("part", "eid", "keys")
    return pick(k, "v = 0"), pick(k, "v > 0"), pick(names, "v = 0"), pick(names, "v > 0"), sizes


query("name_short_view")(lambda spark, d: S.name_short_view(*blocked(spark, d)[2:]))
query("block_stage")(lambda spark, d: S.block_stage(*blocked(spark, d)))
query("decide_stage")(lambda spark, d: S.decide_stage(edges(spark, d), universe(spark, d), truth(spark, d), F.col("s1") % 4 == 0, GRID))
query("kit_export")(lambda spark, d: S.kit_export(scored(spark, d), texts(spark, d), decided(spark, d), country(spark, d), "1"))
query("rescore_export", f"WITH {_MATCHES} SELECT s1, r, p FROM matches WHERE p > 0.9 AND r % 3 <> 0")(lambda spark, d: S.rescore_export(matches(spark, d), edges(spark, d), edges(spark, d).where("r % 3 = 0"), 0.9))
query("llm_merge", f"WITH {_EDGES} SELECT s1, r, p * 20 - 10 AS z FROM edges WHERE p > 0.5")(lambda spark, d: S.llm_merge([scores(spark, d).where(f"s1 % 2 = {k}") for k in (0, 1)], edges(spark, d).where("p > 0.5")))
one("synth_pairs", lambda b: S.synth_pairs(b.where("v = 0").select(F.col("k").alias("eid"), "name", "address")))
