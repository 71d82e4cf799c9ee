"""Queries of edit classes on the business records, and of expected-F decisions on the candidate graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as X
from ..operators.tables import saved
from . import businesses as Z
from .catalogue import _TOP, edges, owned, universe
from .learnt import vocabulary
from .registry import query


def texts(spark, d):
    return Z.pairs(spark, d)


def scored(spark, d):
    """Candidate edges of the business pairs, with a score and a truth made from their keys."""
    t = texts(spark, d).select("s1", "r")
    p = ((F.col("s1") * 7 + F.col("r") * 13) % 97 + 0.5) / 98
    return t.select("s1", "r", p.alias("p"), F.when(p > 0.5, 1).otherwise(0).alias("y"), (2 + F.col("r") % 2).alias("source"))


def country(spark, d):
    return Z.biz(spark, d).where("v = 0").select(F.col("k").alias("s1"), "country")


def ops(spark, d):
    return saved(X.classify_ops(texts(spark, d), country(spark, d), vocabulary(spark, d).withColumn("n", F.col("n") * 20)))


def decided(spark, d):
    return scored(spark, d).where("p >= 0.3").select("s1", "r")


query("classify_ops")(lambda spark, d: ops(spark, d).select("s1", "r", "kind", "position", "added", "dropped", "same_num", "number_edit", "op"))
query("apply_ops")(lambda spark, d: X.apply_ops(decided(spark, d), ops(spark, d), scored(spark, d), country(spark, d).where("country != '0'")))
query("rule_acr")(lambda spark, d: X.rule_acr(decided(spark, d), ops(spark, d), scored(spark, d)))
query("rule_copy")(lambda spark, d: X.rule_copy(decided(spark, d), texts(spark, d), scored(spark, d)))
query("is_swapsim")(lambda spark, d: X.swapsim(texts(spark, d), country(spark, d), vocabulary(spark, d).withColumn("n", F.col("n") * 20)))
query("drop_swapsim")(lambda spark, d: X.drop_swapsim(decided(spark, d), X.swapsim(texts(spark, d), country(spark, d), vocabulary(spark, d).withColumn("n", F.col("n") * 20)), country(spark, d)))
query("copy_swap_other")(lambda spark, d: X.copy_swap_other(ops(spark, d), texts(spark, d).where("ab = ''").select("r")))
query("edit_profile_features")(lambda spark, d: X.edit_profile(ops(spark, d)))
query("hypothesis_tables")(lambda spark, d: X.population_rates(ops(spark, d), scored(spark, d), decided(spark, d), country(spark, d)))
query("rule_pop")(lambda spark, d: X.rule_pop(ops(spark, d)))
query("rule_decisions_score")(lambda spark, d: X.rule_pop(ops(spark, d)).join(decided(spark, d).withColumn("m", F.lit(1)), ["s1", "r"], "left").groupBy("op").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.coalesce("m", F.lit(0))), 6).alias("accepted")))
query("street_swap_bands")(lambda spark, d: X.street_bands(texts(spark, d), [0.25, 0.5, 0.75, 1.0]))
query("preselect", "WITH p AS (SELECT p_partkey AS s1, p_partkey + 1 AS r, p_size % 5 AS rel, p_size % 3 AS inter, p_size % 2 AS extra_r, p_size % 4 AS len_r, p_size % 2 AS substituted FROM part) SELECT * FROM p WHERE (rel = 1 AND inter >= 1 AND extra_r = 1) OR (rel = 1 AND len_r <= 2 AND inter = 0) OR (rel IN (2, 3, 4) AND extra_r = 0 AND substituted = 0)")(
    lambda spark, d: X.preselect(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("s1"), (F.col("p_partkey") + 1).alias("r"), *((F.col("p_size") % m).alias(n) for n, m in (("rel", 5), ("inter", 3), ("extra_r", 2), ("len_r", 4), ("substituted", 2))))))
query("expected_f_full")(lambda spark, d: X.expected_f(edges(spark, d))[0])
query("expected_f_phantom")(lambda spark, d: X.expected_f(edges(spark, d), 0.1, 0.02)[0])
query("expected_f_by_country")(lambda spark, d: X.expected_f_by_country(X.expected_f(edges(spark, d))[1], universe(spark, d)))
query("variant_decision", _TOP + " SELECT s1, r, p FROM top WHERE k = 1 AND p > 0.7")(lambda spark, d: X.variant_decision(edges(spark, d), 0.7))
