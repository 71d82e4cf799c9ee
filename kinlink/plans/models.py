"""Queries of trained scorers and calibration on the candidate graph. Models have no SQL; what is fixed about them is tested."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import models as M
from ..operators.tables import saved
from .catalogue import _read, edges, owned, truth
from .decisions import country
from .registry import query


def features(spark, d):
    """Edges with features of their line and of their groups; y leans on them."""
    e = edges(spark, d)
    c = G.cand_log_counts(e)
    f = e.join(c, ["s1", "r"]).withColumn("line__p", F.col("p")).withColumn("ctx__n_s1", F.col("log_n_s1")).withColumn("ctx__n_r", F.when(F.col("r") % 17 > 0, F.col("log_n_r"))).withColumn("line__mod", F.col("r") % 7)
    y = F.when((F.col("p") > 0.6) | ((F.col("r") % 7 == 3) & (F.col("p") > 0.3)), 1).otherwise(0)
    return saved(f.select("s1", "r", "line__p", "ctx__n_s1", "ctx__n_r", "line__mod", y.alias("y")))


def one(name, f):
    query(name)(lambda spark, d: f(spark, d, features(spark, d)))


def stages(f):
    scored, tau = M.stage0_filter(f)
    return saved(M.stage1_oof(saved(scored), tau)), tau


one("features_stage", lambda s, d, f: f)
one("train_stage1", lambda s, d, f: M.train_stage1(f)[0].select("s1", "r", "y", "p1"))
one("stage0_filter", lambda s, d, f: M.stage0_filter(f)[0].select("s1", "r", "y", "p0"))
one("stage1_oof", lambda s, d, f: stages(f)[0].select("s1", "r", "y", "p0", "p1"))
one("stage2", lambda s, d, f: M.stage2(*stages(f)).select("s1", "r", "y", "p1", "p2"))
one("stage3_contested", lambda s, d, f: M.stage3_contested(f.withColumn("p2", F.col("line__p"))))
one("pseudo_label_training", lambda s, d, f: M.pseudo_label_training(f.where("s1 % 2 = 0"), f.where("s1 % 2 = 0").select("s1", "r", F.when(F.col("line__p") > 0.9, 1).when(F.col("line__p") < 0.05, 0).otherwise(-1).alias("y"))).select("s1", "r", "y", "p"))
one("predict_train_test", lambda s, d, f: M.predict_train_test(M.out_of_fold(f.where("s1 % 4 > 0")).drop("grp"), f, M.fit_trees(f.where("s1 % 4 > 0"))))
one("leave_one_country_out", lambda s, d, f: M.leave_one_country_out(f, country(s, d), "2-HIGH").select("s1", "r", "y", "p"))
one("stacked_logit_eval", lambda s, d, f: M.stacked_logits(f.withColumn("a", F.col("line__p") * 6 - 3).withColumn("b", F.col("line__mod").cast("double")), ["a", "b"]))
one("blend_weight_fit", lambda s, d, f: M.blend_weight_fit(f.withColumn("a", F.col("line__p") * 6 - 3).withColumn("b", F.col("line__mod").cast("double")), "a", "b"))
query("isotonic_crossfit")(lambda spark, d: M.crossfit(edges(spark, d).select("s1", "r", "p", "y")).select("s1", "r", "p", "p_cal"))
query("isotonic_apply")(lambda spark, d: (lambda e: M.apply_isotonic(M.fit_isotonic(e), e).select("s1", "r", "p", "p_cal"))(edges(spark, d).select("s1", "r", "p", "y")))
query("segment_calibration")(lambda spark, d: M.segment_calibration(owned(spark, d).select("s1", "r", "p", "y", "source"), "source").select("s1", "r", "source", "p_cal"))
query("stage3_mass_calibration")(lambda spark, d: M.mass_calibration(edges(spark, d), truth(spark, d)))
_W = "list_distinct(string_split({}, ' '))"
query("cross_encoder", f"""WITH t AS (SELECT p_partkey AS eid, p_name AS text FROM part), band AS (SELECT DISTINCT l_partkey AS s1, l_suppkey AS r FROM lineitem WHERE l_quantity > 10) SELECT s1, r, CAST(12 * len(list_intersect({_W.format('a.text')}, {_W.format('b.text')})) / len(list_distinct(list_concat({_W.format('a.text')}, {_W.format('b.text')}))) - 6 AS DOUBLE) AS z FROM band JOIN t a ON a.eid = s1 JOIN t b ON b.eid = r""")(
    lambda spark, d: M.cross_encoder(_read(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_partkey").alias("s1"), F.col("l_suppkey").alias("r")).distinct(), _read(spark, d, "part").select(F.col("p_partkey").alias("eid"), F.col("p_name").alias("text"))))
query("score_pairs", f"WITH t AS (SELECT p_partkey AS k, p_name AS n FROM part) SELECT a.k AS s1, b.k AS r, CAST(12 * len(list_intersect({_W.format('a.n')}, {_W.format('b.n')})) / len(list_distinct(list_concat({_W.format('a.n')}, {_W.format('b.n')}))) - 6 AS DOUBLE) AS z FROM t a JOIN t b ON b.k = a.k + 1")(
    lambda spark, d: (lambda t: M.score_pairs(t.join(t.select((F.col("s1") - 1).alias("s1"), F.col("s1").alias("r"), F.col("a").alias("b")), "s1")))(_read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("s1"), F.col("p_name").alias("a"))))
