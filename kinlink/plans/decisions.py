"""Queries of the further decisions, edits and evaluations on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import graph as G
from ..operators import keys as K
from .catalogue import _EDGES, _ENTITY, _F05, _MATCHES, _OWNED, _TOP, _UNIVERSE, GRID, _read, edges, matches, owned, scored, truth, universe
from .registry import query

P, E, O, M = "WITH " + _EDGES, edges, owned, matches
_RANK = f"WITH {_OWNED}, k AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, r) - 1 AS k FROM owned)"
_Z = "z AS (SELECT s1, r, p * 20 - 10 AS z FROM edges)"
_C = "country AS (SELECT o_orderkey AS s1, o_orderpriority AS country FROM orders)"


def scores(spark, d):
    return edges(spark, d).select("s1", "r", (F.col("p") * 20 - 10).alias("z"))


def country(spark, d):
    return universe(spark, d).withColumnRenamed("grp", "country")


def add(name, f, sql=None, source=edges):
    query(name, sql)(lambda spark, d: f(source(spark, d)))


# the candidate graph

add("count_by_threshold", D.count_by_threshold, _RANK + " SELECT s1, r, k AS rank, CAST(least(count(*) FILTER (p > 0.5) OVER (PARTITION BY s1), 4) AS INTEGER) AS above FROM k", O)
add("baseline_context", D.baseline_context, P + " SELECT s1, r, count(*) OVER a AS n_s1, count(*) OVER b AS n_r, round(max(p) OVER a - p, 6) AS gap_s1, round(max(p) OVER b - p, 6) AS gap_r FROM edges WINDOW a AS (PARTITION BY s1), b AS (PARTITION BY r)")
add("rival_counts", lambda o: G.rival_counts(o, "key"), "SELECT o_orderkey AS s1, round(ln(1 + CASE WHEN o_orderstatus = 'O' THEN 0 ELSE count(*) OVER (PARTITION BY key) - 1 END), 6) AS rivals FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS key FROM orders)",
    lambda spark, d: _read(spark, d, "orders").select(F.col("o_orderkey").alias("s1"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_custkey").cast("string")).alias("key")))


@query("record_rivalry", P + """, s AS (SELECT o_orderkey AS s1, CAST(o_custkey % 500 AS VARCHAR) AS key FROM orders), n AS (SELECT key, count(*) AS n FROM s GROUP BY key)
  SELECT e.s1, e.r, round(ln(1 + coalesce(n, 0)), 6) AS sharing, coalesce(s.key = CAST(e.r % 700 AS VARCHAR), false) AS same_key FROM edges e LEFT JOIN n ON n.key = CAST(e.r % 700 AS VARCHAR) LEFT JOIN s ON s.s1 = e.s1""")
def _rivalry(spark, d):
    from ..operators import rivalry

    names = _read(spark, d, "orders").select(F.col("o_orderkey").alias("s1"), (F.col("o_custkey") % 500).cast("string").alias("key"))
    return rivalry.record_rivalry(edges(spark, d), names, edges(spark, d).select("r", (F.col("r") % 700).cast("string").alias("key")).distinct())


_VIEWS = "views AS (SELECT s1, r, p AS score, CAST(1 + l % 7 AS BIGINT) AS views, source, CAST(row_number() OVER (PARTITION BY s1 ORDER BY p DESC, r) - 2 AS INTEGER) AS rank_s1, CAST(row_number() OVER (PARTITION BY r ORDER BY p DESC, s1) - 2 AS INTEGER) AS rank_r FROM (SELECT *, s1 + r AS l FROM edges))"


def views(spark, d):
    e = edges(spark, d)
    rank = lambda w: (F.row_number().over(w) - 2).cast("int")
    return e.select("s1", "r", F.col("p").alias("score"), (1 + (F.col("s1") + F.col("r")) % 7).alias("views"), "source", rank(G.s1_order()).alias("rank_s1"), rank(G.r_order()).alias("rank_r"))


add("ret_view_features", D.ret_view_features, P + f", {_VIEWS} SELECT s1, r, score, CASE WHEN rank_s1 < 0 THEN 99 ELSE rank_s1 END AS rank_s1, CASE WHEN rank_r < 0 THEN 99 ELSE rank_r END AS rank_r, bit_count(views) AS n_views, source = 3 AS is_s3 FROM views", views)


@query("recall_curve", P + f""", {_VIEWS}, t AS (SELECT s1, r FROM edges WHERE y = 1), g AS (SELECT a AS trim_s1, b AS trim_r FROM (SELECT unnest([0, 1, 2, 4]) AS a) CROSS JOIN (SELECT unnest([0, 1, 3]) AS b))
  SELECT trim_s1, trim_r, count(*) AS n, round(count(t.s1) / (SELECT count(*) FROM t), 6) AS recall FROM g JOIN views v ON (v.views & ~1) <> 0 OR (rank_s1 >= 0 AND rank_s1 < trim_s1) OR (rank_r >= 0 AND rank_r < trim_r) LEFT JOIN t ON t.s1 = v.s1 AND t.r = v.r GROUP BY trim_s1, trim_r""")
def _recall_curve(spark, d):
    return D.recall_curve(views(spark, d), truth(spark, d), 1, [(a, b) for a in (0, 1, 2, 4) for b in (0, 1, 3)])


_TOKEN = "w AS (SELECT DISTINCT p_partkey AS r, unnest(string_split(p_name, ' ')) AS token FROM part), df AS (SELECT token, ln(1 + (SELECT count(*) FROM part) / count(*)) AS w FROM w GROUP BY token), tw AS (SELECT r, token, w FROM w JOIN df USING (token))"


@query("cluster_support", P + f""", {_TOKEN}, size AS (SELECT r, sum(w) AS size FROM tw GROUP BY r), pairs AS (SELECT a.s1, a.r, b.r AS r2, b.p AS p2 FROM edges a JOIN edges b ON a.s1 = b.s1 AND a.r <> b.r WHERE b.p >= 0.5),
  j AS (SELECT s1, r, r2, p2, (SELECT coalesce(sum(x.w), 0) FROM tw x JOIN tw y USING (token) WHERE x.r = pairs.r AND y.r = pairs.r2) AS c FROM pairs), k AS (SELECT j.*, c / (a.size + b.size - c) AS j FROM j JOIN size a ON a.r = j.r JOIN size b ON b.r = j.r2)
  SELECT s1, r, round(max(j), 6) AS best, round(max(j * p2), 6) AS best_sure, count(*) AS others FROM k GROUP BY s1, r""")
def _support(spark, d):
    part = _read(spark, d, "part")
    w = part.select(F.col("p_partkey").alias("r"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("token"))
    n = part.count()
    weights = w.join(w.groupBy("token").agg(F.log(1 + n / F.count(F.lit(1))).alias("w")), "token")
    return D.cluster_support(edges(spark, d), weights)


query("label_pairs", P + " SELECT s1, r, p, y, source, y AS label FROM edges")(lambda spark, d: D.label_pairs(edges(spark, d), truth(spark, d)))
_P01 = "scored AS (SELECT *, p * p AS p0, p AS p1 FROM edges)"


def staged(spark, d):
    return edges(spark, d).withColumn("p0", F.col("p") * F.col("p")).withColumn("p1", F.col("p"))


add("band_filter", D.band_filter, P + f", {_P01} SELECT * FROM scored WHERE p0 >= 0.0005 AND p1 BETWEEN 0.02 AND 0.99", staged)
add("final_candidates", lambda e: D.final_candidates(e, 0.01), P + f", {_P01} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p DESC, s1) AS k FROM scored WHERE p0 >= 0.01 AND p >= 0.02) WHERE k <= 2", staged)

# decisions

add("top_rest", lambda o: D.top_rest(o, 0.5, 0.7), _RANK + " SELECT s1, r, p FROM k WHERE p > CASE WHEN k = 0 THEN 0.5 ELSE 0.7 END", O)
add("by_size", lambda o: D.by_size(o, (0.6, 0.55, 0.5, 0.45)), _RANK + ", n AS (SELECT *, count(*) FILTER (p > 0.5) OVER (PARTITION BY s1) AS n FROM k) SELECT s1, r, p FROM n WHERE p > CASE WHEN n <= 1 THEN 0.6 WHEN n = 2 THEN 0.55 WHEN n = 3 THEN 0.5 ELSE 0.45 END", O)
add("threshold_by_crowd", lambda e: D.threshold_by_crowd(e, 0.5, 0.6, 0.7, 0.4), _TOP + " SELECT s1, r, p FROM top WHERE k = 1 AND p > CASE WHEN size = 2 THEN 0.5 WHEN size = 3 THEN 0.6 WHEN size >= 4 THEN 0.7 ELSE 0.4 END")
add("threshold_by_rank", lambda o: D.threshold_by_rank(o, 0.5, 0.8, 0.6, 2), _RANK + " SELECT s1, r, p FROM k WHERE p > CASE WHEN k = 0 THEN 0.5 WHEN k >= 2 THEN 0.8 ELSE 0.6 END", O)
add("decision_table", D.decision_table, P + """, c AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p DESC, s1) AS k FROM edges WHERE p >= 0.02), t AS (SELECT * FROM c WHERE k <= 2)
  SELECT s1, r, p, k = 1 AS own, CASE WHEN k = 1 THEN coalesce(lead(p) OVER (PARTITION BY r ORDER BY k), 0.0) ELSE first_value(p) OVER (PARTITION BY r ORDER BY k) END AS rival FROM t""")
_SWEEP = f"""WITH {_OWNED}, {_UNIVERSE}, grid AS (@GRID@), nt AS (SELECT u.s1, count(t.r) AS n_true FROM universe u LEFT JOIN truth t USING (s1) GROUP BY u.s1),
  np AS (SELECT t, o.s1, count(*) AS n_pred, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n_hit FROM grid JOIN owned o ON p >= t GROUP BY t, o.s1), c AS (SELECT grid.t, nt.s1, n_true, coalesce(n_pred, 0) AS n_pred, coalesce(n_hit, 0) AS n_hit FROM grid CROSS JOIN nt LEFT JOIN np ON np.t = grid.t AND np.s1 = nt.s1),
  sweep AS (SELECT t, round(avg({_F05}), 6) AS macro_f05 FROM c GROUP BY t)"""


@query("best_threshold", _SWEEP.replace("@GRID@", f"SELECT CAST(unnest({GRID}) AS DOUBLE) AS t") + " SELECT * FROM sweep ORDER BY macro_f05 DESC, t LIMIT 1")
def _best(spark, d):
    return D.best_of_sweep(G.tune_threshold(universe(spark, d), truth(spark, d), owned(spark, d), GRID), "t", "macro_f05")


SHIFTS = [k / 4 for k in range(-6, 7)]


@query("tune_shift", _SWEEP.replace("@GRID@", f"SELECT 1 / (1 + exp(-(ln(0.675 / 0.325) - shift))) AS t FROM (SELECT CAST(unnest({SHIFTS}) AS DOUBLE) AS shift)") + f" SELECT g.shift, macro_f05 FROM sweep JOIN (SELECT CAST(unnest({SHIFTS}) AS DOUBLE) AS shift) g ON abs(t - 1 / (1 + exp(-(ln(0.675 / 0.325) - g.shift)))) < 1e-9")
def _shift(spark, d):
    return D.tune_shift(universe(spark, d), truth(spark, d), owned(spark, d), SHIFTS)


# edits

_CELLS = "cells AS (SELECT *, CASE s1 % 3 WHEN 0 THEN 'swap' WHEN 1 THEN 'add' ELSE 'same' END AS kind, CASE WHEN r % 2 = 0 THEN 'equal' ELSE 'nudge' END AS relation FROM edges)"


def cells(spark, d):
    return edges(spark, d).withColumn("kind", F.when(F.col("s1") % 3 == 0, "swap").when(F.col("s1") % 3 == 1, "add").otherwise("same")).withColumn("relation", F.when(F.col("r") % 2 == 0, "equal").otherwise("nudge"))


_CHOSEN = f", {_CELLS}, chosen AS (SELECT s1, r FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p DESC, s1) AS k FROM cells) WHERE k = 1 AND p >= 0.1 AND p < 0.6 AND (kind, relation) IN (('swap', 'equal'), ('add', 'nudge')))"
for _name, _add, _sql in (("rule_population_add", True, "SELECT s1, r FROM matches UNION SELECT s1, r FROM chosen"), ("rule_population_drop", False, "SELECT s1, r FROM matches EXCEPT SELECT s1, r FROM chosen")):
    @query(_name, f"WITH {_MATCHES}{_CHOSEN} {_sql}")
    def _population(spark, d, _add=_add):
        chosen = spark.createDataFrame([("swap", "equal"), ("add", "nudge")], "kind string, relation string")
        return D.rule_population(matches(spark, d), cells(spark, d), chosen, 0.1, 0.6, _add)

add("rule_cap_protected", lambda m: D.cap_protected(m.withColumn("added", F.col("r") % 5 == 0), 1, 1, 2), f"""WITH {_MATCHES}, a AS (SELECT *, CASE WHEN r % 5 = 0 THEN 2.0 ELSE p END AS q FROM matches), b AS (SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY q DESC, r) AS k FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY q DESC, r) AS j FROM b WHERE k <= 1)
  SELECT s1, r FROM c WHERE j <= 2""", M)


@query("compose_by_country", f"""WITH {_MATCHES}, {_C}, parts AS (SELECT country, m.s1, r FROM matches m JOIN country c USING (s1) WHERE country IN ('1-URGENT', '2-HIGH') UNION ALL SELECT country, e.s1, r FROM owned e JOIN country c USING (s1) WHERE country NOT IN ('1-URGENT', '2-HIGH') AND p >= 0.6),
  base AS (SELECT s1, r FROM parts WHERE (s1, r) NOT IN (SELECT (s1, r) FROM edges WHERE r % 7 = 0)), free AS (SELECT s1, r, row_number() OVER (PARTITION BY r ORDER BY s1) AS k FROM edges WHERE y = 1 AND p >= 0.02 AND r NOT IN (SELECT r FROM base))
  SELECT s1, r FROM base UNION ALL SELECT s1, r FROM free WHERE k = 1""")
def _compose(spark, d):
    c, first = country(spark, d), ["1-URGENT", "2-HIGH"]
    a = matches(spark, d).join(c, "s1").where(F.col("country").isin(first)).select("country", "s1", "r")
    b = owned(spark, d).where("p >= 0.6").join(c, "s1").where(~F.col("country").isin(first)).select("country", "s1", "r")
    return D.compose_by_country(a.unionByName(b), c, edges(spark, d).where("r % 7 = 0"), truth(spark, d), edges(spark, d).where("p >= 0.02"))


_VOTES = "votes AS (SELECT 1 AS voter, s1, r FROM edges WHERE p >= 0.5 UNION ALL SELECT 2, s1, r FROM edges WHERE y = 1 UNION ALL SELECT 3, s1, r FROM owned WHERE p >= 0.7)"


@query("consensus_bars", f"""WITH {_MATCHES}, {_VOTES}, n AS (SELECT s1, r, count(*) AS n FROM votes GROUP BY s1, r), kept AS (SELECT m.s1, m.r FROM matches m LEFT JOIN n USING (s1, r) WHERE coalesce(n, 0) > 1),
  more AS (SELECT s1, r, row_number() OVER (PARTITION BY r ORDER BY n DESC, s1) AS k FROM n WHERE n >= 2 AND (s1, r) NOT IN (SELECT (s1, r) FROM matches) AND r NOT IN (SELECT r FROM kept)) SELECT s1, r FROM kept UNION ALL SELECT s1, r FROM more WHERE k = 1""")
def _bars(spark, d):
    e = edges(spark, d)
    votes = [v.select(F.lit(k).alias("voter"), "s1", "r") for k, v in enumerate((e.where("p >= 0.5"), e.where("y = 1"), owned(spark, d).where("p >= 0.7")))]
    return D.consensus_bars(matches(spark, d), votes[0].unionByName(votes[1]).unionByName(votes[2]), 1, 2)


query("drop_ladder", f"WITH {_MATCHES}, {_Z}, b AS (SELECT CAST(unnest([-6, -4, -2, 0]) AS DOUBLE) AS bar) SELECT bar, CAST(count(*) FILTER (z >= bar) AS BIGINT) AS kept FROM b CROSS JOIN (SELECT z.z FROM matches JOIN z USING (s1, r)) GROUP BY bar")(
    lambda spark, d: D.drop_ladder(matches(spark, d), scores(spark, d), [-6, -4, -2, 0]))
_POLICY = f"""{_CELLS}, {_C}, fam AS (SELECT s1, r, kind AS family, CASE WHEN kind = 'swap' THEN 'drop' ELSE 'add' END AS action, CASE WHEN kind = 'same' THEN 1 ELSE y END AS y, country FROM cells JOIN country USING (s1)),
  each AS (SELECT family, action, country, count(*) AS n, avg(y) AS rate FROM fam GROUP BY family, action, country),
  w AS (SELECT *, (rate + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS c, 1.96 * sqrt(rate * (1 - rate) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS h FROM each),
  policy AS (SELECT family, action, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n >= 100 AND CASE WHEN action = 'drop' THEN c + h <= 0.02 ELSE c - h >= 0.98 END) = (SELECT count(DISTINCT country) FROM fam) AS enabled FROM w GROUP BY family, action)"""


def families(spark, d):
    return cells(spark, d).join(country(spark, d), "s1").select("s1", "r", F.col("kind").alias("family"), F.when(F.col("kind") == "swap", "drop").otherwise("add").alias("action"), F.when(F.col("kind") == "same", 1).otherwise(F.col("y")).alias("y"), "country")


query("fit_policy", P + f", {_POLICY} SELECT * FROM policy")(lambda spark, d: D.fit_policy(families(spark, d)))


@query("apply_policy", f"WITH {_MATCHES}, {_POLICY}, on_ AS (SELECT f.* FROM fam f JOIN policy USING (family, action) WHERE enabled) SELECT s1, r FROM matches WHERE (s1, r) NOT IN (SELECT (s1, r) FROM on_ WHERE action = 'drop') UNION SELECT f.s1, f.r FROM on_ f JOIN owned o ON o.s1 = f.s1 AND o.r = f.r WHERE f.action = 'add' AND o.p >= 0.02 AND f.r NOT IN (SELECT r FROM matches)")
def _apply(spark, d):
    f = families(spark, d)
    return D.apply_policy(matches(spark, d), f, D.fit_policy(f), edges(spark, d).where("p >= 0.02"), owned(spark, d))


@query("dp_country", f"""WITH {_MATCHES}, {_C}, own AS (SELECT s1 FROM country WHERE country = '3-MEDIUM'), before AS (SELECT s1, r FROM matches WHERE r % 3 <> 0), final AS (SELECT s1, r FROM matches WHERE r % 5 <> 0), chosen AS (SELECT s1, r FROM owned WHERE p >= 0.45),
  new AS (SELECT s1, r FROM chosen WHERE s1 IN (SELECT s1 FROM own) AND (s1, r) NOT IN (SELECT (s1, r) FROM (SELECT s1, r FROM before EXCEPT SELECT s1, r FROM final))),
  added AS (SELECT s1, r FROM (SELECT s1, r FROM final EXCEPT SELECT s1, r FROM before) WHERE s1 IN (SELECT s1 FROM own) AND r NOT IN (SELECT r FROM new))
  SELECT s1, r FROM final WHERE s1 NOT IN (SELECT s1 FROM own) UNION ALL SELECT s1, r FROM new UNION ALL SELECT s1, r FROM added""")
def _dp(spark, d):
    m = matches(spark, d)
    return D.dp_country(m.where("r % 5 != 0"), m.where("r % 3 != 0"), owned(spark, d).where("p >= 0.45"), country(spark, d), "3-MEDIUM")


@query("country_threshold", f"""WITH {_MATCHES}, {_C}, t AS (SELECT s1 FROM country WHERE country = '5-LOW'), final AS (SELECT s1, r FROM matches WHERE p >= 0.4) SELECT f.s1, f.r FROM final f JOIN owned o USING (s1, r) WHERE NOT (f.s1 IN (SELECT s1 FROM t) AND o.p < 0.5)
  UNION ALL SELECT s1, r FROM owned WHERE s1 IN (SELECT s1 FROM t) AND p > 0.35 AND r NOT IN (SELECT r FROM final)""")
def _country_threshold(spark, d):
    m = matches(spark, d).where("p >= 0.4")
    return D.country_threshold(m, m, owned(spark, d), country(spark, d).where("country = '5-LOW'"), 0.35, 0.5)


query("probe_country", f"WITH {_MATCHES}, {_C} SELECT s1, r FROM matches JOIN country USING (s1) WHERE country <> '2-HIGH' UNION ALL SELECT s1, r FROM owned JOIN country USING (s1) WHERE country = '2-HIGH' AND p >= 0.8")(
    lambda spark, d: D.probe_country(matches(spark, d), country(spark, d), "2-HIGH", owned(spark, d).where("p >= 0.8")))
query("probe_shift", f"WITH {_OWNED}, {_C} SELECT s1, r FROM owned JOIN country USING (s1) WHERE 1 / (1 + exp(-(ln(p / (1 - p)) + CASE WHEN country = '2-HIGH' THEN -0.7 ELSE 0 END))) > 0.5")(
    lambda spark, d: D.probe_shift(owned(spark, d), country(spark, d), "2-HIGH", -0.7, 0.5))
query("restore_and_drop", f"WITH {_MATCHES}, {_Z}, kept AS (SELECT s1, r FROM matches JOIN z USING (s1, r) WHERE z >= -2), free AS (SELECT s1, r, row_number() OVER (PARTITION BY r ORDER BY s1) AS k FROM edges WHERE y = 1 AND p >= 0.02 AND r NOT IN (SELECT r FROM kept)) SELECT s1, r FROM kept UNION ALL SELECT s1, r FROM free WHERE k = 1")(
    lambda spark, d: D.restore_and_drop(matches(spark, d), truth(spark, d), scores(spark, d).where("z < -2"), edges(spark, d).where("p >= 0.02")))
query("import_matches", f"WITH {_MATCHES} SELECT s1, r FROM matches")(lambda spark, d: D.import_matches(matches(spark, d), edges(spark, d)))
query("pseudo_labels", f"""WITH {_OWNED} SELECT s1, r, CASE WHEN p <= 0.05 OR r % 11 = 0 THEN 0 ELSE 1 END AS y FROM owned WHERE (p <= 0.05 OR r % 11 = 0 OR p >= 0.9 OR r % 13 = 0) AND s1 % 17 <> 0""")(
    lambda spark, d: D.pseudo_labels(owned(spark, d), owned(spark, d).where("r % 13 = 0"), owned(spark, d).where("r % 11 = 0"), owned(spark, d).where("s1 % 17 = 0")))
query("precision_of_rule", f"""WITH {_MATCHES}, rule AS (SELECT s1, r, y FROM edges WHERE p BETWEEN 0.2 AND 0.5) SELECT count(*) AS pairs, round(avg(y), 6) AS precision, count(*) FILTER (r NOT IN (SELECT r FROM matches)) AS new_pairs, round(avg(y) FILTER (r NOT IN (SELECT r FROM matches)), 6) AS new_precision FROM rule""")(
    lambda spark, d: D.precision_of_rule(edges(spark, d).where("p BETWEEN 0.2 AND 0.5"), truth(spark, d), matches(spark, d)))

# scores of several runs

_RUNS = "runs AS (SELECT 'a' AS run, 'x' AS family, s1, r, p, p * 20 - 10 AS z FROM edges UNION ALL SELECT 'b', 'x', s1, r, p * p, p * p * 8 FROM edges UNION ALL SELECT 'c', 'y', s1, r, p / 2, 3 - p FROM edges)"


def runs(spark, d):
    e = edges(spark, d).select("s1", "r", "p")
    part = lambda run, family, p, z: e.select(F.lit(run).alias("run"), F.lit(family).alias("family"), "s1", "r", p.alias("p"), z.alias("z"))
    p = F.col("p")
    return part("a", "x", p, p * 20 - 10).unionByName(part("b", "x", p * p, p * p * 8)).unionByName(part("c", "y", p / 2, 3 - p))


add("bag_scores", G.bag_scores, P + f", {_RUNS} SELECT s1, r, round(avg(p), 6) AS p, count(*) AS runs FROM runs GROUP BY s1, r", runs)
add("bag_logit_mean", D.bag_logit_mean, P + f", {_RUNS} SELECT s1, r, round(1 / (1 + exp(-avg(ln(p / (1 - p))))), 6) AS p FROM runs GROUP BY s1, r", runs)
add("zmean_logits", G.zmean_logits, P + f", {_RUNS}, s AS (SELECT run, avg(z) AS m, stddev_samp(z) AS sd FROM runs GROUP BY run) SELECT s1, r, round(avg((z - m) / sd), 6) + 0.0 AS z FROM runs JOIN s USING (run) GROUP BY s1, r", lambda s, d: runs(s, d))
add("family_blend", lambda t: D.family_blend(t, t.sparkSession.createDataFrame([("x", 0.7), ("y", 0.3)], "family string, w double")),
    P + f", {_RUNS}, s AS (SELECT run, avg(z) AS m, stddev_samp(z) AS sd FROM runs GROUP BY run), f AS (SELECT family, s1, r, avg((z - m) / sd) AS z FROM runs JOIN s USING (run) GROUP BY family, s1, r) SELECT s1, r, round(sum(z * CASE family WHEN 'x' THEN 0.7 ELSE 0.3 END), 6) AS z FROM f GROUP BY s1, r", runs)
query("import_logits", P + f", {_Z} SELECT e.*, z FROM edges e LEFT JOIN z USING (s1, r)")(lambda spark, d: D.import_logits(edges(spark, d), scores(spark, d)))
query("remap_logits", P + f", {_Z} SELECT s1, r, z FROM edges JOIN z USING (s1, r) WHERE p BETWEEN 0.02 AND 0.99")(
    lambda spark, d: D.import_logits(edges(spark, d).where("p BETWEEN 0.02 AND 0.99").select("s1", "r"), scores(spark, d)))
query("encoder_disagreement", f"WITH {_MATCHES}, {_Z}, {_C}, k AS (SELECT country, CASE WHEN z < 0 THEN 1 ELSE 0 END AS bad FROM matches JOIN z USING (s1, r) JOIN country USING (s1)) SELECT country, count(*) AS n, round(avg(bad), 6) AS rate, round(avg(bad) - (SELECT avg(bad) FROM k WHERE country IN ('1-URGENT', '2-HIGH')), 6) AS excess FROM k GROUP BY country")(
    lambda spark, d: D.encoder_disagreement(matches(spark, d), scores(spark, d), country(spark, d), ["1-URGENT", "2-HIGH"]))
query("logit_diagnostics", P + f", {_Z}, {_C} SELECT country, count(*) AS n, round(1 - count(DISTINCT z) / count(*), 6) AS ties, round(quantile_cont(z, 0.5), 6) AS median, round(avg(CASE WHEN z > 0 THEN 1 ELSE 0 END), 6) AS positive, round(avg(CASE WHEN abs(z) > 10 THEN 1 ELSE 0 END), 6) AS far FROM z JOIN country USING (s1) GROUP BY country")(
    lambda spark, d: D.logit_diagnostics(scores(spark, d), country(spark, d)))

# evaluation

_TWO = f"{_ENTITY}, nb AS (SELECT u.s1, grp, (SELECT count(*) FROM truth t WHERE t.s1 = u.s1) AS n_true, (SELECT count(*) FROM owned m WHERE m.s1 = u.s1 AND p >= 0.6) AS n_pred, (SELECT count(*) FROM owned m WHERE m.s1 = u.s1 AND p >= 0.6 AND y = 1) AS n_hit FROM universe u), two AS (SELECT s.s1, s.grp, s.f05 AS a, round({_F05.replace('n_true', 'nb.n_true').replace('n_pred', 'nb.n_pred').replace('n_hit', 'nb.n_hit')}, 6) AS b FROM scored s JOIN nb USING (s1))"


def both(spark, d):
    return universe(spark, d), truth(spark, d), matches(spark, d), owned(spark, d).where("p >= 0.6")


query("oracle_f05", f"WITH {_EDGES}, {_UNIVERSE}, c AS (SELECT u.s1, (SELECT count(*) FROM truth t WHERE t.s1 = u.s1) AS n_true, (SELECT count(*) FROM edges e WHERE e.s1 = u.s1 AND y = 1 AND p >= 0.3) AS n_pred FROM universe u) SELECT round(avg(round(CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 ELSE 1.25 * n_pred / (0.25 * n_true + n_pred) END, 6)), 6) AS oracle_f05 FROM c")(
    lambda spark, d: D.oracle_f05(universe(spark, d), truth(spark, d), edges(spark, d).where("p >= 0.3")))
query("gate_deltas", f"WITH {_TWO} SELECT '(all)' AS grp, count(*) AS n, round(avg(b - a), 6) AS delta FROM two UNION ALL SELECT grp, count(*), round(avg(b - a), 6) FROM two GROUP BY grp")(lambda spark, d: D.gate_deltas(*both(spark, d)))
query("paired_bootstrap")(lambda spark, d: D.paired_bootstrap(D.two_sets(*both(spark, d))))
query("paired_bootstrap_index")(lambda spark, d: D.paired_bootstrap(D.two_sets(*both(spark, d)), poisson=False))
query("compare_gate")(lambda spark, d: D.compare_gate(*both(spark, d)))
query("blocking_report", P + f""", {_C}, {_UNIVERSE}, h AS (SELECT t.s1, t.r, country, CAST(2 + t.r % 2 AS VARCHAR) AS source, CASE WHEN e.s1 IS NULL THEN 0 ELSE 1 END AS f FROM truth t LEFT JOIN edges e ON e.s1 = t.s1 AND e.r = t.r AND e.p >= 0.3 LEFT JOIN country c ON c.s1 = t.s1),
  n AS (SELECT u.s1, count(e.r) AS n FROM universe u LEFT JOIN edges e ON e.s1 = u.s1 AND e.p >= 0.3 GROUP BY u.s1)
  SELECT 'recall' AS what, '' AS name, round(avg(f), 6) AS value FROM h UNION ALL SELECT 'country', country, round(avg(f), 6) FROM h GROUP BY country UNION ALL SELECT 'source', source, round(avg(f), 6) FROM h GROUP BY source
  UNION ALL SELECT 'mean', '', round(avg(n), 6) FROM n UNION ALL SELECT 'p99', '', floor(quantile_cont(n, 0.99)) FROM n""")(
    lambda spark, d: D.blocking_report(universe(spark, d), truth(spark, d), edges(spark, d).where("p >= 0.3"), country(spark, d), 2 + F.col("r") % 2))
query("decision_diagnostics", f"""WITH {_ENTITY}, o AS (SELECT s1, count(*) FILTER (p > 0.5) AS a, count(*) FILTER (p > 0.9) AS b, sum(p) AS c FROM owned GROUP BY s1) SELECT grp, count(*) AS entities, round(avg(n_pred), 4) AS pred, round(avg(CASE WHEN n_pred = 0 THEN 1 ELSE 0 END), 4) AS empty_share,
  round(avg(coalesce(a, 0)), 4) AS owned_p50, round(avg(coalesce(b, 0)), 4) AS owned_p90, round(avg(coalesce(c, 0)), 4) AS owned_mass FROM scored LEFT JOIN o USING (s1) GROUP BY grp""")(lambda spark, d: D.decision_diagnostics(universe(spark, d), owned(spark, d), matches(spark, d)))
_LOSS = f"""{_ENTITY}, t AS (SELECT s1, r FROM edges WHERE y = 1), wrong AS (SELECT s1, CASE WHEN r IN (SELECT r FROM t) THEN 'fp_elsewhere' ELSE 'fp_orphan' END AS bucket FROM matches WHERE y = 0
  UNION ALL SELECT s1, CASE WHEN p < 0.1 THEN 'fn_no_candidate' WHEN (s1, r) NOT IN (SELECT (s1, r) FROM owned) THEN 'fn_lost' ELSE 'fn_below' END FROM edges WHERE y = 1 AND (s1, r) NOT IN (SELECT (s1, r) FROM matches)), w AS (SELECT s1, bucket, count(*) AS n FROM wrong GROUP BY s1, bucket),
  f AS (SELECT bucket, n, f05, CASE WHEN bucket LIKE 'fp%' THEN CASE WHEN n_true = 0 AND n_pred - n = 0 THEN 1.0 ELSE 1.25 * n_hit / (0.25 * n_true + n_pred - n) END ELSE 1.25 * (n_hit + n) / (0.25 * n_true + n_pred + n) END AS fixed FROM w JOIN scored USING (s1))"""
query("loss_with_gain", f"WITH {_LOSS} SELECT bucket, CAST(sum(n) AS BIGINT) AS n, round(sum(fixed - f05) / (SELECT count(*) FROM universe), 6) AS gain FROM f GROUP BY bucket")(
    lambda spark, d: D.loss_with_gain(universe(spark, d), truth(spark, d), edges(spark, d).where("p >= 0.1"), owned(spark, d), matches(spark, d)))
query("reweight_to_mix", f"WITH {_ENTITY}, m AS (SELECT grp, avg(f05) AS f05, count(*) AS n FROM scored GROUP BY grp), x AS (SELECT o_orderpriority AS grp, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT grp, x.n AS n_there, coalesce(m.n, 0) AS n_here, round(f05, 6) AS mean, round(f05 * x.n / (SELECT sum(n) FROM x), 6) AS part FROM x LEFT JOIN m USING (grp)")(
    lambda spark, d: D.reweight_to_mix(scored(spark, d), universe(spark, d), universe(spark, d).where("s1 % 3 = 0")))
query("rank_auc_plain", P + ", k AS (SELECT y, row_number() OVER (ORDER BY p, s1, r) AS rank FROM edges) SELECT round((sum(rank * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM k")(lambda spark, d: D.rank_auc_plain(edges(spark, d)))
_CUTS = [(0.02, 1), (0.02, 2), (0.1, 2), (0.3, 3)]
query("cut_size_curve", P + f", k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p DESC, s1) AS k FROM edges), c AS (SELECT * FROM (VALUES {', '.join(f'({a}, {k}, {chr(39)}{a:g}/{k}{chr(39)})' for a, k in _CUTS)}) v(a, n, cut)) SELECT cut, round(count(*) / (SELECT count(*) FROM orders), 6) AS per_entity, round(sum(y) / (SELECT sum(y) FROM edges), 6) AS recall FROM c JOIN k ON p >= a AND k.k <= n GROUP BY cut")(
    lambda spark, d: D.cut_size_curve(edges(spark, d), truth(spark, d), universe(spark, d), _CUTS))
_BANDS = [0.3, 0.5, 0.7, 0.9]
_BAND = "CAST((CASE WHEN p >= 0.3 THEN 1 ELSE 0 END) + (CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN p >= 0.7 THEN 1 ELSE 0 END) + (CASE WHEN p >= 0.9 THEN 1 ELSE 0 END) AS INTEGER)"
add("context_calibration", lambda o: D.context_calibration(o, "source", _BANDS), f"WITH {_OWNED} SELECT source AS context, {_BAND} AS band, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM owned GROUP BY 1, 2", O)
query("repeated_halving_cv")(lambda spark, d: D.halving_cv(universe(spark, d), truth(spark, d), owned(spark, d), GRID[::5], list(range(20))))
query("record_mass_stats", P + ", m AS (SELECT r, sum(p) AS m FROM edges GROUP BY r) SELECT round(1000 * sum(CASE WHEN m > 1.05 THEN 1 ELSE 0 END) / (SELECT count(*) FROM orders), 6) AS heavy, round(1000 * sum(greatest(m - 1, 0)) / (SELECT count(*) FROM orders), 6) AS excess FROM m")(
    lambda spark, d: D.record_mass_stats(edges(spark, d), universe(spark, d)))
query("copy_count_posterior")(lambda spark, d: D.copy_count_posterior(edges(spark, d), matches(spark, d)))
query("rescore_gain", f"WITH {_TWO.replace('m.s1 = u.s1 AND p >= 0.6', 'm.s1 = u.s1 AND p >= 0.4')} SELECT s1 % 2 AS half, count(*) AS n, round(avg(b - a), 6) AS delta FROM two GROUP BY 1")(
    lambda spark, d: D.rescore_gain(universe(spark, d), truth(spark, d), matches(spark, d), scores(spark, d), -2.0))
add("leak_by_group", lambda z: D.leak_by_group(z, F.col("s1") % 3, -6.0), P + f", {_Z} SELECT s1 % 3 AS grp, count(*) AS n, round(avg(CASE WHEN z < -6 THEN 1 ELSE 0 END), 6) AS drop_rate, round(avg(CASE WHEN z < 0 THEN 1 ELSE 0 END), 6) AS negative, round(quantile_cont(z, 0.5), 6) AS median FROM z GROUP BY 1", scores)
add("density_crosstab", lambda e: D.density_crosstab(e, _BANDS), P + f", k AS (SELECT least(count(*) OVER (PARTITION BY r), 4) AS crowd, {_BAND} AS b FROM edges) SELECT crowd, " + ", ".join(f"count(*) FILTER (b = {k}) AS band_{k}" for k in range(5)) + " FROM k GROUP BY crowd")
query("pair_stats", P + ", n AS (SELECT s1, count(*) FILTER (r % 2 = 0) AS two, count(*) FILTER (r % 2 = 1) AS three FROM edges WHERE y = 1 GROUP BY s1) SELECT coalesce(two, 0) AS two, coalesce(three, 0) AS three, count(*) AS entities FROM orders LEFT JOIN n ON n.s1 = o_orderkey GROUP BY 1, 2")(
    lambda spark, d: D.pair_stats(truth(spark, d), universe(spark, d), 2 + F.col("r") % 2))
query("sample_pool")(lambda spark, d: D.sample_pool(edges(spark, d), truth(spark, d), 4, 99))
query("dev_export")(lambda spark, d: D.label_pairs(edges(spark, d), truth(spark, d)).where(K.dev_sample(F.col("s1") + 1_000_000_000)))
query("resample_gap")(lambda spark, d: D.resample_gap(universe(spark, d), truth(spark, d), matches(spark, d), universe(spark, d).groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("weight"))))
query("calibration_error", P + ", b AS (SELECT least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS m, avg(y) AS q FROM edges GROUP BY 1) SELECT round(sum(n * abs(m - q)) / sum(n), 6) AS ece FROM b")(
    lambda spark, d: G.reliability_table(edges(spark, d), digits=12).agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n"), 6).alias("ece")))
query("score_algebra", f"WITH {_ENTITY}, s AS (SELECT avg(f05) AS total, avg(CASE WHEN grp = '1-URGENT' THEN 1 ELSE 0 END) AS share, avg(f05) FILTER (grp <> '1-URGENT') AS rest FROM scored) SELECT round((total - (1 - share) * rest) / share, 4) AS f05 FROM s")(
    lambda spark, d: scored(spark, d).join(universe(spark, d), "s1").agg(F.avg("f05").alias("t"), F.avg((F.col("grp") == "1-URGENT").cast("int")).alias("w"), F.avg(F.when(F.col("grp") != "1-URGENT", F.col("f05"))).alias("q")).select(F.round(D.score_algebra(F.col("t"), F.col("w"), F.col("q")), 4).alias("f05")))
query("diff_rates", f"WITH {_MATCHES}, {_C}, b AS (SELECT s1, r FROM edges WHERE y = 1), x AS (SELECT s1, r, -1 AS d FROM matches UNION ALL SELECT s1, r, 1 FROM b), n AS (SELECT s1, r, sum(d) AS d, count(*) AS c FROM x GROUP BY s1, r) SELECT country, round(1000 * count(*) FILTER (c = 1 AND d = 1) / any_value(k), 6) AS added, round(1000 * count(*) FILTER (c = 1 AND d = -1) / any_value(k), 6) AS removed FROM n JOIN country USING (s1) JOIN (SELECT country, count(*) AS k FROM country GROUP BY country) USING (country) GROUP BY country")(
    lambda spark, d: G.diff_matches(matches(spark, d), truth(spark, d)).join(country(spark, d), "s1").groupBy("country").agg(F.sum((F.col("change") == "added").cast("int")).alias("a"), F.sum((F.col("change") == "removed").cast("int")).alias("b"))
    .join(country(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("k")), "country").select("country", F.round(1000 * F.col("a") / F.col("k"), 6).alias("added"), F.round(1000 * F.col("b") / F.col("k"), 6).alias("removed")))
