"""Further decisions, edits and evaluation over the candidate graph: edges (s1, r, p) with source, y; matches (s1, r).

Everything is a join, a window or a grouped aggregate; only resampling draws numbers, by hash, inside the plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph as G
from . import keys as K
from .tables import saved

PAIR = ["s1", "r"]


def logit(p: Column, eps: float = 1e-7) -> Column:
    x = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(x / (1 - x))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


# the candidate graph

def count_by_threshold(owned: DataFrame, least: float = 0.5, most: int = 4) -> DataFrame:
    """Rank of each owned pair in its entity and how many of the entity's pairs lie above ``least`` (``most`` at the most)."""
    n = F.sum((F.col("p") > least).cast("int")).over(W.partitionBy("s1"))
    return G.own_rank(owned).select("s1", "r", F.col("k").alias("rank"), F.least(n, F.lit(most)).cast("int").alias("above"))


def baseline_context(edges: DataFrame) -> DataFrame:
    """Group sizes and distances to the group's best, from both sides."""
    a, b = W.partitionBy("s1"), W.partitionBy("r")
    return edges.select("s1", "r", F.count(F.lit(1)).over(a).alias("n_s1"), F.count(F.lit(1)).over(b).alias("n_r"), F.round(F.max("p").over(a) - F.col("p"), 6).alias("gap_s1"), F.round(F.max("p").over(b) - F.col("p"), 6).alias("gap_r"))


def ret_view_features(candidates: DataFrame) -> DataFrame:
    """Ranks with 99 where a direction did not find the pair, how many views found it, and whether the record is of source 3."""
    rank = lambda c: F.when(F.col(c) < 0, 99).otherwise(F.col(c)).cast("int").alias(c)
    return candidates.select("s1", "r", "score", rank("rank_s1"), rank("rank_r"), F.bit_count("views").alias("n_views"), (F.col("source") == 3).alias("is_s3"))


def cluster_support(edges: DataFrame, weights: DataFrame, sure: float = 0.5) -> DataFrame:
    """How like a record is to the entity's other sure records: best weighted Jaccard, best p times it, how many.

    ``weights``: r, token, w (one row per distinct token). Only tokens that two records of one entity share are joined.
    """
    other = edges.where(F.col("p") >= sure).select("s1", F.col("r").alias("r2"), F.col("p").alias("p2"))
    pairs = edges.select("s1", "r").join(other, "s1").where("r != r2")
    size = weights.groupBy("r").agg(F.sum("w").alias("size"))
    mine, theirs = weights, weights.select(F.col("r").alias("r2"), "token")
    common = pairs.join(mine, "r").join(theirs, ["r2", "token"]).groupBy("s1", "r", "r2").agg(F.sum("w").alias("common"))
    both = pairs.join(common, ["s1", "r", "r2"], "left").na.fill(0.0, ["common"]).join(size, "r").join(size.select(F.col("r").alias("r2"), F.col("size").alias("size2")), "r2")
    like = F.col("common") / (F.col("size") + F.col("size2") - F.col("common"))
    return both.withColumn("j", like).groupBy("s1", "r").agg(F.round(F.max("j"), 6).alias("best"), F.round(F.max(F.col("j") * F.col("p2")), 6).alias("best_sure"), F.count(F.lit(1)).alias("others"))


def label_pairs(edges: DataFrame, truth: DataFrame) -> DataFrame:
    return edges.join(truth.select(*PAIR, F.lit(1).alias("t")).distinct(), PAIR, "left").withColumn("label", F.coalesce("t", F.lit(0))).drop("t")


def band_filter(edges: DataFrame, tau0: float = 0.0005, low: float = 0.02, high: float = 0.99) -> DataFrame:
    """Pairs worth a slow scorer: kept by the first stage, neither sure nor hopeless in the second."""
    return edges.where((F.col("p0") >= tau0) & F.col("p1").between(low, high))


def final_candidates(edges: DataFrame, tau0: float, least: float = 0.02, top: int = 2) -> DataFrame:
    return G.candidate_cut(edges.where(F.col("p0") >= tau0), least, top)


# decisions

def top_rest(owned: DataFrame, first: float, rest: float) -> DataFrame:
    """One bar for an entity's best pair, one for the others, each on its own."""
    return G.own_rank(owned).where(F.col("p") > F.when(F.col("k") == 0, first).otherwise(rest)).select("s1", "r", "p")


def by_size(owned: DataFrame, bars: tuple[float, float, float, float]) -> DataFrame:
    """A bar by how many of the entity's pairs lie above one half: up to one, two, three, more."""
    n = F.col("above")
    rows = owned.join(count_by_threshold(owned), PAIR)
    return rows.where(F.col("p") > F.when(n <= 1, bars[0]).when(n == 2, bars[1]).when(n == 3, bars[2]).otherwise(bars[3])).select("s1", "r", "p")


def threshold_by_crowd(edges: DataFrame, two: float, three: float, four: float, alone: float) -> DataFrame:
    """Owned pairs above a bar by how many entities claim the record."""
    n = F.count(F.lit(1)).over(W.partitionBy("r"))
    rows = edges.withColumn("_n", n).withColumn("_k", F.row_number().over(G.r_order())).where("_k = 1")
    return rows.where(F.col("p") > F.when(F.col("_n") == 2, two).when(F.col("_n") == 3, three).when(F.col("_n") >= 4, four).otherwise(alone)).select("s1", "r", "p")


def threshold_by_rank(owned: DataFrame, first: float, late: float, rest: float, late_from: int = 5) -> DataFrame:
    return G.own_rank(owned).where(F.col("p") > F.when(F.col("k") == 0, first).when(F.col("k") >= late_from, late).otherwise(rest)).select("s1", "r", "p")


def best_of_sweep(sweep: DataFrame, key: str, value: str) -> DataFrame:
    """The first setting with the largest value."""
    return sweep.orderBy(F.desc(value), key).limit(1)


def tune_shift(universe: DataFrame, truth: DataFrame, owned: DataFrame, shifts: list[float], bar: float = 0.675) -> DataFrame:
    """Macro F0.5 of owned pairs above the bar after each shift of the logit; a shift is a bar on p, so one sweep does all."""
    import math

    z = math.log(bar / (1 - bar))
    bars = {s: 1 / (1 + math.exp(-(z - s))) for s in shifts}
    sweep = G.tune_threshold(universe, truth, owned, sorted(bars.values()))
    names = sweep.sparkSession.createDataFrame([(float(s), float(b)) for s, b in bars.items()], "shift double, t double")
    return sweep.join(names, "t").select("shift", "macro_f05")


def decision_table(edges: DataFrame, least: float = 0.02, top: int = 2) -> DataFrame:
    """p after the cut, whether the entity owns the record, and the best p of the record's other entities."""
    cut = G.candidate_cut(edges, least, top).select(*PAIR, F.lit(True).alias("_cut"))
    rows = edges.join(cut, PAIR).withColumn("_k", F.row_number().over(G.r_order()))
    best, second = F.max("p").over(W.partitionBy("r")), F.max(F.when(F.col("_k") == 2, F.col("p"))).over(W.partitionBy("r"))
    return rows.select("s1", "r", "p", (F.col("_k") == 1).alias("own"), F.when(F.col("_k") == 1, F.coalesce(second, F.lit(0.0))).otherwise(best).alias("rival"))


# edits

def rule_population(matches: DataFrame, edges: DataFrame, cells: DataFrame, low: float, high: float, add: bool) -> DataFrame:
    """Owned pairs of the given (kind, relation) cells with p in [low, high) added or dropped. ``edges`` has kind and relation."""
    chosen = G.argmax_owner(edges).where((F.col("p") >= low) & (F.col("p") < high)).join(cells, ["kind", "relation"], "left_semi").select(*PAIR)
    return matches.select(*PAIR).union(chosen).distinct() if add else matches.select(*PAIR).join(chosen, PAIR, "left_anti")


def cap_protected(matches: DataFrame, two: int = 5, three: int = 6, total: int = 11) -> DataFrame:
    """``rule_cap`` with pairs that rules added (``added``) ranked before all others, as if their p were 2."""
    rank = [F.desc(F.when(F.col("added"), F.lit(2.0)).otherwise(F.col("p"))), "r"]
    kept = matches.withColumn("_k", F.row_number().over(W.partitionBy("s1", "source").orderBy(*rank))).where(F.col("_k") <= F.when(F.col("source") == 2, two).otherwise(three))
    return kept.withColumn("_k", F.row_number().over(W.partitionBy("s1").orderBy(*rank))).where(F.col("_k") <= total).select(*PAIR)


def compose_by_country(parts: DataFrame, country: DataFrame, drops: DataFrame, adds: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each country's pairs from its own table (``parts``: country, s1, r), less ``drops``, plus ``adds`` that are candidates of records without an owner (lower s1 first)."""
    base = parts.join(country, ["s1", "country"], "left_semi").select(*PAIR).join(drops.select(*PAIR), PAIR, "left_anti")
    free = adds.select(*PAIR).distinct().join(candidates.select(*PAIR), PAIR, "left_semi").join(base.select("r").distinct(), "r", "left_anti")
    one = free.withColumn("_k", F.row_number().over(W.partitionBy("r").orderBy("s1"))).where("_k = 1").select(*PAIR)
    return base.unionByName(one)


def consensus_bars(base: DataFrame, votes: DataFrame, drop_max: int, add_min: int) -> DataFrame:
    """The base without pairs that at most ``drop_max`` voters have, with pairs that ``add_min`` have and whose record nobody owns."""
    n = votes.distinct().groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    kept = base.select(*PAIR).distinct().join(n, PAIR, "left").where(F.coalesce("n", F.lit(0)) > drop_max).select(*PAIR)
    more = n.where(F.col("n") >= add_min).join(base.select(*PAIR), PAIR, "left_anti").join(kept.select("r"), "r", "left_anti")
    one = more.withColumn("_k", F.row_number().over(W.partitionBy("r").orderBy(F.desc("n"), "s1"))).where("_k = 1").select(*PAIR)
    return kept.unionByName(one)


def drop_ladder(matches: DataFrame, scores: DataFrame, bars: list[float]) -> DataFrame:
    """How many pairs stay at each step of nested score bars."""
    z = matches.select(*PAIR).join(scores.select(*PAIR, "z"), PAIR, "left")
    steps = [F.struct(F.lit(float(b)).alias("bar"), (F.coalesce(F.col("z"), F.lit(1e9)) >= b).cast("long").alias("kept")) for b in bars]
    return z.select(F.explode(F.array(*steps)).alias("s")).groupBy("s.bar").agg(F.sum("s.kept").alias("kept"))


def wilson(n: Column, rate: Column, z: float = 1.96) -> tuple[Column, Column]:
    center = (rate + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return center - half, center + half


def fit_policy(pairs: DataFrame, least: int = 100, floor: float = 0.98) -> DataFrame:
    """Per family (``pairs``: country, family, action, y): whether every country supports it by its Wilson bound."""
    each = pairs.groupBy("family", "action", "country").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    low, high = wilson(F.col("n"), F.col("rate"))
    passes = (F.col("n") >= least) & F.when(F.col("action") == "drop", high <= 1 - floor).otherwise(low >= floor)
    every = pairs.select("country").distinct().agg(F.count(F.lit(1)).alias("countries"))
    out = each.withColumn("passes", passes).groupBy("family", "action").agg(F.sum("n").alias("n"), F.sum(F.col("passes").cast("int")).alias("passed"))
    return out.join(F.broadcast(every)).select("family", "action", "n", (F.col("passed") == F.col("countries")).alias("enabled"))


def apply_policy(base: DataFrame, pairs: DataFrame, policy: DataFrame, candidates: DataFrame, owned: DataFrame) -> DataFrame:
    """Enabled families applied: drops of base pairs, adds of owned candidates of free records."""
    on = pairs.join(policy.where("enabled").select("family", "action"), ["family", "action"], "left_semi")
    kept = base.select(*PAIR).join(on.where("action = 'drop'").select(*PAIR), PAIR, "left_anti")
    adds = on.where("action = 'add'").select(*PAIR).distinct()
    for table in (candidates, owned):
        adds = adds.join(table.select(*PAIR), PAIR, "left_semi")
    return kept.unionByName(adds.join(base.select("r").distinct(), "r", "left_anti").select(*PAIR)).distinct()


def dp_country(final: DataFrame, before: DataFrame, chosen: DataFrame, country: DataFrame, name: str) -> DataFrame:
    """For one country the model's pairs replaced by ``chosen`` while the rule layer (final less before, before less final) stays."""
    own = country.where(F.col("country") == name).select("s1")
    inside = lambda t: t.select(*PAIR).join(own, "s1", "left_semi").select(*PAIR)
    added, dropped = inside(final).subtract(inside(before)), inside(before).subtract(inside(final))
    new = inside(chosen).subtract(dropped)
    new = new.unionByName(added.join(new.select("r"), "r", "left_anti").select(*PAIR))
    return final.select(*PAIR).join(own, "s1", "left_anti").select(*PAIR).unionByName(new)


def country_threshold(final: DataFrame, model: DataFrame, owned: DataFrame, target: DataFrame, low: float, high: float) -> DataFrame:
    """For target entities: model pairs under ``high`` go, and owned pairs above ``low`` come where the model had none of them."""
    p = owned.select(*PAIR, "p").join(target.select("s1"), "s1", "left_semi")
    weak = final.select(*PAIR).join(model.select(*PAIR), PAIR, "left_semi").join(target.select("s1"), "s1", "left_semi").join(p, PAIR, "left").where(F.coalesce("p", F.lit(0.0)) < high).select(*PAIR)
    more = p.where(F.col("p") > low).select(*PAIR).join(final.select("r"), "r", "left_anti").select(*PAIR)
    return final.select(*PAIR).join(weak, PAIR, "left_anti").unionByName(more)


def probe_country(base: DataFrame, country: DataFrame, name: str, other: DataFrame | None = None) -> DataFrame:
    """One country's pairs blanked, or replaced by another table's."""
    own = country.where(F.col("country") == name).select("s1")
    rest = base.select(*PAIR).join(own, "s1", "left_anti").select(*PAIR)
    return rest if other is None else rest.unionByName(other.select(*PAIR).join(own, "s1", "left_semi").select(*PAIR))


def probe_shift(owned: DataFrame, country: DataFrame, name: str, shift: float, bar: float) -> DataFrame:
    """Owned pairs above the bar, after a logit shift for one country."""
    own = country.where(F.col("country") == name).select("s1", F.lit(shift).alias("_b"))
    return owned.join(own, "s1", "left").where(sigmoid(logit(F.col("p")) + F.coalesce("_b", F.lit(0.0))) > bar).select(*PAIR)


def restore_and_drop(base: DataFrame, restore: DataFrame, drop: DataFrame, candidates: DataFrame) -> DataFrame:
    """Without ``drop``; with pairs of ``restore`` that are candidates and whose record is then free (lower s1 first)."""
    kept = base.select(*PAIR).join(drop.select(*PAIR), PAIR, "left_anti")
    free = restore.select(*PAIR).distinct().join(candidates.select(*PAIR), PAIR, "left_semi").join(kept.select("r"), "r", "left_anti")
    return kept.unionByName(free.withColumn("_k", F.row_number().over(W.partitionBy("r").orderBy("s1"))).where("_k = 1").select(*PAIR))


def import_matches(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct pairs; a record with two owners or a pair that is no candidate is an error when the table is read."""
    m = matches.select(*PAIR).distinct().join(candidates.select(*PAIR, F.lit(True).alias("_in")).distinct(), PAIR, "left").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("r")))
    bad = F.when(F.col("_n") > 1, F.raise_error(F.lit("a record is predicted for two entities"))).when(F.col("_in").isNull(), F.raise_error(F.lit("a match is outside the candidates")))
    return m.withColumn("_bad", bad.cast("string")).where("_bad IS NULL").select(*PAIR)


def pseudo_labels(owned: DataFrame, adds: DataFrame, drops: DataFrame, guarded: DataFrame, sure: float = 0.9, unlikely: float = 0.05) -> DataFrame:
    """Labels of unlabelled pairs from decisions: 1 sure or added, 0 unlikely or dropped (0 wins), none where a guard holds or between."""
    rows = owned.select(*PAIR, "p").join(adds.select(*PAIR, F.lit(1).alias("_a")).distinct(), PAIR, "left").join(drops.select(*PAIR, F.lit(1).alias("_d")).distinct(), PAIR, "left")
    y = F.when((F.col("p") <= unlikely) | F.col("_d").isNotNull(), 0).when((F.col("p") >= sure) | F.col("_a").isNotNull(), 1)
    return rows.withColumn("y", y).where("y IS NOT NULL").join(guarded.select(*PAIR), PAIR, "left_anti").select(*PAIR, "y")


# scores of several runs

def bag_logit_mean(tables: DataFrame) -> DataFrame:
    """Mean logit of each pair over runs as a probability; 0 where no run is above 0."""
    z = F.avg(logit(F.col("p")))
    return tables.groupBy(*PAIR).agg(F.when(F.max("p") > 0, F.round(sigmoid(z), 6)).otherwise(F.lit(0.0)).alias("p"))


def family_blend(tables: DataFrame, weights: DataFrame) -> DataFrame:
    """Logits (run, family, s1, r, z) standardised per run, averaged per family, then summed by the family's weight."""
    stats = tables.groupBy("run").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("sd"))
    mean = tables.join(F.broadcast(stats), "run").groupBy("family", *PAIR).agg(F.avg((F.col("z") - F.col("m")) / F.col("sd")).alias("z"))
    return mean.join(F.broadcast(weights), "family").groupBy(*PAIR).agg(F.round(F.sum(F.col("z") * F.col("w")), 6).alias("z"))


def import_logits(edges: DataFrame, logits: DataFrame, least: float = 0.995) -> DataFrame:
    """Edges with the external score of their pair; an error when read if a pair is scored twice or too few pairs of the band are covered."""
    twice = logits.groupBy(*PAIR).agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("_n"))
    joined = edges.join(twice, PAIR, "left")
    share = joined.agg(F.avg(F.col("z").isNotNull().cast("int")).alias("_share"), F.max("_n").alias("_most"))
    bad = F.when(F.col("_most") > 1, F.raise_error(F.lit("a pair is scored twice"))).when(F.col("_share") < least, F.raise_error(F.lit("too few pairs are scored")))
    return joined.drop("_n").join(F.broadcast(share)).withColumn("_bad", bad.cast("string")).where("_bad IS NULL").drop("_bad", "_share", "_most")


def encoder_disagreement(kept: DataFrame, scores: DataFrame, country: DataFrame, labelled: list[str]) -> DataFrame:
    """Share of kept pairs that the other family rejects (z < 0), per country, and its excess over the labelled ones."""
    rows = kept.select(*PAIR).join(scores.select(*PAIR, "z"), PAIR).join(country, "s1")
    each = rows.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("z") < 0).cast("int")).alias("rate"))
    base = rows.where(F.col("country").isin(labelled)).agg(F.avg((F.col("z") < 0).cast("int")).alias("base"))
    return each.join(F.broadcast(base)).select("country", "n", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - F.col("base"), 6).alias("excess"))


def logit_diagnostics(scores: DataFrame, country: DataFrame) -> DataFrame:
    """Per country: rows, share of tied values, median, share above 0 and beyond 10."""
    z = F.col("z")
    return scores.join(country, "s1").groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.round(1 - F.countDistinct("z") / F.count(F.lit(1)), 6).alias("ties"), F.round(F.percentile("z", 0.5), 6).alias("median"),
                                                             F.round(F.avg((z > 0).cast("int")), 6).alias("positive"), F.round(F.avg((F.abs(z) > 10).cast("int")), 6).alias("far"))


# evaluation

def oracle_f05(universe: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Macro F0.5 of the best decision that the candidates allow."""
    found = truth.select(*PAIR).join(candidates.select(*PAIR), PAIR, "left_semi")
    return G.per_entity_f05(universe, truth, found).agg(F.round(F.avg("f05"), 6).alias("oracle_f05"))


def blocking_report(universe: DataFrame, truth: DataFrame, candidates: DataFrame, country: DataFrame, source: Column) -> DataFrame:
    """Recall of all true pairs, by country and by source, and the mean and 99th percentile of candidates per entity."""
    t = truth.select(*PAIR).join(candidates.select(*PAIR, F.lit(1).alias("c")).distinct(), PAIR, "left").join(country, "s1", "left").withColumn("source", source)
    hit = F.round(F.avg(F.col("c").isNotNull().cast("int")), 6)
    one = lambda kind, name, rows: rows.agg(hit.alias("value")).select(F.lit(kind).alias("what"), F.col(name).alias("name") if name else F.lit("").alias("name"), "value")
    size = universe.select("s1").distinct().join(candidates.groupBy("s1").agg(F.countDistinct("r").alias("n")), "s1", "left").na.fill(0, ["n"])
    stats = size.agg(F.round(F.avg("n"), 6).alias("mean"), F.floor(F.percentile("n", 0.99)).cast("double").alias("p99"))
    stats = stats.select(F.explode(F.array(F.struct(F.lit("mean").alias("what"), F.col("mean").alias("value")), F.struct(F.lit("p99").alias("what"), F.col("p99").alias("value")))).alias("s")).select("s.what", F.lit("").alias("name"), "s.value")
    t = t.withColumn("source", F.col("source").cast("string"))
    return one("recall", None, t).unionByName(one("country", "country", t.groupBy("country"))).unionByName(one("source", "source", t.groupBy("source"))).unionByName(stats)


def decision_diagnostics(universe: DataFrame, owned: DataFrame, pred: DataFrame) -> DataFrame:
    """Per group (universe: s1, grp): entities, predictions per entity, share of empty ones, owned pairs above one half and 0.9, owned mass per entity."""
    o = owned.groupBy("s1").agg(F.sum((F.col("p") > 0.5).cast("int")).alias("a"), F.sum((F.col("p") > 0.9).cast("int")).alias("b"), F.sum("p").alias("c"))
    m = pred.groupBy("s1").agg(F.countDistinct("r").alias("n"))
    rows = universe.join(o, "s1", "left").join(m, "s1", "left").na.fill(0)
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("entities"), mean("n", "pred"), mean((F.col("n") == 0).cast("int"), "empty_share"), mean("a", "owned_p50"), mean("b", "owned_p90"), mean("c", "owned_mass"))


def two_sets(universe: DataFrame, truth: DataFrame, base: DataFrame, new: DataFrame) -> DataFrame:
    """s1 and the F0.5 of both sets."""
    a, b = (G.per_entity_f05(universe, truth, x).select("s1", F.col("f05").alias(name)) for x, name in ((base, "a"), (new, "b")))
    return a.join(b, "s1")


def gate_deltas(universe: DataFrame, truth: DataFrame, base: DataFrame, new: DataFrame) -> DataFrame:
    """Mean gain of the new set, overall and by group (universe: s1, grp)."""
    d = two_sets(universe, truth, base, new).join(universe, "s1")
    rows = d.groupingSets([["grp"], []], "grp").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"))
    return rows.select(F.when(F.col("g") == 1, "(all)").otherwise(F.coalesce("grp", F.lit("(none)"))).alias("grp"), "n", "delta")


#: Entities of one block of the index bootstrap.
BLOCK = 1 << 14


def _index_draws(d: DataFrame, draws: int, seed: int, block: int = BLOCK) -> DataFrame:
    """draw, w, d: per block and draw, how many entities were drawn with replacement and their mean d (d: s1, d, written once)."""
    n = d.count()
    rows = d.select("s1", "d", F.pmod(F.xxhash64("s1", F.lit(seed)), F.lit(1 + n // block)).alias("block"))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"))

    def dealt(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("block")
        times = np.random.default_rng([seed, int(key[0])]).multinomial(n, own["size"].to_numpy() / n)
        return pd.DataFrame({"draw": key[0], "block": own["block"], "times": times})

    def drawn(key: tuple, own: pd.DataFrame, times: pd.DataFrame) -> pd.DataFrame:
        values = own.sort_values("s1")["d"].to_numpy(np.float64)
        times = times[times["times"] > 0]
        sums = [values[np.random.default_rng([seed, int(draw), int(key[0]) + 1]).integers(0, len(values), int(k))].sum() for draw, k in zip(times["draw"], times["times"])]
        return pd.DataFrame({"draw": times["draw"], "w": times["times"], "d": np.array(sums, np.float64) / times["times"].to_numpy()})

    every = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    times = every.groupBy("draw").applyInPandas(dealt, "draw int, block long, times long")
    return rows.groupBy("block").cogroup(times.groupBy("block")).applyInPandas(drawn, "draw int, w long, d double")


def paired_bootstrap(scores: DataFrame, draws: int = 200, seed: int = 0, poisson: bool = True) -> DataFrame:
    """delta, ci_low, ci_high, p_better of b - a (scores: s1, a, b) over resamples.

    Poisson: every entity gets its own count of 1 on average in each draw, from a hash of (entity, draw), so a
    draw is one grouped sum whatever the partitioning. Index: n draws with replacement of n entities. They are
    dealt to hash blocks by a multinomial draw and drawn within their block, so no task sees all entities.
    """
    d = scores.select("s1", (F.col("b") - F.col("a")).alias("d"))
    if poisson:
        u = (F.pmod(F.xxhash64("s1", "draw", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        each = d.select("s1", "d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
        tail, cuts, p = 0.0, [], 0.36787944117144233
        for k in range(12):
            tail += p
            cuts.append(tail)
            p /= k + 1
        w = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("_u") > c))
        rows = each.withColumn("_u", u).withColumn("w", w)
    else:
        d = saved(d)
        rows = _index_draws(d, draws, seed)
    means = rows.groupBy("draw").agg((F.sum(F.col("w") * F.col("d")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    total = d.agg(F.round(F.avg("d"), 6).alias("delta"), F.count(F.lit(1)).alias("n"))
    return means.agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"), F.avg((F.col("m") > 0).cast("int")).alias("p_better")).join(F.broadcast(total))


def compare_gate(universe: DataFrame, truth: DataFrame, base: DataFrame, new: DataFrame, least: float = 0.002, draws: int = 200) -> DataFrame:
    """Whether the new set is to be kept: a mean gain of ``least`` and an interval above 0."""
    out = paired_bootstrap(two_sets(universe, truth, base, new), draws)
    return out.withColumn("keep", (F.col("delta") >= least) & (F.col("ci_low") > 0))


def loss_with_gain(universe: DataFrame, truth: DataFrame, edges: DataFrame, owned: DataFrame, pred: DataFrame) -> DataFrame:
    """``loss_buckets`` with what macro F0.5 would gain if the bucket alone were put right."""
    t, p = truth.select(*PAIR).distinct(), pred.select(*PAIR).distinct()
    known = t.select("r").distinct().withColumn("_real", F.lit(1))
    fp = p.join(t, PAIR, "left_anti").join(known, "r", "left").select("s1", F.when(F.col("_real").isNotNull(), "fp_elsewhere").otherwise("fp_orphan").alias("bucket"))
    fn = (t.join(p, PAIR, "left_anti").join(edges.select(*PAIR, F.lit(1).alias("_c")), PAIR, "left").join(owned.select(*PAIR, F.lit(1).alias("_o")), PAIR, "left")
          .select("s1", F.when(F.col("_c").isNull(), "fn_no_candidate").when(F.col("_o").isNull(), "fn_lost").otherwise("fn_below").alias("bucket")))
    wrong = fp.unionByName(fn).groupBy("s1", "bucket").agg(F.count(F.lit(1)).alias("n"))
    score = G.per_entity_f05(universe, truth, pred)
    rows = wrong.join(score, "s1")
    is_fp = F.col("bucket").startswith("fp")
    fixed = F.when(is_fp, G.f05(F.col("n_true"), F.col("n_pred") - F.col("n"), F.col("n_hit"))).otherwise(G.f05(F.col("n_true"), F.col("n_pred") + F.col("n"), F.col("n_hit") + F.col("n")))
    size = universe.select("s1").distinct().count()
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.round(F.sum(fixed - F.col("f05")) / size, 6).alias("gain"))


def reweight_to_mix(scores: DataFrame, here: DataFrame, there: DataFrame) -> DataFrame:
    """Mean score (s1, f05) of groups (s1, grp) weighted by the other table's mix (s1, grp); groups only there are named with a null mean."""
    mean = scores.join(here, "s1").groupBy("grp").agg(F.avg("f05").alias("f05"), F.count(F.lit(1)).alias("n_here"))
    mix = there.groupBy("grp").agg(F.count(F.lit(1)).alias("n_there"))
    total = there.count()
    rows = mix.join(mean, "grp", "left")
    return rows.select("grp", "n_there", F.coalesce("n_here", F.lit(0)).alias("n_here"), F.round("f05", 6).alias("mean"), F.round(F.col("f05") * F.col("n_there") / total, 6).alias("part"))


def precision_of_rule(rule: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of a rule, how many are true, and how many are new on records that nobody owns, with their truth rate."""
    rows = rule.select(*PAIR).distinct().join(truth.select(*PAIR, F.lit(1).alias("y")).distinct(), PAIR, "left").na.fill(0, ["y"])
    new = rows.join(pred.select("r").distinct(), "r", "left_anti")
    a = rows.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("y"), 6).alias("precision"))
    return a.join(F.broadcast(new.agg(F.count(F.lit(1)).alias("new_pairs"), F.round(F.avg("y"), 6).alias("new_precision"))))


def rank_auc_plain(edges: DataFrame) -> DataFrame:
    """Area under the ROC curve by ranks with ties in the order of (p, s1, r), over all edges.

    The rank is counted in two steps: sums of range buckets, then within a bucket, so that no task sees all rows.
    """
    rows = edges.select("p", "s1", "r", "y", F.least(F.floor(F.col("p") * 4096), F.lit(4095)).cast("int").alias("b"))
    size = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.join(F.broadcast(size.select("b", "before")), "b").withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("p", "s1", "r")))
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    return ranked.agg(F.round((F.sum(F.col("rank") * F.col("y")) - pos * (pos + 1) / 2) / (pos * neg), 6).alias("auc"))


def cut_size_curve(edges: DataFrame, truth: DataFrame, universe: DataFrame, cuts: list[tuple[float, int]]) -> DataFrame:
    """For each (least p, entities per record): candidates per entity and recall. Ranks are computed once."""
    ranked = edges.select(*PAIR, "p", F.row_number().over(G.r_order()).alias("_k")).join(truth.select(*PAIR, F.lit(1).alias("y")).distinct(), PAIR, "left").na.fill(0, ["y"])
    steps = F.array(*(F.struct(F.lit(f"{a:g}/{k}").alias("cut"), ((F.col("p") >= a) & (F.col("_k") <= k)).alias("kept")) for a, k in cuts))
    n, true = universe.count(), truth.select(*PAIR).distinct().count()
    rows = ranked.select("y", F.explode(steps).alias("s")).where("s.kept").groupBy("s.cut").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hit"))
    return rows.select("cut", F.round(F.col("n") / n, 6).alias("per_entity"), F.round(F.col("hit") / true, 6).alias("recall"))


def recall_curve(candidates: DataFrame, truth: DataFrame, bit: int, trims: list[tuple[int, int]]) -> DataFrame:
    """Recall and size at each pair of trims; a pair also stays if another view than ``bit`` found it."""
    rows = candidates.join(truth.select(*PAIR, F.lit(1).alias("y")).distinct(), PAIR, "left").na.fill(0, ["y"])
    other = F.col("views").bitwiseAND(F.lit(~bit)) != 0
    kept = lambda a, b: other | F.col("rank_s1").between(0, a - 1) | F.col("rank_r").between(0, b - 1)
    steps = F.array(*(F.struct(F.lit(a).alias("trim_s1"), F.lit(b).alias("trim_r"), kept(a, b).alias("kept")) for a, b in trims))
    true = truth.select(*PAIR).distinct().count()
    return rows.select("y", F.explode(steps).alias("s")).where("s.kept").groupBy("s.trim_s1", "s.trim_r").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y") / true, 6).alias("recall"))


def context_calibration(owned: DataFrame, context: str, bands: list[float]) -> DataFrame:
    """Truth rate against mean p by context column and band of p."""
    band = F.size(F.filter(F.array(*map(F.lit, bands)), lambda b: F.col("p") >= b))
    return owned.groupBy(F.col(context).alias("context"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("rate"))


def halving_cv(universe: DataFrame, truth: DataFrame, owned: DataFrame, grid: list[float], salts: list[int]) -> DataFrame:
    """Per salt and half: the bar that is best on the other half, and its macro F0.5 here. One sweep over (salt, half, bar)."""
    halves = F.explode(F.array(*(F.struct(F.lit(s).alias("salt"), F.pmod(F.xxhash64("s1", F.lit(s)), F.lit(2)).alias("half")) for s in salts))).alias("h")
    true = truth.groupBy("s1").agg(F.countDistinct("r").alias("n_true"))
    people = universe.select("s1").distinct().join(true, "s1", "left").na.fill(0, ["n_true"])
    y = truth.select(*PAIR, F.lit(1).alias("t")).distinct()
    pairs = owned.select(*PAIR, "p").join(y, PAIR, "left")
    steps = F.explode(F.filter(F.array(*map(F.lit, grid)), lambda t: F.col("p") >= t)).alias("bar")
    got = pairs.select("s1", F.coalesce("t", F.lit(0)).alias("t"), steps).groupBy("bar", "s1").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("t").alias("n_hit"))
    gain = got.join(people, "s1").select("s1", "bar", (G.f05(F.col("n_true"), F.col("n_pred"), F.col("n_hit")) - (F.col("n_true") == 0).cast("int")).alias("g"))
    base = people.select("n_true", halves).groupBy("h.salt", "h.half").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n_true") == 0).cast("int")).alias("empty"))
    each = gain.select("bar", "g", halves).groupBy("h.salt", "h.half", "bar").agg(F.sum("g").alias("g")).join(base, ["salt", "half"]).withColumn("f", F.round((F.col("g") + F.col("empty")) / F.col("n"), 6))
    best = each.withColumn("_k", F.row_number().over(W.partitionBy("salt", "half").orderBy(F.desc("f"), "bar"))).where("_k = 1").select("salt", (1 - F.col("half")).alias("half"), "bar")
    return each.join(best, ["salt", "half", "bar"]).select("salt", "half", "bar", F.col("f").alias("macro_f05"))


def record_mass_stats(edges: DataFrame, universe: DataFrame, most: float = 1.05) -> DataFrame:
    """Records whose mass is above ``most`` and the mass above 1, both per 1000 entities."""
    n = universe.select("s1").distinct().count()
    m = edges.groupBy("r").agg(F.sum("p").alias("m"))
    return m.agg(F.round(1000 * F.sum((F.col("m") > most).cast("int")) / n, 6).alias("heavy"), F.round(1000 * F.sum(F.greatest(F.col("m") - 1, F.lit(0.0))) / n, 6).alias("excess"))


def copy_count_posterior(edges: DataFrame, pred: DataFrame, most: int = 3) -> DataFrame:
    """Share of true owners among rivals by how many predicted copies they have, from one hash half of records, with its mean on the other."""
    copies = pred.groupBy("s1").agg(F.countDistinct("r").alias("c"))
    rows = edges.join(copies, "s1", "left").select("r", "y", F.least(F.coalesce("c", F.lit(0)), F.lit(most)).alias("copies")).withColumn("half", F.pmod(F.xxhash64("r"), F.lit(2)))
    return rows.groupBy("copies").agg(F.sum((F.col("half") == 0).cast("int")).alias("n_fit"), F.round(F.avg(F.when(F.col("half") == 0, F.col("y"))), 6).alias("fitted"), F.round(F.avg(F.when(F.col("half") == 1, F.col("y"))), 6).alias("checked"))


def rescore_gain(universe: DataFrame, truth: DataFrame, pred: DataFrame, scores: DataFrame, bar: float) -> DataFrame:
    """Change of macro F0.5 from dropping pairs under the bar, by hash half of the entities."""
    kept = pred.select(*PAIR).join(scores.where(F.col("z") < bar).select(*PAIR), PAIR, "left_anti")
    d = two_sets(universe, truth, pred, kept)
    return d.groupBy((F.col("s1") % 2).alias("half")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"))


def leak_by_group(scores: DataFrame, groups: Column, bar: float) -> DataFrame:
    """Share of pairs under the bar, share below 0 and the median, by group of the entity."""
    return scores.groupBy(groups.alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("z") < bar).cast("int")), 6).alias("drop_rate"), F.round(F.avg((F.col("z") < 0).cast("int")), 6).alias("negative"), F.round(F.percentile("z", 0.5), 6).alias("median"))


def density_crosstab(edges: DataFrame, bands: list[float]) -> DataFrame:
    """How many edges by size of the record's group (up to 4) and band of p, as columns."""
    band = F.concat(F.lit("band_"), F.size(F.filter(F.array(*map(F.lit, bands)), lambda b: F.col("p") >= b)).cast("string"))
    rows = edges.select(F.least(F.count(F.lit(1)).over(W.partitionBy("r")), F.lit(4)).alias("crowd"), band.alias("band"))
    return rows.groupBy("crowd").pivot("band", [f"band_{k}" for k in range(len(bands) + 1)]).count().na.fill(0)


def pair_stats(truth: DataFrame, universe: DataFrame, source: Column) -> DataFrame:
    """How many entities have how many true records of each source."""
    n = truth.select("s1", "r").distinct().withColumn("source", source).groupBy("s1").agg(F.sum((F.col("source") == 2).cast("int")).alias("two"), F.sum((F.col("source") == 3).cast("int")).alias("three"))
    return universe.select("s1").distinct().join(n, "s1", "left").na.fill(0, ["two", "three"]).groupBy("two", "three").agg(F.count(F.lit(1)).alias("entities"))


def sample_pool(edges: DataFrame, truth: DataFrame, mod: int, salt: int) -> DataFrame:
    """A development pool: entities of a hash slice with all their edges, labelled (a sampling operator)."""
    return label_pairs(edges.where(K.hash_slice(F.col("s1"), salt, mod)), truth)


def resample_gap(universe: DataFrame, truth: DataFrame, pred: DataFrame, weights: DataFrame, draws: int = 50) -> DataFrame:
    """Mean, 5 % and 95 % points of macro F0.5 over Poisson resamples of the entities, each group (universe: s1, grp) scaled to its weight."""
    f = G.per_entity_f05(universe, truth, pred).select("s1", "f05").join(universe, "s1")
    zero = f.select("s1", F.lit(0.0).alias("a"), F.col("f05").alias("b"), "grp")
    u = (F.pmod(F.xxhash64("s1", "draw"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    w = F.size(F.filter(F.array(*map(F.lit, (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941))), lambda c: F.col("u") > c))
    rows = zero.select("s1", "grp", "b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("u", u).withColumn("w", w)
    mean = rows.groupBy("draw", "grp").agg((F.sum(F.col("w") * F.col("b")) / F.greatest(F.sum("w"), F.lit(1))).alias("m")).join(F.broadcast(weights), "grp").groupBy("draw").agg((F.sum(F.col("m") * F.col("weight")) / F.sum("weight")).alias("m"))
    return mean.agg(F.avg("m").alias("mean"), F.percentile("m", 0.05).alias("low"), F.percentile("m", 0.95).alias("high"))


def score_algebra(total: float, share: float, rest: float) -> float:
    """A country's mean from the overall mean, its share of entities and the others' mean."""
    return (total - (1 - share) * rest) / share
