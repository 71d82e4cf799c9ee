"""Operators over the candidate graph: edges (s1, r, p) with source, y. Windows and grouped aggregates only.

Ties are always broken by a total order (lower s1, lower r), so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by_s1():
    return W.partitionBy("s1")


def by_r():
    return W.partitionBy("r")


def s1_order():
    return by_s1().orderBy(F.desc("p"), "r")


def r_order():
    return by_r().orderBy(F.desc("p"), "s1")


#: Break-even of the k-th pair (from 0) of an entity under F0.5.
BREAK_EVEN = "(5 * k + 1) / (6.25 * k + 2)"


def group_top2(edges: DataFrame) -> DataFrame:
    """Best, second best (0 if alone) and size of each record's group, on every edge."""
    ranked = edges.withColumn("_k", F.row_number().over(r_order()))
    best, second = F.max("p").over(by_r()), F.max(F.when(F.col("_k") == 2, F.col("p"))).over(by_r())
    return ranked.select("s1", "r", "p", best.alias("best"), F.coalesce(second, F.lit(0.0)).alias("second"), F.count(F.lit(1)).over(by_r()).alias("size"))


def gaps_and_margin(edges: DataFrame) -> DataFrame:
    """Distance to the best of the entity and of the record, and lead over the record's best other entity."""
    top = group_top2(edges)
    rival = F.when(F.col("p") >= F.col("best"), F.col("second")).otherwise(F.col("best"))
    return top.select("s1", "r", F.round(F.max("p").over(by_s1()) - F.col("p"), 6).alias("gap_s1"), F.round(F.col("best") - F.col("p"), 6).alias("gap_r"), F.round(F.col("p") - rival, 6).alias("margin"))


def cand_log_counts(edges: DataFrame) -> DataFrame:
    return edges.select("s1", "r", F.round(F.log1p(F.count(F.lit(1)).over(by_s1())), 6).alias("log_n_s1"), F.round(F.log1p(F.count(F.lit(1)).over(by_r())), 6).alias("log_n_r"))


def rival_counts(entities: DataFrame, key: str) -> DataFrame:
    """log1p of how many other entities share a key; an empty key has none."""
    n = F.count(F.lit(1)).over(W.partitionBy(key)) - 1
    return entities.select("s1", F.round(F.log1p(F.when(F.coalesce(F.col(key), F.lit("")) == "", F.lit(0)).otherwise(n)), 6).alias("rivals"))


def record_side_stats(edges: DataFrame) -> DataFrame:
    second = F.max(F.when(F.col("_k") == 2, F.col("p"))).over(by_r())
    total = F.sum("p").over(by_r())
    return edges.withColumn("_k", F.row_number().over(r_order())).select(
        "s1", "r", (F.col("_k") - 1).alias("r_rank"), F.max("p").over(by_r()).alias("r_best"), F.coalesce(second, F.lit(0.0)).alias("r_second"),
        F.sum((F.col("p") > 0.5).cast("int")).over(by_r()).alias("r_above_half"), F.round(total, 6).alias("r_sum"), F.round(F.col("p") / total, 6).alias("r_share"), F.count(F.lit(1)).over(by_r()).alias("r_n"))


def s1_side_stats(edges: DataFrame) -> DataFrame:
    """The first has no gap above; the last's gap below is its own p."""
    above, below, total = F.lag("p").over(s1_order()), F.lead("p").over(s1_order()), F.sum("p").over(by_s1())
    same = F.sum("p").over(W.partitionBy("s1", "source"))
    count = lambda t: F.sum((F.col("p") > t).cast("int")).over(by_s1())
    return edges.select(
        "s1", "r", (F.row_number().over(s1_order()) - 1).alias("s_rank"), F.max("p").over(by_s1()).alias("s_max"), F.round(total, 6).alias("s_sum"), count(0.5).alias("n50"), count(0.8).alias("n80"), count(0.95).alias("n95"),
        F.round(F.coalesce(above - F.col("p"), F.lit(0.0)), 6).alias("gap_up"), F.round(F.col("p") - F.coalesce(below, F.lit(0.0)), 6).alias("gap_down"),
        (F.round(same - F.col("p"), 6) + F.lit(0.0)).alias("same_source"), (F.round(total - same, 6) + F.lit(0.0)).alias("other_source"), F.count(F.lit(1)).over(by_s1()).alias("s_n"))


def contested_records(edges: DataFrame, least: float = 0.01) -> DataFrame:
    """Records that at least two entities claim."""
    return edges.where(F.col("p") >= least).groupBy("r").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def record_mass(edges: DataFrame) -> DataFrame:
    return edges.groupBy("r").agg(F.round(F.sum("p"), 6).alias("mass"), F.count(F.lit(1)).alias("crowd"))


def rival_copies(edges: DataFrame, sure: float = 0.5) -> DataFrame:
    """Of each edge: the record's best other entity, its p, and its other sure records in the same source."""
    one = edges.withColumn("_k", F.row_number().over(r_order()))
    first = one.where("_k = 1").select("r", F.col("s1").alias("s_a"), F.col("p").alias("p_a"))
    second = one.where("_k = 2").select("r", F.col("s1").alias("s_b"), F.col("p").alias("p_b"))
    copies = edges.where(F.col("p") >= sure).groupBy(F.col("s1").alias("rival"), "source").agg(F.count(F.lit(1)).alias("copies"))
    own = edges.where(F.col("p") >= sure).select(F.col("s1").alias("rival"), "r", F.lit(1).alias("self"))
    rows = edges.join(first, "r").join(second, "r", "left").select("s1", "r", "source", F.when(F.col("s1") == F.col("s_a"), F.col("s_b")).otherwise(F.col("s_a")).alias("rival"), F.when(F.col("s1") == F.col("s_a"), F.col("p_b")).otherwise(F.col("p_a")).alias("rival_p"))
    return rows.join(copies, ["rival", "source"], "left").join(own, ["rival", "r"], "left").select("s1", "r", "rival", F.coalesce("rival_p", F.lit(0.0)).alias("rival_p"), (F.coalesce("copies", F.lit(0)) - F.coalesce("self", F.lit(0))).alias("rival_copies"))


def candidate_cut(edges: DataFrame, least: float = 0.02, top: int = 2) -> DataFrame:
    """First the filter, then each record's best entities."""
    return edges.where(F.col("p") >= least).withColumn("_k", F.row_number().over(r_order())).where(F.col("_k") <= top).drop("_k")


# ownership and decisions

def argmax_owner(edges: DataFrame) -> DataFrame:
    """Each record's best entity, ties to the lower s1."""
    return edges.withColumn("_k", F.row_number().over(r_order())).where("_k = 1").drop("_k")


def own_rank(owned: DataFrame) -> DataFrame:
    return owned.withColumn("k", F.row_number().over(s1_order()) - 1)


def rank_threshold(owned: DataFrame, first: float = 0.55, rest: float = 0.4) -> DataFrame:
    """The best pair above ``first``; the others above ``rest``, if the best was taken."""
    ranked = own_rank(owned).withColumn("_best", F.max("p").over(by_s1()))
    return ranked.where((F.col("_best") > first) & ((F.col("k") == 0) | (F.col("p") > rest))).drop("k", "_best")


def greedy_breakeven(owned: DataFrame, first: float | None = None) -> DataFrame:
    """The k-th pair while it raises the expected F0.5; ``first`` replaces the bar of the first pair."""
    bar = F.expr(BREAK_EVEN) if first is None else F.when(F.col("k") == 0, F.lit(first)).otherwise(F.expr(BREAK_EVEN))
    return own_rank(owned).where(F.col("p") > bar).drop("k")


def logit_shift(p: Column, shift: Column | float) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(F.log(clipped / (1 - clipped)) + shift)))


def crowd_shift(edges: DataFrame, base: float = 0.2, less: float = 0.3, crowd: int = 4) -> DataFrame:
    shift = F.lit(base) - F.when(F.count(F.lit(1)).over(by_r()) >= crowd, F.lit(less)).otherwise(F.lit(0.0))
    return edges.select("s1", "r", F.round(logit_shift(F.col("p"), shift), 6).alias("p_shifted"))


def contested_threshold(edges: DataFrame, contested: float = 0.7, free: float = 0.4) -> DataFrame:
    """Owned pairs above a bar that depends on whether a rival claims the record."""
    ranked = edges.withColumn("_k", F.row_number().over(r_order())).withColumn("_n", F.sum((F.col("p") >= 0.3).cast("int")).over(by_r()))
    return ranked.where((F.col("_k") == 1) & (F.col("p") > F.when(F.col("_n") >= 2, contested).otherwise(free))).select("s1", "r", "p")


# edits of a decided set

def rule_cap(matches: DataFrame, two: int = 2, three: int = 2, total: int = 3) -> DataFrame:
    """At most so many records of each source, then in all, best p first."""
    order = [F.desc("p"), "r"]
    kept = matches.withColumn("_k", F.row_number().over(W.partitionBy("s1", "source").orderBy(*order))).where(F.col("_k") <= F.when(F.col("source") == 2, two).otherwise(three))
    return kept.withColumn("_k", F.row_number().over(by_s1().orderBy(*order))).where(F.col("_k") <= total).select("s1", "r", "p", "source")


def rule_crowded(matches: DataFrame, edges: DataFrame, most: float = 0.75, crowd: int = 4) -> DataFrame:
    """Without pairs of middling p on crowded records."""
    busy = edges.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= crowd).select("r")
    return matches.join(matches.where(F.col("p") <= most).join(busy, "r", "left_semi").select("s1", "r"), ["s1", "r"], "left_anti")


def rule_best_of_empty(matches: DataFrame, edges: DataFrame, least: float = 0.3) -> DataFrame:
    """Entities without a match get their best record that nobody has."""
    free = edges.where(F.col("p") > least).join(matches.select("s1").distinct(), "s1", "left_anti").join(matches.select("r").distinct(), "r", "left_anti")
    mine = free.withColumn("_k", F.row_number().over(r_order())).where("_k = 1").withColumn("_k", F.row_number().over(s1_order())).where("_k = 1")
    return matches.select("s1", "r").unionByName(mine.select("s1", "r"))


def rule_missing_source(matches: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """Added pairs: entities with matches in one source only get their best free record of the other."""
    have = matches.groupBy("s1").agg(F.max((F.col("source") == 2).cast("int")).alias("two"), F.max((F.col("source") == 3).cast("int")).alias("three"))
    lack = have.where("two + three = 1").select("s1", F.when(F.col("two") == 1, 3).otherwise(2).cast("long").alias("source"))
    free = edges.where(F.col("p") >= least).join(matches.select("r").distinct(), "r", "left_anti").join(lack, ["s1", "source"])
    return free.withColumn("_k", F.row_number().over(s1_order())).where("_k = 1").select("s1", "r")


def rule_soft_trim(matches: DataFrame, size: int = 4, least: float = 0.6) -> DataFrame:
    return matches.withColumn("_n", F.count(F.lit(1)).over(by_s1())).where((F.col("_n") < size) | (F.col("p") >= least)).select("s1", "r")


def rule_singleton(matches: DataFrame, least: float = 0.8) -> DataFrame:
    return matches.withColumn("_n", F.count(F.lit(1)).over(by_s1())).where((F.col("_n") > 1) | (F.col("p") > least)).select("s1", "r")


def rule_mass(edges: DataFrame, least: float = 0.3) -> DataFrame:
    """p over the record's mass where that is above 1, then the bar."""
    share = F.round(F.col("p") / F.greatest(F.lit(1.0), F.sum("p").over(by_r())), 6)
    return edges.select("s1", "r", share.alias("share")).where(F.col("share") > least)


def consensus(votes: DataFrame, n: int) -> DataFrame:
    """Pairs that at least n voters have (votes: voter, s1, r), one owner each: most votes, then lower s1."""
    counted = votes.distinct().groupBy("s1", "r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)
    return counted.withColumn("_k", F.row_number().over(by_r().orderBy(F.desc("n"), "s1"))).where("_k = 1").select("s1", "r", "n")


def diff_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.select("s1", "r", F.lit(1).alias("a")).join(new.select("s1", "r", F.lit(1).alias("b")), ["s1", "r"], "full")
    return both.select("s1", "r", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("same").alias("change"))


def audit(matches: DataFrame, candidates: DataFrame, universe: DataFrame) -> DataFrame:
    """Violation counts of a finished set: repeated pairs, records with two owners, pairs that are no candidates, unknown entities."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    return (n(matches.groupBy("s1", "r").count().where("count > 1"), "repeated").unionByName(n(matches.groupBy("r").agg(F.countDistinct("s1").alias("c")).where("c > 1"), "two_owners"))
            .unionByName(n(matches.join(candidates, ["s1", "r"], "left_anti"), "no_candidate")).unionByName(n(matches.join(universe, "s1", "left_anti"), "unknown")))


# evaluation

def f05(true: Column, pred: Column, hit: Column) -> Column:
    return F.when((true == 0) & (pred == 0), 1.0).otherwise(1.25 * hit / (0.25 * true + pred))


def per_entity_f05(universe: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """s1, n_true, n_pred, n_hit, f05 of every entity; pairs count once, outsiders not at all."""
    t = truth.select("s1", "r").distinct().withColumn("t", F.lit(1))
    p = pred.select("s1", "r").distinct().withColumn("p", F.lit(1))
    counts = t.join(p, ["s1", "r"], "full").groupBy("s1").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.sum(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("n_hit"))
    rows = universe.select("s1").distinct().join(counts, "s1", "left").na.fill(0, ["n_true", "n_pred", "n_hit"])
    return rows.withColumn("f05", F.round(f05(F.col("n_true"), F.col("n_pred"), F.col("n_hit")), 6))


def equal_key_f05(entities: DataFrame, records: DataFrame, pred: DataFrame) -> DataFrame:
    """``per_entity_f05`` where an entity's true records are those of an equal key (eid, key; null equals nothing).

    True pairs are counted by key and predicted ones looked up, so a group of copies is not expanded to
    pairs; but for entities with several keys, whose records could count twice.
    """
    e, r = entities.select(F.col("eid").alias("s1"), "key").distinct(), records.select(F.col("eid").alias("r"), "key").distinct()
    keys = e.groupBy("s1").agg(F.count("key").alias("k"), F.max("key").alias("key"))
    one = keys.where("k = 1").join(r.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").select("s1", F.col("n").alias("n_true"))
    several = e.join(keys.where("k > 1").select("s1"), "s1", "left_semi").join(r, "key").groupBy("s1").agg(F.countDistinct("r").alias("n_true"))
    p = pred.select("s1", "r").distinct()
    n_pred = p.groupBy("s1").agg(F.count(F.lit(1)).alias("n_pred"))
    n_hit = p.join(e, "s1").join(r, ["r", "key"]).groupBy("s1").agg(F.countDistinct("r").alias("n_hit"))
    rows = keys.select("s1").join(one.unionByName(several), "s1", "left").join(n_pred, "s1", "left").join(n_hit, "s1", "left").na.fill(0, ["n_true", "n_pred", "n_hit"])
    return rows.withColumn("f05", F.round(f05(F.col("n_true"), F.col("n_pred"), F.col("n_hit")), 6))


def report(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """Macro F0.5 of all and of each group (groups: s1, grp)."""
    return scores.join(groups, "s1").groupingSets([["grp"], []], "grp").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.round(F.avg("f05"), 6).alias("macro_f05")).select(F.when(F.col("_g") == 1, "all").otherwise(F.coalesce("grp", F.lit("(none)"))).alias("grp"), "n", "macro_f05")


def tune_threshold(universe: DataFrame, truth: DataFrame, owned: DataFrame, grid: list[float]) -> DataFrame:
    """Macro F0.5 at each threshold in one pass: an owned pair counts for every threshold it reaches."""
    n = universe.count()
    size = universe.select("s1").distinct().join(truth.groupBy("s1").agg(F.countDistinct("r").alias("n_true")), "s1", "left").na.fill(0, ["n_true"])
    hits = owned.select("s1", "r", "p").join(truth.select("s1", "r", F.lit(1).alias("y")).distinct(), ["s1", "r"], "left").na.fill(0, ["y"])
    steps = F.explode(F.filter(F.array(*map(F.lit, grid)), lambda t: F.col("p") >= t)).alias("t")
    got = hits.select("s1", "y", steps).groupBy("t", "s1").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("y").alias("n_hit"))
    # entities without a prediction at t score 1 if they have no truth, else 0
    empty = size.agg(F.sum((F.col("n_true") == 0).cast("int")).alias("empty")).first()["empty"] or 0
    gain = got.join(size, "s1").select("t", (f05(F.col("n_true"), F.col("n_pred"), F.col("n_hit")) - (F.col("n_true") == 0).cast("int")).alias("g"))
    return gain.groupBy("t").agg(F.round((F.sum("g") + empty) / n, 6).alias("macro_f05"))


def pair_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    found = truth.join(candidates.select("s1", "r", F.lit(1).alias("c")).distinct(), ["s1", "r"], "left")
    return found.agg(F.count(F.lit(1)).alias("n_true"), F.count("c").alias("n_found"), F.round(F.count("c") / F.count(F.lit(1)), 6).alias("recall"))


def loss_buckets(truth: DataFrame, edges: DataFrame, owned: DataFrame, pred: DataFrame) -> DataFrame:
    """Why pairs are wrong: false positives (owned elsewhere, orphan), false negatives (no candidate, lost, below)."""
    t, p = truth.select("s1", "r").distinct(), pred.select("s1", "r").distinct()
    fp = p.join(t, ["s1", "r"], "left_anti").join(t.select("r", F.lit(1).alias("real")).distinct(), "r", "left").select(F.when(F.col("real").isNotNull(), "fp_elsewhere").otherwise("fp_orphan").alias("bucket"))
    fn = (t.join(p, ["s1", "r"], "left_anti").join(edges.select("s1", "r", F.lit(1).alias("c")), ["s1", "r"], "left").join(owned.select("s1", "r", F.lit(1).alias("o")), ["s1", "r"], "left")
          .select(F.when(F.col("c").isNull(), "fn_no_candidate").when(F.col("o").isNull(), "fn_lost").otherwise("fn_below").alias("bucket")))
    return fp.unionByName(fn).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def reliability_table(edges: DataFrame, bins: int = 15, digits: int = 6) -> DataFrame:
    k = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    return edges.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), digits).alias("mean_p"), F.round(F.avg("y"), digits).alias("rate"))


def rank_auc(edges: DataFrame, parts: int = 4096) -> DataFrame:
    """Area under the ROC curve with averaged ties: totals of score ranges first, then the scores within each range, so that no task sees all scores."""
    k = F.least(F.floor(F.col("p") * parts), F.lit(parts - 1)).cast("int")
    by_p = edges.groupBy(k.alias("k"), "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    # one row per range: at most ``parts`` of them are in one window
    ranges = by_p.groupBy("k").agg(F.sum("neg").alias("n")).select("k", F.coalesce(F.sum("n").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    below = F.col("before") + F.coalesce(F.sum("neg").over(W.partitionBy("k").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = by_p.join(F.broadcast(ranges), "k").select("pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("wins"))
    return rows.agg(F.round(F.sum("wins") / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def prediction_diagnostics(universe: DataFrame, pred: DataFrame, groups: DataFrame) -> DataFrame:
    n = universe.select("s1").distinct().join(pred.groupBy("s1").agg(F.count(F.lit(1)).alias("n")), "s1", "left").na.fill(0, ["n"]).join(groups, "s1")
    return n.groupBy("grp").agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("pairs"), F.round(F.avg("n"), 6).alias("per_entity"), F.round(F.avg((F.col("n") == 0).cast("int")), 6).alias("empty_share"))


def bag_scores(tables: DataFrame) -> DataFrame:
    """Mean score of each pair over runs (run, s1, r, p)."""
    return tables.groupBy("s1", "r").agg(F.round(F.avg("p"), 6).alias("p"), F.count(F.lit(1)).alias("runs"))


def zmean_logits(tables: DataFrame) -> DataFrame:
    """Logits standardised per run (sample deviation), then averaged by pair."""
    stats = tables.groupBy("run").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"))
    return tables.join(F.broadcast(stats), "run").groupBy("s1", "r").agg((F.round(F.avg((F.col("z") - F.col("m")) / F.col("s")), 6) + F.lit(0.0)).alias("z"))
