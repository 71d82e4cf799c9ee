"""Scoring of pairs: features, boosted trees by stage with scores out of fold, calibration, pluggable slow scorers.

Tables have s1, r, y (0/1) and feature columns named ``<group>__<name>``; missing features are null.  Folds are
those of the entity's hash, so all pairs of an entity are on one side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph as G
from . import keys as K
from .decide import PAIR, logit
from .tables import saved

EPS = 1e-4


def feature_columns(df: DataFrame) -> list[str]:
    """Columns with a double underscore; none may name a country."""
    names = [c for c in df.columns if "__" in c]
    if bad := [c for c in names if "country" in c.lower()]:
        raise ValueError(f"features must not name countries: {bad}")
    return names


def grouped(df: DataFrame, groups: int = 3) -> DataFrame:
    """``grp``: fold of the entity's hash modulo ``groups``."""
    return df.withColumn("grp", F.pmod(K.fold_of(F.col("s1")), F.lit(groups)))


def fit_trees(df: DataFrame, depth: int = 4, rounds: int = 8, rate: float = 0.2, weight: str | None = None, stop_share: float = 0.05):
    """A boosted model of y; a hash share of the entities tells when to stop."""
    cols = feature_columns(df)
    rows = df.where("y IS NOT NULL").withColumn("y", F.col("y").cast("double")).withColumn("_stop", F.pmod(F.xxhash64("s1", F.lit(5)), F.lit(1000)) < int(1000 * stop_share))
    for c in cols:
        rows = rows.withColumn(c, F.col(c).cast("double"))
    more = {"validationIndicatorCol": "_stop"} if stop_share else {}
    more |= {"weightCol": weight} if weight else {}
    trees = GBTClassifier(featuresCol="_x", labelCol="y", maxDepth=depth, maxIter=rounds, stepSize=rate, seed=3, **more)
    stages = [Imputer(inputCols=cols, outputCols=[f"_f_{c}" for c in cols]), VectorAssembler(inputCols=[f"_f_{c}" for c in cols], outputCol="_x", handleInvalid="keep"), trees]
    return Pipeline(stages=stages).fit(rows)


def scored(model, df: DataFrame, name: str = "p") -> DataFrame:
    """``df`` with the model's probability; inputs come back as they were."""
    own, rows = df.columns, df
    for c in feature_columns(df):
        rows = rows.withColumn(c, F.col(c).cast("double"))
    out = model.transform(rows).withColumn(name, vector_to_array(F.col("probability"))[1])
    return out.select(*[c for c in own if c != name], name)


def out_of_fold(df: DataFrame, name: str = "p", groups: int = 3, **fit) -> DataFrame:
    """Every row scored by a model that saw none of its group's entities."""
    rows, out = grouped(df, groups), None
    for g in range(groups):
        part = scored(fit_trees(rows.where(F.col("grp") != g), **fit), rows.where(F.col("grp") == g), name)
        out = part if out is None else out.unionByName(part)
    return out


def train_stage1(df: DataFrame, **fit):
    """(scores out of fold, the model of all rows)."""
    return out_of_fold(df, "p1", **fit), fit_trees(df, **fit)


def stage0_filter(df: DataFrame, mod: int = 10, share: float = 0.0005) -> tuple[DataFrame, float]:
    """A shallow model of a hash slice of entities scores all rows; tau0 is the quantile of the true pairs outside the slice."""
    inside = K.hash_slice(F.col("s1"), 11, mod)
    model = fit_trees(df.where(inside), depth=3, rounds=6, stop_share=0.0)
    out = scored(model, df, "p0")
    tau = out.where(~inside & (F.col("y") == 1)).agg(F.percentile("p0", share).alias("t")).first()["t"]
    return out, float(tau or 0.0)


def stage1_oof(df: DataFrame, tau0: float, groups: int = 3) -> DataFrame:
    """p1: out-of-fold scores of rows with p0 >= tau0, else p0."""
    high = out_of_fold(df.where(F.col("p0") >= tau0), "p1", groups).drop("grp")
    return high.unionByName(df.where(F.col("p0") < tau0).withColumn("p1", F.col("p0")).select(*high.columns))


def stage2(df: DataFrame, tau0: float, least: float = 0.002, groups: int = 3) -> DataFrame:
    """p2: a model with the first stage's score, its logit and the group's rivals on rows worth it; p1 elsewhere."""
    on = (F.col("p0") >= tau0) & (F.col("p1") >= least)
    edges = df.withColumn("p", F.col("p1"))
    sides = G.record_side_stats(edges.withColumn("source", F.lit(2))).select(*PAIR, F.col("r_rank").alias("ctx__rank"), F.col("r_best").alias("ctx__best"), F.col("r_second").alias("ctx__second"), F.col("r_sum").alias("ctx__sum"), F.col("r_n").alias("ctx__n"))
    rows = saved(df.join(sides, PAIR).withColumn("ctx__p1", F.col("p1")).withColumn("ctx__logit", logit(F.col("p1"))))
    high = out_of_fold(rows.where(on), "p2", groups).drop("grp")
    return high.unionByName(rows.where(~on).withColumn("p2", F.col("p1")).select(*high.columns))


def pseudo_label_training(df: DataFrame, pseudo: DataFrame, weight: float = 0.5, groups: int = 2) -> DataFrame:
    """Scores out of fold of models that also see the other groups' pseudo labels (s1, r, y), at a lower weight; labels -1 are left out."""
    known = df.withColumn("w", F.lit(1.0))
    more = df.drop("y").join(pseudo.where("y >= 0").select(*PAIR, "y"), PAIR).withColumn("w", F.lit(weight))
    every, out = grouped(known.unionByName(more.select(*known.columns)), groups), None
    rows = grouped(df, groups)
    for g in range(groups):
        part = scored(fit_trees(every.where(F.col("grp") != g), weight="w", stop_share=0.0), rows.where(F.col("grp") == g), "p")
        out = part if out is None else out.unionByName(part)
    return out


def stage3_contested(df: DataFrame, least: float = 0.01) -> DataFrame:
    """Rows of contested records scored again; records that touch the holdout are never learnt from, and without others the scores stay."""
    contested = G.contested_records(df.withColumn("p", F.col("p2")), least).select("r")
    touching = df.where(K.is_holdout(F.col("s1"))).select("r").distinct()
    rows = df.join(contested, "r", "left_semi")
    known = rows.join(touching, "r", "left_anti")
    if known.select("y").distinct().count() < 2:
        return rows.select(*PAIR, F.col("p2").alias("p3"))
    return scored(fit_trees(known, stop_share=0.0), rows, "p3").select(*PAIR, "p3")


# calibration

def fit_isotonic(df: DataFrame, label: str = "y", by: str = "p", rising: bool = True):
    rows = df.select(F.col(by).cast("double").alias("x"), F.col(label).cast("double").alias("label"))
    return IsotonicRegression(isotonic=rising, featuresCol="x", labelCol="label", predictionCol="q").fit(rows)


def apply_isotonic(model, df: DataFrame, by: str = "p", name: str = "p_cal") -> DataFrame:
    """The fitted map read by linear interpolation and clipped."""
    out = model.transform(df.withColumn("x", F.col(by).cast("double")))
    return out.withColumn(name, F.least(F.greatest("q", F.lit(EPS)), F.lit(1 - EPS))).drop("x", "q")


def crossfit(df: DataFrame, groups: int = 3) -> DataFrame:
    """Each group calibrated by the others."""
    rows, out = grouped(df, groups), None
    for g in range(groups):
        part = apply_isotonic(fit_isotonic(rows.where(F.col("grp") != g)), rows.where(F.col("grp") == g))
        out = part if out is None else out.unionByName(part)
    return out


def segment_calibration(owned: DataFrame, segment: str, groups: int = 2) -> DataFrame:
    """``crossfit`` within each value of ``segment`` (a small set)."""
    out = None
    for value in sorted(r[0] for r in owned.select(segment).distinct().limit(100).collect()):
        part = crossfit(owned.where(F.col(segment) == value), groups)
        out = part if out is None else out.unionByName(part)
    return out


def mass_calibration(edges: DataFrame, truth: DataFrame, most: float = 0.999) -> DataFrame:
    """p scaled up, never down, so that a record's mass agrees with the share of records of that mass whose owner is present."""
    mass = edges.groupBy("r").agg(F.sum("p").alias("mass"))
    present = mass.join(truth.select("r", F.lit(1).alias("has")).distinct(), "r", "left").na.fill(0, ["has"])
    wanted = apply_isotonic(fit_isotonic(present, "has", "mass"), present, "mass", "goal").select("r", F.greatest(F.col("goal") / F.col("mass"), F.lit(1.0)).alias("scale"))
    return edges.join(wanted, "r").select(*PAIR, F.least(F.col("p") * F.col("scale"), F.greatest(F.lit(most), F.col("p"))).alias("p"))


def predict_train_test(oof: DataFrame, everything: DataFrame, model) -> DataFrame:
    """Rows with a score out of fold keep it calibrated by the other groups; the others get the full model's, calibrated by all."""
    oof = saved(oof)  # eight passes read it, each of which would run the fold's models again
    calibrated = crossfit(oof).select(*PAIR, F.col("p_cal").alias("p"))
    rest = everything.join(oof.select(*PAIR), PAIR, "left_anti")
    return calibrated.unionByName(apply_isotonic(fit_isotonic(oof), scored(model, rest, "p")).select(*PAIR, F.col("p_cal").alias("p")))


# slow scorers

def linear_scorer(a: pd.Series, b: pd.Series) -> pd.Series:
    """The fallback where no text model is at hand: a logit of the share of common words."""
    share = [len(set(x.split()) & set(y.split())) / max(1, len(set(x.split()) | set(y.split()))) for x, y in zip(a.fillna(""), b.fillna(""))]
    return pd.Series(share, dtype=float) * 12 - 6


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] = linear_scorer) -> DataFrame:
    """s1, r, z of any pairs (s1, r, a, b) by a scorer of two text columns; it runs on Arrow batches."""
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"s1": batch["s1"], "r": batch["r"], "z": scorer(batch["a"], batch["b"])})

    return pairs.select("s1", "r", "a", "b").mapInPandas(over, "s1 long, r long, z double")


def cross_encoder(band: DataFrame, texts: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] = linear_scorer) -> DataFrame:
    """z of the band's pairs from the texts of both sides (texts: eid, text)."""
    left, right = (texts.select(F.col("eid").alias(k), F.col("text").alias(v)) for k, v in (("s1", "a"), ("r", "b")))
    return score_pairs(band.select(*PAIR).join(left, "s1").join(right, "r"), scorer)


def stacked_logits(df: DataFrame, columns: list[str], groups: int = 2) -> DataFrame:
    """p of a logistic stack of logit columns, out of fold."""
    rows, out = VectorAssembler(inputCols=columns, outputCol="_x").transform(grouped(df, groups)).withColumn("y", F.col("y").cast("double")), None
    for g in range(groups):
        model = LogisticRegression(featuresCol="_x", labelCol="y", regParam=1e-4).fit(rows.where(F.col("grp") != g))
        part = model.transform(rows.where(F.col("grp") == g)).select(*PAIR, F.col("y").cast("int").alias("y"), vector_to_array(F.col("probability"))[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def blend_weight_fit(df: DataFrame, a: str, b: str, steps: int = 10) -> DataFrame:
    """w, auc on one hash half and on the other, of each convex blend of two logit columns; the mid-rank AUC of all weights in one pass."""
    weights = F.explode(F.array(*(F.lit(k / steps) for k in range(steps + 1)))).alias("w")
    rows = df.select("s1", "r", "y", a, b, weights).withColumn("half", F.pmod(F.xxhash64("s1"), F.lit(2))).withColumn("z", F.round(F.col("w") * F.col(a) + (1 - F.col("w")) * F.col(b), 9))
    by_z = rows.groupBy("w", "half", F.floor(F.col("z") * 4).alias("k"), "z").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranges = by_z.groupBy("w", "half", "k").agg(F.sum("neg").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("w", "half").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("neg").over(W.partitionBy("w", "half", "k").orderBy("z").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = by_z.join(ranges.select("w", "half", "k", "before"), ["w", "half", "k"]).withColumn("wins", F.col("pos") * (F.col("before") + inside + F.col("neg") / 2))
    auc = wins.groupBy("w", "half").agg((F.sum("wins") / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    return auc.groupBy("w").agg(F.round(F.max(F.when(F.col("half") == 0, F.col("auc"))), 6).alias("fit_auc"), F.round(F.max(F.when(F.col("half") == 1, F.col("auc"))), 6).alias("check_auc"))


def leave_one_country_out(df: DataFrame, country: DataFrame, name: str) -> DataFrame:
    """Rows of one country scored by a model of the others."""
    rows = df.join(country, "s1")
    return scored(fit_trees(rows.where(F.col("country") != name).drop("country"), stop_share=0.0), rows.where(F.col("country") == name).drop("country"), "p")
