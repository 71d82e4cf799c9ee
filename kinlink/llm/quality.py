"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards its diagonal and a ridge; the score is
the logistic of the difference of the two Gaussian log-densities (log-determinant and Mahalanobis
distance from Cholesky factors computed once) plus the log prior odds.  Means, and then second moments
about them, are sums over all labelled rows outside the held-out fold.

Defined results.  An empty table gives an empty table; very long texts are read whole, one at a time.  Null and empty texts have statistics of zero and are scored like any other text.
With one class only, the score is that class (0.5 without labels).  Conflicting labels of a document
count as low quality.  Rows without doc_id are left out; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import WIDE, documents, fold, small_batches, stored

SHRINKAGE = 0.1
RIDGE = 1e-3

_UPPER, _LETTER, _DIGIT, _MARK, _ODD, _BANG, _HIGH = (np.zeros(256, bool) for _ in range(7))
_UPPER[0x41:0x5B] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_DIGIT[0x30:0x3A] = True
_MARK[[*b".,;:'\"()-?!"]] = True
_ODD[[*b"#$%&*|<>{}[]@~^=_+\\/`"]] = True
_BANG[ord("!")] = True
_HIGH[0x80:] = True
_NEWLINE = np.ones(256, bool)
_NEWLINE[0x0A] = False
STATISTICS = ("log_words", "word_length", "upper", "digits", "marks", "odd", "bang", "high", "odd_ends", "short_words", "repeated_lines", "distinct_words", "repeated_shingles", "log_line")


def _repeats(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Distinct values per document."""
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=len(before) - 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per document of the chunk."""
    def count(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data])])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    size = np.diff(offsets).astype(float)
    starts, ends, before = K.words(data, offsets, K.NOT_SPACE)
    doc = np.repeat(np.arange(len(size)), np.diff(before))
    n = np.diff(before).astype(float)
    per_word = lambda x: np.bincount(doc, x, len(size)) / np.maximum(n, 1)
    hashes = K.span_hashes(K.lower(data), starts, ends)
    a, b, lines = K.words(data, offsets, _NEWLINE)
    n_lines = np.diff(lines).astype(float)
    runs = np.zeros(0, K.U64)
    whole = np.diff(before) - 4
    if len(hashes) > 4:
        runs = K.sequence_hashes(hashes, np.arange(len(hashes) - 4), 5)
        runs = runs[np.flatnonzero(doc[:-4] == doc[4:])]
    whole = np.maximum(whole, 0)
    share = lambda x, y: x / np.maximum(y, 1)
    root = np.sqrt  # spreads shares near zero
    return np.stack([
        np.log1p(n), np.log1p(share(size, n)), root(share(count(_UPPER), count(_LETTER))), root(share(count(_DIGIT), size)), root(share(count(_MARK), size)),
        root(share(count(_ODD), size)), root(share(count(_BANG), size)), root(share(count(_HIGH), size)),
        root(per_word(_ODD[data[ends - 1]].astype(float)) if len(ends) else np.zeros(len(size))), root(per_word((ends - starts <= 3).astype(float))),
        root(share(n_lines - _repeats(K.span_hashes(data, a, b), lines), n_lines)), share(_repeats(hashes, before), n) * np.log1p(n) / 8,
        root(share(whole - _repeats(runs, np.concatenate([[0], np.cumsum(whole)])), whole)), np.log1p(share(size, n_lines)),
    ], 1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(d, o) for _, _, d, o in K.chunks(batch.column("text"))]
        flat = np.concatenate(rows).reshape(-1) if rows else np.zeros(0)
        step = np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32)
        yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(step), pa.array(flat))], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _moments(centre: dict[int, np.ndarray]):
    """Per class of the partition: rows, sum and sum of outer products about the class's ``centre``."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(STATISTICS)
        total = {y: [0, np.zeros(k), np.zeros((k, k))] for y in centre}
        for batch in batches:
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False)
            for c, t in total.items():
                z = x[y == c] - centre[c]
                t[0] += len(z)
                t[1] += z.sum(0)
                t[2] += z.T @ z
        rows = [(c, t[0], np.concatenate([t[1], t[2].reshape(-1)]).tolist()) for c, t in total.items() if t[0]]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["y", "n", "s"])
    return summed


class Discriminant:
    """Two Gaussians; ``classes`` maps 0/1 to (rows, mean, lower Cholesky factor inverse, log-determinant)."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE, ridge: float = RIDGE):
        """``sums``: of each class its rows, the centre of its moments, the sum and the outer products about it."""
        self.classes = {}
        for y, (n, centre, s, outer) in sums.items():
            off = s / n
            mean = centre + off
            cov = outer / n - np.outer(off, off)
            cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + ridge * np.eye(len(mean))
            factor = np.linalg.cholesky(cov)
            self.classes[y] = (n, mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), float(next(iter(self.classes), 0.5)))
        density = {y: -0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) - 0.5 * det + np.log(n) for y, (n, mean, inverse, det) in self.classes.items()}
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -35, 35)))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """``features``: doc_id, x. Learns from labelled rows whose fold of 3 is not 1."""
    truth = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id"), 3) != 1)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y")))
    k, sums = len(STATISTICS), {}
    rows = features.join(truth, "doc_id").select("x", "y")
    centre = {r["y"]: np.array([r[f"m{i}"] for i in range(k)]) for r in rows.groupBy("y").agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k))).collect() if r["y"] in (0, 1)}
    parts = rows.mapInArrow(_moments(centre), "y int, n long, s array<double>").toPandas()
    for y, group in parts.groupby("y"):
        s = np.sum([np.asarray(v) for v in group["s"]], 0)
        sums[int(y)] = (int(group["n"].sum()), centre[int(y)], s[:k], s[k:].reshape(k, k))
    return Discriminant(sums)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    features = stored(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, "doc_id long, x array<double>"), 1 + docs.count() // WIDE)
    model = spark.sparkContext.broadcast(fit(features, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.value.score(_matrix(batch.column("x"))))], ["doc_id", "score"])

    return features.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
