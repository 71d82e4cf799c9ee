"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words (A-Z folded, split at blanks) and their leading bytes, hashed into
``2**BITS`` buckets; a term counts once per text.  The machine scores
``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j`` over all terms that occur, so a pair of terms can
weigh more than both alone.  A term's value ``x_i`` grows with how far its share differs between the
classes, and no term is left out; each has a weight and factors.

Fitting uses at most ``sample`` labelled rows (a documented bound, chosen by a hash of doc_id); values,
weights and factors come from these rows.

Defined results.  Null and empty texts have no term and get the bias alone.  Without labelled rows of
both classes the score is the share of toxic rows (0.5 if there is none).  Conflicting labels of a
document count as toxic.  Repeated rows score alike.  Rows without doc_id are left out.  An empty table
gives an empty table; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import documents, fold, small_batches, without

BITS = 18
PREFIXES = (4, 6)
SAMPLE = 4_000
FACTORS = 8
#: Chi-square at which a term has half its full value.
HALF_VALUE = 40
#: A toxic row of the fit counts as so many others, since few are.
TOXIC_WEIGHT = 2


def term_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document of the chunk, bucket) of every term occurrence."""
    data = K.lower(data)
    starts, ends, before = K.words(data, offsets, K.NOT_SPACE)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    spans = [ends, *(np.minimum(ends, starts + p) for p in PREFIXES)]
    ids = [((K.span_hashes(data, starts, e) ^ K.U64(k << 60)) * K.U64(0x9E3779B97F4A7C15) >> K.U64(64 - BITS)).astype(np.int64) for k, e in enumerate(spans)]
    return np.tile(doc, len(ids)), np.concatenate(ids)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed: list[bytes] = []
        for a, b, data, offsets in K.chunks(batch.column("text")):
            doc, ids = term_ids(data, offsets)
            both = np.unique(doc << BITS | ids)
            cut = np.searchsorted(both, np.arange(b - a + 1) << BITS)
            ids = (both & ((1 << BITS) - 1)).astype("<u4")
            packed += [ids[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]
        yield pa.record_batch([batch.column("y"), pa.array(packed, pa.binary())], ["y", "ids"])


class FactorizationMachine:
    """Second-order machine over terms with fixed values, logistic loss, Adagrad over mini-batches."""

    def __init__(self, value: np.ndarray, bias: float, factors: int = FACTORS, seed: int = 7):
        self.value, self.w0, self.w = value.astype(np.float32), bias, np.zeros(len(value), np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (len(value), factors)).astype(np.float32)

    def _sums(self, n: int, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margins, factor sums of each document, scaled factors of each pair)."""
        x = self.value[term]
        scaled = self.v[term] * x[:, None]
        sums = np.stack([np.bincount(doc, scaled[:, f], n) for f in range(self.v.shape[1])], 1)
        squares = np.bincount(doc, (scaled * scaled).sum(1), n)
        return self.w0 + np.bincount(doc, self.w[term] * x, n) + 0.5 * ((sums * sums).sum(1) - squares), sums, scaled

    def margins(self, n: int, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Scores before the logistic of n documents; (doc, term) are distinct pairs."""
        return self._sums(n, doc, term)[0]

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.1, l2: float = 1e-4, size: int = 256) -> None:
        rng, g0, gw, gv = np.random.default_rng(11), 1e-8, np.full(self.w.shape, 1e-8, np.float32), np.full(self.v.shape, 1e-8, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), size):
                batch = order[i : i + size]
                n, doc = len(batch), np.repeat(np.arange(len(batch)), [len(rows[j]) for j in batch])
                term = np.concatenate([rows[j] for j in batch]).astype(np.int64)
                margins, sums, scaled = self._sums(n, doc, term)
                miss = (probability(margins) - y[batch]) * np.where(y[batch] == 1, TOXIC_WEIGHT, 1)
                e = miss[doc] / n * self.value[term]
                own = np.flatnonzero(np.bincount(term, minlength=len(self.w)))
                dw = np.bincount(term, e, len(self.w))[own] + l2 * self.w[own]
                dv = np.stack([np.bincount(term, e * (sums[doc, f] - scaled[:, f]), len(self.w))[own] for f in range(self.v.shape[1])], 1) + l2 * self.v[own]
                d0 = float(miss.mean())
                g0 += d0 * d0
                gw[own] += dw * dw
                gv[own] += dv * dv
                self.w0 -= rate * d0 / g0**0.5
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                self.v[own] -= rate * dv / np.sqrt(gv[own])


def values(counts: tuple[np.ndarray, np.ndarray], n0: int, n1: int) -> np.ndarray:
    """x_i of every term from how many rows of each class have it: chi-square over itself plus ``HALF_VALUE``."""
    share = (counts[0] + counts[1]) / (n0 + n1)
    gap = (counts[1] + 0.5) / (n1 + 1) - (counts[0] + 0.5) / (n0 + 1)
    chi = gap * gap / (share * (1 - share) + 1e-9) * n0 * n1 / (n0 + n1)
    return np.where(share > 0, chi / (chi + HALF_VALUE), 0)


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Train on labelled documents outside fold 0 of 5."""
    small_batches(docs.sparkSession)
    truth = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id"), 5) != 0)
             .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("y"))
             .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(truth), F.col("doc_id") == F.col("_id")).select("text", "y").mapInArrow(_terms, "y int, ids binary").toArrow().sort_by([("y", "ascending"), ("ids", "ascending")])
    # views of the table's buffers, not a copy as objects
    y, terms = rows["y"].to_numpy().astype(float), [np.frombuffer(x.as_buffer(), "<u4") for x in rows["ids"]]
    del rows
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n0 or not n1:
        share = (n1 / (n0 + n1)) if n0 + n1 else 0.5
        return FactorizationMachine(np.zeros(1 << BITS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 1)
    seen = np.zeros((2, 1 << BITS))
    for t, own in zip(terms, y.astype(int)):
        seen[own, t] += 1
    machine = FactorizationMachine(values((seen[0], seen[1]), n0, n1), float(np.log(n1 / n0)))
    machine.fit(terms, y)
    return machine


def score(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """doc_id, score of every document; whole texts."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out = [np.zeros(0)]
            for a, b, data, offsets in K.chunks(batch.column("text")):
                doc, ids = term_ids(data, offsets)
                both = np.unique(doc << BITS | ids)
                out.append(probability(m.margins(b - a, both >> BITS, both & ((1 << BITS) - 1))))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(out))], ["doc_id", "score"])

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filter form: whole rows of the documents that are not predicted toxic. Rows without doc_id go; a doc_id with several texts goes if one of them is toxic."""
    return without(docs, toxicity(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
