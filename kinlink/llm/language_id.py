"""Language identification by nearest centroid over TF-IDF weighted byte n-grams.

Texts (A-Z folded, each run of ASCII other than letters one blank) become hashed counts of 1- to 3-byte
n-grams, damped, weighted by inverse document frequency over all documents and normalised.  Every language has several centroids from spherical k-means; a text takes
the language of the centroid with the largest cosine.  A text much further (``SLACK``) than the
language's own training rows is flagged ``rejected``.

Fitting uses about ``per_language`` rows of each language, and ``most`` in all (documented bounds): those
whose hash of doc_id is under a threshold, so that no task sees more than it keeps.

Defined results.  An empty table gives an empty table; very long texts are counted whole.  Null texts and texts without a letter are ``und`` with score 0, whatever else they
hold; so is every text when no row is labelled.  Equal cosines go to the language that sorts first.
Rows without doc_id are left out; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import documents, fold, small_batches

DIMENSIONS = 4096
PER_LANGUAGE = 400
MOST = 6400
CENTROIDS = 4
UNDETERMINED = "und"
#: A text is rejected beyond so many times the distance within which nearly all training rows lie.
SLACK = 1.25


_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = _LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, one row per document of the chunk."""
    data, n = _LETTERS[data], len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    again = np.flatnonzero((data[1:] == 0x20) & (data[:-1] == 0x20) & (doc[1:] == doc[:-1])) + 1
    data, doc = np.delete(data, again).astype(np.uint32), np.delete(doc, again)
    out = np.zeros(n * DIMENSIONS)
    code = np.zeros(len(data), np.uint32)
    for width in (1, 2, 3):
        code = code[: len(data) - width + 1] * np.uint32(257) + data[width - 1 :] if len(data) >= width else code[:0]
        inside = doc[: len(code)] == doc[width - 1 :] if len(code) else np.zeros(0, bool)
        slot = ((code * np.uint32(0x9E3779B1) + np.uint32(width * 0x85EBCA77 & 0xFFFFFFFF)) >> np.uint32(20)).astype(np.int64)
        out += np.bincount(doc[: len(code)][inside] * DIMENSIONS + slot[inside], minlength=len(out))
    return out.reshape(n, DIMENSIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r.astype("<f4").tobytes() for _, _, d, o in K.chunks(batch.column("text")) for r in gram_counts(d, o)]
        yield pa.record_batch([batch.column("lang"), pa.array(rows, pa.binary())], ["lang", "x"])


class Centroids:
    def __init__(self, langs: list[str], counts: np.ndarray, idf: np.ndarray, per: int = CENTROIDS, seed: int = 5):
        names = np.array(langs, dtype=object)
        self.idf = idf
        x = self.vectors(counts)
        rng, means, owner, limits = np.random.default_rng(seed), [], [], {}
        for lang in sorted(set(langs)):
            own = x[names == lang]
            centre = own[rng.permutation(len(own))[: min(per, len(own))]]
            for _ in range(15):
                nearest = (own @ centre.T).argmax(1)
                centre = _unit(np.stack([own[nearest == k].sum(0) if (nearest == k).any() else centre[k] for k in range(len(centre))]))
            means.append(centre)
            owner += [lang] * len(centre)
            limits[lang] = SLACK * float(1 - np.quantile((own @ centre.T).max(1), 0.002))
        self.centre, self.owner, self.limits = np.concatenate(means), np.array(owner, dtype=object), limits

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.vectors(counts) @ self.centre.T
        best = cosine.argmax(1)
        return self.owner[best], np.clip(cosine[np.arange(len(best)), best], 0, 1)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> Centroids | None:
    """Learn from text and lang of documents whose fold of 4 is not 2."""
    spark, parts = docs.sparkSession, 1 << 31
    small_batches(spark)
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    size = rows.groupBy("lang").count().collect()
    each = max(1, min(per_language, most // max(1, len(size))))
    under = spark.createDataFrame([(r["lang"], min(parts, -(-each * parts // r["count"]))) for r in size], "_lang string, _under long")
    chosen = rows.join(F.broadcast(under), F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(parts)) < F.col("_under"))
    found = chosen.select("lang", "text").mapInArrow(_vectors, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    if not len(found):
        return None
    return Centroids(found["lang"].tolist(), np.stack([np.frombuffer(x, "<f4") for x in found["x"]]).astype(float), inverse_frequency(docs))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, df = 0, np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        for a, b, d, o in K.chunks(batch.column("text")):
            for i in range(0, b - a, 256):
                j = min(b - a, i + 256)
                df += (gram_counts(d[o[i] : o[j]], o[i : j + 1] - o[i]) > 0).sum(0)
        n += batch.num_rows
    yield pa.record_batch([pa.array(np.arange(DIMENSIONS + 1)), pa.array(np.append(df, n))], ["slot", "n"])


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """Weight of every n-gram slot from all documents."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(DIMENSIONS + 1)
    n[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 0.1


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            letters = [has_letter(t) for t in batch.column("text").to_pylist()]
            langs, scores, far = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            for a, b, d, o in K.chunks(batch.column("text")) if m else ():
                for i in range(0, b - a, 256):
                    j = min(b - a, i + 256)
                    best, cosine = m.predict(gram_counts(d[o[i] : o[j]], o[i : j + 1] - o[i]))
                    for k in range(j - i):
                        at = a + i + k
                        if letters[at]:
                            langs[at], scores[at], far[at] = best[k], cosine[k], 1 - cosine[k] > m.limits[best[k]]
            yield pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return (docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(predicted, "doc_id long, lang_pred string, score double, rejected boolean")
            .select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
