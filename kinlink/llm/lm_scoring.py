"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting.  Counts of words, pairs and triples of words of the training texts are gathered by hash
bucket, with counts summed in each task before they are sent.
Filter.  A count c has level ``1 + floor(log2 c)``; an n-gram is inserted once for each level up to its
own, so a count is read back by probing level after level until a miss.  N-grams of any count are
held.  Each bucket builds its own segment of ``BITS_PER_INSERTION`` bits for every insertion it counted,
so the filter grows with the input and reads err equally often at any size: ``PROBES`` probes find a
missing n-gram in about 1.2 % of reads.  No task and not the driver holds more than one segment.
Scoring.  ``p(w|v) = MIX * c(vw)/c(v) + (1-MIX) * (c(w)+0.5)/(N+0.5(V+1))`` and
``p(w|uv) = MIX * c(uvw)/c(uv) + (1-MIX) * p(w|v)`` with the counts read from the filter; the base score
uses exact word counts.  Documents are taken in units of about ``UNIT`` tokens.  The distinct n-grams of
a unit are sent to their buckets, and what these hold comes back to the unit, where the scores of its
documents are summed.

Words are told apart by 48 bits of hash, pairs and triples by 32, each besides those that choose the
bucket; buckets grow in number with the input, so that stays far rarer than a false probe.

Defined results.  Null and empty texts are the end token alone.  Without training rows N = V = 0 and
the base is log10(1) a token.  Rows without doc_id are left out; repeated rows count and are scored
each.  An empty table gives an empty table; a very long text is a unit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import WIDE, buckets, documents, fold, small_batches, stored

PROBES = 4
BITS_PER_INSERTION = 10
MIX = 0.5
END = K.U64(0x5EED0E7D00000001)
START = K.U64(0x5EED57A7000000F1)
LOW = K.U64((1 << 48) - 1)
#: Words, pairs, triples.
KINDS = (1, 2, 3)
#: n-grams that one task sums before it sends them.
HELD = 1_000_000
#: Tokens that are scored together; a longer text has a unit of its own.
UNIT = 1_000_000


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END after each document, and where each document begins (length n + 1)."""
    data = K.lower(data)
    starts, ends, before = K.words(data, offsets, K.NOT_SPACE)
    return np.insert(K.span_hashes(data, starts, ends), before[1:], END), before + np.arange(len(before))


def gram_hashes(tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the hash of it and the token before, and of it and the two before, from 48 bits of each."""
    first, tokens = begins[:-1], tokens & LOW

    def chained(before: np.ndarray, start: np.uint64) -> np.ndarray:
        previous = np.empty_like(tokens)
        previous[1:] = before[:-1]
        previous[first] = start
        return K.mix(previous * K.U64(0xD1342543DE82EF95) + tokens)

    pairs = chained(tokens, START)
    return pairs, chained(pairs, START)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> K.U64(32)) * K.U64(n) >> K.U64(32)).astype(np.int64)


def gram_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket in the high half, what tells n-grams of a bucket apart in the low half."""
    return bucket_of(hashes, n).astype(K.U64) << K.U64(32) | hashes & K.U64(0xFFFFFFFF)


def _cuts(kind: int, keys: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket begins in sorted keys."""
    return np.searchsorted(bucket_of(keys, n) if kind == 1 else keys >> K.U64(32), np.arange(n + 1))


def _packed(at: np.ndarray) -> bytes:
    """Small unsigned numbers, low bytes first, then the next; compressed."""
    width = at.dtype.itemsize
    return bytes([width]) + pa.compress(at.view(np.uint8).reshape(-1, width).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(pa.decompress(blob[1:], width * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").reshape(-1)


def _coded(kind: int, keys: np.ndarray) -> bytes:
    """Sorted keys of one bucket. Words: 6 bytes each; n-grams: 2 bytes each and the steps of the upper two, compressed."""
    if kind == 1:
        return K.pack(keys, 6)
    low = keys.astype("<u4")
    steps = np.diff(low >> 16, prepend=np.uint32(0)).astype("<u2")
    return low.astype("<u2").tobytes() + _packed(steps)


def _decoded(kind: int, blob: bytes, n: int) -> np.ndarray:
    if kind == 1:
        return K.unpack(blob, 6)
    low = np.frombuffer(blob, "<u2", n)
    return (np.cumsum(_unpacked(blob[2 * n :], n).astype(K.U64)) << K.U64(16)) | low


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, K.U64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _dealt(kind: int, keys: np.ndarray, counts: np.ndarray, n: int) -> Iterator[tuple]:
    """(bucket, kind, keys seen once, how many, other keys, their counts) as packed columns."""
    cut = _cuts(kind, keys, n)
    for b in np.flatnonzero(np.diff(cut)).tolist():
        k, c = keys[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]]
        once = c == 1
        yield b, kind, _coded(kind, k[once]), int(once.sum()), _coded(kind, k[~once]), c[~once].astype("<i8").tobytes()


_GRAMS = "bucket int, kind int, once binary, n_once long, keys binary, counts binary"


def _grams(n: int):
    schema = _schema(_GRAMS)

    def sent(held: dict[int, tuple[list, list]]) -> pa.RecordBatch:
        rows = [r for kind, (keys, counts) in held.items() for r in _dealt(kind, *_summed(keys, counts), n)]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = lambda: {kind: ([], []) for kind in KINDS}
        held, size = empty(), 0
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column("text")):
                tokens, begins = token_hashes(data, offsets)
                for kind, keys in zip(KINDS, (tokens, *(gram_keys(h, n) for h in gram_hashes(tokens, begins)))):
                    k, c = np.unique(keys, return_counts=True)
                    held[kind][0].append(k)
                    held[kind][1].append(c)
                    size += len(k)
                if size > HELD:
                    yield sent(held)
                    held, size = empty(), 0
        yield sent(held)
    return counted


def _received(rows: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for k, once, m, more, n in zip(*(rows.column(c).to_pylist() for c in ("kind", "once", "n_once", "keys", "counts"))):
        if k == kind:
            c = np.frombuffer(n, "<i8")
            keys += [_decoded(kind, once, m), _decoded(kind, more, len(c))]
            counts += [np.ones(m, np.int64), c]
    return _summed(keys, counts)


_COUNTS = "bucket int, n long, v long, insertions long, words binary, word_counts binary, most int, bits binary"


def _counts(rows: pa.Table) -> pa.Table:
    bucket = rows.column("bucket")[0].as_py()
    words, n = _received(rows, 1)
    kinds = [(1, words, level(n))]
    for kind in KINDS[1:]:
        grams, m = _received(rows, kind)
        kinds.append((kind, grams, level(m)))
    insertions, most = sum(int(k[2].sum()) for k in kinds), max(int(k[2].max(initial=0)) for k in kinds)
    bits = LogFrequencySegment.built(kinds, BITS_PER_INSERTION * insertions)
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": [int(n.sum())], "v": [len(words)], "insertions": [insertions], "words": pa.array([K.pack(words, 6)], pa.binary()), "word_counts": pa.array([n.astype("<i8").tobytes()], pa.binary()),
                     "most": pa.array([most], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})


def level(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count), 0 for 0."""
    return np.frexp(count.astype(float))[1].astype(np.int64)


#: What a level stands for: 1, and otherwise the middle of its counts on the log scale.
MEANING = np.concatenate([[0.0, 1.0], 2.0 ** (np.arange(2, 64) - 0.5)])


class LogFrequencySegment:
    """The filter's bits of one bucket."""

    def __init__(self, bits: np.ndarray, size: int, most: int):
        self.bits, self.size, self.most = bits, size, most

    @staticmethod
    def places(keys: np.ndarray, kind: int, lev: int, probe: int, size: int) -> np.ndarray:
        h = K.mix(keys + K.U64(kind << 60 | lev << 52 | probe << 49))
        return ((h >> K.U64(32)) * K.U64(size) >> K.U64(32)).astype(np.int64)

    @staticmethod
    def built(kinds: list[tuple[int, np.ndarray, np.ndarray]], size: int) -> np.ndarray:
        """Bytes of a segment of ``size`` bits that holds (kind, 48-bit keys, levels)."""
        bits = np.zeros(size, bool)
        for kind, keys, levels in kinds:
            for lev in range(1, int(levels.max(initial=0)) + 1):
                own = keys[levels >= lev]
                for probe in range(PROBES):
                    bits[LogFrequencySegment.places(own, kind, lev, probe, size)] = True
        return np.packbits(bits, bitorder="little")

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        out, live = np.zeros(len(keys), np.uint8), np.arange(len(keys) if self.size else 0)
        for lev in range(1, self.most + 1):
            for probe in range(PROBES):
                if not len(live):
                    return out
                at = self.places(keys[live], kind, lev, probe, self.size)
                live = live[(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1]
            out[live] = lev
        return out


class Model:
    """What scoring needs besides the counts: N, V, training documents, buckets."""

    def __init__(self, n: int, v: int, docs: int, buckets: int):
        self.n, self.v, self.docs, self.buckets, self.room = n, v, docs, buckets, n + 0.5 * (v + 1)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """(model, exact word counts and filter segments by bucket) from the texts of ``docs``."""
    n, size = buckets(docs), docs.count()
    small_batches(docs.sparkSession)
    counts = stored(docs.select("text").mapInArrow(_grams(n), _GRAMS).groupBy("bucket").applyInArrow(_counts, _COUNTS), 1 + size // WIDE)
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v"))).first()
    return Model(total["n"], total["v"], size, n), counts


_PARTS = "batch long, bucket int, kind int, keys binary, ids binary, begins binary, at binary"
_FOUND = "batch long, bucket int, kind int, keys binary, ids binary, begins binary, at binary, levels binary, counts binary"
_SCORES = "doc_id long, n_tokens long, n_known long, known_score double, score double"


def _schema(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])


def _units(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, token hashes, where each document begins) of runs of rows with about ``UNIT`` tokens."""
    held, first, size = [], 0, 0
    for _, b, data, offsets in K.chunks(column):
        tokens, begins = token_hashes(data, offsets)
        held.append((tokens, begins[:-1] + size))
        size += len(tokens)
        if size >= UNIT or b == len(column):
            yield first, b, np.concatenate([t for t, _ in held]), np.append(np.concatenate([x for _, x in held]), size)
            held, first, size = [], b, 0


def _parts(n: int):
    schema = _schema(_PARTS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype("<i8")
            for a, b, tokens, begins in _units(batch.column("text")):
                words, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                place = -1 - int(K.mix(np.array([number], K.U64))[0] % K.U64(n))
                rows = [(number, place, 0, _packed(order.astype("<u4")), ids[a:b].tobytes(), begins.astype("<i8").tobytes(), _packed(rank[at].astype("<u4")))]
                for kind, keys in zip(KINDS, (words, *(np.unique(gram_keys(h, n)) for h in gram_hashes(tokens, begins)))):
                    cut = _cuts(kind, keys, n)
                    rows += [(number, k, kind, _coded(kind, keys[cut[k] : cut[k + 1]]), int(cut[k + 1] - cut[k]).to_bytes(8, "little"), b"", b"") for k in np.flatnonzero(np.diff(cut)).tolist()]
                number += 1
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return dealt


def _looked_up(parts: pa.Table, counts: pa.Table) -> pa.Table:
    """Levels of the n-grams of one bucket and exact counts of its words; other rows pass through."""
    own = (counts.to_pylist() or [{"words": b"", "word_counts": b"", "bits": b"", "insertions": 0, "most": 0}])[0]
    words, values = K.unpack(own["words"], 6), np.frombuffer(own["word_counts"], "<i8")
    segment = LogFrequencySegment(np.frombuffer(own["bits"], np.uint8), BITS_PER_INSERTION * own["insertions"], own["most"])
    out = []
    for row in parts.to_pylist():
        row |= {"levels": b"", "counts": b""}
        if row["kind"]:
            keys = _decoded(row["kind"], row["keys"], int.from_bytes(row["ids"], "little"))
            row |= {"keys": row["keys"] if row["kind"] == 1 else b"", "levels": _packed(segment.levels(keys, row["kind"]))}
            if row["kind"] == 1:
                place = np.minimum(np.searchsorted(words, keys), max(0, len(words) - 1))
                c = np.where(words[place] == keys, values[place], 0) if len(words) else np.zeros(len(keys), np.int64)
                row["counts"] = _packed(c.astype("<u8"))
        out.append(row)
    return pa.Table.from_pylist(out, _schema(_FOUND))


def _joined(docs: int, room: float, buckets: int):
    def joined(rows: pa.Table) -> pa.Table:
        """Scores of the documents of one unit."""
        own = sorted(rows.to_pylist(), key=lambda r: r["bucket"])
        first = next(r for r in own if not r["kind"])
        of = lambda kind: [r for r in own if r["kind"] == kind]
        levels = lambda kind: MEANING[np.concatenate([_unpacked(r["levels"], int.from_bytes(r["ids"], "little")) for r in of(kind)])]
        begins = np.frombuffer(first["begins"], "<i8")
        words = np.concatenate([K.unpack(r["keys"], 6) for r in of(1)])
        at = _unpacked(first["keys"], len(words))[_unpacked(first["at"], int(begins[-1]))]  # words come by hash, token numbers by how often a word occurs
        count, word = np.concatenate([_unpacked(r["counts"], len(r["keys"]) // 6) for r in of(1)]), levels(1)[at]
        chance, context = (word + 0.5) / room, word
        for kind, hashes in zip(KINDS[1:], gram_hashes(words[at], begins)):
            before = np.empty_like(word)
            before[1:] = context[:-1]
            before[begins[:-1]] = max(docs, 1)
            context = np.minimum(levels(kind)[np.unique(gram_keys(hashes, buckets), return_inverse=True)[1]], before)
            chance = MIX * np.divide(context, before, out=np.zeros_like(word), where=before > 0) + (1 - MIX) * chance
        score = np.log10(chance)
        known, base, score = (np.add.reduceat(x, begins[:-1]) for x in ((count > 0).astype(np.int64)[at], np.log10(count + 0.5)[at], score))
        return pa.table({"doc_id": pa.array(np.frombuffer(first["ids"], "<i8")), "n_tokens": np.diff(begins), "n_known": known, "known_score": base, "score": score})
    return joined


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of ``docs``."""
    small_batches(docs.sparkSession)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_parts(model.buckets), _PARTS)
    held = counts.select("bucket", "insertions", "words", "word_counts", "most", "bits").groupBy("bucket")
    found = parts.groupBy("bucket").cogroup(held).applyInArrow(_looked_up, _FOUND)
    rows = found.groupBy("batch").applyInArrow(_joined(model.docs, model.room, model.buckets), _SCORES)
    return rows.select("doc_id", "n_tokens", "n_known", (F.col("known_score") - F.col("n_tokens") * F.lit(float(np.log10(model.room)))).alias("base_score"), "score")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Train on documents whose fold of 5 is not 1, score all."""
    docs = docs.where(F.col("doc_id").isNotNull())
    model, counts = train(docs.where(fold(F.col("doc_id"), 5) != 1))
    return score(docs, model, counts).select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(int(model.n)).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
