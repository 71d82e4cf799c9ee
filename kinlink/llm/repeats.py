"""Removal of byte strings that occur earlier in the corpus.

A byte goes if a string of ``LENGTH`` bytes that covers it, within its document, also starts earlier
(smaller doc_id, or same document and earlier start).

The method named for this operator, external induced sorting, scans one priority queue over all
suffixes in order.  That scan is one task over all rows, so it is replaced here by what it shares with
induced sorting: a sample of suffixes that the text itself chooses, names for them, and induction of
all other positions from the sample.

Sample.  Of the ``LENGTH - GRAM + 1`` grams of a string, the one with the least hash (the leftmost of
equals) is its anchor.  Equal strings have equal anchors at equal offsets, so only strings with the
same anchor gram can be equal, and consecutive strings mostly share one anchor.
Names.  An anchor occurrence stands for an interval of starts; the bytes under them are its context,
named by a hash.  In each task, and then in each hash bucket, only the first occurrence of a context
counts; every string of the later ones is a repeat.
Induction.  Where a gram has several contexts, the first occurrence of each is fetched with its bytes,
in document order, and its strings are compared byte for byte with those seen.  A bit array of bounded
size says which occurrences to fetch; a collision fetches one too many, never one too few.

Defined results.  Null text is empty; texts under ``LENGTH`` bytes lose nothing.  Rows without doc_id
are left out.  doc_id names a document: rows that repeat it with the same text come back once each,
with equal results, and do not count as earlier than one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import WIDE, buckets, documents, small_batches, stored

LENGTH = 100
GRAM = 24
#: Bits of the array that says which occurrences are fetched.
FETCH_BITS = 1 << 27
_PLACE = K.U64((1 << 31) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, document, place, first start, last start) of the anchors of a chunk; places and starts count from the chunk's begin."""
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, K.U64), none, none, none, none
    hashes = K.window_hashes(data, gram)
    keys = hashes & ~_PLACE | np.arange(len(hashes), dtype=K.U64)
    rows = -(-len(keys) // width)
    grid = np.full(rows * width, 2**64 - 1, K.U64)
    grid[: len(keys)] = keys
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    starts = np.arange(n - length + 1)
    least = np.minimum(ahead[starts], behind[starts + width - 1])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = doc[starts] == doc[starts + length - 1]
    starts, place = starts[whole], (least[whole] & _PLACE).astype(np.int64)
    if not len(starts):
        return np.zeros(0, K.U64), none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(starts) != 1)]))
    last = np.append(first[1:], len(starts)) - 1
    return hashes[place[first]], doc[starts[first]], place[first], starts[first], starts[last]


def _batch_anchors(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(gram, doc_id, place, first, last, context) of a batch, places from the document's begin."""
    ids, parts = batch.column("doc_id").to_numpy(zero_copy_only=False), []
    for a, b, data, offsets in K.chunks(batch.column("text")):
        gram, doc, place, lo, hi = anchors(data, offsets)
        context = K.span_hashes(data, lo, hi + LENGTH) if len(gram) else gram
        begin = offsets[doc]
        parts.append((gram, ids[a:b][doc], place - begin, lo - begin, hi - begin, K.mix(context + ((place - lo) << 8 | (hi - place)).astype(K.U64))))
    if not parts:
        return np.zeros(0, K.U64), *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, K.U64)
    return tuple(np.concatenate(c) for c in zip(*parts))


def _bucket(gram: np.ndarray, n: int) -> np.ndarray:
    """Anchors have small hashes, so they are mixed again."""
    return ((K.mix(gram) >> K.U64(32)) * K.U64(n) >> K.U64(32)).astype(np.int64)


def _first(name: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows are the first occurrence of their name."""
    order = np.lexsort((place, doc, name))
    head = np.ones(len(order), bool)
    head[1:] = name[order][1:] != name[order][:-1]
    group = np.cumsum(head) - 1
    lead = order[np.flatnonzero(head)][group]
    out = np.zeros(len(order), bool)
    out[order] = (doc[order] == doc[lead]) & (place[order] == place[lead])
    return out


_OUT = "kind string, bucket int, doc_id long, payload binary"
_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("payload", pa.binary())])


def _removed(n: int, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple]:
    """Rows of removed bytes for each of n groups of documents: packed (document, from, to)."""
    order, cut = K.split_by((K.mix(doc.astype(np.int64).view(K.U64)) % K.U64(n)).astype(np.int64), n)
    spans = np.stack([doc, lo, hi + LENGTH], 1)[order].astype("<i8")
    for k in range(n):
        if cut[k + 1] > cut[k]:
            yield "removed", -1 - k, 0, spans[cut[k] : cut[k + 1]].tobytes()


def _by_document(rows: pa.Table) -> pa.Table:
    """doc_id and its packed [from, to) pairs, of one group of documents."""
    spans = np.frombuffer(b"".join(rows.column("payload").to_pylist()), "<i8").reshape(-1, 3)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    cut = np.append(np.flatnonzero(np.concatenate([[True], spans[1:, 0] != spans[:-1, 0]])), len(spans))
    return pa.table({"doc_id": pa.array(spans[cut[:-1], 0].copy()), "spans": pa.array([spans[x:y, 1:].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())})


def _table(rows) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _named(n: int):
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, doc, place, lo, hi, context = _batch_anchors(batch)
            first = _first(K.mix(gram) ^ context, doc, place)
            again = ~first
            rows = list(_removed(n, doc[again], lo[again], hi[again]))
            own = np.flatnonzero(first)
            order, cut = K.split_by(_bucket(gram[own], n), n)
            own = own[order]
            for b in range(n):
                o = own[cut[b] : cut[b + 1]]
                if len(o):
                    head = len(o).to_bytes(8, "little")
                    rows.append(("anchors", b, 0, head + gram[o].astype("<u8").tobytes() + context[o].astype("<u8").tobytes() + doc[o].astype("<i8").tobytes() + place[o].astype("<u4").tobytes() + np.stack([place[o] - lo[o], hi[o] - place[o] + 128], 1).astype(np.uint8).tobytes()))
            yield from _table(rows).to_batches()
    return sent


def _unpack(payload: bytes) -> tuple[np.ndarray, ...]:
    n, at, out = int.from_bytes(payload[:8], "little"), 8, []
    for kind, size in (("<u8", 8), ("<u8", 8), ("<i8", 8), ("<u4", 4), (np.uint8, 2)):
        out.append(np.frombuffer(payload, kind, n * size // np.dtype(kind).itemsize, at))
        at += n * size
    side = out.pop().reshape(-1, 2).astype(np.int64)
    gram, context, doc, place = out[0], out[1], out[2], out[3].astype(np.int64)
    return gram, context, doc, place, place - side[:, 0], place + side[:, 1] - 128


def _occurrence(gram: np.ndarray, doc: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Bit of an occurrence within a segment of ``size`` bits."""
    h = K.mix(K.mix(gram + place.astype(K.U64)) + doc.astype(K.U64))
    return ((h >> K.U64(32)) * K.U64(size) >> K.U64(32)).astype(np.int64)


def _judged(n: int, bits: int):
    """Of one bucket: repeats of a whole context, and a segment of the bit array for what must be compared byte for byte."""
    def judge(rows: pa.Table) -> pa.Table:
        own = rows.to_pylist()
        out = [("removed", r["bucket"], 0, r["payload"]) for r in own if r["kind"] == "removed"]
        parts = [_unpack(r["payload"]) for r in own if r["kind"] == "anchors"]
        if parts:
            gram, context, doc, place, lo, hi = (np.concatenate(c) for c in zip(*parts))
            name = K.mix(gram) ^ context
            first = _first(name, doc, place)
            out += _removed(n, doc[~first], lo[~first], hi[~first])
            o = np.flatnonzero(first)
            order = o[np.lexsort((name[o], gram[o]))]
            g, c = gram[order], name[order]
            new = np.concatenate([[True], (g[1:] != g[:-1])])
            group = np.cumsum(new) - 1
            differs = np.bincount(group[1:], (c[1:] != c[:-1]) & ~new[1:], group[-1] + 1) > 0 if len(g) > 1 else np.zeros(group[-1] + 1, bool)
            ask = order[differs[group]]
            segment = np.zeros(bits // n // 8 * 8 + 8, bool)
            segment[_occurrence(gram[ask], doc[ask], place[ask], len(segment))] = True
            if len(ask):
                out.append(("ask", own[0]["bucket"], 0, np.packbits(segment, bitorder="little").tobytes()))
        return _table(out)
    return judge


_FETCHED = "bucket int, gram long, doc_id long, place int, first int, last int, bytes binary"


def _fetch(n: int, asked, bits: int):
    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, size = asked.value, bits // n // 8 * 8 + 8
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            columns: list[list] = [[] for _ in range(7)]
            for a, b, data, offsets in K.chunks(batch.column("text")):
                gram, doc, place, lo, hi = anchors(data, offsets)
                if not len(gram):
                    continue
                bucket = _bucket(gram, n)
                begin = offsets[doc]
                bit = _occurrence(gram, ids[a:b][doc], place - begin, size)
                take = np.zeros(len(gram), bool)
                for k in np.unique(bucket).tolist():
                    if k in segments:
                        o = np.flatnonzero(bucket == k)
                        take[o] = segments[k][bit[o] >> 3] >> (bit[o] & 7).astype(np.uint8) & 1 == 1
                o = np.flatnonzero(take)
                raw = data.tobytes()
                for column, values in zip(columns, (bucket[o].tolist(), gram[o].view(np.int64).tolist(), ids[a:b][doc[o]].tolist(), (place - begin)[o].tolist(), (lo - begin)[o].tolist(), (hi - begin)[o].tolist(), [raw[x : y + LENGTH] for x, y in zip(lo[o].tolist(), hi[o].tolist())])):
                    column += values
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "gram", "doc_id", "place", "first", "last", "bytes"])
    return fetched


def _compare(n: int):
    return lambda rows: _compared(n, rows)


def _compared(n: int, rows: pa.Table) -> pa.Table:
    """Strings of one bucket's fetched contexts, in document order within each gram."""
    rows = rows.sort_by([("gram", "ascending"), ("doc_id", "ascending"), ("place", "ascending")])
    out: list[tuple[int, int, int]] = []
    columns = [rows.column(c).to_pylist() for c in ("gram", "doc_id", "place", "first", "last", "bytes")]
    for _, entries in groupby(zip(*columns), key=lambda r: r[0]):
        entries = list(entries)
        if len(entries) < 2:
            continue
        seen: dict[tuple[int, bytes], tuple[int, int]] = {}
        for _, doc, place, first, last, raw in entries:
            for start in range(first, last + 1):
                was = seen.setdefault((place - start, raw[start - first : start - first + LENGTH]), (doc, start))
                if was < (doc, start):
                    out.append((doc, start, start))
    if not out:
        return _table([])
    doc, lo, hi = (np.array(c, np.int64) for c in zip(*out))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1)])
    head = np.flatnonzero(new)
    return _table(_removed(n, doc[head], lo[head], hi[np.append(head[1:], len(hi)) - 1]))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans (packed [from, to) pairs, may overlap) of removed bytes, for documents that lose any."""
    spark, n = docs.sparkSession, buckets(docs)
    small_batches(spark)
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    judged = stored(own.mapInArrow(_named(n), _OUT).groupBy("bucket").applyInArrow(_judged(n, FETCH_BITS), _OUT), 1 + own.count() // WIDE)
    asked = {r["bucket"]: np.frombuffer(bytes(r["payload"]), np.uint8) for r in judged.where("kind = 'ask'").select("bucket", "payload").toLocalIterator()}
    compared = own.mapInArrow(_fetch(n, spark.sparkContext.broadcast(asked), FETCH_BITS), _FETCHED).groupBy("bucket").applyInArrow(_compare(n), _OUT)
    return judged.where("kind = 'removed'").unionByName(compared).groupBy("bucket").applyInArrow(_by_document, "doc_id long, spans binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, spans, kept = [], [], []
        for text, parts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = (text or "").encode()
            merged: list[list[int]] = []
            for a, b in sorted(np.frombuffer(parts or b"", "<i8").reshape(-1, 2).tolist()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edge = [0, *(x for s in merged for x in s), len(raw)]
            sizes.append(len(raw))
            spans.append(merged)
            kept.append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])))
        yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes), kept (remaining bytes) of every document."""
    spans = repeated_spans(docs)
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(spans, "doc_id", "left").mapInArrow(_cut, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
