"""Benchmark decontamination by a prefix-filtered join with exact containment.

Every window of an item (``WINDOW`` consecutive words; a shorter item is one window) is a sequence of
word shingles (``SHINGLE`` words; a shorter window is one shingle).  All shingles of a window must
occur for the window to occur, so its necessary prefix is one shingle: the rarest of the window, by
occurrences counted over all documents.  A document position whose shingle is some window's prefix is
a candidate; the shingle's place in the window gives the only possible start (positional bound), the
document's words must hold the whole window (length bound), and the words are then compared.

Windows are told apart by their words, so that a passage of many items is compared once.  Items are
taken in blocks of bounded size, each broadcast and joined with all documents.

Defined results.  An empty benchmark hits nothing.  Null texts and texts without words have no hit; items without words are no item.
Items with equal words count each.  Rows without doc_id (item_id) are left out.  Repeated rows are
judged alike.  A result row is one document row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import documents, small_batches, stored, without

WINDOW = 10
SHINGLE = 5
#: Bytes of item texts in one block; larger benchmarks take several passes.
BLOCK_BYTES = 16 << 20


class Items:
    """Windows of a block of items, indexed by their prefix shingle."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int = WINDOW, width: int = SHINGLE):
        data, offsets = K.buffers(pa.array(texts, pa.string()))
        data = K.lower(data)
        starts, ends, before = K.words(data, offsets, K.ALNUM)
        words = K.span_hashes(data, starts, ends)
        self.width, self.data, self.starts, self.ends, self.words = width, data, starts, ends, words
        names: dict[tuple[bytes, ...], int] = {}
        rows, members = [], []
        for item, a, b in zip(ids, before[:-1].tolist(), before[1:].tolist()):
            n = min(window, b - a)
            spelt = [data[x:y].tobytes() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]
            for at in range(a, b - n + 1) if n else ():
                name = names.setdefault(tuple(spelt[at - a : at - a + n]), len(rows))
                if name == len(rows):
                    rows.append((at, n))
                    members.append(set())
                members[name].add(item)
        #: Of each distinct window: its items, the place of its first word, its length.
        self.items = [sorted(m) for m in members]
        self.at = np.array([r[0] for r in rows], np.int64)
        self.size = np.array([r[1] for r in rows], np.int64)
        self.shingles = {q: np.unique(self._at(q)) for q in np.unique(np.minimum(self.size, width)).tolist()}

    def _at(self, q: int) -> np.ndarray:
        """All shingles of q words of the windows whose shingles have q words."""
        own = np.minimum(self.size, self.width) == q
        places = [self.at[own] + k for k in range(int(self.size[own].max()) - q + 1)] if own.any() else []
        limit = np.concatenate([self.at[own] + self.size[own]] * len(places)) if places else np.zeros(0, np.int64)
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        return K.sequence_hashes(self.words, places[places + q <= limit], q)

    def order(self, seen: dict[int, int]) -> None:
        """Choose every window's rarest shingle (ties: the first) and index the windows by it."""
        self.index = {}
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            q = min(n, self.width)
            sums = np.stack([K.sequence_hashes(self.words, self.at[own] + k, q) for k in range(n - q + 1)], 1)
            rare = np.vectorize(lambda h: seen.get(h, 0), otypes=[np.int64])(sums.astype(np.int64)).argmin(1)
            key = sums[np.arange(len(own)), rare]
            order = np.argsort(key, kind="stable")
            self.index[n] = (key[order], rare[order], own[order])


def _near(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of ``values`` that are in the sorted ``table``: a 16-bit screen, then a search."""
    screen = np.zeros(1 << 16, bool)
    screen[(table >> K.U64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(screen[(values >> K.U64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, values[maybe]), max(0, len(table) - 1))
    return maybe[table[at] == values[maybe]] if len(table) else maybe[:0]


def _count(items: Items):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {q: (np.unique(t), np.zeros(len(np.unique(t)), np.int64)) for q, t in items.value.shingles.items()}
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column("text")):
                data = K.lower(data)
                starts, ends, before = K.words(data, offsets, K.ALNUM)
                words = K.span_hashes(data, starts, ends)
                for q, (table, n) in tables.items():
                    values = K.sequence_hashes(words, np.arange(max(0, len(words) - q + 1)), q)
                    np.add.at(n, np.searchsorted(table, values[_near(values, table)]), 1)
        keys = [t for t, _ in tables.values()]
        yield pa.record_batch([pa.array(np.concatenate(keys or [np.zeros(0, K.U64)]).astype(np.int64)), pa.array(np.concatenate([n for _, n in tables.values()] or [np.zeros(0, np.int64)]))], ["shingle", "n"])
    return counted


def _search(items: Items):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = items.value
        for batch in batches:
            n_words, spans, hits = [], [], []
            for a, b, data, offsets in K.chunks(batch.column("text")):
                data = K.lower(data)
                starts, ends, before = K.words(data, offsets, K.ALNUM)
                words = K.span_hashes(data, starts, ends)
                doc = np.repeat(np.arange(b - a), np.diff(before))
                per_doc: dict[int, tuple[set, set]] = {}
                for n, (key, rare, window) in it.index.items():
                    q = min(n, it.width)
                    values = K.sequence_hashes(words, np.arange(max(0, len(words) - q + 1)), q)
                    at = _near(values, key)
                    lo, hi = np.searchsorted(key, values[at], "left"), np.searchsorted(key, values[at], "right")
                    at, k = np.repeat(at, hi - lo), np.concatenate([np.arange(x, y) for x, y in zip(lo, hi)] or [np.zeros(0, np.int64)]).astype(np.int64)
                    start = at - rare[k]
                    ok = (start >= 0) & (start + n <= len(words))
                    start, k = start[ok], k[ok]
                    ok = doc[start] == doc[start + n - 1]
                    start, k = start[ok], k[ok]
                    k = window[k]
                    for j in range(n):  # word for word: first their hashes, then their bytes
                        ok = words[start + j] == it.words[it.at[k] + j]
                        start, k = start[ok], k[ok]
                    for j in range(n):
                        mine, own = start + j, it.at[k] + j
                        size = ends[mine] - starts[mine]
                        ok = size == it.ends[own] - it.starts[own]
                        ok[ok] = K.same_spans(data, starts[mine[ok]], it.data, it.starts[own[ok]], size[ok])
                        start, k = start[ok], k[ok]
                    for s, w in zip(start.tolist(), k.tolist()):
                        mine = per_doc.setdefault(int(doc[s]), (set(), set()))
                        mine[0].add((s - int(before[doc[s]]), s - int(before[doc[s]]) + n))
                        mine[1].update(it.items[w])
                n_words += np.diff(before).tolist()
                for k in range(b - a):
                    mine = per_doc.get(k, ((), ()))
                    spans.append([list(x) for x in _merged(mine[0])])
                    hits.append(sorted(mine[1]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "n_words", "spans", "items"])
    return found


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def find_items(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged runs of hit words, from 0), items (ids that occur) per document row."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    source = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + int(total) // block_bytes
    out = None
    if blocks > 1:  # rows need a name of their own to meet again
        own = stored(own.withColumn("row", F.monotonically_increasing_id()))
    for block in range(blocks):
        rows = source.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        shared = spark.sparkContext.broadcast(items)
        seen = own.select("text").mapInArrow(_count(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 0").toPandas()
        items.order(dict(zip(seen["shingle"].tolist(), seen["n"].tolist())))
        part = own.select("doc_id" if blocks == 1 else F.col("row").alias("doc_id"), "text").mapInArrow(_search(spark.sparkContext.broadcast(items)), "doc_id long, n_words long, spans array<array<long>>, items array<long>")
        out = part if out is None else out.unionByName(part)
    if blocks == 1:
        return out
    joined = out.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr("""aggregate(spans, cast(array() as array<array<bigint>>), (acc, x) ->
        case when size(acc) > 0 and x[0] <= acc[size(acc) - 1][1]
             then concat(slice(acc, 1, size(acc) - 1), array(array(acc[size(acc) - 1][0], greatest(acc[size(acc) - 1][1], x[1]))))
             else concat(acc, array(x)) end)""")
    return joined.withColumn("spans", merged).join(own.select(F.col("row"), F.col("doc_id").alias("id")), F.col("row") == F.col("doc_id")).select(F.col("id").alias("doc_id"), "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest columns of ``find_items``."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return find_items(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Filter form: whole rows of the documents without a hit. Rows without doc_id go; a doc_id with several texts goes if one of them has a hit."""
    return without(docs, decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM b, range(1, len(w) - least(len(w), 10) + 2) r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, sizes.n, array_to_string(list_slice(w, i, i + sizes.n - 1), ' ') AS s FROM d, sizes, range(1, len(w) - sizes.n + 2) r(i)),
hit AS (SELECT doc_id, i, win.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, range(i, i + n) r(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
