"""Candidate retrieval: weighted key overlap, top k in both directions, merged views.

Key tables are (part, eid, key), or (part, eid, keys) with an array a row.  A key seeds a search if at most ``seed_cap`` records of the
other side have it, or if it is one of the ``rarest`` keys of the searching record, so that a record of
common keys only is searched too.  Keys that do not seed are added to the best ``verify`` of each record only.

No pair is a row before it is among the best of a record.  Records of equal keys are one class.  A block of
one side's classes meets the other side's, block by block, in one task, which adds up the postings of the
seeding keys in an array and keeps the best of each class.  Memory goes with the blocks; the postings that
are read go with the seeds, as the definition asks.  Occurrences of keys are no rows either: records go in
chunks with a dictionary of their own, and only its entries are counted and numbered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import dropped, saved

#: Of the reference's stage: postings up to which a key seeds, pairs verified and kept, by direction.
SEED_CAP, VERIFY, KEEP, TRIM = (3000, 1000), (400, 200), (40, 8), (30, 2)
RAREST = 3
#: Sizes of a task: postings at once, keys and classes of a block of the searched side, records held for a block of queries; blocks that use the cores; keys of a chunk of records.
CELLS, PLACES, DOCS, HELD = 2_000_000, 8_000_000, 100_000, 4_000_000
BLOCKS, CHUNK = 3, 250_000
MOST_TASKS = 1000


def key_weights(keys: DataFrame) -> DataFrame:
    """part, key, idf = max(ln(N / df), 0.01) over all records of the partition."""
    n = keys.groupBy("part").agg(F.countDistinct("eid").alias("n"))
    return keys.groupBy("part", "key").agg(F.count(F.lit(1)).alias("df")).join(n, "part").select("part", "key", "df", F.greatest(F.log(F.col("n") / F.col("df")), F.lit(0.01)).alias("idf"))


def row_norms(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("part", "eid").agg(F.sqrt(F.sum("idf")).alias("norm"))


_CHUNK = "chunk long, parts array<string>, keys array<string>, n_s1 array<int>, n_r array<int>, n array<int>, r_part array<string>, eid array<long>, n_keys array<int>, codes binary, sides binary"
_RECORD = "part string, is_s1 boolean, eid long, cls binary, norm double, n_keys int, of int, kids binary, df binary"
_RECORD_ARROW = pa.schema([("part", pa.string()), ("is_s1", pa.bool_()), ("eid", pa.int64()), ("cls", pa.binary()), ("norm", pa.float64()), ("n_keys", pa.int32()), ("of", pa.int32()), ("kids", pa.binary()), ("df", pa.binary())])
_FOUND = "part string, is_s1 boolean, cls binary, d array<long>, score array<double>"
_FOUND_ARROW = pa.schema([("part", pa.string()), ("is_s1", pa.bool_()), ("cls", pa.binary()), ("d", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))])


def _idf(of: np.ndarray, df: np.ndarray) -> np.ndarray:
    return np.maximum(np.log(of / df), 0.01)


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(kind)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in chunks of about ``CHUNK`` keys: their distinct (part, key) with how many records have them, and each record's keys as places among these."""
    made = TaskContext.get().partitionId() << 32
    for batch in batches:
        total = np.cumsum(sum(_numbers(batch.column(c).value_lengths(), np.int64) for c in ("s1", "r")))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK, "right")))
            some, a = batch.slice(a, b - a), b
            part, s1, r = some.column("part").dictionary_encode(), some.column("s1"), some.column("r")
            rec = np.concatenate([np.repeat(np.arange(some.num_rows), _numbers(x.value_lengths(), np.int64)) for x in (s1, r)])
            on_s1 = np.arange(len(rec)) < len(s1.flatten())
            flat = pa.concat_arrays([s1.flatten(), r.flatten()]).dictionary_encode()
            n = len(flat.dictionary)
            own, code = np.unique(_numbers(part.indices, np.int64)[rec] * n + _numbers(flat.indices, np.int64), return_inverse=True)
            pairs, same = np.unique(rec * len(own) + code, return_inverse=True)
            rec, code = pairs // len(own), pairs % len(own)
            sides = [np.bincount(same[x], minlength=len(pairs)) > 0 for x in (on_s1, ~on_s1)]
            lists = [part.dictionary.take(pa.array(own // n)), flat.dictionary.take(pa.array(own % n)), *(pa.array(np.bincount(code[x], minlength=len(own)).astype(np.int32)) for x in (*sides, slice(None)))]
            lists += [some.column("part"), some.column("eid"), pa.array(np.bincount(rec, minlength=some.num_rows).astype(np.int32))]
            raw = code.astype("<i4"), (sides[0] + 2 * sides[1]).astype(np.uint8)
            row = [pa.array([made], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists), *(pa.array([x.tobytes()], pa.binary()) for x in raw)]
            yield pa.record_batch(row, names=[c.split()[0] for c in _CHUNK.split(", ")])
            made += 1


def _records(seed_cap: tuple[int, int], rarest: int):
    """Records with the keys that the other side has too, the norm over all keys, and a name that records of equal keys and norms share."""
    def rows_of(chunk: dict) -> list[tuple]:
        known = np.empty((5, len(chunk["known"]["pos"])))
        pos = chunk["known"]["pos"]
        for k, c in enumerate(("kid", "df", "post_s1", "post_r", "of")):
            known[k, pos] = chunk["known"][c]
        code, weights = np.frombuffer(chunk["codes"], "<i4"), _idf(known[4], known[1])
        n = len(chunk["n_keys"])
        rec, rows = np.repeat(np.arange(n), chunk["n_keys"]), []
        every = np.lexsort((known[0, code], rec))
        for is_s1 in (True, False):
            mine = every[chunk["sides"][every] & (1 if is_s1 else 2) > 0]
            own_rec, kid, idf = rec[mine], known[0, code[mine]].astype("<i4"), weights[code[mine]]
            other, norm = known[3 if is_s1 else 2, code[mine]].astype(np.int64), np.sqrt(np.bincount(own_rec, idf, n))
            size = np.bincount(own_rec, minlength=n)
            order = np.lexsort((kid, other, other == 0, own_rec))
            place = np.empty(len(kid), np.int64)
            place[order] = np.arange(len(kid)) - (np.cumsum(size) - size)[own_rec] + 1
            seeds = ((other <= seed_cap[not is_s1]) | (place <= rarest)).astype(np.uint8)
            own = other > 0
            of, df = (known[x, code[mine]].astype(np.int64)[own] for x in (4, 1))
            k, w, s, cut = kid[own], (2 * df + seeds[own]).astype("<u4"), seeds[own], np.append(0, np.cumsum(np.bincount(own_rec[own], minlength=n))).tolist()
            for i in range(n):
                x, y = cut[i], cut[i + 1]
                if x < y:
                    raw = k[x:y].tobytes(), w[x:y].tobytes()
                    cls = hashlib.blake2b(raw[0] + s[x:y].tobytes() + norm[i].tobytes(), digest_size=16).digest()
                    rows.append((chunk["part"][i], is_s1, chunk["eid"][i], cls, float(norm[i]), y - x, int(of[x]), *raw))
        return rows

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                col = lambda c: batch.column(c).slice(i, 1).flatten()  # noqa: E731,B023
                known = col("known")
                chunk = {"part": col("r_part").to_pylist(), "eid": col("eid").to_pylist(), "n_keys": _numbers(col("n_keys"), np.int64), "codes": batch.column("codes")[i].as_py(), "sides": np.frombuffer(batch.column("sides")[i].as_py(), np.uint8),
                         "known": {c: known.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "kid", "df", "post_s1", "post_r", "of")}}
                rows = rows_of(chunk)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(_RECORD_ARROW), _RECORD_ARROW)], schema=_RECORD_ARROW)
    return made


def weighted_records(s1_keys: DataFrame, r_keys: DataFrame, seed_cap: tuple[int, int], rarest: int) -> DataFrame:
    """A row for each record and side, with keys as numbers, in the order of (part, key), without gaps; df has twice the records of a key, plus 1 if it seeds."""
    spark = s1_keys.sparkSession

    def side(t: DataFrame, own: str, other: str) -> DataFrame:
        return t.select("part", "eid", (F.col("keys") if "keys" in t.columns else F.array("key")).alias(own), F.array().cast("array<string>").alias(other))

    each = side(s1_keys, "s1", "r").unionByName(side(r_keys, "r", "s1")).where("size(s1) + size(r) > 0")
    each = each.groupBy("part", "eid").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("s1", "r")))
    chunks = saved(each.mapInArrow(_chunks, _CHUNK))
    n = chunks.select(F.explode("r_part").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("of"))
    entries = chunks.select(F.explode(F.arrays_zip("parts", "keys", "n_s1", "n_r", "n")).alias("x")).select(F.col("x.parts").alias("part"), F.col("x.keys").alias("key"), "x.n_s1", "x.n_r", "x.n")
    stats = entries.groupBy("part", "key").agg(F.sum("n_s1").alias("post_s1"), F.sum("n_r").alias("post_r"), F.sum("n").alias("df")).join(n, "part")
    stats = stats.select("part", "key", *(F.col(c).cast("int").alias(c) for c in ("post_s1", "post_r", "df", "of")))
    stats = saved(stats.orderBy("part", "key").withColumn("place", F.monotonically_increasing_id()))
    task, first, at = F.shiftright("place", 33), [], 0
    for t, rows in sorted((r["t"], r["n"]) for r in stats.groupBy(task.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()):
        first += [at] * (t + 1 - len(first))
        at += rows
    starts = F.array(*(F.lit(x).cast("long") for x in first or [0]))
    stats = stats.withColumn("kid", (F.get(starts, task.cast("int")) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).drop("place")
    mine = chunks.select("chunk", F.posexplode(F.arrays_zip("parts", "keys")).alias("pos", "x")).select("chunk", "pos", F.col("x.parts").alias("part"), F.col("x.keys").alias("key"))
    known = mine.join(stats, ["part", "key"]).groupBy("chunk").agg(F.collect_list(F.struct("pos", "kid", "df", "of", "post_s1", "post_r")).alias("known"))
    records = saved(chunks.drop("parts", "keys", "n_s1", "n_r", "n").join(known, "chunk").mapInArrow(_records(seed_cap, rarest), _RECORD))
    for table in (chunks, stats):
        dropped(table)
    spark._jvm.System.gc()  # else shuffles that nothing reads again stay on the disks until the driver happens to collect its garbage
    return records


def _slices(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the runs [begin, begin + n), one after another."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(begin - end + n, n)


def _raw(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The bytes of all values, one after another."""
    out = [b"" if x is None else x for c in column.chunks for x in c.to_pylist()]
    return np.frombuffer(b"".join(out), kind)


class Block:
    """A block of one side's classes with its postings."""

    def __init__(self, rows: pa.Table):
        kids = _raw(rows["kids"], "<i4")
        self.norm = rows["norm"].to_numpy()
        self.n = rows["n_keys"].to_numpy().astype(np.int64)
        self.begin = np.cumsum(self.n) - self.n
        both = kids.astype(np.int64) << 32 | np.arange(len(kids))
        both.sort()
        kids, place = (both >> 32).astype(np.int32), both & 0xFFFFFFFF
        self.first = np.flatnonzero(np.append(True, kids[1:] != kids[:-1]))
        self.known, self.size = kids[self.first], np.diff(np.append(self.first, len(kids)))
        self.keys = np.empty(len(kids), np.int32)
        self.keys[place] = np.repeat(np.arange(len(self.known), dtype=np.int32), self.size)
        self.posts = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)[place]
        eids = rows["eids"].combine_chunks()
        self.n_members = _numbers(eids.value_lengths(), np.int64)
        members = _numbers(eids.flatten(), np.int64)
        self.members = members[np.lexsort((members, np.repeat(np.arange(len(self.n)), self.n_members)))]
        self.begin_members = np.cumsum(self.n_members) - self.n_members
        self.least = self.members[self.begin_members]

    def best(self, queries: Queries, verify: int, held: list) -> None:
        """Merge into ``held`` (value, eid, score of the best ``verify`` records so far) what this block has for each query."""
        scratch, docs, share = np.zeros(len(self.known)), len(self.norm), 1 / self.norm
        for low, high in queries.pieces(CELLS):
            x, y = queries.cut[low], queries.cut[high]
            at = np.minimum(np.searchsorted(self.known, queries.kids[x:y]), len(self.known) - 1)
            here = self.known[at] == queries.kids[x:y]
            for q in range(low, high):
                a, b = queries.cut[q], queries.cut[q + 1]
                mine = here[a - x : b - x]
                own, idf, seeds = at[a - x : b - x][mine], queries.idf[a:b][mine], queries.seeds[a:b][mine]
                key, weight = own[seeds], idf[seeds]
                if not len(key):
                    continue
                n = self.size[key]
                cut, sums, a = np.append(0, np.cumsum(n)), None, 0
                while a < len(key):  # so many postings at once
                    b = max(a + 1, int(np.searchsorted(cut, cut[a] + CELLS, "right")) - 1)
                    some = np.bincount(self.posts[_slices(self.first[key[a:b]], n[a:b])], np.repeat(weight[a:b], n[a:b]), docs)
                    sums, a = some if sums is None else sums + some, b
                value = sums * share
                # values are whole billionths, so what lies a little under a bar is still looked at
                least = (held[q][0][-1] - 1.5) / 1e9 if held[q] is not None and len(held[q][0]) >= verify else 0.0
                c = np.flatnonzero(value > max(least, 0.0))
                if len(c) > verify:
                    value = value[c]
                    c = c[value >= np.partition(value, len(c) - verify)[len(c) - verify] - 2e-9]
                if len(c):
                    held[q] = self._merged(held[q], c, np.floor(sums[c] / self.norm[c] * 1e9 + 0.5).astype(np.int64), own, idf, queries.norm[q], verify, scratch)

    def _merged(self, held, c, v, at, idf, norm, verify, scratch):
        if held is not None and len(held[0]) >= verify:
            good = v >= held[0][-1]  # an equal value may have a smaller eid
            c, v = c[good], v[good]
        if len(v) > verify:
            good = v >= np.partition(v, len(v) - verify)[len(v) - verify]
            c, v = c[good], v[good]
        if not len(v):
            return held
        # every class has a member, so those behind the first ``verify`` classes have no place
        order = np.lexsort((self.least[c], -v))[:verify]
        c, v = c[order], v[order]
        n = self.n_members[c]
        full = np.searchsorted(np.cumsum(n), verify)
        if full < len(v):
            good = v >= v[full]
            c, v, n = c[good], v[good], n[good]
        scratch[at] = idf
        total = np.add.reduceat(scratch[self.keys[_slices(self.begin[c], self.n[c])]], np.cumsum(self.n[c]) - self.n[c])
        scratch[at] = 0.0
        score = np.floor(total / (norm * self.norm[c]) * 1e6 + 0.5).astype(np.int64)
        rows = np.repeat(v, n), self.members[_slices(self.begin_members[c], n)], np.repeat(score, n)
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows))
        order = np.lexsort((rows[1], -rows[0]))[:verify]
        return tuple(x[order] for x in rows)


class Queries:
    """The queries of a block: names, norms, and keys with weights and whether they seed, one after another."""

    def __init__(self, rows: pa.Table):
        self.cls, self.norm = rows["cls"].to_pylist(), rows["norm"].to_numpy()
        self.cut = np.append(0, np.cumsum(rows["n_keys"].to_numpy().astype(np.int64)))
        self.kids, df = _raw(rows["kids"], "<i4"), _raw(rows["df"], "<u4")
        self.seeds, self.idf = (df & 1).astype(bool), _idf(np.repeat(rows["of"].to_numpy(), np.diff(self.cut)), df >> 1)

    def pieces(self, keys: int) -> Iterator[tuple[int, int]]:
        """Runs of queries with about so many keys."""
        a = 0
        while a < len(self.cls):
            b = max(a + 1, int(np.searchsorted(self.cut, self.cut[a] + keys, "right")) - 1)
            yield a, b
            a = b


def _searched(verify: tuple[int, int], keep: tuple[int, int]):
    """Rows sorted by (block, turn): the queries of a block, turn -1, then the other side, one block a turn."""
    def out(part: str, is_s1: bool, queries: Queries, held: list) -> pa.RecordBatch:
        cls, d, score = [], [], []
        for name, h in zip(queries.cls, held):
            if h is not None:
                order = np.lexsort((h[1], -h[2]))[: keep[not is_s1]]
                cls.append(name)
                d.append(h[1][order])
                score.append(h[2][order] / 1e6)
        k = len(cls)
        return pa.record_batch([pa.array([part] * k, pa.string()), pa.array([is_s1] * k, pa.bool_()), pa.array(cls, pa.binary()), pa.array(d, pa.list_(pa.int64())), pa.array(score, pa.list_(pa.float64()))], schema=_FOUND_ARROW)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
        now, rows = None, []
        for batch in batches:
            block, turn = _numbers(batch.column("block"), np.int64), _numbers(batch.column("turn"), np.int64)
            ends = np.flatnonzero(np.append((block[1:] != block[:-1]) | (turn[1:] != turn[:-1]), True)) + 1 if len(block) else []
            a = 0
            for b in ends:
                if now != (block[a], turn[a]):
                    if rows:
                        yield *now, pa.Table.from_batches(rows)
                    now, rows = (block[a], turn[a]), []
                rows.append(batch.slice(a, b - a))
                a = b
        if rows:
            yield *now, pa.Table.from_batches(rows)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, held, of = None, None, [], None
        for block, turn, rows in turns(batches):
            if block != now:
                if queries:
                    yield out(*of, queries, held)
                now, queries = block, None
            if turn < 0:
                queries, of = Queries(rows), (rows["part"][0].as_py(), rows["is_s1"][0].as_py())
                held = [None] * len(queries.cls)
            elif queries:
                Block(rows).best(queries, verify[not of[1]], held)
        if queries:
            yield out(*of, queries, held)
    return found


def _slots(spark, n: int) -> list[int]:
    """For each of n partitions a number that Spark deals to it."""
    out = {}
    for r in spark.range(max(100, 20 * n)).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect():
        out[r["p"]] = r["id"]
    return [out.get(p, p) for p in range(n)]


def best_overlaps(s1_keys: DataFrame, r_keys: DataFrame, seed_cap: tuple[int, int] = SEED_CAP, verify: tuple[int, int] = VERIFY, keep: tuple[int, int] = KEEP, rarest: int = RAREST) -> DataFrame:
    """part, is_s1 (whether q is an entity), q, d, score, rank from 0: of each record the ``keep`` best of its ``verify`` records with the largest seeded overlap.

    Only directions with a positive ``keep`` are searched.  Records of equal keys and norms are one class:
    as a query it is searched once; as a result it needs its ``verify`` smallest eids, as ties go by eid.
    """
    spark, w = s1_keys.sparkSession, ["part", "is_s1", "cls"]
    records = weighted_records(s1_keys, r_keys, seed_cap, rarest)
    first = records.select(*w, "eid", "n_keys").withColumn("_k", F.row_number().over(W.partitionBy(*w).orderBy("eid"))).where(F.col("_k") <= max(verify))
    heads = saved(first.groupBy(*w).agg(F.collect_list("eid").alias("eids"), F.min("eid").alias("eid"), F.first("n_keys").alias("n_keys")))
    sizes = {(r["part"], r["is_s1"]): (r["n"], r["places"]) for r in heads.groupBy("part", "is_s1").agg(F.count(F.lit(1)).alias("n"), F.sum("n_keys").alias("places")).collect()}
    plan = []
    for (part, s1), (n, _) in sizes.items():
        if keep[not s1] and (part, not s1) in sizes:
            m, places = sizes[part, not s1]
            blocks = max(-(-n * verify[not s1] // HELD), min(BLOCKS, -(-n // 2000)))
            plan += [(-n * places / blocks, part, s1, max(-(-int(places) // PLACES), -(-m // DOCS)))] * blocks
    plan.sort()  # the longest tasks come first
    tasks = min(max(1, len(plan)), MOST_TASKS)
    slots = _slots(spark, tasks)
    blocks = spark.createDataFrame([(part, s1, i, slots[i % tasks], turns) for i, (_, part, s1, turns) in enumerate(plan)], "part string, is_s1 boolean, block int, slot long, turns int")
    blocks = blocks.groupBy("part", "is_s1").agg(F.collect_list(F.struct("block", "slot")).alias("blocks"), F.first("turns").alias("turns"))
    asked = blocks.select("part", "is_s1", F.col("blocks").alias("asked"))
    searched = blocks.select("part", (~F.col("is_s1")).alias("is_s1"), F.col("blocks").alias("searched"), "turns")
    h = F.xxhash64("cls")
    classes = records.join(heads.drop("n_keys", "cls"), ["part", "is_s1", "eid"]).join(F.broadcast(asked), ["part", "is_s1"], "left").join(F.broadcast(searched), ["part", "is_s1"], "left")
    as_query = F.when(F.col("asked").isNull(), F.array()).otherwise(F.array(F.struct(F.get("asked", F.pmod(h, F.size("asked")).cast("int")).alias("to"), F.lit(-1).alias("turn"))))
    as_result = F.coalesce(F.transform("searched", lambda x: F.struct(x.alias("to"), F.pmod(h, F.col("turns")).cast("int").alias("turn"))), F.array())
    dealt = classes.select("part", "is_s1", "cls", "norm", "n_keys", "of", "kids", "df", "eids", F.explode(F.concat(as_query, as_result)).alias("x"))
    query = F.col("x.turn") < 0
    dealt = dealt.select("x.to.slot", "x.to.block", "x.turn", "part", "is_s1", F.when(query, F.col("cls")).alias("cls"), "norm", "n_keys", "of", "kids", F.when(query, F.col("df")).alias("df"), F.when(~query, F.col("eids")).alias("eids"))
    dealt = dealt.repartition(tasks, "slot").sortWithinPartitions("block", "turn")
    found = saved(dealt.mapInArrow(_searched(verify, keep), _FOUND))
    each = records.select(*w, F.col("eid").alias("q")).join(found, w).select("part", "is_s1", "q", F.posexplode(F.arrays_zip("d", "score")).alias("rank", "x"))
    return each.select("part", "is_s1", "q", "x.d", "x.score", "rank")


def topk_overlap(queries: DataFrame, docs: DataFrame, seed_cap: int = SEED_CAP[0], verify: int = VERIFY[0], k: int = KEEP[0]) -> DataFrame:
    """(part, q, d, score, rank from 0): of each query the k documents with the largest normalised overlap."""
    return best_overlaps(queries, docs, (seed_cap, 0), (verify, 0), (k, 0)).drop("is_s1")


def union_trim(forward: DataFrame, backward: DataFrame, trim_s1: int, trim_r: int) -> DataFrame:
    """Pairs that rank high in either direction; an absent rank is -1, the score the larger one."""
    f = forward.select(F.col("q").alias("s1"), F.col("d").alias("r"), F.col("score").alias("a"), F.col("rank").alias("rank_s1"))
    b = backward.select(F.col("d").alias("s1"), F.col("q").alias("r"), F.col("score").alias("b"), F.col("rank").alias("rank_r"))
    kept = f.join(b, ["s1", "r"], "full").where((F.col("rank_s1") < trim_s1) | (F.col("rank_r") < trim_r))
    return kept.select("s1", "r", F.greatest("a", "b").alias("score"), F.coalesce("rank_s1", F.lit(-1)).alias("rank_s1"), F.coalesce("rank_r", F.lit(-1)).alias("rank_r"))


def search_view(s1_keys: DataFrame, r_keys: DataFrame, keep: tuple[int, int] = KEEP, trim: tuple[int, int] = TRIM, **search) -> DataFrame:
    """Both directions from one table of classes, trimmed."""
    best = saved(best_overlaps(s1_keys, r_keys, keep=keep, **search))
    return union_trim(best.where("is_s1"), best.where("NOT is_s1"), *trim)


def merge_views(views: dict[int, DataFrame]) -> DataFrame:
    """Views by bit: union of pairs, bits or-ed, best score."""
    return merge_views_of({bit: [view] for bit, view in views.items()})


def merge_views_of(views: dict[int, list[DataFrame]]) -> DataFrame:
    rows = None
    for bit, tables in views.items():
        for view in tables:
            part = view.select("s1", "r", "score", F.lit(bit).cast("long").alias("bit"))
            rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("s1", "r").agg(F.bit_or("bit").alias("views"), F.max("score").alias("score"))


def partition_by_country(records: DataFrame) -> DataFrame:
    """part for each record: its trimmed label; a record without one joins every partition of the others (the empty one if there is no other)."""
    label = F.trim(F.coalesce(F.col("country"), F.lit("")))
    rows = records.withColumn("part", label)
    labels = rows.where("part != ''").select("part").distinct()
    # labels are an open but small set; an unlabelled record meets each through the constant key
    each = labels.select(F.lit("").alias("_empty"), F.col("part").alias("_part"))
    spread = rows.where("part = ''").join(each, F.col("part") == F.col("_empty"), "left").withColumn("part", F.coalesce("_part", F.lit(""))).drop("_empty", "_part")
    return rows.where("part != ''").unionByName(spread)


def exact_key_rescue(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs whose key is held by one record on each side (columns eid, key)."""
    alone = lambda df, name: df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("eid").alias(name)).where("n = 1").drop("n")
    return alone(left, "s1").join(alone(right, "r"), "key").select("s1", "r", "key")


def capped_key_join(left: DataFrame, right: DataFrame, most: int = 20) -> DataFrame:
    """Equal keys, without keys that more than ``most`` records of the right side share."""
    few = right.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("key")
    return left.select(F.col("eid").alias("s1"), "key").join(right.join(few, "key").select(F.col("eid").alias("r"), "key"), "key").select("s1", "r", "key")
