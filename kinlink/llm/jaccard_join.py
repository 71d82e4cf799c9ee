"""N-gram Jaccard join: which documents have shingle sets with Jaccard similarity of 0.75 or more.

1. Extended prefixes.  Sets are ordered by hash.  Two linked sets share at least a tenth of the needed
   overlap within prefixes that are a tenth of the set longer than the plain prefix filter's.  Prefixes
   go to hash buckets, which tell each document how many of its tokens other sets share; a document
   with fewer than the bound links with nothing.  Only 32 bits of a token are dealt, as tokens taken for
   one another can only add documents that are looked at further, and 48 bits of a set's name.
2. The remaining sets, one per distinct set, are ordered by document frequency (exact for all tokens
   but the rare ones, which tie) and joined on the tokens of their plain prefixes.
3. First each set is compared with one pivot of its groups: linear work that settles most groups, as
   what is in one component needs no more comparison.  In groups that are still in several components,
   bit maps that bound the overlap say which sets may link; these join sets to clusters.  A cluster is
   one row for each set, and no pair is a row: its task finds the pairs that share a token of both
   prefixes, screens and compares those in different components, and joins the components of each link
   at once, so a set that links needs few comparisons more.  No link that joins components is missed.
4. Comparison with a pivot: the sets are stored in a trie, most frequent token first, so near copies
   share paths.  The traversal carries the overlap with the pivot down shared paths and prunes as soon
   as the overlap so far and the tokens that remain cannot reach the needed overlap.

Every step only leaves out pairs that cannot link.  Tokens and, but for step 1, sets are told apart by
64-bit hashes, not by their bytes.

Defined results.  Null and empty texts, and texts without words, have an empty set and link with
nothing.  Texts of fewer than five words have one shingle.  Rows without doc_id are left out.
Repeated rows have equal sets and so one component; rows that repeat a doc_id with another text are
documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import NARROW, WIDE, buckets, documents, dropped, small_batches, stored, without

WIDTH = 5
PERCENT = 75
#: Tasks that share the pairs of a large group or cluster at most, and the members for which one more task joins in.
PARTS = 16
PER_PART = 512
#: Tokens in at least one of ``2**FREQUENT`` of all places are ordered by their count, so at most ``2**FREQUENT`` are.
FREQUENT = 20
LEAST_FREQUENT = 16
#: Bits of the array that says which sets take part in the join.
TAKE_BITS = 1 << 25
#: Sizes of the bit map that bounds a set's overlap with others; a larger map folds into a smaller one.
MAP_BITS = (256, 512, 1024, 2048, 4096, 8192)
#: Sets that one pivot is compared with in one task.
PER_PIVOT = 256


def needed(n: np.ndarray | int):
    """Least overlap of a set of n tokens with any set it links with."""
    return (PERCENT * n + 99) // 100


def overlap(n, m):
    """Least overlap of linked sets of n and m tokens."""
    return (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bucket(tokens: np.ndarray, n: int) -> np.ndarray:
    return ((K.mix(tokens) >> K.U64(32)) * K.U64(n) >> K.U64(32)).astype(np.int64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# 1. extended prefixes

_POSTS = "batch long, bucket int, at binary, tokens binary, sets binary, base boolean"
_POSTS_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("at", pa.binary()), ("tokens", pa.binary()), ("sets", pa.binary()), ("base", pa.bool_())])
_SHARED_ARROW = pa.schema([("batch", pa.int64()), ("at", pa.binary()), ("n", pa.binary()), ("sets", pa.binary()), ("base", pa.bool_())])


def _posts(n: int):
    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sets = list(K.text_shingles(batch.column("text"), WIDTH))
            ids = np.array([set_id(s) if len(s) else 0 for s in sets], np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            _, first = np.unique(ids, return_index=True)
            prefix = [sets[i][: int(sizes[i] - needed(sizes[i]) + max(1, -(-sizes[i] // 10)))] for i in first.tolist()]
            at = np.repeat(first, [len(p) for p in prefix])
            tokens = np.concatenate(prefix) if prefix else np.zeros(0, K.U64)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False).astype("<i8")
            rows = [(number, -1 - number % n, docs.tobytes(), sizes.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), True)]
            order, cut = K.split_by(_bucket(tokens, n), n)
            for b in range(n):
                own = order[cut[b] : cut[b + 1]]
                if len(own):
                    mine = at[own]  # sorted, and under 2**16
                    local = mine[np.flatnonzero(np.diff(mine, prepend=-1))]
                    rows.append((number, b, mine.astype("<u2").tobytes(), tokens[own].astype("<u4").tobytes(), K.pack(ids[local].view(K.U64), 6), False))
            number += 1
            yield _batch(rows, _POSTS_ARROW)
    return posted


def _shared(rows: pa.Table) -> pa.Table:
    """How many tokens of each document of one bucket are also in another set; base rows pass through."""
    out, tokens, sets, where = [], [], [], []
    own = rows.to_pylist()
    for k, r in enumerate(own):
        if r["base"]:
            out.append((r["batch"], r["at"], r["tokens"], r["sets"], True))
            continue
        mine = np.frombuffer(r["at"], "<u2").astype(np.int64)
        new = np.diff(mine, prepend=-1) != 0
        back = np.cumsum(new) - 1
        tokens.append(np.frombuffer(r["tokens"], "<u4"))
        sets.append(K.unpack(r["sets"], 6)[back])
        where.append((k, back, mine[new].astype("<u2")))
    if tokens:
        t, s = np.concatenate(tokens), np.concatenate(sets)
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        new = np.concatenate([[True], t[1:] != t[:-1]])
        group = np.cumsum(new) - 1
        many = np.zeros(group[-1] + 1, bool)
        many[group[1:][~new[1:] & (s[1:] != s[:-1])]] = True
        flag = np.zeros(len(t), bool)
        flag[order] = many[group]
        begin = 0
        for k, back, local in where:
            n = np.bincount(back[flag[begin : begin + len(back)]], minlength=len(local))
            begin += len(back)
            out.append((own[k]["batch"], local.tobytes(), n.astype("<u4").tobytes(), b"", False))
    return pa.Table.from_batches([_batch(out, _SHARED_ARROW)])


_INFO = "doc_id long, set_id long, n long, joins boolean"


def _info(rows: pa.Table) -> pa.Table:
    own = rows.to_pylist()
    base = next(r for r in own if r["base"])
    docs, sizes, ids = (np.frombuffer(base[c], "<i8") for c in ("at", "n", "sets"))
    shared = np.zeros(len(docs), np.int64)
    for r in own:
        if not r["base"]:
            shared[np.frombuffer(r["at"], "<u2").astype(np.int64)] += np.frombuffer(r["n"], "<u4")
    joins = (shared >= np.maximum(1, -(-needed(sizes) // 10))) & (sizes > 0)
    return pa.table({"doc_id": docs, "set_id": ids, "n": sizes, "joins": joins})


def shingle_info(docs: DataFrame) -> DataFrame:
    """doc_id, set_id, n (size of the set) of every row; joins: the first row of a set in its batch that may link."""
    small_batches(docs.sparkSession)
    posts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_posts(buckets(docs)), _POSTS)
    return posts.groupBy("bucket").applyInArrow(_shared, "batch long, at binary, n binary, sets binary, base boolean").groupBy("batch").applyInArrow(_info, _INFO)


# 2. distinct sets and token groups

def _taken(info: DataFrame, n: int) -> list[np.ndarray]:
    """Segments of a bit array over the set ids that take part."""
    size = TAKE_BITS // n // 8 * 8 + 8

    def segment(rows: pa.Table) -> pa.Table:
        bits = np.zeros(size, bool)
        bits[_bit(rows.column("set_id").to_numpy(), size)] = True
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = info.where("joins").select("set_id", F.pmod("set_id", F.lit(n)).cast("int").alias("bucket")).groupBy("bucket").applyInArrow(segment, "bucket int, bits binary")
    out = [np.zeros(size // 8, np.uint8)] * n
    for row in rows.toLocalIterator():
        out[row["bucket"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def _bit(ids: np.ndarray, size: int) -> np.ndarray:
    return ((K.mix(ids.view(K.U64)) >> K.U64(32)) * K.U64(size) >> K.U64(32)).astype(np.int64)


_SETS_ARROW = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])


def _sets(taken):
    def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = taken.value
        n, size = len(segments), 8 * len(segments[0])
        for batch in batches:
            best: dict[int, tuple] = {}
            for tokens in K.text_shingles(batch.column("text"), WIDTH):
                if not len(tokens):
                    continue
                name = set_id(tokens)
                bit = int(_bit(np.array([name]), size)[0])
                if segments[name % n][bit >> 3] >> (bit & 7) & 1 and name not in best:
                    best[name] = (name, len(tokens), tokens.astype("<u8").tobytes())
            yield _batch(list(best.values()), _SETS_ARROW)
    return shipped


def _token_counts(n: int):
    schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<u8").astype("<u4")
            order, cut = K.split_by(_bucket(tokens.astype(K.U64), n), n)
            yield _batch([(b, tokens[order[cut[b] : cut[b + 1]]].tobytes()) for b in range(n) if cut[b + 1] > cut[b]], schema)
    return counted


def _frequent(least: int):
    def kept(rows: pa.Table) -> pa.Table:
        tokens, counts = np.unique(np.frombuffer(b"".join(rows.column("tokens").to_pylist()), "<u4"), return_counts=True)
        own = counts >= least
        return pa.table({"tokens": pa.array([tokens[own].tobytes()], pa.binary()), "counts": pa.array([counts[own].astype("<i8").tobytes()], pa.binary())})
    return kept


def _ordered(sets: DataFrame, n: int) -> DataFrame:
    """Sets with their tokens rarest first. Tokens are counted by 32 bits, which is as good an order of all tokens: any will do that is one for all sets."""
    places = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = max(LEAST_FREQUENT, -(-int(places) >> FREQUENT))
    rows = sets.select("tokens").mapInArrow(_token_counts(n), "bucket int, tokens binary").groupBy("bucket").applyInArrow(_frequent(least), "tokens binary, counts binary").collect()
    tokens = np.frombuffer(b"".join(bytes(r["tokens"]) for r in rows), "<u4")
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), "<i8")
    order = np.argsort(tokens)
    shared = sets.sparkSession.sparkContext.broadcast((tokens[order], counts[order]))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for batch in batches:
            out, maps = [], []
            for raw in batch.column("tokens").to_pylist():
                t = np.frombuffer(raw, "<u8")
                if len(known):
                    low = t.astype("<u4")
                    at = np.minimum(np.searchsorted(known, low), len(known) - 1)
                    t = t[np.lexsort((t, np.where(known[at] == low, count[at], 0)))]
                bits = np.zeros(next((b for b in MAP_BITS if b >= 4 * len(t)), MAP_BITS[-1]), bool)
                bits[(K.mix(t) >> K.U64(51)).astype(np.int64) % len(bits)] = True
                out.append(t.tobytes())
                maps.append(np.packbits(bits).tobytes())
            yield pa.record_batch([batch.column("node"), batch.column("n"), pa.array(out, pa.binary()), pa.array(maps, pa.binary())], ["node", "n", "tokens", "map"])

    return sets.mapInArrow(ranked, "node long, n long, tokens binary, map binary")


_PREFIX_ARROW = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])
_GROUPS = "gid long, weight long, nodes binary, sizes binary"
_GROUPS_ARROW = pa.schema([("gid", pa.int64()), ("weight", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary())])


def _prefixes(n: int):
    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy(zero_copy_only=False)
            parts = [np.frombuffer(t, "<u8", int(s - needed(s) + 1)) for t, s in zip(batch.column("tokens").to_pylist(), sizes)]
            lengths = [len(p) for p in parts]
            tokens = np.concatenate(parts) if parts else np.zeros(0, K.U64)
            nodes, size = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), lengths), np.repeat(sizes, lengths)
            order, cut = K.split_by(_bucket(tokens, n), n)
            rows = [(b, tokens[o].tobytes(), nodes[o].astype("<i8").tobytes(), size[o].astype("<u4").tobytes()) for b in range(n) for o in [order[cut[b] : cut[b + 1]]] if len(o)]
            yield _batch(rows, _PREFIX_ARROW)
    return posted


def _token_groups(rows: pa.Table) -> pa.Table:
    """Distinct member lists of the tokens of one bucket that at least two sets share; weight: how many tokens have the list."""
    tokens, nodes, sizes = (np.frombuffer(b"".join(rows.column(c).to_pylist()), k) for c, k in (("tokens", "<u8"), ("nodes", "<i8"), ("sizes", "<u4")))
    sizes = sizes.astype("<i8")
    order = np.lexsort((nodes, tokens))
    tokens, nodes, sizes = tokens[order], nodes[order], sizes[order]
    cut = np.append(np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])), len(tokens))
    many = np.flatnonzero(np.diff(cut) > 1)
    found: dict[bytes, list] = {}
    for a, b in zip(cut[many].tolist(), cut[many + 1].tolist()):
        raw = nodes[a:b].tobytes()
        if raw in found:
            found[raw][1] += 1
        else:
            found[raw] = [int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True), 1, raw, sizes[a:b].tobytes()]
    return pa.Table.from_batches([_batch(list(found.values()), _GROUPS_ARROW)])


# 3. pairs to compare

_CHECKED_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64())])


def _fits(n, m):
    """Whether sets of these sizes can link at all."""
    return (np.minimum(n, m) * 100) >= np.maximum(n, m) * PERCENT


def _pivot_pairs():
    """(pivot, other, weight) of each group; groups of the same sets tend to have the same pivot."""
    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for r in batch.to_pylist():
                nodes, sizes = np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["sizes"], "<i8")
                p = int(np.argmin(K.mix(nodes.view(K.U64))))
                o = np.flatnonzero(_fits(sizes, sizes[p]) & (nodes != nodes[p]))
                out.append(np.stack([np.full(len(o), nodes[p]), nodes[o], np.full(len(o), r["weight"])], 1))
            yield _arrays(out)
    return paired


class Maps:
    """Bit maps of a group's sets: a bit of one map only is a token of one set only, which bounds the overlap."""

    def __init__(self, maps: list[bytes], sizes: np.ndarray):
        self.sizes, self.length = sizes, np.array([len(m) for m in maps])
        self.folded = {}
        for size in sorted(set(self.length.tolist())):
            rows = np.zeros((len(maps), size), np.uint8)
            for k in np.flatnonzero(self.length >= size):
                m = np.frombuffer(maps[k], np.uint8)
                while len(m) > size:
                    m = m[: len(m) // 2] | m[len(m) // 2 :]
                rows[k] = m
            self.folded[size] = rows

    def may_link(self, p: int, others: np.ndarray) -> np.ndarray:
        out, common = np.zeros(len(others), bool), np.minimum(self.length[p], self.length[others])
        for size in np.unique(common).tolist():
            own = np.flatnonzero(common == size)
            x, y = self.folded[size][p], self.folded[size][others[own]]
            n, m = self.sizes[p], self.sizes[others[own]]
            most = np.minimum(n - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
            out[own] = most >= overlap(n, m)
        return out


def _part(nodes: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Places of the pivots of one of ``parts`` tasks."""
    own = np.arange(len(nodes) - 1)
    return own if parts == 1 else own[(K.mix(nodes[:-1].view(K.U64)) % K.U64(parts)).astype(np.int64) == part]


def _open_pairs(batches: Iterator[pa.RecordBatch], spanning: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs of each group that are in different components and that size and bit maps allow, one set against the rest at a time.

    ``spanning``: only as many as join what all of them join, under one for each member.
    Rows are groups with a ``part``, the hash class of pivots to take, of ``parts``."""
    out: list[np.ndarray] = []
    held = 0

    def flushed() -> pa.RecordBatch:
        x = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        x = x[np.concatenate([[True], (x[1:] != x[:-1]).any(1)])] if len(x) else x
        return pa.record_batch([pa.array(x[:, k].copy()) for k in range(2)], schema=_CHECKED_ARROW)

    for batch in batches:
        for r in batch.to_pylist():
            nodes, sizes, comps = (np.frombuffer(r[c], "<i8") for c in ("nodes", "sizes", "comps"))
            maps = Maps(r["maps"], sizes)
            joined = np.arange(len(nodes))
            for p in _part(nodes, r["part"], r["parts"]).tolist():
                o = p + 1 + np.flatnonzero(_fits(sizes[p + 1 :], sizes[p]) & (comps[p + 1 :] != comps[p]) & (joined[p + 1 :] != joined[p]))
                o = o[maps.may_link(p, o)]
                if len(o):
                    if spanning:
                        names, first = np.unique(joined[o], return_index=True)
                        joined[np.isin(joined, names)] = joined[p]
                        o = o[first]
                    out.append(np.stack([np.full(len(o), nodes[p]), nodes[o]], 1))
                    held += len(o)
            if held > 500_000:
                yield flushed()
                out, held = [], 0
    yield flushed()


def _spanning_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _open_pairs(batches, spanning=True)


def _arrays(parts: list[np.ndarray]) -> pa.RecordBatch:
    x = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    return pa.record_batch([pa.array(x[:, k].copy()) for k in range(3)], schema=_PAIRS_ARROW)


def _members(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each set of each group, with its component."""
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(np.frombuffer(n, "<i8"), np.frombuffer(s, "<i8")) for n, s in zip(batch.column("nodes").to_pylist(), batch.column("sizes").to_pylist())]
            k = [len(n) for n, _ in rows]
            pick = lambda i: np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), k)) for c in ("gid", "weight")] + [pa.array(pick(0)), pa.array(pick(1))], ["gid", "weight", "node", "n"])

    return groups.mapInArrow(flat, "gid long, weight long, node long, n long").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _open(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The groups whose members are in several components."""
    several = _members(groups, labels).groupBy("gid").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("gid")
    return groups.join(several, "gid", "left_semi")


def _labelled(groups: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Groups with their members' components and bit maps."""
    rows = _members(groups, labels).join(sets.select("node", "map"), "node")

    def regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            gid, weight, node, n, comp = (t.column(c).to_numpy() for c in ("gid", "weight", "node", "n", "comp"))
            cut = np.append(np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])), len(gid)) if len(gid) else np.zeros(1, np.int64)
            rows = [(int(gid[a]), int(weight[a]), node[a:b].tobytes(), n[a:b].tobytes(), comp[a:b].tobytes(), t.column("map").slice(a, b - a).to_pylist()) for a, b in zip(cut[:-1], cut[1:])]
            return _batch(rows, pa.schema([*_GROUPS_ARROW, ("comps", pa.binary()), ("maps", pa.list_(pa.binary()))]))

        for batch in batches:
            if not batch.num_rows:
                continue
            gid = batch.column("gid").to_numpy(zero_copy_only=False)
            tail = int(np.searchsorted(gid, gid[-1], "left"))
            if tail:
                yield closed([*held, batch.slice(0, tail)])
                held = []
            elif held and held[-1].column("gid")[0].as_py() != gid[0]:
                yield closed(held)
                held = []
            held.append(batch.slice(tail))
        if held:
            yield closed(held)

    return rows.repartition("gid").sortWithinPartitions("gid", "node").select("gid", "weight", "node", "n", "comp", "map").mapInArrow(regrouped, _GROUPS + ", comps binary, maps array<binary>")


# 4. comparison

class Trie:
    """Sets as paths, most frequent token first, kept as sorted paths and the depth that each shares with the one before."""

    def __init__(self, names: list[int], sets: list[np.ndarray]):
        paths = [s[::-1] for s in sets]
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
        self.names, self.paths = [names[i] for i in order], [paths[i] for i in order]
        self.shared = [0]
        for a, b in zip(self.paths, self.paths[1:]):
            n = min(len(a), len(b))
            differs = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(differs[0]) if len(differs) else n)

    def linked(self, pivot: np.ndarray, step: int = 64) -> list[int]:
        """Names of the sets that link with the pivot."""
        table, out = np.sort(pivot), []
        carried, known = np.zeros(max(map(len, self.paths), default=0) + 1, np.int64), 0
        for name, path, shared in zip(self.names, self.paths, self.shared):
            n, known = len(path), min(known, shared)
            need = overlap(n, len(table))
            while True:
                # carried[d] is the overlap of the first d tokens; the rest of the path could all match
                if int((carried[: known + 1] - np.arange(known + 1)).min()) + n < need:
                    break
                if known == n:
                    out.append(name)
                    break
                more = path[known : known + step]
                at = np.minimum(np.searchsorted(table, more), len(table) - 1)
                np.cumsum(table[at] == more, out=carried[known + 1 : known + 1 + len(more)])
                carried[known + 1 : known + 1 + len(more)] += carried[known]
                known += len(more)
        return out



def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pivot, salt), the pivot's own row first."""
    key, pivot, names, sets = None, None, [], []

    def found() -> pa.RecordBatch:
        rows = [(key[0], x) for x in Trie(names, sets).linked(pivot)] if names else []
        return _batch(rows, _CHECKED_ARROW)

    for batch in batches:
        for a, salt, b, tokens in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "tokens"))):
            if (a, salt) != key:
                if names:
                    yield found()
                key, pivot, names, sets = (a, salt), None, [], []
            t = np.frombuffer(tokens, "<u8")
            if b is None:
                pivot = t
            else:
                names.append(b)
                sets.append(t)
    if names:
        yield found()


def linked_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; ``pairs`` is stored, distinct, a the pivot."""
    sizes = pairs.groupBy("a").agg(F.floor((F.count(F.lit(1)) - 1) / PER_PIVOT).cast("int").alias("salts"))
    salted = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts") + 1).cast("int").alias("salt"))
    others = salted.join(sets.select(F.col("node").alias("b"), "tokens"), "b").select("a", "salt", "b", "tokens")
    pivots = sizes.join(sets.select(F.col("node").alias("a"), "tokens"), "a").select("a", F.explode(F.sequence(F.lit(0), "salts")).alias("salt"), F.lit(None).cast("long").alias("b"), "tokens")
    rows = others.unionByName(pivots).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_compared, "a long, b long")


class Cluster:
    """Sets with their tokens, rarest first, and components; pairs that share no token of both prefixes cannot link."""

    def __init__(self, nodes: list[int], comps: list[int], sets: list[np.ndarray], maps: list[bytes]):
        self.nodes, self.comps, self.sets = np.array(nodes, np.int64), np.array(comps, np.int64), sets
        self.sizes = np.array([len(s) for s in sets])
        self.maps = Maps(maps, self.sizes)
        length = self.sizes - needed(self.sizes) + 1
        self.cut = np.append(0, np.cumsum(length)).tolist()
        self.token = np.unique(np.concatenate([s[:n] for s, n in zip(sets, length)]), return_inverse=True)[1]
        order = np.argsort(self.token, kind="stable")
        self.posts = np.repeat(np.arange(len(sets)), length)[order]
        self.first = np.searchsorted(self.token[order], np.arange(self.token.max() + 2)).tolist()

    def links(self, part: int = 0, parts: int = 1, step: int = 64) -> list[tuple[int, int]]:
        """Links of the pivots of one part, as many as join all components that links of these pivots join."""
        out, comps, sizes, label = [], self.comps, self.sizes, np.zeros(len(self.nodes), bool)
        for p in _part(self.nodes, part, parts).tolist():
            label[:] = False
            for t in self.token[self.cut[p] : self.cut[p + 1]].tolist():
                label[self.posts[self.first[t] : self.first[t + 1]]] = True
            label[: p + 1] = False
            o = np.flatnonzero(label & (comps != comps[p]))
            o = o[_fits(sizes[o], sizes[p])]
            o = o[self.maps.may_link(p, o)]
            table = np.sort(self.sets[p])
            while len(o):
                now, o = o[:step], o[step:]
                flat = np.concatenate([self.sets[k] for k in now.tolist()])
                same = table[np.minimum(np.searchsorted(table, flat), len(table) - 1)] == flat
                common = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes[now]) - sizes[now])
                for k in now[common >= overlap(sizes[p], sizes[now])].tolist():
                    if comps[k] != comps[p]:
                        out.append((int(self.nodes[p]), int(self.nodes[k])))
                        comps[comps == comps[k]] = comps[p]
                o = o[comps[o] != comps[p]]
        return out


def _cluster_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, part, node)."""
    key, rows = None, []

    def found() -> pa.RecordBatch:
        nodes, comps, raw, maps = zip(*rows)
        return _batch(Cluster(nodes, comps, [np.frombuffer(t, "<u8") for t in raw], maps).links(*key[1:]), _CHECKED_ARROW)

    for batch in batches:
        for cluster, part, parts, *row in zip(*(batch.column(c).to_pylist() for c in ("cluster", "part", "parts", "node", "comp", "tokens", "map"))):
            if (cluster, part, parts) != key:
                if rows:
                    yield found()
                key, rows = (cluster, part, parts), []
            rows.append(row)
    if rows:
        yield found()


def _parts(members: Column) -> Column:
    return F.least(F.ceil(members / PER_PART), F.lit(PARTS)).cast("int")


def clustered_links(left: DataFrame, labels: DataFrame, sets: DataFrame, files: int) -> DataFrame:
    """Links between the components of open groups, as many as join all that links join."""
    # groups with the same first member meet in one task; large groups are split by pivot
    rows = _labelled(left, labels, sets).withColumn("parts", _parts(F.length("nodes") / 8)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition(F.substring("nodes", 1, 8), "part")
    may = stored(rows.select("nodes", "sizes", "comps", "maps", "part", "parts").mapInArrow(_spanning_pairs, "a long, b long").distinct(), files)
    if may.isEmpty():
        return may
    of = stored(components(may).withColumnRenamed("comp", "cluster"), files)
    size = of.groupBy("cluster").agg(_parts(F.count(F.lit(1))).alias("parts"))
    members = of.join(size, "cluster").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    members = members.join(sets.select("node", "tokens", "map"), "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "node")
    return stored(members.select("cluster", "part", "parts", "node", "comp", "tokens", "map").mapInArrow(_cluster_links, "a long, b long"), files)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark, n = docs.sparkSession, buckets(docs)
    size = docs.count()
    info = stored(shingle_info(docs), 1 + size // WIDE)
    own = docs.where(F.col("doc_id").isNotNull()).select("text")
    taken = spark.sparkContext.broadcast(_taken(info, n))
    # a node is a set, not a doc_id, as rows may repeat a doc_id with other texts
    distinct = own.mapInArrow(_sets(taken), "node long, n long, tokens binary").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    distinct = stored(distinct, 1 + size // WIDE)
    taken.unpersist()
    all_rows, size = size, distinct.count()
    wide, narrow = 1 + size // WIDE, 1 + size // NARROW
    sets = stored(_ordered(distinct, n), wide)
    dropped(distinct)
    groups = sets.select("node", "n", "tokens").mapInArrow(_prefixes(n), "bucket int, tokens binary, nodes binary, sizes binary").groupBy("bucket").applyInArrow(_token_groups, _GROUPS)
    groups = stored(groups.groupBy("gid").agg(F.sum("weight").alias("weight"), F.first("nodes").alias("nodes"), F.first("sizes").alias("sizes")), wide)
    # each set with the pivot that shares most tokens
    pairs = groups.mapInArrow(_pivot_pairs(), "a long, b long, w long").groupBy("a", "b").agg(F.sum("w").alias("w"))
    pairs = stored(pairs.groupBy("b").agg(F.max(F.struct("w", F.col("a"))).alias("s")).select(F.col("s.a").alias("a"), "b"), wide)
    found = stored(linked_pairs(sets, pairs), 1 + pairs.count() // WIDE)
    labels = stored(components(found), narrow)
    left = stored(_open(groups, labels), wide)
    if not left.isEmpty():
        found = clustered_links(left, labels, sets, wide)
        if not found.isEmpty():
            labels = stored(components(found.unionByName(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")))), narrow)
    dropped(sets, groups)
    first = info.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first")).join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    first = stored(first, 1 + all_rows // NARROW)
    least = first.join(first.groupBy("comp").agg(F.min("first").alias("least")), "comp").select("set_id", "least")
    return info.join(least, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Filter form: of each component the document with the smallest doc_id, whole rows. Rows without doc_id go; all rows that repeat a doc_id stay or go together."""
    return without(docs, jaccard_components(docs).groupBy("doc_id").agg(F.min((F.col("doc_id") != F.col("component_id")).cast("int")).alias("others")).where("others = 1").select(F.col("doc_id").alias("_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
