"""Best-fit packing of tokenised documents into sequences of bounded length.

Each task packs what it reads, online, with a fixed number of open bins.  The open bins' free space
is the index of a bit in one integer; the best fit for a length is the lowest set bit at or above it.
When all bins are open and none fits, the fullest one closes for good.  The bins still open when a task
ends, a bounded number, are handed on as wholes to the same packer with the same bound, largest first,
so that a task's remainder does not stay half empty.

A document is its token ids and a final 0.  Only longer documents are cut, at multiples of the length.

Defined results.  Null and empty texts are the final 0 alone.  Rows without doc_id are left out.
Repeated rows are packed once each.  Equal free space goes to the bin used last.  An empty table gives
an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WIDE, documents, small_batches, stored

LENGTH = 2048
OPEN_BINS = 1024
#: Open bins that one task of a later round takes.
BINS_PER_TASK = 20_000
#: Words, and letter runs, whose ids a worker remembers.
REMEMBERED = 300_000
REMEMBERED_RUNS = 400_000
_BLANKS = re.compile("[\t\n\x0b\x0c\r ]+")
#: Blank to Python, but not to the vocabulary.
_SEPARATOR = re.compile("[\x1c-\x1f]")
#: Letters whose lower case is one letter, then ASCII marks that no contraction or special token of the vocabulary starts with.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\\[-`{-~]*)")
_WORD_END = "</w>"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts.  ASCII blanks always end a token of this vocabulary, so words are encoded once and remembered.

    A word of plain letters with closing marks is two groups of tokens, each encoded alone, so ``Word,`` and
    ``word`` share what is remembered.  New letter runs are encoded together, and their ids told apart by
    the tokens that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.runs = Tokenizer.from_file(path), {}, {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(_WORD_END) for i in range(size)])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # leaves out offsets

    def _learn_runs(self, runs: list[str]) -> None:
        for i in range(0, len(runs), 1000):
            part = runs[i : i + 1000]
            ids = self._ids(" ".join(part))
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                raw, at = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.runs.update((w, raw[x:y]) for w, x, y in zip(part, at, at[1:]))
            else:
                self.runs.update((w, self._ids(w).tobytes()) for w in part)

    def learn(self, words: set[str], batch: set[str]) -> None:
        """Ids of ``words``. Where too many are remembered, those of the present batch stay."""
        runs, known, plain, match = self.runs, self.words, [], _PLAIN.fullmatch
        if len(known) + len(words) > REMEMBERED:
            known = self.words = {w: known[w] for w in batch if w in known}
        for word in words:
            if found := match(word):
                run, marks = found.groups()
                plain.append((word, run.lower(), marks))
            else:
                known[word] = self._ids(word).tobytes()
        new = {x for _, run, marks in plain for x in (run, marks)}
        if len(runs) + len(new) > REMEMBERED_RUNS:
            used = {f[1].lower() for w in batch if (f := match(w))}
            runs = self.runs = {r: runs[r] for r in used | new if r in runs}
        self._learn_runs(list(new.difference(runs, ("",))))
        runs[""] = b""
        for word, run, marks in plain:
            known[word] = runs[run] + runs[marks]

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), 1000):
            split = [_BLANKS.split(t) if _SEPARATOR.search(t) else t.split() for t in (t or "" for t in texts[i : i + 1000])]
            new = set().union(*split)
            missing = new.difference(self.words)
            if missing:
                self.learn(missing, new)
            known = self.words
            for words in split:
                yield np.frombuffer(b"".join(map(known.__getitem__, words)) + b"\0\0\0\0", "<u4")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker, kept between tasks."""
    return Encoder(path)


class BestFit:
    """Online best fit with at most ``bins`` open bins; ``put`` gives (bin, offset)."""

    def __init__(self, length: int = LENGTH, bins: int = OPEN_BINS):
        self.length, self.bins = length, bins
        #: Open bins by free space; the bit set holds the spaces that occur.
        self.free: dict[int, list[int]] = defaultdict(list)
        self.bits = self.open = self.made = 0

    def _take(self, space: int) -> int:
        stack = self.free[space]
        out = stack.pop()
        if not stack:
            self.bits &= ~(1 << space)
        return out

    def put(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = self._take(space)
        else:
            if self.open >= self.bins and size < self.length:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            at, space = self.made, self.length
            self.made += 1
            self.open += 1
        left = space - size
        if left:
            self.free[left].append(at)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return at, self.length - space

    def left_open(self) -> list[tuple[int, int]]:
        """(bin, tokens in it) of the bins that are still open."""
        return [(at, self.length - space) for space, stack in self.free.items() for at in stack]


#: Rows with piece -1 are no pieces: the bins that a task leaves open, and what is in them.
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece, packed within its task; bins are numbered by task."""
    small_batches(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fit, base = encoder(path), BestFit(length, bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            columns: list[list[int]] = [[] for _ in _NAMES]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                for k, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    at, offset = fit.put(len(part))
                    for column, value in zip(columns, (doc_id, k, start, len(part), zlib.crc32(part), base + at, offset)):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)
        rows = [(None, -1, 0, used, 0, base + at, 0) for at, used in fit.left_open()]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, _PIECES)


_NAMES = [x.split()[0] for x in _PIECES.split(", ")]
_TYPES = [pa.int32() if x.endswith(" int") else pa.int64() for x in _PIECES.split(", ")]


def _whole_bins(length: int, bins: int):
    """Pack bins as wholes, largest first, with the same bound on open bins."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((n, b) for batch in batches for b, n in zip(batch.column("bin").to_pylist(), batch.column("length").to_pylist())), key=lambda x: (-x[0], x[1]))
        fit, base = BestFit(length, bins), (1 << 62) + (TaskContext.get().partitionId() << 32)
        placed = [(b, base + at, off) for n, b in found for at, off in [fit.put(n)]]
        if placed:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*placed)], ["bin", "sequence_id", "shift"])
    return packed


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, bins: int = OPEN_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    # before the packer, which numbers its bins by task
    rows = stored(pieces(docs.coalesce(1 + docs.count() // WIDE), path or vocabulary_path(), length, bins))
    left = rows.where("piece = -1").select("bin", "length")
    tasks = 1 + left.count() // BINS_PER_TASK
    moved = stored(left.repartition(tasks, F.xxhash64("bin")).mapInArrow(_whole_bins(length, bins), "bin long, sequence_id long, shift long"))
    return rows.where("piece >= 0").join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
