"""The language model's filter grows with what is inserted, and its reads are close to the counts."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kinlink.llm import lm_scoring
from kinlink.llm.kernels import chunks

WORDS = ["w%d" % k for k in range(300)]


def text(k):
    return " ".join(WORDS[(k * 7 + j * j) % len(WORDS)] for j in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, text(k)) for k in range(200)], "doc_id long, text string").repartition(3).cache()


def brute(rows):
    """score of every document from exact counts, each read as the meaning of its level."""
    tokens = {i: re.findall(r"\S+", t) + ["\0"] for i, t in rows}
    train = [w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two, three = (collections.Counter(g for w in train for g in zip(*(["\1"] * (n - 1 - k) + w[: len(w)] if k < n - 1 else w for k in range(n)))) for n in (1, 2, 3))
    read = lambda c: 0.0 if not c else float(lm_scoring.MEANING[int(math.log2(c)) + 1])
    room, out = sum(one.values()) + 0.5 * (len(one) + 1), {}
    for i, w in tokens.items():
        out[i] = 0.0
        for k, x in enumerate(w):
            v, u = w[k - 1] if k else "\1", w[k - 2] if k > 1 else "\1"
            before = len(train) if not k else read(one[v,])
            pair = min(read(two[v, x]), before)
            p = 0.5 * (pair / before if before else 0) + 0.5 * (read(one[x,]) + 0.5) / room
            wide = len(train) if not k else min(read(two[u, v]), len(train) if k == 1 else read(one[u,]))
            out[i] += math.log10(0.5 * (min(read(three[u, v, x]), wide) / wide if wide else 0) + 0.5 * p)
    return out


def test_every_insertion_has_its_bits(docs):
    """A segment has as many bits an insertion however many there are, and nothing is collected for a broadcast."""
    for part in (docs.where("doc_id < 20"), docs):
        model, counts = lm_scoring.train(part)
        rows = counts.collect()
        assert rows and all(8 * len(r["bits"]) >= lm_scoring.BITS_PER_INSERTION * r["insertions"] > 0 for r in rows)
        assert not hasattr(model, "filter")


def test_scores_are_those_of_the_counts(docs):
    want = brute([(k, text(k)) for k in range(200)])
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(docs).collect()}
    off = sorted(abs(got[i] - s) / abs(s) for i, s in want.items())
    assert len(got) == 200 and off[100] < 0.02 and off[-1] < 0.15


def test_units_keep_all_rows(monkeypatch):
    monkeypatch.setattr(lm_scoring, "UNIT", 5)
    monkeypatch.setattr(lm_scoring.K, "chunks", lambda column: chunks(column, 8))
    column = pa.array(["a b c d", None, "", "e f", "g h i j k l m", "n"])
    units = list(lm_scoring._units(column))
    assert len(units) > 2 and [u[:2] for u in units] == list(zip([0, *[u[1] for u in units[:-1]]], [u[1] for u in units])) and units[-1][1] == 6
    lengths = [n for *_, tokens, begins in units for n in np.diff(begins).tolist() if begins[-1] == len(tokens)]
    assert lengths == [5, 1, 1, 3, 8, 2]


def test_pairs_seen_once_count(spark):
    """A held-out text that repeats pairs seen once scores above one whose words are the same and whose pairs are new."""
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1][:2]
    words = ["x%d" % k for k in range(40)]
    train = " ".join(words)
    rows = [(k, train if k == 99 else "other text %d" % k) for k in range(100) if k not in held and zlib.crc32(str(k).encode()) % 5 != 1]
    assert (99, train) in rows
    rows += [(held[0], train), (held[1], " ".join(words[::-1]))]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 20
    want = brute(rows)
    assert got[held[0]] == pytest.approx(want[held[0]], rel=0.05)
