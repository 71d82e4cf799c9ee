"""Array kernels shared by the text operators: byte buffers, words, hashes, shingles.

All functions work on one *chunk*: the concatenated UTF-8 bytes of some documents and the
offsets that delimit them.  Nothing here depends on Spark, so every kernel has a brute-force
twin in ``tests/llm``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 18

_SLOT = np.random.default_rng(20240229).integers(1, 2**64, 64, dtype=U64) | U64(1)
_ODD = U64(0x9E3779B97F4A7C15)
#: Low bytes of a lane of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Longer spans are hashed one by one.
LONG = 512

#: ASCII blanks of the contracts: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACE
#: Digits, a-z and everything outside ASCII (upper case is folded before).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64; wraps."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``most`` bytes; a longer text has a chunk of its own."""
    data, offsets = buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes of ``kind``, and per document how many words lie before it (length n + 1)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = kind[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data``, and past its end zeros, as one integer."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes: each eight bytes are folded into the state by a bijection."""
    lanes, size = _lanes(data), ends - starts
    out = mix(size.astype(U64) * _SLOT[63] + _SLOT[62])
    live = None
    for at in range(0, min(LONG, int(size.max(initial=0))), 8):
        if live is None:
            out = mix((out ^ lanes[starts] & _LOW[np.minimum(size, 8)]) * _ODD)
        else:
            lane = lanes[starts[live] + at] & _LOW[np.minimum(size[live] - at, 8)]
            out[live] = mix((out[live] ^ lane) * _ODD)
        live = np.flatnonzero(size > at + 8) if live is None else live[size[live] > at + 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """``span_hashes`` of the ``width`` bytes from every place that has them, for a width up to ``LONG``."""
    n, lanes = max(0, len(data) - width + 1), _lanes(data)
    out = np.full(n, mix(np.full(1, width, U64) * _SLOT[63] + _SLOT[62])[0], U64)
    for at in range(0, width, 8):
        out ^= lanes[at : at + n] & _LOW[min(8, width - at)]
        out *= _ODD
        _mix_in_place(out)
    return out


def _mix_in_place(x: np.ndarray) -> None:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x ^= x >> U64(shift)
        if factor != 1:
            x *= U64(factor)


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of a from each start are those of b, over ``size`` bytes."""
    x, y, out = _lanes(a), _lanes(b), np.ones(len(size), bool)
    live, at = np.flatnonzero(size > 0), 0
    while len(live):
        differs = (x[a_starts[live] + at] ^ y[b_starts[live] + at]) & _LOW[np.minimum(size[live] - at, 8)]
        out[live[differs != 0]] = False
        at += 8
        live = live[(differs == 0) & (size[live] > at)]
    return out


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of ``length`` consecutive word hashes from each start."""
    total = np.full(len(starts), length, U64) * _SLOT[62]
    for k in range(length):
        total += hashes[starts + k] * _SLOT[k % 60] if k < 60 else mix(hashes[starts + k] + U64(k))
    return mix(total)


def shingle_sets(hashes: np.ndarray, before: np.ndarray, width: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``width``-word shingles; with fewer words, of the whole sequence."""
    n = len(hashes)
    full = sequence_hashes(hashes, np.arange(max(0, n - width + 1)), width)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(sequence_hashes(hashes, np.array([a]), b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def text_shingles(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Shingle sets of the rows of a text column, blank-separated words, A-Z folded."""
    for _, _, data, offsets in chunks(column):
        data = lower(data)
        starts, ends, before = words(data, offsets, NOT_SPACE)
        yield from shingle_sets(span_hashes(data, starts, ends), before, width)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned 64-bit values."""
    return values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8").astype(U64, copy=False)


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by bucket, and where each bucket begins (length n + 1)."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))
