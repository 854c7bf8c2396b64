"""Words and shingles of Arrow string batches as NumPy arrays, without a Python object per word.

Work arrays are bounded: hashing goes through the words in slices of about SLICE bytes however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; their work arrays take some fifty times as much, and stay in a worker's heap.
SLICE = 1 << 16
U64 = np.uint64

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = U64(0x9E3779B97F4A7C15)
_LANES = _rng.integers(1, 1 << 63, 16, dtype=np.int64).astype(U64) | U64(1)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded number, so that work arrays stay small. What Arrow holds for later is given
    back at the end, as an idle worker would keep it beside the next stages."""
    for b in batches:
        for at in range(0, max(b.num_rows, 1), rows):
            yield b.slice(at, rows)
    b = None
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null is empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of its first word for each text (one more than texts)."""
    inside = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z."""
    out = np.empty(len(starts), U64)
    if not len(starts):
        return out
    power = _powers(int((ends - starts).max()))
    cuts = np.searchsorted(starts, np.arange(starts[0], ends[-1], SLICE))
    for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
        if a == b:
            continue
        s, e = starts[a:b], ends[a:b]
        size = e - s
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        inner = np.arange(int(size.sum())) - np.repeat(at, size)
        values = _BYTE[data[inner + np.repeat(s, size)]] * power[inner]
        out[a:b] = np.add.reduceat(values, at)
    return mix64(out)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row; with fewer, of the whole sequence as one; of no words, none."""
    if not len(words):
        return words
    if len(words) < n:
        return mix64((words * _LANES[: len(words)]).sum(dtype=U64, keepdims=True) + U64(len(words)))
    out = words[: len(words) - n + 1] * _LANES[0]
    for k in range(1, n):
        out = out + words[k : len(words) - n + 1 + k] * _LANES[k]
    return mix64(out + U64(n))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = text_bytes(column)
    starts, ends, first = word_bounds(data, off)
    words = word_hashes(data, starts, ends)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(shingle_hashes(words[a:b], n))
