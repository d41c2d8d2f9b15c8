"""Hashes of words and word shingles for whole Arrow batches, without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
BASE = U(0x5851F42D4C957F2D)
SLICE_BYTES = 4 << 20
_powers: dict[str, np.ndarray] = {}


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high bits depend on all bits."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of BASE and of its inverse modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, b in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(size, b, dtype=U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of about `limit` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word: runs without `\\x20\\x09-\\x0D` inside a row."""
    n = len(data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def hashed_spans(data: np.ndarray, offsets: np.ndarray):
    """(hash of every word, first word of every row, first byte and end of every word, lower-cased bytes)."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return np.empty(0, U), np.zeros(len(offsets), np.int64), none, none, data
    s, e = word_spans(data, offsets)
    data = lowered(data)
    up, down = _power(n)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=sums[1:])
    h = scramble((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * ODD)
    return h, np.searchsorted(s, offsets), s, e, data


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, A-Z lower-cased; first word of every row)."""
    return hashed_spans(data, offsets)[:2]


def shingle_hashes(h: np.ndarray, w: int) -> np.ndarray:
    """Hash of every run of `w` hashes."""
    if len(h) < w:
        return np.empty(0, U)
    x = h[:len(h) - w + 1].copy()
    for j in range(1, w):
        x = scramble(x * ODD + h[j:len(h) - w + 1 + j])
    return x


def shingle_sets(column, w: int):
    """For every row the sorted distinct shingle hashes: of `w` words, or of all words if there are fewer."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        h, at = word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        x = shingle_hashes(h, w)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= w:
                yield np.unique(x[a:b - w + 1])
            elif b > a:
                yield shingle_hashes(h[a:b], b - a) + U(b - a)
            else:
                yield np.empty(0, U)
