"""Vectorised primitives on UTF-8 buffers shared by the corpus operators.

Every function works on one bounded slice of documents: a ``uint8`` buffer plus
``int64`` document offsets.  Hashes are polynomial in two bases, modulo the prime
2**31 - 1 (modulo a power of two, Thue-Morse words collide), taken from prefix sums, so
a whole slice costs a few numpy passes and no Python loop.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M = U64((1 << 31) - 1)
_BASES = (0x2545F491, 0x4F6CDD1D)
#: Elements that are hashed at once, so that they stay in the processor's cache.
_BLOCK = 1 << 15
_powers: list[tuple[np.ndarray, np.ndarray]] = []
#: What operators keep in a worker from task to task; other operators' release() empties it, as idle stores count beside their work.
stores: list[dict] = []
_BYTE = np.random.RandomState(20240607).randint(1, 2**31 - 1, 256, dtype=np.int64).astype(U64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release() -> None:
    """Give memory that a finished slice held, and the stores of operators that ran before, back to the system."""
    for s in stores:
        s.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, but for a last subtraction."""
    high = x >> U64(31)
    x = x & _M
    x += high
    return x


def _table(base: int, size: int) -> np.ndarray:
    """Powers 0 .. size - 1 of a base, by doubling."""
    out = np.ones(size, np.uint32)
    n = 1
    while n < size:
        m = min(n, size - n)
        x = _fold(_fold(out[:m].astype(U64) * U64(pow(base, n, int(_M)))))
        out[n : n + m] = np.where(x >= _M, x - _M, x)
        n += m
    return out


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers 0..n of each hash base and of its inverse, kept by the worker."""
    if not _powers or len(_powers[0][0]) <= n:
        size = max(1 << 16, n + n // 8 + 1)
        _powers[:] = [(_table(b, size), _table(pow(b, -1, int(_M)), size)) for b in _BASES]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all result bits depend on all input bits."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """For each base a row C with C[e]-C[s] proportional to the hash of data[s:e]."""
    out = np.zeros((2, len(data) + 1), U64)
    tables = powers(len(data))
    for a in range(0, len(data), _BLOCK):
        code = _BYTE[data[a : a + _BLOCK]]
        z = a + len(code)
        for row, (p, _) in zip(out, tables, strict=True):
            part = row[a + 1 : z + 1]
            np.cumsum(_fold(code * p[a:z]), out=part)
            part += row[a]
    return out


def _joined(difference: list[np.ndarray], q: list[np.ndarray], size) -> np.ndarray:
    """One mixed hash of both bases' differences, brought to a common power by q, and the size."""
    h = None
    for d, power in zip(difference, q, strict=True):
        d = _fold(_fold(_fold(_fold(d)) * power))
        np.subtract(d, _M, out=d, where=d >= _M)
        h = d if h is None else h | (d << U64(31))
    return mix(h + size)


_SIZE = 0x632BE59BD9B4E019


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte ranges [start, end) under prefix_hash c."""
    tables = powers(c.shape[1])
    out = np.empty(len(start), U64)
    for a in range(0, len(start), _BLOCK):
        s, e = start[a : a + _BLOCK], end[a : a + _BLOCK]
        out[a : a + _BLOCK] = _joined([row[e] - row[s] for row in c], [q[s] for _, q in tables], (e - s).astype(U64) * U64(_SIZE))
    return out


def window_hash(c: np.ndarray, w: int) -> np.ndarray:
    """Mixed hashes of all windows of w bytes under prefix_hash c, as range_hash has them."""
    n = c.shape[1] - w
    tables = powers(c.shape[1])
    out = np.empty(n, U64)
    size = U64(w * _SIZE & (2**64 - 1))
    for a in range(0, n, _BLOCK):
        z = min(n, a + _BLOCK)
        out[a:z] = _joined([row[a + w : z + w] - row[a:z] for row in c], [q[a:z] for _, q in tables], size)
    return out


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int):
    """Row ranges [i, j) of at most `limit` bytes, but at least one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with table[b] true that stay in one document, and words before each document."""
    is_word = table[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    a = offsets[:-1][np.diff(offsets) > 0]
    first[a] = is_word[a]
    z = offsets[1:][np.diff(offsets) > 0] - 1
    last[z] = is_word[z]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def byte_table(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


#: [^\x20\x09-\x0D]+
NOT_SPACE = ~byte_table([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text; every byte of a non-ASCII character belongs.
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each `w` consecutive values, by block-wise prefix and suffix minima."""
    n = len(values)
    if n < w:
        return values[:0]
    m = -(-n // w) * w
    a = np.full(m, np.iinfo(values.dtype).max, values.dtype)
    a[:n] = values
    blocks = a.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])
