"""Vectorised work on the UTF-8 bytes of Arrow string columns, shared by the operators of this subpackage.

Texts are looked at in chunks of about CHUNK bytes (a longer text is a chunk of its own), so the memory a
worker needs follows the chunk and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

#: Bytes that are part of a word of [^\x20\x09-\x0D]+, and of [0-9a-z] with everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64); works in place and returns its input."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 64)
        both = []
        for b in (_BASE, _INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each value begins; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    if len(col) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give the memory that is free in this process back to the system.

    Workers are kept for later tasks and stages, and what the allocators hold meanwhile counts as the executor's.
    """
    if _POWERS and len(_POWERS[0]) > CHUNK + 64:
        _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library alone has it
    if trim is not None:
        trim(0)


def chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes and offsets of each chunk of the column; then what the batch took is released."""
    data, at = raw(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    release()


def spans(b: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a chunk begin and end; a word never crosses a document's border."""
    m = word[b]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(b) + 1, bool)
    border[at] = True
    begins, ends = m.copy(), m.copy()
    begins[1:] &= ~m[:-1] | border[1:-1]
    ends[:-1] &= ~m[1:] | border[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashes(b: np.ndarray, *pairs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """A 64-bit hash of bytes s..e of b for each pair of arrays (s, e); equal bytes, equal hashes."""
    p, inv = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=total[1:])
    return [mix((total[e] - total[s]) * inv[s]) for s, e in pairs]


def owner(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie before each document's border: offsets of words by document."""
    return np.searchsorted(starts, at)


def words(b: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a chunk and, for each document, where its words begin (with one entry more)."""
    b = LOWER[b]
    s, e = spans(b, at, word)
    return hashes(b, (s, e))[0], owner(at, s)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbouring words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD1342543DE82EF95)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def ints(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))
