"""Patched frame-of-reference blocks of 32-bit unsigned integers.

A block of BLOCK values stores its minimum, the differences from it packed at the width that PERCENTILE of them
fit in, and the rest as exceptions: their places, and the bits above the width. All blocks of one width are
packed together, a bit position at a time.

Image, little-endian: header (magic, number of values, blocks, exceptions), then by block the minimum (u32), the
width (u8), the number of exceptions (u16) and the start among the 64-bit words (u64); the words; the exceptions'
places (u16) and high bits (u32). An empty array is a header alone.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 256
PERCENTILE = 0.9
_MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sQII")
_LANES = 64
_BITS = np.zeros(1 << 16, np.uint8)
for _k in range(16):
    _BITS[1 << _k : 1 << (_k + 1)] = _k + 1


def _lengths(d: np.ndarray) -> np.ndarray:
    """The number of bits of each value."""
    high = d >> np.uint32(16)
    return np.where(high > 0, 16 + _BITS[high], _BITS[d & np.uint32(0xFFFF)]).astype(np.uint8) if high.any() else _BITS[d]


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values as rows of words."""
    lanes = np.ascontiguousarray(low.reshape(-1, _LANES).T).astype(np.uint64)
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for j in range(_LANES):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(low), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((_LANES, columns.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(_LANES):
        word, shift = divmod(j * width, 64)
        x = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            x |= columns[word + 1] << np.uint64(64 - shift)
        out[j] = x & mask
    return np.ascontiguousarray(out.T).reshape(len(words), -1)


def encode(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The image of an array of values below 2**32."""
    n = len(values)
    if not n:
        return _HEAD.pack(_MAGIC, 0, 0, 0)
    blocks = -(-n // BLOCK)
    x = np.full(blocks * BLOCK, values[-1], np.uint32)
    x[:n] = values
    x = x.reshape(blocks, BLOCK)
    least = x.min(axis=1)
    x -= least[:, None]
    bits = _lengths(x)
    k = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.partition(bits, k, axis=1)[:, k]
    block, place = np.nonzero(bits > width[:, None])
    high = x[block, place] >> width[block].astype(np.uint32)
    size = width.astype(np.int64) * (BLOCK // _LANES)
    start = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            packed = _pack(x[own] & np.uint32((1 << w) - 1), w)
            words[start[own][:, None] + np.arange(packed.shape[1])] = packed
    counts = np.bincount(block, minlength=blocks)
    return b"".join((_HEAD.pack(_MAGIC, n, blocks, len(block)), least.astype("<u4").tobytes(), width.tobytes(), counts.astype("<u2").tobytes(), start.astype("<u8").tobytes(), words.astype("<u8").tobytes(), place.astype("<u2").tobytes(), high.astype("<u4").tobytes()))


class Image:
    """An image's blocks; any run of them can be decoded alone."""

    def __init__(self, data: bytes | memoryview):
        magic, self.n, blocks, exceptions = _HEAD.unpack_from(data, 0)
        if magic != _MAGIC:
            raise ValueError("not a block image")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.least, self.width, counts, self.start = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u8", blocks).astype(np.int64)
        self.words = take("<u8", int(self.width.sum(dtype=np.int64)) * (BLOCK // _LANES))
        self.place, self.high = take("<u2", exceptions), take("<u4", exceptions)
        self.patches = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The values of blocks first to last - 1, with the padding of the last of all."""
        width = self.width[first:last]
        out = np.zeros((len(width), BLOCK), np.uint32)
        for w in np.unique(width).tolist():
            if w:
                own = np.flatnonzero(width == w)
                out[own] = _unpack(self.words[self.start[first + own][:, None] + np.arange(w * (BLOCK // _LANES))], w)
        a, b = self.patches[first], self.patches[last]
        block = np.repeat(np.arange(len(width)), np.diff(self.patches[first : last + 1]))
        out[block, self.place[a:b]] |= self.high[a:b] << width[block].astype(np.uint32)
        out += self.least[first:last][:, None]
        return out.reshape(-1)

    def values(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Values first to last - 1."""
        last = self.n if last is None else min(last, self.n)
        if first >= last:
            return np.zeros(0, np.uint32)
        block = first // BLOCK
        return self.blocks(block, -(-last // BLOCK))[first - block * BLOCK : last - block * BLOCK]


def decode(data: bytes) -> np.ndarray:
    return Image(data).values()
