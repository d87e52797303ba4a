"""Vectorised word and window hashing over the buffers of Arrow string columns.

A word is a maximal run of bytes outside space and 0x09-0x0D, which for UTF-8 text is
the pattern ``[^\\x20\\x09-\\x0D]+``. A word's hash sums a bijective mix of each of its
eight-byte pieces and the piece's place, so words of up to eight bytes and equal length
never share one; a window's hash combines those of two shorter windows, neither linear nor
symmetric. No sequence is weak by its form, as it would be under a polynomial modulo
2**64. Two seeds give two independent hashes, 128 bits together. Nothing depends on
Python's own hash.

Texts are handled in slices, and what a slice needs besides its words is made in blocks,
so a very long text costs its own bytes and some 24 bytes a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at a time; a longer text is handled alone, in blocks of so many bytes or words.
SLICE_BYTES = 1 << 19
BLOCK_WORDS = 1 << 16

_SEEDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_ODD = tuple(np.uint64(x) for x in (0xD1342543DE82EF95, 0xA0761D6478BD642F))
#: The low 0 to 8 bytes of a number.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of two hashes, in that order."""
    x = a * _ODD[seed]
    x ^= x >> np.uint64(32)
    x += b
    return mix(x)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and len + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of some whole texts: byte spans, 64-bit hashes, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of len(texts) + 1
    hashes: np.ndarray

    def second(self) -> np.ndarray:
        """Hashes that are independent of `hashes`."""
        return word_hashes(self.data, self.starts, self.ends, 1)

    def part(self, a: int, b: int) -> Words:
        """Words a to b, as if of one text."""
        return Words(self.data, self.starts[a:b], self.ends[a:b], np.array([0, b - a]), self.hashes[a:b])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans aren't empty."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # spans of a block's bytes, or one longer span
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE_BYTES, side="right")))
        from_ = int(starts[a])
        body = np.zeros(int(ends[b - 1]) - from_ + 8, np.uint8)
        body[:-8] = data[from_ : ends[b - 1]]
        sizes = (ends[a:b] - starts[a:b]).astype(np.int64)
        pieces = (sizes + 7) >> 3
        place = ranges(np.zeros(b - a, np.int64), pieces)
        value = np.lib.stride_tricks.sliding_window_view(body, 8)[np.repeat(starts[a:b] - from_, pieces) + 8 * place].view("<u8").ravel()
        value &= _LOW[np.minimum(np.repeat(sizes, pieces) - 8 * place, 8)]
        value ^= mix(place.view(np.uint64) * _ODD[seed] + _SEEDS[seed])
        total = np.add.reduceat(mix(value), np.cumsum(pieces) - pieces)
        out[a:b] = mix(total + sizes.view(np.uint64) * _SEEDS[seed])
        a = b
    return out


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, in blocks of bytes; words end at the given edges of texts."""
    n, kind = len(data), np.int32 if len(data) < 1 << 31 else np.int64
    begins, stops = [], []
    edges = offsets[(offsets > 0) & (offsets < n)]
    for a in range(0, n, SLICE_BYTES):
        b = min(a + SLICE_BYTES, n)
        solid = ~SPACE[data[max(a - 1, 0) : min(b + 1, n)]]
        skip = int(a > 0)
        own = solid[skip : skip + b - a]
        new, last = own.copy(), own.copy()
        new[1 - skip :] &= ~solid[: len(new) - 1 + skip]
        last[: len(solid) - skip - 1] &= ~solid[skip + 1 :][: b - a]
        here = edges[np.searchsorted(edges, a) : np.searchsorted(edges, b)] - a
        new[here] = own[here]
        here = edges[np.searchsorted(edges, a + 1) : np.searchsorted(edges, b, side="right")] - a - 1
        last[here] = own[here]
        begins.append((np.flatnonzero(new) + a).astype(kind))
        stops.append((np.flatnonzero(last) + (a + 1)).astype(kind))
    return np.concatenate(begins), np.concatenate(stops)


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words and their hashes. lower: fold A-Z before hashing."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    starts, ends = _spans(data, offsets)
    if lower:
        data = LOWER[data]
    return Words(data, starts, ends, np.searchsorted(starts, offsets), word_hashes(data, starts, ends))


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of `size` words; run i begins at word i. Runs may cross texts.

    Runs of 1, 2, 4, ... words are combined from two of half the length, and those of the
    bits of `size` are put together, in blocks of words.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK_WORDS):
        m = min(BLOCK_WORDS, n - a)
        run, width = hashes[a : a + m + size - 1], 1
        total, done = None, 0
        while True:
            if size & width:
                own = run[done : done + m]
                total = own if total is None else pair(total, own, seed)
                done += width
            if done == size:
                break
            run = pair(run[:-width], run[width:], seed)
            width *= 2
        out[a : a + m] = mix(total + np.uint64(size))
    return out


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """The positions at which a run of `size` words stays within its text, ascending."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    return ranges(first[:-1], counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for each i in turn."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of SLICE_BYTES together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_slices(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first text, text after the last, their words) for each slice of a column."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        yield i, j, split(part, offsets[i : j + 1] - offsets[i], lower)


def pack(values: np.ndarray) -> bytes:
    """Sorted uint64 values as byte planes of their differences; planes of small values,
    which the differences of dense values have, are deflated."""
    planes = np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
    parts = []
    for plane in planes:
        most = int(plane.max()) if len(plane) else 0
        small = zlib.compress(plane.tobytes(), 1) if 0 < most < 64 else b""
        parts.append(b"" if not most else small if small and len(small) < len(plane) else plane.tobytes())
    return np.array([len(values), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpack(blob: bytes) -> np.ndarray:
    """The values of :func:`pack`."""
    count, *sizes = np.frombuffer(blob, "<u4", 9).tolist()
    planes, at = np.zeros((8, count), np.uint8), 36
    for plane, size in zip(planes, sizes):
        if size:
            body = blob[at : at + size]
            plane[:] = np.frombuffer(body if size == count else zlib.decompress(body), np.uint8)
        at += size
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
