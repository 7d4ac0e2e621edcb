"""Word and byte hashing over Arrow text columns, vectorised with numpy.

All functions work on a *block*: some whole texts as UTF-8, joined by one
separator byte.  Blocks are bounded in bytes, so a worker's memory does not
depend on the number of rows in an Arrow batch; only a single text longer than
a block makes a block of its own.

Hashes are polynomial, modulo 2**64, over random byte (or word) weights: one
running sum gives the hash of any range by a subtraction and a multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: With its separators a block stays below a power of two, as the tables of powers have such sizes.
BLOCK_BYTES = (1 << 20) - (1 << 14)

_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE_WEIGHTS = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_WORD_BASES = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_MASK = (1 << 64) - 1


def _table(excluded: str) -> np.ndarray:
    """True for the bytes that separate words."""
    out = np.zeros(256, bool)
    out[list(excluded.encode("latin-1"))] = True
    return out


#: Separators of ``[^\x20\x09-\x0D]+``.
SPACE = _table("\x20\x09\x0a\x0b\x0c\x0d")
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NON_WORD = np.zeros(256, bool)
NON_WORD[0x00:0x30] = NON_WORD[0x3A:0x61] = NON_WORD[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads a hash over all of its bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def _grown(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    inverse = np.full(size, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return np.multiply.accumulate(steps), np.multiply.accumulate(inverse)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    return _grown(base, 1 << max(16, int(n).bit_length()))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as bytes; a null text is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        ends, lo = np.cumsum(lengths), 0
        while lo < len(lengths):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
            part = batch.slice(lo, hi - lo)
            yield part, [x or b"" for x in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
            lo = hi


class Words:
    """The words of a block's texts.

    start, end: byte ranges in ``raw``; doc: index of the text of each word;
    first: index of each text's first word, and at the end the number of words.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE, lower: bool = False):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.raw = LOWER[raw] if lower else raw
        gap = separators[self.raw]
        starts = ~gap
        starts[1:] &= gap[:-1]
        self.start = np.flatnonzero(starts)
        ends = gap.copy()
        ends[0] = False
        ends[1:] &= ~gap[:-1]
        self.end = np.flatnonzero(ends)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        return range_hashes(self.raw, self.start, self.end, which)

    def windows(self, hashed: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """The hash of each n words that follow one another, wherever they start; see ``whole`` for those inside one text."""
        if len(hashed) < n:
            return np.zeros(0, np.uint64)
        forward, back = powers(_WORD_BASES[which], len(hashed) + 1)
        sums = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(hashed * forward[: len(hashed)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * back[: len(hashed) - n + 1])

    def whole(self, n: int) -> np.ndarray:
        """Starts of windows of n words that lie within one text."""
        if len(self) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self) - n + 1])


def prefix_sums(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """Running sums from which ``between`` takes the hash of any range."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_WEIGHTS[which][raw] * powers(_BASES[which], len(raw))[0][: len(raw)], out=sums[1:])
    return sums


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(_BASES[which], len(sums))[1][start])


def range_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    return between(prefix_sums(raw, which), start, end, which)


def text_hashes(texts: list[bytes], which: int = 0) -> np.ndarray:
    """One hash for each whole text, its length mixed in."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offset = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return mix(range_hashes(raw, offset[:-1], offset[1:], which) + sizes.astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))
