"""Vectorised word and window hashing over whole Arrow text columns.

A batch of texts is read straight from Arrow's UTF-8 buffer: byte lookup tables
find the words, and Rabin-Karp prefix sums modulo 2**64 hash every word and
every window of words without a Python loop over words. Chunks hold about
``CHUNK_BYTES`` of text (a longer single text is one chunk of its own), so
memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
#: And no more texts than 16 bits can number
CHUNK_TEXTS = 1 << 16
_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


def _splitmix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = np.array([_splitmix_int(i + 1) for i in range(256)], dtype=np.uint64)
_BYTES = np.arange(256)
#: ``[^\x20\x09-\x0D]+``
IS_WORD = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: A-Z to a-z, other bytes unchanged
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes that begin a code point
IS_POINT = (_BYTES & 0xC0) != 0x80


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, extended as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            factors = np.full(size, self.base, dtype=np.uint64)
            factors[0] = 1
            self.up = np.multiply.accumulate(factors)
            factors[1:] = self.inverse
            self.down = np.multiply.accumulate(factors)
        return self.up, self.down


_byte_powers = _Powers(_BYTE_BASE)
_word_powers = _Powers(_WORD_BASE)


@dataclass
class Chunk:
    """Some consecutive texts: their bytes, and where each text starts and ends."""

    first: int  # index of the first text in the batch
    data: np.ndarray
    offsets: np.ndarray  # one more than texts

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks; a null reads as an empty text."""
    first = 0
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        if part.null_count:
            part = part.fill_null("")
        part = part.cast(pa.large_string())
        _, offset_buffer, data_buffer = part.buffers()
        offsets = np.frombuffer(offset_buffer, dtype=np.int64, count=part.offset + len(part) + 1)[part.offset :] if len(part) else np.zeros(1, np.int64)
        data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
            hi = min(hi, len(part), lo + CHUNK_TEXTS)
            yield Chunk(first + lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi
        first += len(part)


@dataclass
class Words:
    """Words of a chunk in order: byte range, and the first word of each text in ``bounds``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i]..bounds[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(chunk: Chunk, table: np.ndarray = IS_WORD) -> Words:
    inside = table[chunk.data]
    size = len(inside)
    edge = np.zeros(size + 1, dtype=bool)
    edge[chunk.offsets] = True  # words never run from one text into the next
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.offsets))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _byte_powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(word_hashes: np.ndarray, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """The hash of the ``length`` words from each index in ``at``: Rabin-Karp over word hashes."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    n = len(word_hashes)
    up, down = _word_powers.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(word_hashes * up[:n], out=sums[1:])
    return mix((sums[at + length] - sums[at]) * down[at] + np.asarray(length).astype(np.uint64))


def window_starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """Indexes of the words from which ``length`` words fit in the same text."""
    n = int(bounds[-1])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    return np.flatnonzero(left >= length)


def covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """For each of ``n`` words, whether a window of ``length`` words from some index in ``at`` covers it."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.subtract.at(steps, at + length, 1)
    return np.cumsum(steps[:-1]) > 0


def per_text_sum(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the words of each text."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
