"""Vectorised word splitting and hashing over Arrow string batches.

All word rules used by the operators separate words by ASCII bytes only, and every
byte of a multi-byte UTF-8 character is a word byte, so words can be found on the raw
UTF-8 bytes of an Arrow string column without decoding it.

A word's 64-bit hash is a table-mapped polynomial over its bytes modulo 2**64.  With an
odd multiplier the prefix sums of a whole batch give every word's hash by one
subtraction and one multiplication; k-word windows are hashed the same way over the
word hashes.  Nothing depends on the process, so hashes agree between executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; bounds the temporaries (about 60 bytes per text byte) and keeps them in the cache.
CHUNK_BYTES = 1 << 18

_MASK = (1 << 64) - 1
_BYTE_MULTIPLIER = 0x9E3779B97F4A7C15
_WINDOW_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _byte_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = _byte_table()
_powers_cache: dict[int, np.ndarray] = {}


def powers(multiplier: int, n: int) -> np.ndarray:
    """multiplier**0 .. multiplier**(n-1) modulo 2**64."""
    have = _powers_cache.get(multiplier)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length()) if n else 1024
        have = np.full(size, multiplier & _MASK, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers_cache[multiplier] = have
    return have[:n]


def _inverse(multiplier: int) -> int:
    return pow(multiplier, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _is_word(separators: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = _is_word([(0x20, 0x20), (0x09, 0x0D)])
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased.
ALNUM = _is_word([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of some consecutive rows of a batch."""

    first_row: int  # of the batch
    rows: int
    data: np.ndarray  # their bytes
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # rows + 1 word numbers: row r has words first[r] .. first[r+1]-1
    hash: np.ndarray  # uint64 of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def windows(self, k: int, which: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; meaningful where :meth:`whole` is true."""
        m = _WINDOW_MULTIPLIERS[which]
        n = len(self.hash)
        if n < k:
            return np.zeros(n, dtype=np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * powers(m, n), out=sums[1:])
        out = np.zeros(n, dtype=np.uint64)
        out[: n - k + 1] = mix((sums[k:] - sums[: n - k + 1]) * powers(_inverse(m), n - k + 1))
        return out

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one row."""
        last = np.repeat(self.first[1:], self.counts)
        return np.arange(len(self.hash)) + k <= last


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return off, raw


def split_words(column: pa.Array, is_word: np.ndarray = SPACED, lower: bool = False, chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a string column, some rows at a time; a row is never cut."""
    if len(column) == 0:
        return
    off, raw = string_buffers(column)
    r, n = 0, len(off) - 1
    while r < n:
        to = max(r + 1, int(np.searchsorted(off, off[r] + chunk, side="right")) - 1)
        yield _split(r, off[r : to + 1] - off[r], raw[off[r] : off[to]], is_word, lower)
        r = to


def _split(first_row: int, off: np.ndarray, data: np.ndarray, is_word: np.ndarray, lower: bool) -> Words:
    rows, n = len(off) - 1, len(data)
    if lower:
        data = _LOWER[data]
    inside = is_word[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] |= inside[edge]
        ends[edge - 1] |= inside[edge - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers(_BYTE_MULTIPLIER, n), out=sums[1:])
    h = mix((sums[end] - sums[start]) * powers(_inverse(_BYTE_MULTIPLIER), n)[start] + (end - start).astype(np.uint64))
    return Words(first_row, rows, data, start, end, np.searchsorted(start, off), h)
