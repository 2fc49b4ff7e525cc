"""Vectorised hashing of words and byte windows inside an Arrow batch.

An Arrow string column already is one UTF-8 buffer with offsets, so words and windows of all
documents of a slice are hashed at once with numpy, without a Python object per word. Hashes
depend on the bytes alone: they are the same in every process, batch and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from voucherlens.llm.common import kept

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * _BASE + U64(seed)) | U64(1)


@lru_cache(maxsize=4)
def _byte_codes(lower: bool) -> np.ndarray:
    codes = constants(7, 256).copy()
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse; kept for ordinary slices, not for giants."""
    powers = kept("hashing")
    if powers and len(powers["base"]) > n:
        return powers["base"], powers["inverse"]
    size = max(n + 1, SLICE_BYTES + (1 << 16))
    made = []
    for b in (_BASE, _BASE_INV):
        p = np.full(size, b, dtype=U64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=U64))
    if size <= 2 * SLICE_BYTES:
        powers.update(base=made[0], inverse=made[1])
    return made[0], made[1]


class Texts:
    """Some documents as one byte buffer: document ``i`` is ``buf[offs[i]:offs[i + 1]]``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def prefix(self, lower: bool = False) -> np.ndarray:
        """Prefix sums from which :meth:`span_hash` reads the hash of any span."""
        power, _ = _powers(len(self.buf))
        out = np.zeros(len(self.buf) + 1, dtype=U64)
        np.cumsum(_byte_codes(lower)[self.buf] * power[:len(self.buf)], out=out[1:])
        return out

    def span_hash(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans ``start`` to ``end``; they depend on content and length."""
        _, inverse = _powers(len(self.buf))
        with np.errstate(over="ignore"):
            h = (prefix[end] - prefix[start]) * inverse[start]
            return mix(h + (end - start).astype(U64) * U64(0xD1B54A32D192ED03))

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and per document the number of words before it.

        A word is a maximal run of bytes with ``is_word[byte]`` within one document.
        """
        n = len(self.buf)
        mask = np.zeros(n + 2, dtype=bool)
        mask[1:-1] = is_word[self.buf]
        first = mask[1:] & ~mask[:-1]  # at n: never
        last = mask[:-1] & ~mask[1:]   # ends (exclusive)
        inner = self.offs[(self.offs > 0) & (self.offs < n)]
        both = inner[mask[inner] & mask[inner + 1]]  # a word runs up to a border and one starts
        first[both] = True
        last[both] = True
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        return starts, ends, np.searchsorted(starts, self.offs)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES
           ) -> Iterator[tuple[int, int, Texts]]:
    """Cuts a string column into runs of rows of about ``limit`` bytes: (from, to, texts).

    A longer document is a slice of its own, never cut. Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    n = len(array)
    if n == 0:
        return
    offs = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + n + 1]
    data = array.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to, Texts(buf[offs[at]:offs[to]], offs[at:to + 1] - offs[at])
        at = to


def byte_class(separators: bytes) -> np.ndarray:
    """Table of the bytes that belong to words: all but ``separators``."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


# Words are runs of anything but space and the controls 0x09 to 0x0D.
SPACE_WORDS = byte_class(b"\x20" + bytes(range(0x09, 0x0E)))


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``concat(arange(s, s + l))`` over all pairs, without a loop."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def ngram_hash(words: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes (document borders not regarded)."""
    if len(words) < n:
        return np.zeros(0, dtype=U64)
    k = constants(seed + n, n)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, dtype=U64)
        for j in range(n):
            h += mix(words[j:len(words) - n + 1 + j] * k[j])
        return mix(h)
