"""Elias-Fano sequences and the n-gram trie built of them, over flat buffers.

A sequence of ``n`` non-decreasing numbers below ``u`` is kept in about ``2 + log2(u / n)`` bits
each: the low bits packed side by side, the high parts in unary. All queries take arrays and run
as numpy passes over the buffer, which may be bytes from a table or a file mapped into memory.
"""

from __future__ import annotations

import mmap

import numpy as np

U64 = np.uint64
_MAGIC = 0x454654524945
_POP8 = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _select_in_byte() -> np.ndarray:
    table = np.zeros((256, 8), dtype=np.uint8)
    for byte in range(256):
        for rank, bit in enumerate(i for i in range(8) if byte >> i & 1):
            table[byte, rank] = bit
    return table


_SELECT8 = _select_in_byte()


def _zeros_select(high: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Bit places of the zeros with the ranks ``k`` (from 0)."""
    byte = np.searchsorted(before, k, side="right") - 1
    return byte * 8 + _SELECT8[~high[byte], k - before[byte]]


class EliasFano:
    """Read access to an encoded sequence. ``low`` and ``high`` are views into one buffer."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = _POP8[high].astype(np.int64)
        self.ones_before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros_before = np.arange(len(high) + 1, dtype=np.int64) * 8 - self.ones_before

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        """Header (n, width, bytes of low, bytes of high), low bits, high bits."""
        n = len(values)
        values = values.astype(U64)
        width = max(0, (universe // max(1, n)).bit_length() - 1)
        low = b""
        if n and width:
            bits = np.zeros((n, width), dtype=np.uint8)
            for i in range(width):
                bits[:, i] = (values >> U64(i)) & U64(1)
            low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        # Eight spare bytes, so that a value can be read as one 64-bit word and one byte.
        low += bytes(9)
        tops = (values >> U64(width)).astype(np.int64)
        unary = np.zeros(n + (int(tops[-1]) if n else 0) + 2, dtype=np.uint8)
        unary[tops + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").tobytes()
        head = np.array([n, width, len(low), len(high)], dtype=np.int64).tobytes()
        return head + low + high

    @classmethod
    def read(cls, buf: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """The sequence at byte ``at`` and the place behind it."""
        n, width, n_low, n_high = (int(x) for x in np.frombuffer(buf[at:at + 32], np.int64))
        at += 32
        low, high = buf[at:at + n_low], buf[at + n_low:at + n_low + n_high]
        return cls(n, width, low, high), at + n_low + n_high

    def _low(self, i: np.ndarray) -> np.ndarray:
        if self.width == 0:
            return np.zeros(len(i), dtype=U64)
        bit = i * self.width
        byte, shift = bit >> 3, (bit & 7).astype(U64)
        word = np.zeros(len(i), dtype=U64)
        for k in range((self.width + 14) // 8):
            part = self.low[byte + k].astype(U64)
            place = 8 * k
            if place < 64:
                word |= (part << U64(place)) >> shift
                if place + 8 > 64 - 7:  # bits that the left shift pushed out
                    spilt = np.maximum(place + 8 - 64, 0)
                    if spilt:
                        word |= part >> U64(8 - spilt) << (U64(64) - shift)
            else:
                word |= np.where(shift > 0, part << ((U64(place) - shift) & U64(63)), U64(0))
        return word & U64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        i = np.asarray(i, dtype=np.int64)
        byte = np.searchsorted(self.ones_before, i, side="right") - 1
        place = byte * 8 + _SELECT8[self.high[byte], i - self.ones_before[byte]]
        return ((place - i).astype(U64) << U64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each ``x`` the place of the first value that is not below it (``n`` if none)."""
        x = np.asarray(x, dtype=U64)
        top = (x >> U64(self.width)).astype(np.int64)
        zeros = int(self.zeros_before[-1])
        # Values with high part t lie between the t-th and the (t + 1)-th zero.
        first = np.zeros(len(x), dtype=np.int64)
        some = (top > 0) & (top <= zeros)
        first[some] = _zeros_select(self.high, self.zeros_before, top[some] - 1) - (top[some] - 1)
        first[top > zeros] = self.n
        last = np.full(len(x), self.n, dtype=np.int64)
        some = top < zeros
        last[some] = _zeros_select(self.high, self.zeros_before, top[some]) - top[some]
        first, last = np.minimum(first, self.n), np.minimum(last, self.n)
        want = x & U64((1 << self.width) - 1)
        # Binary search by the low bits inside the (short) run of equal high parts.
        lo, hi = first, last
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            below = self._low(mid) < want[active]
            lo[active[below]] = mid[below] + 1
            hi[active[~below]] = mid[~below]
            active = active[lo[active] < hi[active]]
        return lo


CONTEXT_BITS, SUCCESSOR_BITS = 48, 40
CODE_STEP = 10 / 254  # log10 probabilities from 0 down to -10 in 254 steps


def quantise(log10_p: np.ndarray) -> np.ndarray:
    """Codes 1..255; rounding is towards less probability, so that sums stay below one."""
    return np.clip(np.ceil(-log10_p / CODE_STEP - 1e-9), 0, 254).astype(np.uint8) + np.uint8(1)


def probability(codes: np.ndarray) -> np.ndarray:
    """What a code stands for; code 0 (absent) is probability 0."""
    table = np.concatenate([[0.0], 10.0 ** (-CODE_STEP * np.arange(255))])
    return table[codes]


class NgramTrie:
    """Contexts, monotone pointers to their successors, and one probability code a successor.

    Successors of all contexts form one increasing sequence: each context adds the largest
    shifted value so far to its own. They are found relative to their context, by a successor
    search for the shifted value between the context's pointers.
    """

    def __init__(self, buf: np.ndarray):
        head = np.frombuffer(buf[:16], dtype=np.int64)
        if head[0] != _MAGIC:
            raise ValueError("not an n-gram trie")
        self.contexts, at = EliasFano.read(buf, 16)
        self.pointers, at = EliasFano.read(buf, at)
        self.successors, at = EliasFano.read(buf, at)
        self.codes = buf[at:at + int(head[1])]

    @classmethod
    def from_bytes(cls, data: bytes) -> NgramTrie:
        return cls(np.frombuffer(data, dtype=np.uint8))

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        """A trie in a file, mapped into memory: pages are read when a query touches them."""
        with open(path, "rb") as f:
            return cls(np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ),
                                     dtype=np.uint8))

    @staticmethod
    def build(context: np.ndarray, successor: np.ndarray, log10_p: np.ndarray) -> bytes:
        """From n-grams sorted by context, then successor, without repetition."""
        n = len(context)
        new = np.ones(n, dtype=bool)
        new[1:] = context[1:] != context[:-1]
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        shifted = successor.astype(U64) + which.astype(U64) * U64(1 << SUCCESSOR_BITS)
        pointers = np.concatenate([starts, [n]]) if n else np.zeros(1, dtype=np.int64)
        parts = [np.array([_MAGIC, n], dtype=np.int64).tobytes(),
                 EliasFano.encode(context[starts], 1 << CONTEXT_BITS),
                 EliasFano.encode(pointers, n + 1),
                 EliasFano.encode(shifted, max(1, len(starts)) << SUCCESSOR_BITS),
                 quantise(log10_p).tobytes()]
        return b"".join(parts)

    def find(self, context: np.ndarray, lengths: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of n-grams, 0 where the trie has none.

        ``context[i]`` is asked for with the next ``lengths[i]`` of ``successor``.
        """
        codes = np.zeros(len(successor), dtype=np.uint8)
        if self.contexts.n == 0 or len(successor) == 0:
            return codes
        place = self.contexts.successor(context)
        known = place < self.contexts.n
        known[known] = self.contexts.access(place[known]) == context[known].astype(U64)
        lo, hi = np.zeros((2, len(context)), dtype=np.int64)
        lo[known] = self.pointers.access(place[known])
        hi[known] = self.pointers.access(place[known] + 1)
        ask = np.flatnonzero(np.repeat(known, lengths))
        which = np.repeat(np.arange(len(context)), lengths)[ask]
        shifted = (successor[ask].astype(U64)
                   + place[which].astype(U64) * U64(1 << SUCCESSOR_BITS))
        at = self.successors.successor(shifted)
        inside = (at >= lo[which]) & (at < hi[which])
        ask, at, shifted = ask[inside], at[inside], shifted[inside]
        same = self.successors.access(at) == shifted
        codes[ask[same]] = self.codes[at[same]]
        return codes
