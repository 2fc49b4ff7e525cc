"""Deep-shallow sorting of byte strings: multikey quicksort above, blind tries below.

Strings are ordered inside groups. The shallow phase splits groups of equal prefixes by eight
bytes at a time and touches only groups that still tie, which is a multikey quicksort with words
for characters. Groups that tie beyond ``SHALLOW`` bytes have long common prefixes; going on byte by
byte would read those again and again. The deep phase puts such a group into a blind (Patricia)
trie: an insertion walks down by branching bytes alone, compares with one string at the leaf, and
splits the path where they differ.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64


class BlindTrie:
    """Patricia trie over byte strings. A node is ``[depth, {byte: child}]``, a leaf
    ``(string, [numbers])``; the byte -1 stands for the end of a string."""

    def __init__(self):
        self.root = None

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - 1 - (differ.bit_length() - 1) // 8

    def insert(self, text: bytes, number: int) -> None:
        if self.root is None:
            self.root = (text, [number])
            return
        node = self.root
        while isinstance(node, list):
            depth, children = node
            c = text[depth] if depth < len(text) else -1
            node = children[c] if c in children else next(iter(children.values()))
        if node[0] == text:
            node[1].append(number)
            return
        same = self.common(node[0], text)
        old = node[0][same] if same < len(node[0]) else -1
        new = text[same] if same < len(text) else -1
        above, key, node = None, None, self.root
        while isinstance(node, list) and node[0] < same:
            above, key = node, text[node[0]]
            node = node[1][key]
        leaf = (text, [number])
        if isinstance(node, list) and node[0] == same:
            node[1][new] = leaf
            return
        branch = [same, {old: node, new: leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][key] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.extend(node[1])
        return out


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of bytes, filled up with zeros."""
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8)
    return flat.reshape(len(strings), width)


def deep_shallow_sort(strings: list[bytes], groups: np.ndarray, width: int
                      ) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, then string; and the common prefix of each string with the one before.

    Strings are at most ``width`` bytes. Across groups the common prefix is -1.
    """
    n = len(strings)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    width = -(-max(width, SHALLOW) // 8) * 8
    matrix = _matrix(strings, width)
    words = matrix[:, :SHALLOW].copy().view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    place = np.zeros(n, dtype=np.int64)  # by position in the order: where its tie begins
    g = groups[order]
    start = np.concatenate([[True], g[1:] != g[:-1]])
    place = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    for d in range(SHALLOW // 8):
        size = np.bincount(place, minlength=n)
        tied = np.flatnonzero(size[place] > 1)
        if len(tied) == 0:
            break
        rows, tie = order[tied], place[tied]
        w = words[rows, d]
        sub = np.lexsort((w, tie))
        rows, w = rows[sub], w[sub]  # ties are runs of places, so their order stays
        order[tied] = rows
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (tie[1:] != tie[:-1])])
        place[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
    size = np.bincount(place, minlength=n)
    for first in np.flatnonzero(size > 1):
        tie = slice(first, first + size[first])
        rows = order[tie].tolist()
        trie = BlindTrie()
        # What ties so far may differ in length only (zeros against nothing), so whole strings
        # go into the trie unless all reach below the shallow depth.
        cut = SHALLOW if min(len(strings[r]) for r in rows) >= SHALLOW else 0
        for r in rows:
            trie.insert(strings[r][cut:], r)
        order[tie] = trie.ordered()
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    lcp = np.full(n, -1, dtype=np.int64)
    for a in range(1, n, 1 << 14):  # blocks bound the memory of the comparison
        here, above = order[a:a + (1 << 14)], order[a - 1:a - 1 + min(1 << 14, n - a)]
        differ = matrix[here] != matrix[above]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[a:a + (1 << 14)] = np.where(
            groups[here] == groups[above],
            np.minimum(first, np.minimum(lengths[here], lengths[above])), -1)
    return order, lcp
