"""Enhanced suffix arrays of many short texts, and their maximal repeats.

Suffixes are sorted within groups of texts, neighbours get the length of their
common prefix, and a stack scan over these lengths walks the tree of common
prefix intervals bottom up. An interval whose suffixes are preceded by different
bytes cannot be extended to the left: it is a maximal repeat, given with all its
occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class SuffixArray:
    """Suffixes of at least ``least`` bytes of texts data[first[t]:first[t + 1]], sorted within ``group``.

    ``text`` and ``at`` give the text and offset of each sorted suffix, ``lcp`` its
    common prefix with the one before it (0 across groups).
    """

    def __init__(self, data: np.ndarray, first: np.ndarray, group: np.ndarray, least: int) -> None:
        length = np.diff(first)
        n = np.maximum(0, length - least + 1)
        text = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        rest = length[text] - at
        width = -(-int(length.max(initial=1)) // 8) * 8
        padded = np.concatenate([data, np.zeros(width, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, width)[first[text] + at]
        rows = np.where(np.arange(width) < rest[:, None], rows, 0).astype(np.uint8)
        words = rows.view(">u8").astype(np.uint64)
        order = np.lexsort([*words.T[::-1], group[text]]) if len(text) else np.empty(0, np.int64)
        self.text, self.at, self.data, self.first = text[order], at[order], data, first
        rows, rest, groups = rows[order], rest[order], group[self.text]
        self.lcp = np.zeros(len(order), np.int64)
        if len(order) > 1:
            differ = rows[1:] != rows[:-1]
            same = np.where(differ.any(1), differ.argmax(1), width)
            self.lcp[1:] = np.where(groups[1:] == groups[:-1], np.minimum(same, np.minimum(rest[1:], rest[:-1])), 0)

    def before(self) -> np.ndarray:
        """Byte before each sorted suffix; for the start of a text -1 - its number, unlike any other."""
        inner = self.at > 0
        return np.where(inner, self.data[np.maximum(self.first[self.text] + self.at - 1, 0)].astype(np.int64), -1 - self.text)

    def intervals(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(depth, lo, hi) of every common prefix interval of ``least`` bytes or more; children first."""
        starts = np.flatnonzero((self.lcp >= least) & ~np.concatenate([[False], self.lcp[:-1] >= least]))
        ends = np.flatnonzero((self.lcp >= least) & ~np.concatenate([self.lcp[1:] >= least, [False]])) + 1
        for a, b in zip(starts.tolist(), ends.tolist()):
            lcp = self.lcp[a:b].tolist()
            stack: list[tuple[int, int]] = []
            for i, depth in enumerate([*lcp, 0], a):
                lo = i - 1
                while stack and stack[-1][0] > depth:
                    top, lo = stack.pop()
                    yield top, lo, i
                if depth and (not stack or stack[-1][0] < depth):
                    stack.append((depth, lo))

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """Length and sorted places of every repeat that no common byte extends to the left."""
        before = self.before()
        for depth, lo, hi in self.intervals(least):
            b = before[lo:hi]
            if (b != b[0]).any():
                yield depth, np.arange(lo, hi)


def repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Maximal repeats of at least ``least`` bytes in a few texts: content and all (text, offset)."""
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    found = SuffixArray(np.frombuffer(b"".join(texts), np.uint8), first, np.zeros(len(texts), np.int64), least)
    out = []
    for depth, places in found.maximal_repeats(least):
        where = sorted(zip(found.text[places].tolist(), found.at[places].tolist()))
        t, p = where[0]
        out.append((texts[t][p : p + depth], where))
    return sorted(out)
