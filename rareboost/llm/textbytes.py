"""Whole texts as byte arrays: words, rolling hashes and sliding minima, vectorised over Arrow batches.

A batch is worked off in runs of whole documents of about CHUNK bytes, so memory
follows the longest document and not the batch. Hashes are 64 bits: polynomial
prefix sums modulo 2**64 with an odd base, then a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Characters of words of letters and digits: 0-9, A-Z, a-z and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offsets of each; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive documents [a, b) of at most ``limit`` bytes together, one document at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2**64."""
    size = max(1 << 16, 1 << int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, _U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=_U))
        _powers[size] = tuple(made)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of ``h`` over the result."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal contents hash alike wherever they stand."""
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[: len(values)], dtype=_U, out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbouring values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[: len(values)], dtype=_U, out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n] + _U(k * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (bytes where ``inside`` holds) and each document's first word."""
    is_in = inside[data]
    before = np.empty_like(is_in)
    before[:1] = False
    before[1:] = is_in[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    starts = np.flatnonzero(is_in & ~before)
    after = np.empty_like(is_in)
    after[-1:] = False
    after[:-1] = is_in[1:]
    after[edge - 1] = False
    return starts, np.flatnonzero(is_in & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased, and each document's first word."""
    starts, ends, first = words(data, offsets, inside)
    return spans_hash(LOWER[data].astype(_U) + _U(1), starts, ends), first


def sliding(values: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every w neighbouring values, in log w passes."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out, width = values, 1
    while width < w:
        step = min(width, w - width)
        out = pick(out[: len(out) - step], out[step:])
        width += step
    return out[:n]


def winnow(hashes: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    """Positions that hold the least hash of some valid window of w hashes; ties are all taken.

    ``valid`` says for each window start whether the window lies in one document.
    Equal windows choose equal places, whatever surrounds them.
    """
    least = sliding(hashes, w, np.minimum)
    if not len(least):
        return np.empty(0, np.int64)
    least = np.where(valid[: len(least)], least, _U(0))
    padded = np.concatenate([np.zeros(w - 1, _U), least, np.zeros(w - 1, _U)])
    return np.flatnonzero(sliding(padded, w, np.maximum) == hashes)


class Lookup:
    """Exact membership of hashes in a sorted list, behind a bitmap of their upper bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(hashes >> _U(48)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of each value that occurs, and the range of its places in the sorted list."""
        at = np.flatnonzero(self.seen[(values >> _U(48)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, values[at], "left")
        hi = np.searchsorted(self.hashes, values[at], "right")
        there = hi > lo
        return at[there], lo[there], hi[there]


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [lo, hi): the index of the range and each number in it."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
