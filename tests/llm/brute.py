"""Plain re-computations that the operators are held against."""

from __future__ import annotations

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = SPACE.findall(lower(text or ""))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id), by comparing every pair that shares a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    by: dict[tuple[str, ...], list[int]] = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    pairs = {(a, b) for group in by.values() for a in group for b in group if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}
