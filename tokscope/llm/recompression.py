"""Locally consistent parsing of word sequences by restricted recompression, in numpy."""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Rounds: (kind, longest symbol that takes part, in words).  Two neighbours merge if both are that short and
#: are equal ("run") or open and close by the round's bits ("pair").
ROUNDS = (("run", 1), ("pair", 1), ("pair", 1), ("run", 2), ("pair", 2), ("pair", 2))
#: Whether a symbol's edge stays depends on so many words on either side of it, and on nothing else.
CONTEXT = sum(reach for _, reach in ROUNDS)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def parse(h: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the word hashes ``h``: (name, start, end).

    ``edge`` marks the first word of each document; no symbol reaches over it.  A name is a hash of the names
    merged into it, so equal runs and pairs get the same name everywhere, in every task.
    """
    name, start = mix64(h), np.arange(len(h), dtype=np.int64)
    for k, (kind, reach) in enumerate(ROUNDS):
        if len(name) < 2:
            break
        size = np.diff(np.append(start, len(h)))
        near = (size[:-1] <= reach) & (size[1:] <= reach) & ~edge[start[1:]]
        if kind == "run":
            joins = near & (name[:-1] == name[1:])
        else:
            salt = np.uint64((k + 1) * int(_B) & 0xFFFFFFFFFFFFFFFF)
            bit = (mix64(name + salt) & np.uint64(1)).astype(bool)
            joins = near & ~bit[:-1] & bit[1:]
        if not joins.any():
            continue
        first = np.flatnonzero(np.append(True, ~joins))
        count = np.diff(np.append(first, len(name)))
        merged = name[first].copy()
        many = count > 1
        if kind == "run":
            merged[many] = mix64(merged[many] * _A + count[many].astype(np.uint64) * _B)
        else:
            merged[many] = mix64(merged[many] * _A + name[first[many] + 1] * _B + np.uint64(1))
        name, start = merged, start[first]
    return name, start, np.append(start[1:], len(h))


class Prefix:
    """Hashes of stretches of a sequence in constant time: two independent 64-bit sums."""

    BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
    _powers: list[tuple[np.ndarray, np.ndarray]] = []

    @classmethod
    def powers(cls, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The bases' and their inverses' first n powers, kept between calls."""
        if not cls._powers or len(cls._powers[0][0]) < n:
            size = max(n, 1 << 16)
            run = lambda x: np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64)))
            cls._powers = [(run(b), run(pow(b, -1, 1 << 64))) for b in cls.BASES]
        return cls._powers

    def __init__(self, h: np.ndarray):
        self.back, self.total = [], []
        for b, (power, back) in zip(self.BASES, self.powers(len(h) + 1), strict=True):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum((h ^ (h >> np.uint64(29)) + np.uint64(b & 0xFFFF)) * power[: len(h)], out=total[1:])
            self.total.append(total)
            self.back.append(back)

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        total = self.total[which]
        return mix64((total[end] - total[start]) * self.back[which][start] + (end - start).astype(np.uint64))


def chosen(name: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For each window (``at``: its first word) the symbol that stands for it, or -1.

    Of the symbols at least CONTEXT words inside the window, the one with the least hash, and of these the first:
    equal windows hold equal symbols there, so they choose the same place.
    """
    n = int(end[-1]) if len(end) else 0
    starts, ends = np.zeros(n + 2, np.int64), np.zeros(n + 2, np.int64)
    starts[start + 1] = 1  # symbols that start before a place
    ends[end] = 1  # symbols that end at a place or before
    np.cumsum(starts, out=starts)
    np.cumsum(ends, out=ends)
    a = starts[at + CONTEXT]
    size = np.maximum(ends[at + window - CONTEXT] - a, 0)
    order = mix64(name ^ _B)
    out = np.full(len(at), -1, np.int64)
    least, best = order, np.arange(len(name))  # of the 2 ** level symbols from each one on
    level, most = 0, int(size.max(initial=0))
    while 1 << level <= most:
        width = 1 << level
        now = np.flatnonzero((size >= width) & (size < 2 * width))
        lo = a[now]
        hi = lo + size[now] - width
        out[now] = np.where(least[lo] <= least[hi], best[lo], best[hi])
        if len(least) <= width:
            break
        left, right = least[:-width], least[width:]
        first = left <= right
        least, best = np.where(first, left, right), np.where(first, best[:-width], best[width:])
        level += 1
    return out
