"""Suffix arrays over short texts of symbols, searched for long matches in which symbols differ by at most one.

A text is 64 symbols, read around; a suffix is the text read from one of its starts. A suffix array holds the suffixes
of one start in sorted order, with the number of leading symbols that each shares with the one before it. Suffixes with
a common beginning stand together, so a search goes down both arrays at once: from each pair of such stretches to their
next symbols, found by bisection, until the match is as long as asked. It finds every pair, none is left to chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Pairs held at a time, and pairs of suffixes below which two stretches are compared directly.
CHUNK, DIRECT = 1 << 20, 4
#: Texts compared at a time as a batch of their own, and matches from which a text is hot.
SLICE, HOT = 4096, 256

Covers = Callable[[np.ndarray, np.ndarray], np.ndarray]


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each stretch, one after the other."""
    offset = np.cumsum(size) - size
    return np.repeat(begin - offset, size) + np.arange(int(size.sum()))


class SuffixArray:
    """Sorted suffixes (``x``: rows x symbols, uint8, below 255) with their ids, up to ``depth`` symbols; immutable."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, depth: int):
        words = np.zeros((len(x), -(-depth // 8) * 8), np.uint8)
        words[:, :depth] = x[:, :depth]
        order = np.lexsort(words.view(">u8").astype(np.uint64).T[::-1]) if len(x) else np.zeros(0, np.int64)
        self.x, self.ids, self.depth = x[order], ids[order], depth
        differ = self.x[1:, :depth] != self.x[:-1, :depth]
        self.shared = np.r_[np.zeros(min(len(x), 1), np.int64), np.where(differ.any(axis=1), differ.argmax(axis=1), depth)]
        self._levels: list = []

    def __len__(self) -> int:
        return len(self.ids)

    def merged(self, other: SuffixArray) -> SuffixArray:
        return SuffixArray(np.concatenate([self.x, other.x]), np.concatenate([self.ids, other.ids]), self.depth)

    def level(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches that share d + 1 symbols: their starts (and the end), first child of each one above, and a sorted key."""
        while len(self._levels) <= d:
            k = len(self._levels)
            above = self._levels[-1][0][:-1] if k else np.zeros(1, np.int64)
            starts = np.flatnonzero(self.shared <= k)
            parent = np.searchsorted(above, starts, "right") - 1
            key = parent * 256 + self.x[starts, k]
            self._levels.append((np.r_[starts, len(self)], np.r_[np.searchsorted(starts, above), len(starts)], key))
        return self._levels[d]


def long_matches(new: SuffixArray, old: SuffixArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``new`` and of ``old`` whose first ``depth`` symbols may all be within one, in pieces of bounded size."""
    if not len(new) or not len(old):
        return
    root = np.zeros(1, np.int64)
    stack = [(0, root, root)]
    while stack:
        d, a, b = stack.pop()
        starts_a, child_a, key_a = new.level(d)
        starts_b, _, key_b = old.level(d)
        first, size = child_a[a], child_a[a + 1] - child_a[a]
        a = spans(first, size)
        at = np.repeat(b, size) * 256 + (key_a[a] & 255)
        low = np.searchsorted(key_b, at - ((at & 255) > 0), "left")
        n = np.searchsorted(key_b, at + 1, "right") - low
        a, b = np.repeat(a, n), spans(low, n)
        size_a, size_b = starts_a[a + 1] - starts_a[a], starts_b[b + 1] - starts_b[b]
        done = size_a * size_b <= DIRECT if d + 1 < new.depth else np.ones(len(a), bool)
        yield from _products(starts_a[a[done]], size_a[done], starts_b[b[done]], size_b[done])
        a, b = a[~done], b[~done]
        for s in range(0, len(a), CHUNK):
            stack.append((d + 1, a[s : s + CHUNK], b[s : s + CHUNK]))


def _products(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All rows of each stretch with all of its partner, at most about CHUNK pairs at a time."""
    rows = spans(a, size_a)
    b, size_b = np.repeat(b, size_a), np.repeat(size_b, size_a)
    ends, s = np.cumsum(size_b), 0
    while s < len(rows):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + CHUNK, "right")))
        yield np.repeat(rows[s:e], size_b[s:e]), spans(b[s:e], size_b[s:e])
        s = e


def matches(new: SuffixArray, old: SuffixArray, covers: Covers) -> tuple[np.ndarray, np.ndarray]:
    """Ids (smaller, larger) of different texts with a long match whose whole texts ``covers`` finds alike."""
    lo, hi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in long_matches(new, old):
        i, j = new.ids[a], old.ids[b]
        ask = np.flatnonzero(i > j if new is old else i != j)
        for s in range(0, len(ask), CHUNK // 8):
            k = ask[s : s + CHUNK // 8]
            k = k[covers(new.x[a[k]], old.x[b[k]])]
            lo.append(np.minimum(i[k], j[k]))
            hi.append(np.maximum(i[k], j[k]))
    return np.concatenate(lo), np.concatenate(hi)


def replay(x: np.ndarray, ids: np.ndarray, batch: np.ndarray, depth: int, covers: Covers, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Meet texts batch by batch: (lo, hi) of each pair that ``covers`` finds alike, and (leader, id) of texts left out.

    Each batch, in slices of bounded size, is made a segment: a suffix array that is searched in the segments before it and
    in itself, and then stands unchanged until it is merged with one of like size, so that there is never more than a
    logarithm of segments. A text that a hot one (HOT matches and more) covers is compared with all smaller ids, but gets
    no place in a segment: larger ids don't meet it, and it is named with its leader. Rows of ``history`` are searched,
    but not among themselves.
    """
    order = np.lexsort((ids, batch, ~history))
    segments: list[SuffixArray] = []
    count: dict[int, int] = {}
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    left: list[tuple[np.ndarray, np.ndarray]] = []

    def add(segment: SuffixArray) -> None:
        segments.append(segment)
        while len(segments) > 1 and len(segments[-2]) <= 2 * len(segments[-1]):
            last = segments.pop()
            segments.append(segments.pop().merged(last))

    def hot_among(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Counts the matches; gives the ids that a hot text covers (itself not covered), each named in ``left``."""
        out: set[int] = set()
        by = np.lexsort((hi, lo))
        lo, hi = lo[by], hi[by]
        leader, begin, n = np.unique(lo, return_index=True, return_counts=True)
        for k in range(len(leader)):
            name = int(leader[k])
            if name in out:
                continue
            count[name] = count.get(name, 0) + int(n[k])
            if count[name] > HOT:
                of = hi[begin[k] : begin[k] + n[k]]
                of = of[~np.isin(of, np.fromiter(out, np.int64, len(out)))]
                left.append((np.full(len(of), name), of))
                out.update(of.tolist())
        return np.fromiter(out, np.int64, len(out))

    old = order[history[order]]
    if len(old):
        add(SuffixArray(x[old], ids[old], depth))
    fresh = order[~history[order]]
    for part in np.split(fresh, np.flatnonzero(np.diff(batch[fresh])) + 1) if len(fresh) else []:
        for s in range(0, len(part), SLICE):
            rows = part[s : s + SLICE]
            new = SuffixArray(x[rows], ids[rows], depth)
            found = [matches(new, held, covers) for held in segments]
            lo, hi = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            pairs.append((lo, hi))
            own = np.isin(hi, ids[rows])  # of history, ids may be larger
            out = hot_among(lo[own], hi[own])
            covered = rows[np.isin(ids[rows], out)]
            if len(covered):
                rows = rows[~np.isin(ids[rows], out)]
                new = SuffixArray(x[rows], ids[rows], depth)
                lo, hi = matches(SuffixArray(x[covered], ids[covered], depth), new, covers)
                pairs.append((lo[np.isin(hi, out)], hi[np.isin(hi, out)]))
            lo, hi = matches(new, new, covers)
            out = hot_among(lo, hi)
            seen = ~np.isin(lo, out)
            pairs.append((lo[seen], hi[seen]))
            if len(out):
                rows = rows[~np.isin(ids[rows], out)]
                new = SuffixArray(x[rows], ids[rows], depth)
            if len(new):
                add(new)
    none = (np.zeros(0, np.int64),) * 2
    lo, hi = (np.concatenate(c) for c in zip(none, *pairs))
    leader, id_ = (np.concatenate(c) for c in zip(none, *left))
    return lo, hi, leader, id_
