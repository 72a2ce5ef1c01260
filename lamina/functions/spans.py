"""A slice as spans on a line: run (y, x0, x1) is [y * width + x0, y * width + x1).

The line of an image with spare columns between its rows makes every set operation on
runs one of intervals: sorted arrays, two binary searches and no pixel. ``width`` must
exceed the right-most column by two or more, so that no span touches the next row.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SPARE = 4  # columns between rows


class Slice(NamedTuple):
    """Disjoint spans in order, each with an id."""

    start: np.ndarray
    end: np.ndarray
    id: np.ndarray

    def where(self, keep: np.ndarray) -> Slice:
        return Slice(self.start[keep], self.end[keep], self.id[keep])

    def sorted(self) -> Slice:
        by = np.argsort(self.start, kind="stable")
        return Slice(self.start[by], self.end[by], self.id[by])


NOTHING = Slice(*(np.zeros(0, np.int64) for _ in range(3)))


def of_runs(y, x0, x1, ids, width: int) -> Slice:
    y, a, b, i = (np.asarray(v, np.int64) for v in (y, x0, x1, ids))
    return Slice(y * width + a, y * width + b, i).sorted()


def to_runs(line: Slice, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1, id); touching spans of one id become one run."""
    if not len(line.start):
        return line.start, line.start, line.start, line.id
    new = np.ones(len(line.start), bool)
    new[1:] = (line.start[1:] != line.end[:-1]) | (line.id[1:] != line.id[:-1])
    first = np.flatnonzero(new)
    start, end = line.start[first], line.end[np.append(first[1:], len(new)) - 1]
    y = start // width
    return y, start - y * width, end - y * width, line.id[first]


def meet(s: np.ndarray, e: np.ndarray, t: np.ndarray, u: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, common): spans i of the first set and j of the second that overlap, or come within ``slack``."""
    low, high = np.searchsorted(u, s - slack, "right"), np.searchsorted(t, e + slack, "left")
    n = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(s)), n)
    j = np.repeat(low, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    return i, j, np.minimum(e[i], u[j]) - np.maximum(s[i], t[j])


def minus(line: Slice, s: np.ndarray, e: np.ndarray) -> Slice:
    """What of ``line`` lies outside the spans [s, e)."""
    far = np.iinfo(np.int64).max // 4
    t, u = np.concatenate([[-far], e]), np.concatenate([s, [far]])
    i, j, common = meet(line.start, line.end, t, u)
    i, j = i[common > 0], j[common > 0]
    return Slice(np.maximum(line.start[i], t[j]), np.minimum(line.end[i], u[j]), line.id[i])


def painted(line: Slice, s: np.ndarray, e: np.ndarray, value: int) -> Slice:
    """``line`` with the spans [s, e) drawn over it."""
    rest = minus(line, s, e)
    return Slice(np.concatenate([rest.start, s]), np.concatenate([rest.end, e]), np.concatenate([rest.id, np.full(len(s), value, np.int64)])).sorted()


def union(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of any spans, as disjoint ones in order."""
    by = np.argsort(s, kind="stable")
    s, e = s[by], e[by]
    reach = np.maximum.accumulate(e) if len(e) else e
    first = np.flatnonzero(np.append(True, s[1:] > reach[:-1])) if len(s) else np.zeros(0, np.int64)
    return s[first], reach[np.append(first[1:], len(s)) - 1] if len(s) else e


def sums(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sum of ``n`` for each."""
    if not len(n):
        return (*keys, n)
    by = np.lexsort(keys[::-1])
    ordered = [k[by] for k in keys]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in ordered], axis=0))
    return (*(k[new] for k in ordered), np.add.reduceat(n[by], np.flatnonzero(new)))


def sizes(line: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(id, voxels) by id."""
    return sums((line.id,), line.end - line.start)


def overlaps(a: Slice, b: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of a, id of b, common voxels), in order."""
    i, j, common = meet(a.start, a.end, b.start, b.end)
    return sums((a.id[i], b.id[j]), common)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component; edges (a, b) over nodes 0 to n - 1."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def touching(line: Slice, width: int, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of spans of one id that touch by edges; with ``slack`` 1 by corners too."""
    i, j, _ = meet(line.start + width, line.end + width, line.start, line.end, slack)
    side = np.flatnonzero(line.start[1:] == line.end[:-1]) if len(line.start) else np.zeros(0, np.int64)
    i, j = np.concatenate([i, side]), np.concatenate([j, side + 1])
    same = line.id[i] == line.id[j]
    return i[same], j[same]


def pieces(line: Slice, width: int, slack: int = 0) -> np.ndarray:
    """For each span the first span of its piece: connected spans of one id."""
    return joined(len(line.start), *touching(line, width, slack))
