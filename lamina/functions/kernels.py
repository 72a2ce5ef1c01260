"""NumPy kernels over one slice: runs, regions, morphology, shape.

A mask is a Boolean array; ``runs`` lists its horizontal runs and regions are unions of
touching runs, so the cost follows the number of runs, not of pixels.
"""

from __future__ import annotations

import numpy as np

from lamina.functions import spans as L

FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
EIGHT = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)


def disk(r: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]


def runs(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1, value) of the runs of equal non-zero values, in raster order."""
    padded = np.zeros((image.shape[0], image.shape[1] + 2), image.dtype)
    padded[:, 1:-1] = image
    change = padded[:, 1:] != padded[:, :-1]
    y, x = np.nonzero(change)
    value = padded[y, x + 1]
    last = np.append(y[1:] != y[:-1], True) if len(y) else np.zeros(0, bool)
    end = np.append(x[1:], 0) if len(x) else x
    keep = (value != 0) & ~last
    return y[keep], x[keep], end[keep], value[keep]


def join_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, value: np.ndarray, slack: int = 0) -> np.ndarray:
    """A component number (0..) for runs, in the order of their first run; runs of equal value
    on neighbouring lines touch if they overlap, with ``slack`` 1 also at corners."""
    if not len(y):
        return np.zeros(0, np.int64)
    y, left = np.asarray(y, np.int64), int(np.min(x0))
    width = int(np.max(x1)) - left + L.SPARE
    start = (y - y.min()) * width + x0 - left
    by = np.argsort(start, kind="stable")
    i, j = L.touching(L.Slice(start[by], (start + x1 - x0)[by], np.asarray(value)[by]), width, slack)
    return np.unique(L.joined(len(y), by[i], by[j]), return_inverse=True)[1]


def paint(shape: tuple[int, int], y, x0, x1, value, dtype=np.int64) -> np.ndarray:
    """The slice that runs draw; later runs win."""
    out = np.zeros(shape, dtype)
    y, a, b, v = (np.asarray(c) for c in (y, x0, x1, value))
    n = (b - a).astype(np.int64)
    at = np.repeat(y.astype(np.int64) * shape[1] + a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    out.ravel()[at] = np.repeat(v, n)
    return out


def regions(mask: np.ndarray, connectivity: int = 1) -> np.ndarray:
    """Regions numbered 1.. in raster order; connectivity 1: by edges, 2: by corners too."""
    y, a, b, v = runs(mask.astype(np.int8))
    return paint(mask.shape, y, a, b, join_runs(y, a, b, v, connectivity - 1) + 1)


def areas(labels: np.ndarray) -> np.ndarray:
    return np.bincount(labels.ravel())


def shifted(mask: np.ndarray, dy: int, dx: int, outside: bool = False) -> np.ndarray:
    """mask moved by (dy, dx); what comes from outside the image is ``outside``."""
    out = np.full(mask.shape, outside)
    h, w = mask.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def dilate(mask: np.ndarray, offsets) -> np.ndarray:
    out = np.zeros(mask.shape, bool)
    for dy, dx in offsets:
        out |= shifted(mask, dy, dx)
    return out


def erode(mask: np.ndarray, offsets) -> np.ndarray:
    """Pixels outside the image count as set, so the border doesn't erode."""
    out = np.ones(mask.shape, bool)
    for dy, dx in offsets:
        out &= shifted(mask, -dy, -dx, outside=True)
    return out


def close(mask: np.ndarray, r: int) -> np.ndarray:
    return erode(dilate(mask, disk(r)), disk(r))


def fill_holes(mask: np.ndarray, connectivity: int = 1) -> np.ndarray:
    """Fill background that ``connectivity`` steps can't reach from outside."""
    free = regions(np.pad(~mask, 1, constant_values=True), connectivity)
    return (free != free[0, 0])[1:-1, 1:-1]


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    labels = regions(mask)
    ok = areas(labels) >= least
    ok[0] = False
    return ok[labels]


def largest(mask: np.ndarray) -> np.ndarray | None:
    """The largest region, the first of equal ones; None if there is none."""
    labels = regions(mask)
    n = areas(labels)
    return labels == 1 + int(np.argmax(n[1:])) if len(n) > 1 else None


def box_of(mask: np.ndarray) -> tuple[int, int, int, int]:
    y, x = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return int(y[0]), int(x[0]), int(y[-1]) + 1, int(x[-1]) + 1


def centre(mask: np.ndarray) -> tuple[float, float]:
    y, x = np.nonzero(mask)
    return float(y.mean()), float(x.mean())


def box_overlap(a, b) -> float:
    h, w = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = h * w if h > 0 and w > 0 else 0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def _chain(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of points with ascending first and one each, those on the lower convex chain."""
    out: list[tuple[int, int]] = []
    for p in points:
        while len(out) > 1 and (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) >= (p[1] - out[-2][1]) * (out[-1][0] - out[-2][0]):
            out.pop()
        out.append(p)
    return out


def hull_of_runs(rows: list[tuple[int, int, int]]) -> int:
    """Pixels whose centre lies in the convex hull of the pixels' edge midpoints, for runs (y, x0, x1).

    In half steps the midpoints of a run's ends lie on its line and half a line above and
    below; on each of these lines only the outermost count. Everything is exact in integers.
    """
    low: dict[int, int] = {}
    high: dict[int, int] = {}
    for y, a, b in rows:
        for line, grow in ((2 * y - 1, 0), (2 * y, 1), (2 * y + 1, 0)):
            left, right = 2 * a - grow, 2 * b - 2 + grow
            if line not in low or left < low[line]:
                low[line] = left
            if line not in high or right > high[line]:
                high[line] = right
    lines = sorted(low)
    left = _chain([(k, low[k]) for k in lines])
    right = _chain([(k, -high[k]) for k in lines])
    n = i = j = 0
    for line in range(lines[0] + 1, lines[-1], 2):  # the lines of pixels
        while left[i + 1][0] < line:
            i += 1
        while right[j + 1][0] < line:
            j += 1
        (p, x), (q, u) = left[i], left[i + 1]
        first = -((-(x * (q - p) + (u - x) * (line - p))) // (2 * (q - p)))
        (p, x), (q, u) = right[j], right[j + 1]
        last = (-(x * (q - p) + (u - x) * (line - p))) // (2 * (q - p))
        n += max(0, last - first + 1)
    return n


def hull_area(mask: np.ndarray) -> int:
    """Pixels whose centre lies in the convex hull of the pixels' edge midpoints."""
    y, a, b, _ = runs(mask.astype(np.int8))
    return hull_of_runs(list(zip(y.tolist(), a.tolist(), b.tolist(), strict=True)))


def solidity(mask: np.ndarray) -> float:
    return float(mask.sum()) / hull_area(mask)


def eccentricity(mask: np.ndarray) -> float:
    y, x = np.nonzero(mask)
    if len(y) < 2:
        return 0.0
    low, high = np.linalg.eigvalsh(np.cov(np.stack([y, x]).astype(float), bias=True))
    return float(np.sqrt(max(0.0, 1 - max(low, 0.0) / high))) if high > 0 else 0.0


def nearest_distance(points: np.ndarray, others: np.ndarray) -> float:
    """The least Euclidean distance between two sets of pixels, in blocks."""
    best = np.inf
    for k in range(0, len(points), 512):
        d = points[k : k + 512, None, :] - others[None, :, :]
        best = min(best, float((d * d).sum(2).min()))
    return float(np.sqrt(best))


def outline(mask: np.ndarray) -> np.ndarray:
    """Coordinates of the pixels with a 4-neighbour outside the mask."""
    inner = mask.copy()
    for dy, dx in FOUR:
        inner &= shifted(mask, dy, dx)
    return np.argwhere(mask & ~inner)
