"""Cleaning slices, joining entangled pieces, and boxes of objects that vanish."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import kernels as K
from lamina.functions import spans as L
from lamina.functions.expressions import swap_axes
from lamina.model import as_runs
from lamina.operators.graph import first_come
from lamina.operators.overlap import Planes, by_windows
from lamina.operators.regions import RUN, _crop, _frame, fill_objects


class _Piece:
    """A region of one label with its mask in a window that holds its dilation."""

    def __init__(self, shape: tuple[int, int], y: np.ndarray, x0: np.ndarray, x1: np.ndarray, label: int, r: int):
        self.label, self.area = label, int((x1 - x0).sum())
        self.box = int(y.min()), int(x0.min()), int(y.max()) + 1, int(x1.max())
        m = r + 2
        a, b = max(0, self.box[0] - m), max(0, self.box[1] - m)
        c, d = min(shape[0], self.box[2] + m), min(shape[1], self.box[3] + m)
        self.window = a, b, c, d
        self.mask = K.paint((c - a, d - b), y - a, x0 - b, x1 - b, np.ones(len(y), np.int8), np.int8) > 0
        self.grown = K.dilate(self.mask, K.disk(r))
        self.near = K.dilate(self.mask, [*K.EIGHT, (0, 0)])
        self.edge = K.outline(self.mask) + [a, b]

    def on(self, name: str, box) -> np.ndarray:
        """The named mask on another window; outside the own one it is empty."""
        a, b, c, d = box
        out = np.zeros((c - a, d - b), bool)
        p, q, s, t = self.window
        y0, x0, y1, x1 = max(a, p), max(b, q), min(c, s), min(d, t)
        if y0 < y1 and x0 < x1:
            out[y0 - a : y1 - a, x0 - b : x1 - b] = getattr(self, name)[y0 - p : y1 - p, x0 - q : x1 - q]
        return out


def _background_distance(image: np.ndarray, reach: int) -> np.ndarray:
    """Distance of each pixel to the nearest foreground pixel of the square within ``reach``; infinite where there is none."""
    on = image > 0
    out = np.full(image.shape, np.inf)
    for d2, dy, dx in sorted(((a * a + b * b, a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)), reverse=True):
        out[K.shifted(on, -dy, -dx)] = np.sqrt(d2)
    return out


def _median(values: np.ndarray) -> float:
    values, n = np.sort(values), len(values)
    return float(values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2)


def _score(image: np.ndarray, gaps: np.ndarray, p: _Piece, q: _Piece, r: int) -> float:
    box = tuple(f(a, b) for f, a, b in zip((min, min, max, max), p.window, q.window, strict=True))
    gp, gq, mp = p.on("grown", box), q.on("grown", box), p.on("mask", box)
    both, either = gp & gq, (gp | gq).sum()
    touch = (mp & q.on("near", box)).sum() / (int((p.near & ~p.mask).sum()) + 1)
    here = np.s_[box[0] : box[2], box[1] : box[3]]
    corridor = gaps[here][both & (image[here] == 0)]
    gap = _median(corridor) if len(corridor) else 0.0
    apart = 0.0 if (mp & q.on("mask", box)).any() else K.nearest_distance(p.edge, q.edge)
    return 0.2 * (both.sum() / either if either else 0.0) + 0.8 * touch + 0.5 * np.exp(-apart / 2.0) - 0.25 * gap / (r + 1e-6)


def join_entangled(image: np.ndarray, r: int = 2, min_score: float = 0.6, prune: str = "geometric") -> np.ndarray:
    """Touching pieces of different labels that fit together take the largest one's label.

    Pieces go in ascending order of label and raster; each joins its best partner of
    another group if the score is high enough. ``prune="as_written"`` compares the rows of
    one box with the columns of the other, as the original tool does.
    """
    y, x0, x1, label = K.runs(image)
    by = np.lexsort((x0, y, label))
    y, x0, x1, label = y[by], x0[by], x1[by], label[by]
    number = K.join_runs(y, x0, x1, label)  # by label, then raster order
    order = np.argsort(number, kind="stable")
    at = np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []
    pieces = [_Piece(image.shape, y[k], x0[k], x1[k], int(label[k[0]]), r) for k in at]
    n = len(pieces)
    gaps = _background_distance(image, r)
    h, w = image.shape
    box = np.array([(max(0, a - r), max(0, b - r), min(h, c + r), min(w, d + r)) for a, b, c, d in (p.box for p in pieces)]).reshape(n, 4)
    group, members = list(range(n)), {i: [i] for i in range(n)}
    head = list(range(n))  # the piece that stands for a group: the larger at each union
    for i in range(n):
        if prune == "geometric":
            near = (box[:, 0] < box[i, 2]) & (box[i, 0] < box[:, 2]) & (box[:, 1] < box[i, 3]) & (box[i, 1] < box[:, 3])
        else:
            low = np.arange(n) < i  # the earlier piece of a pair is the first box
            first, second = np.where(low[:, None], box, box[i]), np.where(low[:, None], box[i], box)
            near = ~((first[:, 0] >= second[:, 3]) | (second[:, 0] >= first[:, 3]) | (first[:, 2] <= second[:, 1]) | (second[:, 2] <= first[:, 1]))
        best, partner = -np.inf, None
        for j in np.flatnonzero(near).tolist():
            if pieces[j].label == pieces[i].label or group[i] == group[j]:
                continue
            if (s := _score(image, gaps, pieces[i], pieces[j], r)) > best:
                best, partner = s, j
        if partner is not None and best >= min_score:
            a, b = group[i], group[partner]
            keep, gone = (a, b) if pieces[head[a]].area >= pieces[head[b]].area else (b, a)
            members[keep] += members.pop(gone)
            for m in members[keep]:
                group[m] = keep
    out = np.zeros_like(image)
    for ids in members.values():
        top = min(ids, key=lambda k: (-pieces[k].area, k))
        for k in ids:
            a, b, c, d = pieces[k].window
            out[a:c, b:d][pieces[k].mask] = pieces[top].label
    return out


def harmonize_entangled(runs: DataFrame, *, r: int = 2, min_score: float = 0.6, prune: str = "geometric") -> DataFrame:
    """``join_entangled`` on every slice. Slices are independent groups."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if prune == "geometric":
            image, oy, ox = _crop(rows, r + 1)
            cut = max(0, -oy), max(0, -ox)  # the image begins at 0
            image, oy, ox = image[cut[0] :, cut[1] :], oy + cut[0], ox + cut[1]
        else:  # rows and columns are compared with each other: positions matter
            oy = ox = 0
            image = K.paint((int(rows["y"].max()) + r + 2, int(rows["x1"].max()) + r + 1), rows["y"], rows["x0"], rows["x1"], rows["id"])
        return _frame(key, join_entangled(image, r, min_score, prune), oy, ox)

    return runs.groupBy("volume", "z").applyInPandas(one, RUN)


def clean_slices(runs: DataFrame, *, min_area: int = 500, r: int = 2, min_score: float = 0.45, prune: str = "geometric") -> DataFrame:
    """Large pieces with filled holes, the highest id where they overlap, then entangled ones joined."""
    return harmonize_entangled(fill_objects(runs, min_area=min_area), r=r, min_score=min_score, prune=prune)


_MISSING = "volume long, z int, ord long, y0 int, x0 int, y1 int, x1 int, third boolean"


def missing_boxes(volume: DataFrame, *, min_area: int = 800, connectivity: int = 1, iou_thresh: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Boxes to add on the second and on the third slice of each window of four.

    ``z`` of the results is the window's first slice; windows with less than four
    slices give nothing. What the first slice holds plays no part. ``volume``: runs or voxels.
    """

    def boxes(planes: Planes, line: L.Slice, rank: int) -> np.ndarray:
        """Rows (z, rank, number in the window, box) of the pieces of ``min_area`` and more."""
        z, y, a, b = planes.places(line)
        if not len(z):
            return np.zeros((0, 7), np.int64)
        first, c = np.unique(L.pieces(line, planes.width, connectivity - 1), return_inverse=True)
        low, high = np.full((len(first), 2), np.iinfo(np.int64).max), np.full((len(first), 2), np.iinfo(np.int64).min)
        np.minimum.at(low, c, np.stack([y, a], 1))
        np.maximum.at(high, c, np.stack([y + 1, b], 1))
        at = z[first]
        number = np.arange(len(first)) - np.searchsorted(at, at) + 1  # by first run inside the window
        out = np.concatenate([np.stack([at, np.full(len(at), rank), number], 1), low, high], 1)
        return out[np.bincount(c, b - a) >= min_area]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        planes = Planes(rows)
        found = np.concatenate([boxes(planes, planes.absent(*of), k) for k, of in enumerate(((2, 1), (3, 1), (3, 2, 1)))])
        found = found[(found[:, 0] >= 0) & (found[:, 0] <= int(rows["_last"].iloc[0]))]
        found = found[np.lexsort(found[:, 2::-1].T)]
        two, three = [], []
        for w in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1):
            n, box = int((w[:, 1] < 2).sum()), w[:, 3:].astype(np.float64)
            some = first_come(box[:n], iou_thresh) + list(range(n, len(w)))
            two.append(w[some][first_come(box[some], iou_thresh)])
            three.append(w[n:][first_come(box[n:], iou_thresh)])
        out = np.concatenate(two + three)
        third = np.arange(len(out)) >= sum(map(len, two))
        order = out[:, 2] + np.where(third, 0, out[:, 1] << 32)
        at = {c: out[:, k].astype(np.int32) for c, k in (("z", 0), ("y0", 3), ("x0", 4), ("y1", 5), ("x1", 6))}
        return pd.DataFrame({"volume": key[0], "ord": order, "third": third} | at)

    runs = as_runs(volume)
    depth = runs.groupBy("volume").agg((F.max("z") - 3).alias("_last"))
    found = by_windows(runs.join(depth, "volume"), 1, 2, 3, keep=("_last",)).applyInPandas(one, _MISSING)
    return found.filter("not third").drop("third"), found.filter("third").drop("third")


def update_boxes(boxes: DataFrame, voxels: DataFrame, names: DataFrame, *, min_area: int = 500) -> DataFrame:
    """``boxes`` with those of objects that vanish for a slice or two.

    ``names(image_name, z)`` places images; a box belongs to the image of its own slice.
    New boxes come after the old ones of an image and aren't compared with them.
    """
    two, _ = missing_boxes(voxels, min_area=min_area)
    at = two.withColumn("z", F.col("z") + 1).join(names, "z")
    last = boxes.groupBy("image_name").agg(F.max("ord").alias("_last"))
    new = at.join(last, "image_name", "left").select("image_name", "z", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(_by_image())).cast("int").alias("ord"), *swap_axes([F.col(c) for c in ("y0", "x0", "y1", "x1")]))
    return boxes.unionByName(new)


def _by_image():
    from pyspark.sql import Window

    return Window.partitionBy("image_name").orderBy("ord")
