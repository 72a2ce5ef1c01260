"""Regions inside a slice and in three dimensions."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import kernels as K
from lamina.functions import spans as L
from lamina.operators.graph import connected_components, with_singles
from lamina.session import cut

COMPONENT_SLICES = 16  # slices of a volume that one group holds
COMPONENT_RUN = "volume long, z int, y int, x0 int, x1 int, id long, c int"


def slice_components(runs: DataFrame, connectivity: int = 1) -> DataFrame:
    """Runs with ``c``: pieces of each id on each slice, numbered by id, then raster order.

    A group holds 16 slices, which lie on one line with a spare row between them.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_slices").sort_values(["z", "id", "y", "x0"])
        z, y, a, b, v = (rows[k].to_numpy() for k in ("z", "y", "x0", "x1", "id"))
        line = (z - z.min()).astype(np.int64) * (int(y.max()) - int(y.min()) + 2) + y
        c = K.join_runs(line, a, b, v, connectivity - 1)
        first = np.append(True, z[1:] != z[:-1])  # the first run of a slice is in its first piece
        return rows.assign(c=(c - c[first][np.cumsum(first) - 1] + 1).astype(np.int32))

    slices = F.floor(F.col("z") / COMPONENT_SLICES).cast("int").alias("_slices")
    return runs.select("volume", "z", "y", "x0", "x1", "id", slices).groupBy("volume", "_slices").applyInPandas(one, COMPONENT_RUN)


SLAB = 32  # slices of a volume that one task labels


def _slab_parts(runs: DataFrame, connectivity: int) -> DataFrame:
    """Foreground runs with ``_slab`` and ``_part``, their region inside the slab, and on the
    first run of a part its voxels as ``_n``."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        z, y, a, b = (rows[c].to_numpy(np.int64) for c in ("z", "y", "x0", "x1"))
        low, top, left = int(z.min()), int(y.min()), int(a.min())
        width = int(b.max()) - left + L.SPARE
        height = int(y.max()) - top + 2  # a spare row between slices
        line = ((z - low) * height + y - top) * width - left
        s, e = L.union(line + a, line + b)  # touching runs of different ids are one
        i, j = [], []
        for dz, dy in NEIGHBOURS:
            if (steps := abs(dz) + abs(dy)) <= connectivity:
                by = (dz * height + dy) * width
                p, q, _ = L.meet(s + by, e + by, s, e, int(connectivity > steps))
                i, j = [*i, p], [*j, q]
        first, part = np.unique(L.joined(len(s), np.concatenate(i), np.concatenate(j)), return_inverse=True)
        n = np.zeros(len(s), np.int64)
        n[first] = np.bincount(part, e - s).astype(np.int64)
        y = s // width
        at = {"z": y // height + low, "y": y % height + top, "x0": s - y * width + left, "x1": e - y * width + left, "_part": part}
        return pd.DataFrame({"volume": key[0], "_slab": key[1], "_n": n} | {c: v.astype(np.int32) for c, v in at.items()})

    slab = F.floor(F.col("z") / SLAB).cast("int").alias("_slab")
    return runs.select("volume", "z", "y", "x0", "x1", slab).groupBy("volume", "_slab").applyInPandas(one, "volume long, _slab int, z int, y int, x0 int, x1 int, _part int, _n long")


# neighbours (dz, dy); they touch along x with slack 1 where one more step is allowed
NEIGHBOURS = ((0, 1), (1, 0), (1, 1), (1, -1))


def _components(runs: DataFrame, connectivity: int) -> tuple[DataFrame, DataFrame]:
    """(runs by slab and part, the parts with their ``id`` in the volume and size ``_n``).

    Slabs are labelled alone; only their parts are numbered, and only runs on both sides
    of a border are joined.
    """
    runs = cut(_slab_parts(runs, connectivity))
    order = Window.partitionBy("volume").orderBy("z", "y", "x0")
    parts = cut(runs.filter("_n > 0").withColumn("node", F.row_number().over(order).cast("long")).select("volume", "_slab", "_part", "_n", "node"))
    side = lambda at, name: runs.filter(F.pmod("z", F.lit(SLAB)) == at).join(parts.drop("_n"), ["volume", "_slab", "_part"]).select("volume", "z", "y", F.col("x0").alias(f"{name}0"), F.col("x1").alias(f"{name}1"), F.col("node").alias(name))
    above, below, edges = side(SLAB - 1, "a"), side(0, "b"), None
    for dz, dy in NEIGHBOURS:
        steps = dz + abs(dy)
        if dz == 0 or steps > connectivity:
            continue
        slack = int(connectivity > steps)
        both = above.join(below.withColumn("z", F.col("z") - dz).withColumn("y", F.col("y") - dy), ["volume", "z", "y"])
        some = both.filter((F.col("a0") < F.col("b1") + slack) & (F.col("b0") < F.col("a1") + slack)).select("volume", "a", "b")
        edges = some if edges is None else edges.unionByName(some)
    labels = with_singles(parts.select("volume", "node"), connected_components(edges, keys=["volume"]), ["volume"])
    rank = F.dense_rank().over(Window.partitionBy("volume").orderBy("root")).cast("long")
    return runs, parts.join(labels.withColumn("id", rank), ["volume", "node"]).select("volume", "_slab", "_part", "_n", "id")


def _numbered(runs: DataFrame, parts: DataFrame) -> DataFrame:
    return runs.drop("_n").join(parts, ["volume", "_slab", "_part"]).select("volume", "z", "y", "x0", "x1", "id")


def volume_components(runs: DataFrame, connectivity: int = 1) -> DataFrame:
    """Runs of the foreground relabelled by 3D regions: 1 = faces, 2 = edges, 3 = corners.

    ``id`` becomes a dense number by first run in (z, y, x) order.
    """
    return _numbered(*_components(runs, connectivity))


def large_regions(runs: DataFrame, min_voxels: int = 90_000, connectivity: int = 1) -> DataFrame:
    """The foreground's 3D regions of ``min_voxels`` voxels and more, with region numbers as ids."""
    runs, parts = _components(runs, connectivity)
    parts = cut(parts)
    big = parts.groupBy("volume", "id").agg(F.sum("_n").alias("_all")).filter(F.col("_all") >= min_voxels)
    return _numbered(runs, parts.join(big.select("volume", "id"), ["volume", "id"], "left_semi"))


SHAPE = "volume long, z int, id long, area long, y0 int, x0 int, y1 int, x1 int, cy double, cx double, solidity double, eccentricity double"


def _crop(rows: pd.DataFrame, pad: int = 1):
    """(image, y offset, x offset) of the runs with a margin."""
    oy, ox = int(rows["y"].min()) - pad, int(rows["x0"].min()) - pad
    shape = (int(rows["y"].max()) - oy + 1 + pad, int(rows["x1"].max()) - ox + pad)
    return K.paint(shape, rows["y"] - oy, rows["x0"] - ox, rows["x1"] - ox, rows["id"]), oy, ox


SHAPE_SLICES = 16  # slices of a volume in one group


@functools.lru_cache(maxsize=1 << 16)
def _shape_of(pattern: bytes) -> tuple:
    """(area, box, centre, solidity, eccentricity) of the largest region of the runs (y, x0, x1), which begin at 1."""
    y, a, b = np.frombuffer(pattern, np.int32).reshape(-1, 3).T
    mask = K.largest(K.paint((int(y.max()) + 2, int(b.max()) + 1), y, a, b, np.ones(len(y), np.int64)) > 0)
    return int(mask.sum()), *K.box_of(mask), *K.centre(mask), K.solidity(mask), K.eccentricity(mask)


def shapes(runs: DataFrame) -> DataFrame:
    """The largest region of each id on each slice: area, box, centroid, solidity, eccentricity.

    What repeats is measured once: an object is looked up by its runs from the corner of its box.
    """

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["z", "id", "y", "x0"])
        z, i, y, a, b = (rows[c].to_numpy() for c in ("z", "id", "y", "x0", "x1"))
        first = np.flatnonzero(np.append(True, (z[1:] != z[:-1]) | (i[1:] != i[:-1])))
        n = np.diff(np.append(first, len(z)))
        oy, ox = y[first] - 1, np.minimum.reduceat(a, first) - 1
        line = np.stack([y - np.repeat(oy, n), a - np.repeat(ox, n), b - np.repeat(ox, n)], 1).astype(np.int32)
        found = [_shape_of(line[k : k + m].tobytes()) for k, m in zip(first.tolist(), n.tolist(), strict=True)]
        area, y0, x0, y1, x1, cy, cx, solid, round_ = (np.array(c) for c in zip(*found, strict=True))
        at = {c: (v + o).astype(np.int32) for c, v, o in (("y0", y0, oy), ("x0", x0, ox), ("y1", y1, oy), ("x1", x1, ox))}
        return pd.DataFrame({"volume": key[0], "z": z[first], "id": i[first], "area": area, "cy": cy + oy, "cx": cx + ox, "solidity": solid, "eccentricity": round_} | at)

    group = F.floor(F.col("z") / SHAPE_SLICES).cast("int").alias("_slices")
    return runs.select("volume", "z", "y", "x0", "x1", "id", group).groupBy("volume", "_slices").applyInPandas(one, SHAPE)


def _frame(key, image: np.ndarray, oy: int, ox: int) -> pd.DataFrame:
    y, a, b, v = K.runs(image)
    return pd.DataFrame({"volume": key[0], "z": key[1], "y": (y + oy).astype(np.int32), "x0": (a + ox).astype(np.int32), "x1": (b + ox).astype(np.int32), "id": v.astype(np.int64)})


RUN = "volume long, z int, y int, x0 int, x1 int, id long"


@functools.lru_cache(maxsize=1 << 14)
def _filled(pattern: bytes, min_area: int, background: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1) of the large pieces, with their holes filled, of the runs (y, x0, x1), which begin at 1."""
    y, a, b = np.frombuffer(pattern, np.int32).reshape(-1, 3).T
    mask = K.drop_small(K.paint((int(y.max()) + 2, int(b.max()) + 1), y, a, b, np.ones(len(y), np.int8), np.int8) > 0, min_area)
    return K.runs(K.fill_holes(mask, background).astype(np.int8))[:3] if mask.any() else (np.zeros(0, np.int64),) * 3


def fill_objects(runs: DataFrame, *, min_area: int = 1, background: int = 2) -> DataFrame:
    """Each id on each slice: pieces of ``min_area`` pixels and more, their holes filled.

    ``background``: steps through which background reaches a hole (2: corners too).
    Where filled objects overlap, the highest id wins.
    """

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        rows = rows.sort_values(["id", "y", "x0"])
        y, a, b, i = (rows[c].to_numpy() for c in ("y", "x0", "x1", "id"))
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        for k, m in zip(first.tolist(), [*first[1:].tolist(), len(i)], strict=True):
            oy, ox = int(y[k]) - 1, int(a[k:m].min()) - 1  # an id's own box; what repeats is filled once
            line = np.stack([y[k:m] - oy, a[k:m] - ox, b[k:m] - ox], 1).astype(np.int32)
            p, q, r = _filled(line.tobytes(), min_area, background)
            if len(p):
                parts.append((p + oy, q + ox, r + ox, np.full(len(p), i[k])))
        if not parts:
            return rows.iloc[:0][["volume", "z", "y", "x0", "x1", "id"]]
        y, a, b, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        oy, ox = int(y.min()), int(a.min())
        return _frame(key, K.paint((int(y.max()) - oy + 1, int(b.max()) - ox), y - oy, a - ox, b - ox, v), oy, ox)

    return runs.groupBy("volume", "z").applyInPandas(one, RUN)
