"""Joins of neighbouring slices and of two volumes; counts, geometry and edges.

Everything works on runs: scan lines meet in an equi-join on (volume, z, y), whose
candidates are the few runs of one line, and overlap is a difference of bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import spans as L
from lamina.functions.expressions import dice, edge_features, iou
from lamina.model import EDGE, as_runs
from lamina.session import cut, small


def _meet(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """(volume, z, left, right, inter): common voxels by slice of two sets of runs."""
    p = a.select("volume", "z", "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col(left).alias("_l"))
    q = b.select("volume", "z", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col(right).alias("_r"))
    both = p.join(q, ["volume", "z", "y"]).filter("a0 < b1 and b0 < a1")
    width = F.least("a1", "b1") - F.greatest("a0", "b0")
    return both.select("volume", "z", "_l", "_r", width.alias("_w"))


def volume_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(volume, a_id, b_id, inter) of two label volumes."""
    pairs = _meet(a, b, "id", "id").groupBy("volume", "_l", "_r").agg(F.sum("_w").cast("long").alias("inter"))
    return pairs.select("volume", F.col("_l").alias("a_id"), F.col("_r").alias("b_id"), "inter")


def common_voxels(a: DataFrame, b: DataFrame) -> DataFrame:
    """(volume, n): voxels in both volumes, whatever their ids."""
    return _meet(a, b, "id", "id").groupBy("volume").agg(F.sum("_w").cast("long").alias("n"))


def instance_pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Overlapping (gt_id, pred_id) with sizes, IoU and Dice. A size counts all voxels."""
    size = lambda runs, name: runs.groupBy("volume", F.col("id").alias(f"{name}_id")).agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias(f"{name}_voxels"))
    pairs = volume_overlaps(gt, pred).withColumnsRenamed({"a_id": "gt_id", "b_id": "pred_id"})
    out = pairs.join(size(gt, "gt"), ["volume", "gt_id"]).join(size(pred, "pred"), ["volume", "pred_id"])
    i, a, b = F.col("inter"), F.col("gt_voxels"), F.col("pred_voxels")
    return out.select("volume", "gt_id", "pred_id", "inter", "gt_voxels", "pred_voxels", iou(i, a, b).alias("iou"), dice(i, a, b).alias("dice"))


def geometry(runs: DataFrame, *keys: str) -> DataFrame:
    """area and centroid (cy, cx) of each group; sums over runs are exact."""
    w = F.col("x1") - F.col("x0")
    sums = runs.groupBy(*keys).agg(F.sum(w).cast("long").alias("area"), F.sum(w * F.col("y")).cast("double").alias("_y"), F.sum(w * (F.col("x0") + F.col("x1") - 1)).cast("double").alias("_x"))
    return sums.select(*keys, "area", (F.col("_y") / F.col("area")).alias("cy"), (F.col("_x") / 2.0 / F.col("area")).alias("cx"))


def bounding_boxes(runs: DataFrame, *keys: str) -> DataFrame:
    """Half-open boxes of each group."""
    return runs.groupBy(*keys).agg(
        F.min("z").alias("z0"), (F.max("z") + 1).alias("z1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1")
    )


def running_offsets(components: DataFrame) -> DataFrame:
    """(volume, z, k, offset): components before each slice; one row a slice, so windows are small."""
    counts = components.groupBy("volume", "z").agg(F.max("c").cast("long").alias("k"))  # numbered from 1
    before = Window.partitionBy("volume").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0)).cast("long"))


def with_global_ids(runs: DataFrame) -> DataFrame:
    """Add ``gid``: numbers of components over the whole stack. The runs are stored, since they are read twice."""
    runs = cut(runs)
    offsets = small(cut(running_offsets(runs).select("volume", "z", "offset")))
    return runs.join(offsets, ["volume", "z"]).withColumn("gid", F.col("offset") + F.col("c")).drop("offset")


def keep_large(runs: DataFrame, min_voxels: int = 90_000) -> DataFrame:
    """Runs of the objects with at least ``min_voxels`` voxels."""
    big = runs.groupBy("volume", "id").agg(F.sum(F.col("x1") - F.col("x0")).alias("_n")).filter(F.col("_n") >= min_voxels)
    return runs.join(big.select("volume", "id"), ["volume", "id"], "left_semi").select(*runs.columns)


def filter_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(volume, objects, voxels_before, voxels_after) of a filter on runs."""
    w = F.sum(F.col("x1") - F.col("x0")).cast("long")
    a = before.groupBy("volume").agg(w.alias("voxels_before"))
    b = after.groupBy("volume").agg(F.countDistinct("id").alias("objects"), w.alias("voxels_after"))
    return a.join(b, "volume", "left").select("volume", F.coalesce("objects", F.lit(0)).alias("objects"), "voxels_before", F.coalesce("voxels_after", F.lit(0)).alias("voxels_after"))


def merge_volumes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Voxels of ``first``, and of ``second`` where ``first`` has background."""
    place = ["volume", "z", "y", "x"]
    both = first.select(*place, F.col("id").alias("_a")).join(second.select(*place, F.col("id").alias("_b")), place, "full_outer")
    return both.select(*place, F.coalesce("_a", "_b").alias("id"))


def overlay(*volumes: DataFrame) -> DataFrame:
    """One id per voxel: the highest, as if ids were painted in ascending order.

    Voxels are dealt by line, so runs and joins of lines that follow need no further shuffle.
    """
    place = ["volume", "z", "y", "x"]
    out = volumes[0].select(*place, "id")
    for v in volumes[1:]:
        out = out.unionByName(v.select(*place, "id"))
    return out.repartition("volume", "z", "y").groupBy(*place).agg(F.max("id").alias("id"))


CHUNK = 16  # windows that one group holds, beside the slices that reach beyond its last one


class Planes:
    """Windows of a chunk on one line: ``z`` is a window's first slice, and planes keep a spare row between them."""

    def __init__(self, rows: pd.DataFrame):
        self.left, self.top = int(rows["x0"].min()), int(rows["y"].min())
        self.width = int(rows["x1"].max()) - self.left + L.SPARE
        self.plane = (int(rows["y"].max()) - self.top + 2) * self.width
        self.chunk = int(rows["_chunk"].iloc[0])
        z = rows["z"].to_numpy(np.int64) - self.chunk * CHUNK
        line = z * self.plane + (rows["y"].to_numpy(np.int64) - self.top) * self.width - self.left
        self.start, self.end = line + rows["x0"].to_numpy(), line + rows["x1"].to_numpy()

    def absent(self, later: int, *earlier: int) -> L.Slice:
        """Spans of the chunk's windows that lie on their slice ``later`` but on none of ``earlier``."""
        a, b = L.union(self.start - later * self.plane, self.end - later * self.plane)
        own = (a >= 0) & (a < CHUNK * self.plane)
        s, e = (np.concatenate([v - k * self.plane for k in earlier]) for v in (self.start, self.end))
        return L.minus(L.Slice(a[own], b[own], np.ones(int(own.sum()), np.int64)), *L.union(s, e))

    def places(self, line: L.Slice) -> tuple[np.ndarray, ...]:
        """(z, y, x0, x1) of spans, in order."""
        y, a, b, _ = L.to_runs(line, self.width)
        z, y = np.divmod(y, self.plane // self.width)
        return z + self.chunk * CHUNK, y + self.top, a + self.left, b + self.left


def by_windows(volume: DataFrame, *steps: int, keep: tuple[str, ...] = ()):
    """Runs grouped by chunks of windows; a window's slices are ``steps`` after its first one."""
    chunks = F.array_distinct(F.array(*[F.floor((F.col("z") - s) / CHUNK) for s in steps]))
    return as_runs(volume).select("volume", "z", "y", "x0", "x1", *keep, F.explode(chunks).alias("_chunk")).groupBy("volume", "_chunk")


def absent_from(volume: DataFrame, later: int, *earlier: int) -> DataFrame:
    """Runs (volume, z, y, x0, x1) of the places occupied on slice z + later but on none of
    z + e; z is the window's first slice. ``volume``: runs or voxels."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        planes = Planes(rows)
        at = planes.places(planes.absent(later, *earlier))
        return pd.DataFrame({"volume": key[0]} | {c: v.astype(np.int32) for c, v in zip(("z", "y", "x0", "x1"), at, strict=True)})

    return by_windows(volume, later, *earlier).applyInPandas(one, "volume long, z int, y int, x0 int, x1 int")


_PAIR = "volume long, z int, dz int, c_src int, c_tgt int, gid_src long, gid_tgt long, px long, a0 long, a1 long, y0 double, x0 double, y1 double, x1 double"


def _pairs(runs: DataFrame, dzs: tuple[int, ...], min_px: int, parents: bool) -> DataFrame:
    """Pairs of components with the sums behind their features, found inside chunks of slices; dz = 0: each
    component with itself. ``parents`` adds the ids of both ends."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        planes = Planes(rows)
        by = np.argsort(planes.start, kind="stable")
        start, end = planes.start[by], planes.end[by]
        of = {k: v.to_numpy()[by] for k, v in rows.items()}
        _, first, part = np.unique(of["z"].astype(np.int64) << 32 | of["c"], return_index=True, return_inverse=True)
        n = end - start
        total = lambda v: np.bincount(part, v, len(first))
        area = total(n).astype(np.int64)
        y, x = total(n * of["y"]) / area, total(n * (of["x0"].astype(np.int64) + of["x1"] - 1)) / 2.0 / area
        z, c, gid = (of[k][first] for k in ("z", "c", "gid"))
        out = []
        for dz in dzs:
            if dz:
                i, j, common = L.meet(start + dz * planes.plane, end + dz * planes.plane, start, end)
                own = (of["z"][i] // CHUNK == planes.chunk) & (common > 0)
                s, t, px = L.sums((part[i[own]], part[j[own]]), common[own])
                s, t, px = (v[px >= min_px] for v in (s, t, px))
            else:
                s = t = np.flatnonzero(z // CHUNK == planes.chunk)
                px = area[s]
            at = {"volume": key[0], "z": z[s], "dz": dz, "c_src": c[s], "c_tgt": c[t], "gid_src": gid[s], "gid_tgt": gid[t], "px": px}
            ends = {"a0": area[s], "a1": area[t], "y0": y[s], "x0": x[s], "y1": y[t], "x1": x[t]}
            ids = {"inst_src": of["id"][first][s], "inst_tgt": of["id"][first][t]} if parents else {}
            out.append(pd.DataFrame(at | ends | ids))
        return pd.concat(out, ignore_index=True)

    keep = ("c", "gid", "id") if parents else ("c", "gid")
    return by_windows(runs, 0, *dzs, keep=keep).applyInPandas(one, _PAIR + ", inst_src long, inst_tgt long" * parents)


def meetings(runs: DataFrame, *, dzs=(1, 2)) -> DataFrame:
    """Every component (dz = 0) and every pair of components with a common place, with parents. Stored: training,
    scoring and linking read this table in place of the runs."""
    return cut(_pairs(runs, (0, *dzs), 1, True))


def _edges(runs: DataFrame, dzs: tuple[int, ...], min_px: int, parents: bool) -> DataFrame:
    """Candidate links with features, of component runs or of their ``meetings``."""
    if "px" in runs.columns:
        pairs = runs.filter(F.col("dz").isin(*dzs) & (F.col("px") >= min_px))
    else:
        pairs = _pairs(runs, dzs, min_px, parents)
    features = edge_features(*[F.col(k) for k in ("px", "a0", "a1", "y0", "x0", "y1", "x1")])
    return pairs.select("volume", "z", "dz", "c_src", "c_tgt", "gid_src", "gid_tgt", *features, *["inst_src", "inst_tgt"] * parents)


def build_edges(runs: DataFrame, *, dzs=(1,), min_px: int = 8) -> DataFrame:
    """Candidate links with features; ``runs`` are component runs with ``c``, ``gid``, or their ``meetings``."""
    return _edges(runs, tuple(dzs), min_px, False).select(*EDGE)


def training_edges(runs: DataFrame, *, dzs=(1,), min_px: int = 8) -> DataFrame:
    """``build_edges`` with the parents' instances and ``label_same``."""
    edges = _edges(runs, tuple(dzs), min_px, True).drop("gid_src", "gid_tgt")
    return edges.withColumn("label_same", (F.col("inst_src") == F.col("inst_tgt")).cast("int"))


def endpoints(runs: DataFrame, track: str = "track", forward: bool = True) -> DataFrame:
    """(volume, z, c) without a same-track voxel on the next (previous) slice."""
    step = 1 if forward else -1

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        planes = Planes(rows)
        by = np.argsort(planes.start, kind="stable")
        start, end = planes.start[by], planes.end[by]
        z, c, t = (rows[k].to_numpy()[by] for k in ("z", "c", track))
        i, j, common = L.meet(start + step * planes.plane, end + step * planes.plane, start, end)
        going = i[(t[i] == t[j]) & (common > 0)]
        at = z.astype(np.int64) << 32 | c
        own = at[z // CHUNK == planes.chunk]
        left = np.setdiff1d(own, at[going])
        return pd.DataFrame({"volume": key[0], "z": (left >> 32).astype(np.int32), "c": (left & 0xFFFFFFFF).astype(np.int32)})

    return by_windows(runs, 0, step, keep=("c", track)).applyInPandas(one, "volume long, z int, c int")


def track_mode(components: DataFrame, tracks: DataFrame) -> DataFrame:
    """(volume, z, c, track): the track that most voxels of a component carry, ties to the lowest."""
    votes = _meet(components, tracks, "c", "id").groupBy("volume", "z", "_l", "_r").agg(F.sum("_w").alias("_n"))
    first = votes.groupBy("volume", "z", F.col("_l").alias("c")).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_r").alias("track"))).alias("_b"))
    return first.select("volume", "z", "c", F.col("_b.track").alias("track"))


def neighbour_vote(volume: DataFrame) -> DataFrame:
    """(volume, z, id, neighbour, n): the other id most found in each object's 4-neighbour ring on a slice.

    ``volume``: runs or voxels with one id a place. A ring is the union of an id's spans moved by a
    step, and ids are kept apart by planes, so one slice is one union and one search.
    """

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, top = int(rows["x0"].min()), int(rows["y"].min())
        width = int(rows["x1"].max()) - left + L.SPARE
        line = L.of_runs(rows["y"] - top + 1, rows["x0"] - left + 1, rows["x1"] - left + 1, rows["id"], width)
        ids, own = np.unique(line.id, return_inverse=True)
        plane = (int(rows["y"].max()) - top + 4) * width
        # a run between its two side steps is its own
        s, e = (np.concatenate([v - width, v + width, w]) for v, w in ((line.start, line.start - 1), (line.end, line.end + 1)))
        s, e = L.union(s + np.tile(own, 3) * plane, e + np.tile(own, 3) * plane)
        own = s // plane
        i, j, common = L.meet(s - own * plane, e - own * plane, line.start, line.end)
        other = (ids[own[i]] != line.id[j]) & (common > 0)
        a, b, n = L.sums((ids[own[i[other]]], line.id[j[other]]), common[other])
        by = np.lexsort((b, -n, a))
        by = by[np.unique(a[by], return_index=True)[1]]
        return pd.DataFrame({"volume": key[0], "z": key[1], "id": a[by], "neighbour": b[by], "n": n[by]})

    runs = as_runs(volume).select("volume", "z", "y", "x0", "x1", "id")
    return runs.groupBy("volume", "z").applyInPandas(one, "volume long, z int, id long, neighbour long, n long")


def box_candidates(boxes: DataFrame, *, margin: int = 0, tile: int = 64) -> DataFrame:
    """Pairs (i < j) of overlapping boxes of one slice with different labels.

    Boxes go to the row tiles that they touch, so the theta-join is an equi-join with a
    few candidates. ``boxes``: volume, z, i, label, y0, x0, y1, x1.
    """
    grown = boxes.select("volume", "z", "i", "label", *[(F.greatest(F.lit(0), F.col(c) - margin)).alias(c) for c in ("y0", "x0")], *[(F.col(c) + margin).alias(c) for c in ("y1", "x1")])
    tiled = grown.withColumn("t", F.explode(F.sequence(F.floor(F.col("y0") / tile), F.floor((F.col("y1") - 1) / tile))))
    a, b = tiled.alias("a"), tiled.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("volume", "z", "t")]
    hit = (F.col("a.i") < F.col("b.i")) & (F.col("a.label") != F.col("b.label")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    # only the first common tile reports a pair
    first = F.col("a.t") == F.greatest(F.floor(F.col("a.y0") / tile), F.floor(F.col("b.y0") / tile))
    return a.join(b, [*same, hit, first]).select(F.col("a.volume").alias("volume"), F.col("a.z").alias("z"), F.col("a.i").alias("i"), F.col("b.i").alias("j"))


def dilate(voxels: DataFrame, offsets: list[tuple[int, int]], ny: int, nx: int) -> DataFrame:
    """Each id grown by the offsets on its slice, clipped to the image."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    moved = voxels.select("volume", "z", "y", "x", "id", F.explode(steps).alias("s")).select("volume", "z", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "id")
    return moved.filter(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)).distinct()
