"""Connected components, one-to-one matching and box suppression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import spans as L
from lamina.session import cut, free

GROUP_EDGES = 1 << 20  # edges of a group that one task joins in memory


def _joined_groups(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``connected_components`` of groups of at most ``GROUP_EDGES`` edges, each in one task."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)]), return_inverse=True)
        root = L.joined(len(nodes), at[: len(rows)], at[len(rows) :])
        return pd.DataFrame(dict(zip(keys, key, strict=True)) | {"node": nodes, "root": nodes[root]})

    kinds = dict(edges.dtypes)
    return edges.groupBy(*keys).applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "node long, root long"]))


def connected_components(edges: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """(keys..., node, root) of the nodes in ``edges(keys..., a, b)``; root: the smallest node.

    Every node points to its smallest neighbour if that is smaller, pointers jump once,
    and edges move to what their ends point to. Edges inside a root vanish, so the graph
    shrinks each round, until none is left. Every round is written to the shared folder.
    Where each group of the keys has few edges, groups are joined in memory instead.
    """
    keys = keys or []
    edges = cut(edges.select(*keys, "a", "b"))
    if keys and (edges.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= GROUP_EDGES:
        labels = cut(_joined_groups(edges, keys))
        free(edges)
        return labels
    one = edges.filter("a <> b")
    left = cut(one.unionByName(one.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    ends = edges.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = cut(ends.withColumn("root", F.col("node")))
    free(edges)
    while left.limit(1).count():
        least = cut(left.groupBy(*keys, "a").agg(F.min("b").alias("_m")).select(*keys, F.col("a").alias("_from"), F.least("a", "_m").alias("_mid")))
        onward = least.select(*keys, F.col("_from").alias("_mid"), F.col("_mid").alias("_to"))
        to = cut(least.join(onward, [*keys, "_mid"]).select(*keys, "_from", "_to"))
        at = lambda c: to.select(*keys, F.col("_from").alias(c), F.col("_to").alias(f"_{c}"))  # noqa: B023, E731
        used = [labels, left, least, to]
        labels = cut(labels.join(at("root"), [*keys, "root"], "left").select(*keys, "node", F.coalesce("_root", "root").alias("root")))
        left = cut(left.join(at("a"), [*keys, "a"]).join(at("b"), [*keys, "b"]).filter("_a <> _b").select(*keys, F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        free(*used)
    return labels


def with_singles(nodes: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Every node of ``nodes(keys..., node)`` with its root; nodes without edges are their own."""
    return nodes.join(labels, [*keys, "node"], "left").select(*keys, "node", F.coalesce("root", "node").alias("root"))


def dense_rank_ids(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Roots renumbered 1..k in ascending order within each volume."""
    roots = labels.select(*keys, "root").distinct()
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("root"))
    return labels.join(roots.withColumn("track", number.cast("long")), [*keys, "root"])


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight assignment of rows to columns of a non-negative matrix.

    Shortest augmenting paths with potentials, O(n**2 m) for n rows and m columns.
    """
    flip = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if flip else weight)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        slack, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while owner[j]:
            seen[j] = True
            open_ = np.flatnonzero(~seen[1:]) + 1
            reduced = cost[owner[j] - 1, open_ - 1] - u[owner[j]] - v[open_]
            better = reduced < slack[open_]
            slack[open_[better]], back[open_[better]] = reduced[better], j
            k = open_[np.argmin(slack[open_])]
            step = slack[k]
            u[owner[seen]] += step
            v[seen] -= step
            slack[open_] -= step
            j = k
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((c, r) for r, c in pairs) if flip else sorted(pairs)


def match(pairs: DataFrame, threshold: float) -> DataFrame:
    """One-to-one (volume, gt_id, pred_id) of greatest total IoU among pairs with IoU >= threshold.

    IoU is compared as a float, as stored. Above one half every pair is unique, and a
    filter is the answer; else the pair graph falls into components, each assigned alone.
    """
    ok = pairs.filter(F.col("iou").cast("float") >= F.lit(float(threshold)).cast("double"))
    if threshold > 0.5:
        return ok.select(*pairs.columns)
    rows = match_each(pairs, [threshold]).drop("IoU_threshold")
    return rows.select(*pairs.columns)


BLOCKS = 1024  # numbers of blocks that one group may hold


def _chosen(gt: np.ndarray, pred: np.ndarray, iou: np.ndarray, t: float) -> np.ndarray:
    """Which pairs of a block the assignment at threshold ``t`` takes."""
    g, gi = np.unique(gt, return_inverse=True)
    p, pi = np.unique(pred, return_inverse=True)
    w = np.zeros((len(g), len(p)))
    w[gi, pi] = np.where(iou >= t, iou, 0.0)
    if min(w.shape) == 1:  # a star: the first of its greatest, as ``assign`` has it
        best = int(np.argmax(w))
        taken = {divmod(best, len(p))} if w.ravel()[best] > 0 else set()
    else:
        taken = {(r, c) for r, c in assign(w) if w[r, c] > 0}
    return np.array([x in taken for x in zip(gi.tolist(), pi.tolist(), strict=True)], bool)


def match_each(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """``match`` for several thresholds, with ``IoU_threshold``; components are found once.

    Components at the lowest threshold hold those of all others. A pair whose ends have no
    other pair is a block of its own, which needs no search.
    """
    low = [float(t) for t in thresholds]
    g, p = (Window.partitionBy("volume", c) for c in ("gt_id", "pred_id"))
    ok = pairs.filter(F.col("iou").cast("float") >= F.lit(min(low)).cast("double"))
    alone = (F.count("*").over(g) == 1) & (F.count("*").over(p) == 1)
    ok = cut(ok.select(*pairs.columns, alone.alias("_alone")))
    each = F.broadcast(pairs.sparkSession.createDataFrame([(t,) for t in low], "IoU_threshold double"))  # a constant
    iou = F.col("iou").cast("float")
    single = ok.filter("_alone").drop("_alone").join(each, (iou >= F.col("IoU_threshold")) & (iou > 0))
    more = ok.filter("not _alone").drop("_alone")
    # predictions as negative nodes keep the two sides apart
    edges = more.select("volume", F.col("gt_id").alias("a"), (-F.col("pred_id")).alias("b"))
    root = connected_components(edges, keys=["volume"]).select("volume", F.col("node").alias("gt_id"), F.col("root").alias("_block"))

    def blocks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_block", kind="stable")
        gt, pred, block = (rows[c].to_numpy() for c in ("gt_id", "pred_id", "_block"))
        iou = rows["iou"].to_numpy().astype(np.float32).astype(np.float64)
        ends = [*np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist(), len(rows)]
        own = rows.drop(columns=["_block", "_group"])
        out = []
        for t in low:
            keep = np.concatenate([_chosen(gt[a:b], pred[a:b], iou[a:b], t) for a, b in zip(ends, ends[1:])])
            out.append(own[keep].assign(IoU_threshold=t))
        return pd.concat(out, ignore_index=True)

    rows = more.join(root, ["volume", "gt_id"]).select(*pairs.columns, "_block", F.floor(F.col("_block") / BLOCKS).alias("_group"))
    return single.unionByName(rows.groupBy("volume", "_group").applyInPandas(blocks, single.schema))


def link_tracks(components: DataFrame, edges: DataFrame, p_thresh: float = 0.5) -> DataFrame:
    """(volume, gid, track): components joined by edges with ``p_link`` at the threshold or above.

    Every kept edge joins its ends, so a track may branch. A track's number is its
    smallest ``gid``, whatever the order of the edges.
    """
    kept = edges.filter(F.col("p_link") >= p_thresh).select("volume", F.col("gid_src").alias("a"), F.col("gid_tgt").alias("b"))
    nodes = components.select("volume", F.col("gid").alias("node")).distinct()
    return with_singles(nodes, connected_components(kept, keys=["volume"]), ["volume"]).select("volume", F.col("node").alias("gid"), F.col("root").alias("track"))


def gap_filter(p_thresh: float, d_max: float, ratio_min: float) -> Column:
    """Edges that may bridge a missing slice."""
    return (F.col("dz") == 2) & (F.col("p_link") >= p_thresh) & (F.col("d_centroid") <= d_max) & (F.col("area_ratio") >= ratio_min)


def gap_links(edges: DataFrame, forward: DataFrame, backward: DataFrame, *, p_thresh: float = 0.8, d_max: float = 3.0, ratio_min: float = 0.5) -> DataFrame:
    """One-to-one links over one missing slice (dz = 2), between track ends, by p descending.

    Ties go by source, then target. Slices are independent, so each is one group.
    """
    some = edges.filter(gap_filter(p_thresh, d_max, ratio_min))
    ends = some.join(forward.select("volume", "z", F.col("c").alias("c_src")), ["volume", "z", "c_src"], "left_semi")
    ends = ends.join(backward.select("volume", (F.col("z") - 2).alias("z"), F.col("c").alias("c_tgt")), ["volume", "z", "c_tgt"], "left_semi")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["p_link", "c_src", "c_tgt"], ascending=[False, True, True])
        src, tgt, keep = set(), set(), []
        for a, b in zip(rows["c_src"], rows["c_tgt"], strict=True):
            keep.append(a not in src and b not in tgt)
            if keep[-1]:
                src.add(a)
                tgt.add(b)
        return rows[keep]

    rows = ends.select("volume", "z", "c_src", "c_tgt", "gid_src", "gid_tgt", "p_link")
    return rows.groupBy("volume", "z").applyInPandas(greedy, rows.schema)


def fill_gaps(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """(volume, gid, track) with the tracks at both ends of each link joined; the smaller number stays."""
    of = lambda end: tracks.select("volume", F.col("gid").alias(f"gid_{end}"), F.col("track").alias(f"_{end}"))
    pairs = links.join(of("src"), ["volume", "gid_src"]).join(of("tgt"), ["volume", "gid_tgt"]).filter("_src <> _tgt")
    merged = connected_components(pairs.select("volume", F.col("_src").alias("a"), F.col("_tgt").alias("b")), keys=["volume"])
    to = merged.select("volume", F.col("node").alias("track"), F.col("root").alias("_to"))
    return tracks.join(to, ["volume", "track"], "left").select("volume", "gid", F.coalesce("_to", "track").alias("track"))


def first_come(box: np.ndarray, iou_thresh: float) -> list[int]:
    """The boxes that overlap no kept earlier one with ``iou_thresh`` or more."""
    area = (box[:, 2:] - box[:, :2]).prod(1)
    side = np.minimum(box[:, None, 2:], box[None, :, 2:]) - np.maximum(box[:, None, :2], box[None, :, :2]) if len(box) <= 2_000 else None
    if side is not None:  # all pairs at once
        inter = np.where((side > 0).all(2), side.prod(2), 0.0)
        hit = inter / (area[:, None] + area[None, :] - inter + 1e-9) >= iou_thresh
    kept: list[int] = []
    for i, b in enumerate(box):
        if side is not None:
            if not hit[i, kept].any():
                kept.append(i)
            continue
        k = box[kept]
        part = np.minimum(k[:, 2:], b[2:]) - np.maximum(k[:, :2], b[:2])
        inter = np.where((part > 0).all(1), part.prod(1), 0.0)
        if not (inter / (area[kept] + area[i] - inter + 1e-9) >= iou_thresh).any():
            kept.append(i)
    return kept


def drop_duplicate_boxes(boxes: DataFrame, iou_thresh: float = 0.8) -> DataFrame:
    """First-come suppression of boxes by slice: ``boxes(volume, z, ord, y0, x0, y1, x1)``."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        return rows.iloc[first_come(rows[["y0", "x0", "y1", "x1"]].to_numpy(np.float64), iou_thresh)]

    rows = boxes.select("volume", "z", "ord", "y0", "x0", "y1", "x1")
    return rows.groupBy("volume", "z").applyInPandas(fold, rows.schema)
