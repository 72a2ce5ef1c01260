"""Scoring edges with a forest and linking components through the stack."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import spans as L
from lamina.functions.expressions import ratio
from lamina.model import FEATURES
from lamina.operators import graph
from lamina.operators.forest import Forest, train
from lamina.operators.graph import fill_gaps, gap_filter, gap_links, link_tracks
from lamina.operators.overlap import build_edges, endpoints, meetings, with_global_ids
from lamina.operators.regions import slice_components
from lamina.session import cut

SPLIT_BITS = 10  # of a hash order that are counted at once
SCORE_BUCKETS = 4096


def stratified_split(edges: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation): the first ``share`` of each class in a seeded hash order."""
    edges = cut(edges)  # read twice below
    key = F.xxhash64(F.lit(seed), "volume", "z", "dz", "c_src", "c_tgt")
    marked = edges.withColumn("_key", key).withColumn("_bucket", F.shiftright("_key", 64 - SPLIT_BITS))
    counts: dict = {}
    for label, bucket, n in marked.groupBy("label_same", "_bucket").count().collect():  # classes * 2**SPLIT_BITS rows at most
        counts.setdefault(label, []).append((bucket, n))
    rows = []  # of each class the bucket in which the share ends, and what is left of it there
    for label, buckets in counts.items():
        rest = math.ceil(share * sum(n for _, n in buckets))
        for bucket, n in sorted(buckets):
            if rest <= n:
                rows.append((label, bucket, rest))
                break
            rest -= n
    ends = F.broadcast(edges.sparkSession.createDataFrame(rows, "label_same int, _end long, _rest int"))
    placed = marked.join(ends, "label_same")
    # only the bucket in which the share ends is put in order
    last = placed.filter("_bucket = _end").withColumn("_held", F.row_number().over(Window.partitionBy("label_same", "_bucket").orderBy("_key", "volume", "z", "dz", "c_src", "c_tgt")) <= F.col("_rest"))
    done = cut(placed.filter("_bucket <> _end").withColumn("_held", F.col("_bucket") < F.col("_end")).unionByName(last).select(*edges.columns, "_held"))
    return done.filter("not _held").drop("_held"), done.filter("_held").drop("_held")


def slice_split(edges: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation) that keep whole slices together."""
    held = F.pmod(F.xxhash64(F.lit(seed), "volume", "z"), F.lit(10_000)) < int(share * 10_000)
    return edges.filter(~held), edges.filter(held)


def train_forest(edges: DataFrame, *, trees: int = 400, min_leaf: int = 2, depth: int = 30, seed: int = 42) -> Forest:
    """A forest on the edge features with balanced class weights n / (2 n_c)."""
    return train(edges, FEATURES, "label_same", trees=trees, min_leaf=min_leaf, depth=depth, seed=seed)


def save_model(model: Forest, path: str) -> None:
    model.save(path)


def load_model(path: str) -> Forest:
    return Forest.load(SparkSession.getActiveSession(), path)


def score_edges(edges: DataFrame, model: Forest) -> DataFrame:
    """Add ``p_link``, the model's probability that both ends belong together."""
    return model.score(edges, "p_link")


def importances(model: Forest) -> list[tuple[str, float]]:
    return sorted(zip(FEATURES, model.importances(), strict=True), key=lambda x: -x[1])


def ranking_scores(scored: DataFrame, label: str = "label_same", score: str = "p_link") -> DataFrame:
    """One row: roc_auc and average_precision (a step sum); null with a single class.

    Rows of one score are one step. Running sums go over buckets of the score first, then
    inside each bucket, so no task holds all scores.
    """
    steps = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label)).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    steps = cut(steps.withColumn("k", F.floor(F.col("s") * SCORE_BUCKETS)))
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    none = F.lit(0.0)
    before = steps.groupBy("k").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).select("k", F.coalesce(F.sum("p").over(down), none).alias("_p"), F.coalesce(F.sum("n").over(down), none).alias("_n"))
    w = Window.partitionBy("k").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = steps.withColumn("tp", F.sum("p").over(w)).withColumn("fp", F.sum("n").over(w)).join(F.broadcast(before), "k")
    run = run.withColumn("tp", F.col("tp") + F.col("_p")).withColumn("fp", F.col("fp") + F.col("_n"))
    total = F.broadcast(steps.agg(F.sum("p").alias("_all_p"), F.sum("n").alias("_all_n")))
    terms = run.join(total, F.lit(True))
    auc = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.first(F.col("_all_p") * F.col("_all_n"))
    ap = F.sum(F.col("p") / F.col("_all_p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = F.first((F.col("_all_p") > 0) & (F.col("_all_n") > 0))
    return terms.agg(F.when(both, auc).alias("roc_auc"), F.when(both, ap).alias("average_precision"))


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """precision, recall, f1 and support of each label."""
    hit = (F.col("p_link") >= threshold).cast("int")
    labels = F.explode(F.array(F.lit(0), F.lit(1))).alias("label")
    rows = scored.select("label_same", hit.alias("_hit")).select("*", labels)
    c = rows.groupBy("label").agg(
        F.count_if((F.col("label_same") == F.col("label")) & (F.col("_hit") == F.col("label"))).alias("_tp"), F.count_if(F.col("_hit") == F.col("label")).alias("_said"), F.count_if(F.col("label_same") == F.col("label")).alias("support")
    )
    p, r = ratio(F.col("_tp"), F.col("_said")), ratio(F.col("_tp"), F.col("support"))
    return c.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def _labelled(runs: DataFrame, connectivity: int = 1) -> DataFrame:
    """Component runs with ``c`` and ``gid``, as they are if ``runs`` have them already."""
    return runs if "gid" in runs.columns else with_global_ids(slice_components(runs, connectivity))


def _painted(components: DataFrame, tracks: DataFrame) -> DataFrame:
    """Component runs with their track as id."""
    return components.join(tracks, ["volume", "gid"]).select("volume", "z", "y", "x0", "x1", F.col("track").alias("id"))


def _components(met: DataFrame) -> DataFrame:
    return met.filter("dz = 0").select("volume", F.col("gid_src").alias("gid"))


def link_full(runs: DataFrame, model, *, min_px: int = 8, connectivity: int = 1, skip_links: bool = False, p_thresh: float = 0.6, met: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored edges, linked runs) of one pass over neighbouring slices.

    ``runs``: those of a volume, or of its components; ``met``: the ``meetings`` of these, if they are known.
    """
    parts, dzs = _labelled(runs, connectivity), (1, 2) if skip_links else (1,)
    met = meetings(parts, dzs=dzs) if met is None else met
    scored = cut(score_edges(build_edges(met, dzs=dzs, min_px=min_px), model))
    return scored, _painted(parts, link_tracks(_components(met), scored, p_thresh))


def _linked_groups(met: DataFrame, scored: DataFrame, p_dz1: float, gap) -> DataFrame:
    """(volume, gid, first, track): the tracks of pass A and of pass B, a volume in one task.

    Rows are components (kind 0), pairs on neighbouring slices (1), links of pass A (2) and those that
    pass B may take (3). An end has no pair of its own track on the next (previous) slice.
    """

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind = rows["kind"].to_numpy()
        gid = np.unique(rows["a"].to_numpy()[kind == 0])
        a, b = (np.searchsorted(gid, rows[c].to_numpy()) for c in ("a", "b"))
        joined = kind == 2
        root = L.joined(len(gid), a[joined], b[joined])
        same = (kind == 1) & (root[a] == root[b])
        going, coming = np.zeros((2, len(gid)), bool)
        going[a[same]] = coming[b[same]] = True
        free = np.flatnonzero((kind == 3) & ~going[a] & ~coming[b])
        p = rows["p_link"].to_numpy()
        for k in free[np.lexsort((b[free], a[free], -p[free]))].tolist():  # a component is on one slice, so slices don't meet
            if not (going[a[k]] or coming[b[k]]):
                going[a[k]] = coming[b[k]] = joined[k] = True
        return pd.DataFrame({"volume": key[0], "gid": gid, "first": gid[root], "track": gid[L.joined(len(gid), a[joined], b[joined])]})

    row = lambda df, kind, p: df.select("volume", F.lit(kind).alias("kind"), F.col("gid_src").alias("a"), F.col("gid_tgt").alias("b"), p.alias("p_link"))
    known = row(met.filter("dz = 0"), 0, F.lit(0.0)).unionByName(row(met.filter("dz = 1"), 1, F.lit(0.0)))
    links = row(scored.filter((F.col("dz") == 1) & (F.col("p_link") >= p_dz1)), 2, F.col("p_link")).unionByName(row(scored.filter(gap), 3, F.col("p_link")))
    return known.unionByName(links).groupBy("volume").applyInPandas(one, "volume long, gid long, first long, track long")


def link_iterative(runs: DataFrame, model, *, met: DataFrame | None = None, min_px: int = 8, p_dz1: float = 0.6, p_dz2: float = 0.7, d_max: float = 3.0, ratio_min: float = 0.5) -> dict[str, DataFrame]:
    """Pass A links neighbouring slices; pass B bridges single missing slices at track ends.

    ``runs``: those of a volume, or of its components; ``met``: the ``meetings`` of these, if they are known.
    Volumes of at most ``graph.GROUP_EDGES`` pairs and components are linked in memory.
    """
    parts = _labelled(runs)
    met = meetings(parts) if met is None else met
    scored = cut(score_edges(build_edges(met, dzs=(1, 2), min_px=min_px), model))
    first = scored.filter("dz = 1")
    if (met.groupBy("volume").count().agg(F.max("count")).first()[0] or 0) <= graph.GROUP_EDGES:
        both = cut(_linked_groups(met, scored, p_dz1, gap_filter(p_dz2, d_max, ratio_min)))
        of = lambda c: both.select("volume", "gid", F.col(c).alias("track"))
        return {"edges_a": first, "linked_a": _painted(parts, of("first")), "edges": scored, "linked": _painted(parts, of("track"))}
    tracks = cut(link_tracks(_components(met), first, p_dz1))
    on = cut(parts.join(tracks, ["volume", "gid"]))
    links = gap_links(scored, endpoints(on), endpoints(on, forward=False), p_thresh=p_dz2, d_max=d_max, ratio_min=ratio_min)
    return {"edges_a": first, "linked_a": _painted(parts, tracks), "edges": scored, "linked": _painted(parts, fill_gaps(tracks, links))}


def link_volume(runs: DataFrame, model, mode: str = "full", **options):
    """``link_full`` or ``link_iterative`` by name."""
    if mode not in ("full", "iterative"):
        raise ValueError(f"mode is {mode!r}; it can be 'full' or 'iterative'")
    return (link_full if mode == "full" else link_iterative)(runs, model, **options)
