"""A random forest whose trees grow side by side, each in one task.

Features become numbers of bins between quantiles, so equal rows are counted once and every
tree draws its bootstrap from those counts. They travel to all tasks, and a tree grows level
by level on histograms of its nodes. Trees are rows of a table in the shared folder and never
meet on the driver. Scoring sends the distinct binned rows to the trees, not the trees to the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import cut

BITS = 5  # of a key for each feature, so 32 bins
BINS = 1 << BITS
BLOCK = 1 << 15  # nodes whose histograms are held at once
SLICE = 1 << 16  # rows that walk down a tree at once
TREE = "tree long, feature binary, bin binary, child binary, p binary, gain binary"


def keys_of(columns: list[np.ndarray], cuts: list[list[float]]) -> np.ndarray:
    """The bins of each row, BITS a feature; missing values go to the last bin."""
    out = np.zeros(len(columns[0]), np.int64)
    for k, (v, c) in enumerate(zip(columns, cuts, strict=True)):
        out |= np.searchsorted(np.array(c, float), v.astype(float), "left").astype(np.int64) << (BITS * k)
    return out


def bins_of(keys: np.ndarray, features: int) -> np.ndarray:
    """(feature, row) -> bin."""
    return np.stack([(keys >> (BITS * k)) & (BINS - 1) for k in range(features)]).astype(np.uint8)


def _best(bins: np.ndarray, rows: np.ndarray, at: np.ndarray, side: tuple[np.ndarray, ...], total: tuple[np.ndarray, ...], choice: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin) of each node's best split among its chosen features."""
    nodes = len(choice)
    best, feature, place = np.zeros(nodes), np.zeros(nodes, np.int8), np.zeros(nodes, np.uint8)
    a, b, n = (t[:, None] for t in total)
    own = 2 * a * b / (a + b)
    for chosen in choice.T:
        key = at * BINS + bins[chosen[at], rows]
        x, y, m = (np.bincount(key, w, nodes * BINS).reshape(nodes, BINS).cumsum(1)[:, :-1] for w in side)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = own - 2 * x * y / (x + y) - 2 * (a - x) * (b - y) / (a + b - x - y)
        gain[~((m >= min_leaf) & (n - m >= min_leaf))] = 0
        at_most = gain.argmax(1)
        gain = gain[np.arange(nodes), at_most]
        more = gain > best
        best[more], feature[more], place[more] = gain[more], chosen[more], at_most[more]
    return best, feature, place


def grow(bins: np.ndarray, counts: np.ndarray, weights: tuple[float, float], rng: np.random.Generator, *, depth: int, min_leaf: int) -> tuple[np.ndarray, ...]:
    """(feature or -1, bin, left child, p, gain by feature) of a tree; the right child follows the left one.

    ``counts``: rows of each class for every column of ``bins``. Nodes choose among
    ceil(sqrt(features)) features; a leaf holds ``min_leaf`` drawn rows at least.
    """
    drawn = rng.poisson(counts)
    rows = np.flatnonzero(drawn.sum(0))
    if not len(rows):  # nothing drawn: the classes as they are
        drawn, rows = counts, np.arange(counts.shape[1])
    side = [drawn[0, rows] * weights[0], drawn[1, rows] * weights[1], drawn[:, rows].sum(0).astype(float)]
    at, nodes, first, gains = np.zeros(len(rows), np.int64), 1, 0, np.zeros(len(bins))
    levels: list[tuple[np.ndarray, ...]] = []
    for level in range(depth + 1):
        total = [np.bincount(at, w, nodes) for w in side]
        feature, place, child = np.full(nodes, -1, np.int8), np.zeros(nodes, np.uint8), np.zeros(nodes, np.int32)
        levels.append((feature, place, child, (total[1] / (total[0] + total[1])).astype(np.float32)))
        first += nodes
        open_ = np.flatnonzero((total[0] > 0) & (total[1] > 0) & (total[2] >= 2 * min_leaf)) if level < depth else np.zeros(0, np.int64)
        if not len(open_):
            break
        choice = rng.random((len(open_), len(bins))).argsort(1)[:, : math.ceil(math.sqrt(len(bins)))]
        number = np.full(nodes, -1)
        number[open_] = np.arange(len(open_))
        live = number[at] >= 0
        rows, at, side = rows[live], number[at[live]], [w[live] for w in side]
        found = []
        for k in range(0, len(open_), BLOCK):
            some = slice(None) if len(open_) <= BLOCK else np.flatnonzero((at >= k) & (at < k + BLOCK))
            found.append(_best(bins, rows[some], at[some] - k, tuple(w[some] for w in side), tuple(t[open_[k : k + BLOCK]] for t in total), choice[k : k + BLOCK], min_leaf))
        gain, by, upto = (np.concatenate(v) for v in zip(*found, strict=True))
        split = np.flatnonzero(gain > 1e-9 * (total[0] + total[1])[open_])
        if not len(split):
            break
        gains += np.bincount(by[split], gain[split], len(bins))
        feature[open_[split]], place[open_[split]] = by[split], upto[split]
        child[open_[split]] = first + 2 * np.arange(len(split))
        number = np.full(len(open_), -1)
        number[split] = np.arange(len(split))
        live = number[at] >= 0
        rows, at, side = rows[live], at[live], [w[live] for w in side]
        at = 2 * number[at] + (bins[by[at], rows] > upto[at])
        nodes = 2 * len(split)
    return (*(np.concatenate(v) for v in zip(*levels, strict=True)), gains)


def walk(bins: np.ndarray, feature: np.ndarray, place: np.ndarray, child: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The p of the leaf that each column of ``bins`` comes to."""
    node = np.zeros(bins.shape[1], np.int64)
    live = np.arange(bins.shape[1])
    while len(live):
        live = live[feature[node[live]] >= 0]
        here = node[live]
        node[live] = child[here] + (bins[feature[here], live] > place[here])
    return p[node].astype(float)


class Forest:
    """Trees as a table, with the cuts between the bins of each feature."""

    def __init__(self, features: list[str], cuts: list[list[float]], trees: DataFrame):
        self.features, self.cuts, self.trees = features, cuts, trees

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_key``, their bins."""
        cuts, names = self.cuts, self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys_of(columns, cuts))], names=[*batch.schema.names, "_key"])

        schema = rows.select("*", F.lit(0).cast("long").alias("_key")).schema
        return rows.mapInArrow(run, schema)

    def probabilities(self, keys: DataFrame) -> DataFrame:
        """(_key, p) of the distinct ``keys``: the mean over the trees."""
        spark, width = keys.sparkSession, len(self.features)
        known = np.sort(keys.distinct().toArrow().column(0).to_numpy())
        sent = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, first, sums = sent.value, None, None
            slices = range(0, len(known), SLICE)
            bins = [bins_of(known[k : k + SLICE], width) for k in slices]
            for batch in batches:
                for tree, *parts in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                    arrays = [np.frombuffer(x, t) for x, t in zip(parts, (np.int8, np.uint8, np.int32, np.float32), strict=True)]
                    p = [walk(b, *arrays) for b in bins]
                    first = tree if first is None else min(first, tree)
                    sums = p if sums is None else [x + y for x, y in zip(sums, p, strict=True)]
            for k, x in enumerate(sums or []):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([first]), pa.array([x.tobytes()], pa.binary())], names=["slice", "first", "sums"])

        trees = self.trees.count()

        def mean(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("first")
            total = np.sum([np.frombuffer(x, float) for x in rows["sums"]], axis=0)
            return pd.DataFrame({"_key": sent.value[key[0] * SLICE : (key[0] + 1) * SLICE], "p": total / trees})

        sums = self.trees.mapInArrow(run, "slice long, first long, sums binary")
        return sums.groupBy("slice").applyInPandas(mean, "_key long, p double")

    def score(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the probability of class 1."""
        keyed = cut(self.keyed(rows))
        p = self.probabilities(keyed.select("_key")).withColumnRenamed("p", name)
        return keyed.join(p, "_key").select(*rows.columns, name)

    def importances(self) -> list[float]:
        """The mean over the trees of each feature's share of the gain."""
        gains = np.array([np.frombuffer(x, float) for (x,) in self.trees.select("gain").collect()])
        share = (gains / np.where(gains.sum(1) > 0, gains.sum(1), 1)[:, None]).mean(0)
        return (share / share.sum() if share.sum() > 0 else share).tolist()

    def save(self, path: str) -> None:
        spark = self.trees.sparkSession
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        rows = [(k, name, c) for k, (name, c) in enumerate(zip(self.features, self.cuts, strict=True))]
        spark.createDataFrame(rows, "place int, feature string, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/bins")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        bins = spark.read.parquet(f"{path}/bins").orderBy("place").collect()
        return cls([r["feature"] for r in bins], [list(r["cuts"]) for r in bins], spark.read.parquet(f"{path}/trees"))


def train(rows: DataFrame, features: list[str], label: str, *, trees: int, min_leaf: int, depth: int, seed: int) -> Forest:
    """A forest with balanced class weights n / (2 n_c); ``label``: 0 or 1."""
    spark = rows.sparkSession
    at = [k / BINS for k in range(1, BINS)]
    cuts = [sorted(set(c)) for c in rows.approxQuantile(features, at, 0.002)]
    forest = Forest(features, cuts, rows)
    binned = forest.keyed(rows.select(*features, label)).groupBy("_key").agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")).toArrow()
    if not len(binned):
        raise ValueError("no rows to train on")
    keys, counts = binned.column(0).to_numpy(), np.stack([binned.column(k).to_numpy() for k in (1, 2)])
    by = np.argsort(keys)
    each = counts.sum(1)
    weights = tuple(float(each.sum() / (2.0 * n)) if n else 0.0 for n in each)
    sent = spark.sparkContext.broadcast((keys[by], np.ascontiguousarray(counts[:, by])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = sent.value
        bins = bins_of(keys, len(features))
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                parts = grow(bins, counts, weights, np.random.default_rng([seed, tree]), depth=depth, min_leaf=min_leaf)
                yield pa.RecordBatch.from_arrays([pa.array([tree]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=[c.split()[0] for c in TREE.split(", ")])

    tasks = min(trees, 8 * spark.sparkContext.defaultParallelism)
    forest.trees = cut(spark.range(0, trees, 1, tasks).mapInArrow(run, TREE))
    sent.unpersist()
    return forest
