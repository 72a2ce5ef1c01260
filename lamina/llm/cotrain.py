"""Quality classifier by co-training (operator 2).

Two views of a document: its content (byte frequencies and hashed words) and its page
metadata (source, language, length, line layout). A logistic classifier learns each;
over rounds each hands confident pseudo-labels to the other. A round reads all documents:
both views score every one, and of those that a view is sure of, the first of each class
in a seeded hash order go to the other view, a fixed number a round. So the pool is the
whole corpus, and what a round brings to the driver is bounded by parameters alone. Both
views are then calibrated on held-out labels and combined, and one more pass scores all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewise as B
from .shared import small_batches, table, written

WORDS = 1024  # slots of hashed words
CONTENT = 256 + WORDS + 1
LAYOUT = 24
SLOTS = 32  # hashed source, hashed language
META = LAYOUT + 2 * SLOTS + 1


def content_view(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    rows = len(offs) - 1
    size = np.maximum(1, np.diff(offs))[:, None]
    row = np.repeat(np.arange(rows), np.diff(offs))
    byte = np.bincount(row * 256 + data, minlength=rows * 256).reshape(rows, 256) / size
    low = B.LOWER[data]
    start, end, of = B.spans(B.ALNUM[low], offs)
    slot = (B.span_hash(low, start, end) % np.uint64(WORDS)).astype(np.int64)
    word = np.bincount(of * WORDS + slot, minlength=rows * WORDS).reshape(rows, WORDS) / np.maximum(1, np.bincount(of, minlength=rows))[:, None]
    again = (slot[1:] == slot[:-1]) & (of[1:] == of[:-1]) if len(of) else np.zeros(0, bool)
    twice = np.bincount(of[1:][again], minlength=rows) / np.maximum(1, np.bincount(of, minlength=rows)) if len(of) else np.zeros(rows)
    return np.hstack([np.sqrt(byte) * 4, np.sqrt(word), twice[:, None] * 4]).astype(np.float32)


def meta_view(data: np.ndarray, offs: np.ndarray, lang: list, source: list) -> np.ndarray:
    rows = len(offs) - 1
    start, end, of = B.lines(data, offs)
    n = np.bincount(of, minlength=rows)
    width = np.bincount(of, end - start, rows) / np.maximum(n, 1)
    out = np.zeros((rows, META), np.float32)
    each = np.arange(rows)
    out[each, np.minimum(11, np.log2(1 + np.diff(offs)) / 1.5).astype(int)] = 1
    out[each, 12 + np.minimum(7, np.log2(1 + width) / 1.5).astype(int)] = 1
    out[each, 20 + np.minimum(3, np.log2(1 + n) / 2).astype(int)] = 1
    for k, values in enumerate((source, lang)):
        slot = np.array([zlib.crc32(str(v).encode()) % SLOTS for v in values], np.int64) if rows else np.zeros(0, np.int64)
        out[each, LAYOUT + k * SLOTS + slot] = 1
    out[:, -1] = 1
    return out


def _views(batch: pa.RecordBatch):
    lang, source = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    for a, b, data, offs in B.chunks(batch.column(0)):
        yield a, b, content_view(data, offs), meta_view(data, offs, lang[a:b], source[a:b])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, x, m in _views(batch):
            raw = [pa.array([v.astype(np.float16).tobytes() for v in view], pa.binary()) for view in (x, m)]
            yield pa.RecordBatch.from_arrays([batch.column(3).slice(a, b - a), *raw], names=["label", "content", "meta"])


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic weights with soft labels and row weights; the last column is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - shrink * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-4:
            break
    return w


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sure(weights_var, sure: float, each: int, seed: int):
    """Of the documents that a view is sure of, the ``each`` first of a class in hash order.

    Rows (text, lang, source, key) -> (view, label, order, content, meta); a task holds
    its first ones only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = weights_var.value
        held: dict[tuple[int, int], list] = {(v, y): [] for v in (0, 1) for y in (0, 1)}
        for batch in batches:
            key = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            order = (B.mix(key ^ np.uint64(seed)) >> np.uint64(1)).astype(np.int64)
            for a, b, *views in _views(batch):
                for v in (0, 1):
                    p = _p(views[v] @ weights[v])
                    for y, score in ((1, p), (0, 1 - p)):
                        some = np.flatnonzero(score >= sure)
                        some = some[np.argsort(order[a:b][some], kind="stable")[:each]]
                        mine = held[v, y]
                        mine += [(int(order[a + i]), *(view[i].astype(np.float16).tobytes() for view in views)) for i in some.tolist()]
                        mine.sort()
                        del mine[each:]
        for (v, y), rows in held.items():
            if rows:
                n, x, m = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(rows), pa.int32()), pa.array([y] * len(rows), pa.int32()), pa.array(n, pa.int64()), pa.array(x, pa.binary()), pa.array(m, pa.binary())], names=["view", "label", "place", "content", "meta"])

    return run


def _read(rows: list, column: str, n: int) -> np.ndarray:
    return np.array([np.frombuffer(r[column], np.float16) for r in rows], np.float32).reshape(len(rows), n)


def fit(docs: DataFrame, labels: DataFrame, *, labelled: int = 4000, rounds: int = 5, each_round: int = 160, sure: float = 0.9) -> dict:
    """Learn from at most ``labelled`` labelled rows and from pseudo-labels over all others.

    Labelled rows are the first in a hash order of ``doc_id``; several labels of one
    document are averaged. A fifth of them calibrates. In each of ``rounds`` a view gives
    the other ``each_round`` documents at most, in the labels' proportion of classes, of
    those that it is at least ``sure`` of.
    """
    spark, salted = docs.sparkSession, lambda salt: F.xxhash64("doc_id", F.lit(salt))
    good = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    some = written(good.orderBy(salted(1), "doc_id").limit(labelled), "labelled")
    columns = ["text", "lang", "source", "label"]
    with small_batches(spark):
        seen = docs.join(F.broadcast(some), "doc_id").select(*columns).mapInArrow(_features, "label double, content binary, meta binary")
        known = seen.orderBy("content", "meta", "label").limit(2 * labelled).collect()
    none = {"weights": [np.zeros(CONTENT, np.float32), np.zeros(META, np.float32)], "calibration": [np.array([1.0, 0.0])] * 2, "both": np.array([0.5, 0.5, 0.0])}
    if not known:
        return none
    order = np.random.default_rng(5).permutation(len(known))
    known = [known[i] for i in order]
    views, y = [_read(known, "content", CONTENT), _read(known, "meta", META)], np.array([r["label"] for r in known])
    held = np.arange(len(y)) % 5 == 4
    train, rate = ~held, float(np.clip(y[~held].mean(), 0.02, 0.98))
    quota = {1: max(1, round(each_round * rate)), 0: max(1, round(each_round * (1 - rate)))}
    # what each view has been given: features of both views are kept, the other's are used
    given: list[list[tuple[np.ndarray, float]]] = [[], []]
    weights: list[np.ndarray] = [np.zeros(CONTENT), np.zeros(META)]
    others = docs.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti").select("text", "lang", "source", F.coalesce(F.xxhash64("doc_id", "text"), F.lit(0)).alias("key"))
    for turn in range(rounds + 1):
        for v in (0, 1):
            more = given[v]
            x = np.vstack([views[v][train], *(m[0][None] for m in more)])
            target = np.concatenate([y[train], [m[1] for m in more]])
            weights[v] = logistic(x.astype(np.float64), target, np.concatenate([np.ones(train.sum()), np.full(len(more), 0.5)]))
        if turn == rounds:
            break
        sent = spark.sparkContext.broadcast([w.astype(np.float32) for w in weights])
        with small_batches(spark):
            found = others.mapInArrow(_sure(sent, sure, max(quota.values()), 101 + turn), "view int, label int, place long, content binary, meta binary")
            first = F.row_number().over(Window.partitionBy("view", "label").orderBy("place", "content", "meta"))
            rows = found.withColumn("_rank", first).filter(F.col("_rank") <= F.when(F.col("label") == 1, quota[1]).otherwise(quota[0])).collect()
        for r in sorted(rows, key=lambda r: (r["view"], r["label"], r["_rank"])):
            other = 1 - r["view"]
            given[other].append((np.frombuffer(r[("content", "meta")[other]], np.float16).astype(np.float32), float(r["label"])))
    return {"weights": [w.astype(np.float32) for w in weights]} | _combined([views[v][held] @ weights[v] for v in (0, 1)], y[held])


def _combined(z: list[np.ndarray], y: np.ndarray) -> dict:
    """Platt scaling of each view, then of their evidence together."""
    if not len(y):
        return {"calibration": [np.array([1.0, 0.0])] * 2, "both": np.array([0.5, 0.5, 0.0])}
    one = np.ones(len(y))
    calibration = [logistic(np.stack([x, one], 1), y, one, 0.01) for x in z]
    c = np.stack([x * k[0] + k[1] for x, k in zip(z, calibration, strict=True)] + [one], 1)
    return {"calibration": calibration, "both": logistic(c, y, one, 0.01)}


def _scorer(model_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_var.value
        (wx, wm), cal, both = model["weights"], model["calibration"], model["both"]
        for batch in batches:
            z = np.zeros((batch.num_rows, 2))
            for a, b, x, m in _views(batch):
                z[a:b, 0], z[a:b, 1] = x @ wx, m @ wm
            c = [z[:, v] * cal[v][0] + cal[v][1] for v in (0, 1)]
            score = _p(c[0] * both[0] + c[1] * both[1] + both[2])
            rest = batch.columns[3:]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(_p(c[0])), pa.array(_p(c[1])), pa.array(score)], names=[*batch.schema.names[3:], "p_content", "p_meta", "score"])

    return run


def score_quality(docs: DataFrame, model: dict, *, columns: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Add ``p_content``, ``p_meta``, ``score`` (0 to 1) and ``kept`` to every row.

    ``columns``: those that stay (all by default).

    Defined cases: a null text is scored as an empty one, null languages and sources
    as a value of their own; every row is scored by itself; without labels every score
    is 0.5 and every row is kept; an empty table gives an empty table; columns with the
    names of the added ones are replaced, others may have any name.
    """
    own = ("p_content", "p_meta", "score", "kept")
    keep = [c for c in (columns or docs.columns) if c not in own]
    rows = docs.select("text", "lang", "source", F.struct(*keep).alias("row"))
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.DoubleType()) for c in own[:3]]])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_scorer(sent), schema)
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *own[:3], (F.col("score") >= threshold).alias("kept"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score_quality(docs, model, columns=["doc_id"])
