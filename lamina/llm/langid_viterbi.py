"""Language identification with Viterbi spans (operator 6).

A word is a run of letters and marks. Its script, read from the ranges of its code points,
narrows the candidate languages to those that were learned in it. Every word gets a score per language from its byte trigrams
and itself; Viterbi with a switching penalty then labels spans of mixed texts. All
texts of an Arrow batch advance word by word together, so a step is one NumPy call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewise as B
from .shared import table

SLOTS = 1 << 16
PENALTY = 8.0
# Ranges of code points of scripts (first, last, number); all others are Latin or tell nothing.
RANGES = (
    (0x370, 0x3FF, 1), (0x1F00, 0x1FFF, 1), (0x400, 0x52F, 2), (0x1C80, 0x1C8F, 2), (0x2DE0, 0x2DFF, 2), (0x530, 0x58F, 3), (0x590, 0x5FF, 4), (0x600, 0x6FF, 5), (0x750, 0x77F, 5), (0x8A0, 0x8FF, 5),
    (0xFB50, 0xFDFF, 5), (0xFE70, 0xFEFF, 5), (0x900, 0x97F, 6), (0x980, 0x9FF, 7), (0xA00, 0xA7F, 8), (0xA80, 0xAFF, 9), (0xB00, 0xB7F, 10), (0xB80, 0xBFF, 11), (0xC00, 0xC7F, 12), (0xC80, 0xCFF, 13),
    (0xD00, 0xD7F, 14), (0xD80, 0xDFF, 15), (0xE00, 0xE7F, 16), (0xE80, 0xEFF, 17), (0xF00, 0xFFF, 18), (0x1000, 0x109F, 19), (0x10A0, 0x10FF, 20), (0x1100, 0x11FF, 21), (0x3130, 0x318F, 21), (0xAC00, 0xD7AF, 21),
    (0x1200, 0x137F, 22), (0x1780, 0x17FF, 23), (0x3040, 0x30FF, 24), (0x31F0, 0x31FF, 24), (0xFF66, 0xFF9F, 24), (0x2E80, 0x2FDF, 25), (0x3400, 0x4DBF, 25), (0x4E00, 0x9FFF, 25), (0xF900, 0xFAFF, 25), (0x20000, 0x2FA1F, 25),
)
SCRIPTS = 26
_ranges = np.array(sorted(RANGES), np.int64)


def scripts_of(data: np.ndarray) -> np.ndarray:
    """The script of the character that begins at each byte; 0 inside one, and for Latin."""
    out = np.zeros(len(data), np.int8)
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    x = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (x[lead + k] for k in range(4))
    two, three = ((b0 & 0x1F) << 6) | (b1 & 0x3F), ((b0 & 0xF) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
    point = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, ((b0 & 7) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)))
    k = np.searchsorted(_ranges[:, 0], point, side="right") - 1
    out[lead] = np.where((k >= 0) & (point <= _ranges[k, 1]), _ranges[k, 2], 0)
    return out


#: Everything but letters and their marks. Each such character becomes one space, so places stay.
NO_LETTER = r"[^\p{L}\p{M}]"
GROUP = 4 << 20  # bytes of text that Viterbi labels together
_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPAN = "struct<lang:string,start:int,end:int>"


def _features(data: np.ndarray, offs: np.ndarray):
    """Words (start, end, row, script) and the slots of their trigrams and of themselves."""
    low = B.LOWER[data]
    inside = B.LETTER[low]
    start, end, row = B.spans(inside, offs)
    byte = np.where(inside, low, 32).astype(np.uint32)
    if not len(start):
        none = np.zeros(0, np.int64)
        return start, end, row, none.astype(np.int8), none, none
    before, after = np.full(len(byte), 32, np.uint32), np.full(len(byte), 32, np.uint32)
    before[1:], after[:-1] = byte[:-1], byte[1:]
    edge = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(byte))]
    before[edge], after[edge - 1] = 32, 32
    tri = ((before * np.uint32(0x01000193) ^ byte) * np.uint32(0x85EBCA6B) ^ after) * np.uint32(0xC2B2AE35)
    word = B.span_hash(low, start, end)
    bounds = np.stack([start, np.minimum(end, len(byte) - 1)], 1).ravel()
    of = scripts_of(data)
    script = np.maximum.reduceat(of, bounds[:-1] if bounds[-1] >= len(byte) else bounds)[::2]
    script = np.where(end - start == 1, of[start], script)
    return start, end, row, script.astype(np.int8), (tri >> np.uint32(16)).astype(np.int64), (word >> np.uint64(48)).astype(np.int64)


def _counter(langs: list[str]):
    """Per task: counts of slots by language. kind 0: trigrams, 1: words, 2: scripts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(langs)
        total = [np.zeros((n, SLOTS), np.int64), np.zeros((n, SLOTS), np.int64), np.zeros((n, SCRIPTS), np.int64)]
        for batch in batches:
            lang = np.array([langs.index(x) for x in batch.column(1).to_pylist()], np.int64)
            for a, _, data, offs in B.chunks(batch.column(0)):
                start, end, row, script, tri, word = _features(data, offs)
                if not len(start):
                    continue
                own = lang[a + row]
                of = np.repeat(own, end - start)
                at = np.repeat(start - np.concatenate([[0], np.cumsum(end - start)])[:-1], end - start) + np.arange(len(of))
                total[0] += np.bincount(of * SLOTS + tri[at], minlength=n * SLOTS).reshape(n, SLOTS)
                total[1] += np.bincount(own * SLOTS + word, minlength=n * SLOTS).reshape(n, SLOTS)
                total[2] += np.bincount(own * SCRIPTS + script, minlength=n * SCRIPTS).reshape(n, SCRIPTS)
        for kind, t in enumerate(total):
            k, slot = np.nonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(t[k, slot])], names=["kind", "lang", "slot", "n"])

    return run


def letters(text: Column) -> Column:
    return F.regexp_replace(text, NO_LETTER, " ")


def fit(labelled: DataFrame, *, per_lang: int = 1500, max_langs: int = 500) -> dict:
    """Learn from (doc_id, text, lang) on a sample of about ``per_lang`` rows a language.

    The sample is by a hash of ``doc_id``. What reaches the driver is bounded by
    languages x slots, at most ``max_langs`` languages.
    """
    rows = labelled.filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs")
    langs = [r["lang"] for r in sizes]
    if not langs:
        return {"langs": [], "tri": None, "word": None, "allowed": None}
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(scale, int(scale * per_lang / r["count"]) + 1))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.element_at(share, F.col("lang")))
    counted = sample.select(letters(F.col("text")).alias("text"), "lang").mapInArrow(_counter(langs), "kind int, lang int, slot int, n long")
    counts = [np.zeros((len(langs), SLOTS)), np.zeros((len(langs), SLOTS)), np.zeros((len(langs), SCRIPTS))]
    for kind, k, slot, n in counted.groupBy("kind", "lang", "slot").agg(F.sum("n")).collect():  # languages x slots at most
        counts[kind][k, slot] = n
    tables = []
    for c in counts[:2]:
        p = np.log((c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * SLOTS))
        tables.append(np.ascontiguousarray((p - p.mean(0)).T.astype(np.float32)))
    some = counts[2] >= 0.001 * np.maximum(1, counts[2].sum(1, keepdims=True))
    allowed = some.T.copy()
    allowed[~allowed.any(1)] = True
    return {"langs": langs, "tri": tables[0], "word": tables[1], "allowed": allowed}


def _scores(model: dict, data: np.ndarray, offs: np.ndarray):
    start, end, row, script, tri, word = _features(data, offs)
    n = len(model["langs"])
    if not len(start):
        return start, end, row, np.zeros((0, n), np.float32)
    inside = B.LETTER[B.LOWER[data]]
    out = model["word"][word]
    first = np.concatenate([[0], np.cumsum(end - start)])[:-1]
    for k in range(n):
        out[:, k] += np.add.reduceat(model["tri"][:, k][tri[inside]], first)
    out[~model["allowed"][script]] -= 1000.0
    return start, end, row, out


def viterbi(score: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of every word; ``count``: words of each text, in order."""
    total, n = score.shape
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    by = np.argsort(-count, kind="stable")
    by = by[count[by] > 0]
    first, count = first[by], count[by]
    back = np.zeros((total, n), np.int8 if n < 128 else np.int16)
    state = np.zeros(total, np.int64)
    same = np.arange(n)
    if not len(by):
        return state
    active = np.searchsorted(-count, -np.arange(count[0]) - 0.5)  # texts with more than t words
    now = score[first].astype(np.float64)
    for t in range(1, int(count[0])):
        a = active[t]
        prev = now[:a]
        top = prev.argmax(1)
        best = prev[np.arange(a), top][:, None] - penalty
        switch = best > prev
        at = first[:a] + t
        back[at] = np.where(switch, top[:, None], same)
        now[:a] = np.where(switch, best, prev) + score[at]
    last = first + count - 1
    state[last] = now.argmax(1)
    for t in range(int(count[0]) - 1, 0, -1):
        a = active[t]
        at = first[:a] + t
        state[at - 1] = back[at, state[at]]
    return state


def _labeller(model_var, penalty: float, names: list[str], with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_var.value
        langs, n = model["langs"], len(model["langs"])
        label = pa.array(langs, pa.string())
        for batch in batches:
            texts, rows = batch.column(names.index("text")), batch.num_rows
            pred, share, has = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows, bool)
            lists = []
            for a, b, _, _ in B.chunks(texts, GROUP):  # bounds the memory of a step
                part, chars = [], []
                for c, _, data, offs in B.chunks(texts.slice(a, b - a), GROUP // 4) if n else ():
                    start, end, row, s = _scores(model, data, offs)
                    points = B.code_points(data)
                    base = points[offs[row]]
                    part.append((c + row, end - start, s))
                    chars.append(np.stack([points[start] - base, points[end] - base], 1))
                m = b - a
                if not part or not sum(len(p[0]) for p in part):
                    lists.append(pa.array([[]] * m, _SPANS))
                    continue
                row, width, score = (np.concatenate(x) for x in zip(*part, strict=True))
                del part
                state = viterbi(score, np.bincount(row, minlength=m), penalty)
                weight = np.bincount(row * n + state, width, m * n).reshape(m, n)
                pred[a:b], whole = weight.argmax(1), weight.sum(1)
                has[a:b] = whole > 0
                share[a:b] = np.where(whole > 0, weight.max(1) / np.maximum(whole, 1), 0.0)
                if with_spans:
                    char = np.concatenate(chars)
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (state[1:] != state[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(row)) - 1
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=m))]).astype(np.int32)
                    values = pa.StructArray.from_arrays([label.take(pa.array(state[first])), pa.array(char[first, 0].astype(np.int32)), pa.array(char[last, 1].astype(np.int32))], names=["lang", "start", "end"])
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets), values))
            found = label.take(pa.array(pred)) if n else pa.nulls(rows, pa.string())
            found = pa.array([x if h else None for x, h in zip(found.to_pylist(), has.tolist(), strict=True)], pa.string())
            keep = [(k, c) for k, c in zip(names, batch.columns, strict=True) if k != "text"]
            extra = [("_lang", found), ("_score", pa.array(share))] + ([("_spans", pa.concat_arrays(lists) if lists else pa.array([], _SPANS))] if with_spans else [])
            yield pa.RecordBatch.from_arrays([c for _, c in keep + extra], names=[k for k, _ in keep + extra])

    return run


def identify(docs: DataFrame, model: dict, *, penalty: float = PENALTY, columns: list[str] | None = None, spans: bool = True) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``spans`` (language, start, end in code points).

    ``lang_pred`` is the language with the most bytes of words in the spans, ``score``
    its share of them, 0 to 1. ``columns``: those that stay (all but ``text`` by default).

    Defined cases: ``und``, score 0 and no spans if the text is null or has no letter,
    or if the model learned nothing; ties go to the language that sorts first; every
    row is labelled by itself; an empty table gives an empty table; columns with the
    names of the added ones are replaced, others may have any name.
    """
    keep = [c for c in (columns or docs.columns) if c not in ("text", "lang_pred", "score", "spans")]
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*keep).alias("row"), F.when(has_letter, letters(F.col("text"))).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType()), *([T.StructField("_spans", T._parse_datatype_string(f"array<{SPAN}>"))] if spans else [])]
    out = rows.mapInArrow(_labeller(sent, penalty, rows.columns, spans), T.StructType([rows.schema["row"], *added]))
    new = [F.coalesce("_lang", F.lit("und")).alias("lang_pred"), F.col("_score").alias("score")]
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *new, *([F.col("_spans").alias("spans")] if spans else []))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model, spans=False).select("doc_id", "held_out", "lang_pred", "score")
