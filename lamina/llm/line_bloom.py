"""Line deduplication with two Bloom filters (operator 9).

A first pass over the texts sends the hashes of line keys, each once a batch, to the
shards of two Bloom filters: hashes seen once and hashes seen at least twice. Both bits
of a hash lie in one shard, so a shard is filled by one task with two small bit sets. A
second pass sends on only the keys found in the second filter. Those are confirmed
exactly, by the key itself, and the smallest document keeps them.

The second filter is broadcast while it has at most ``max_bits``. Beyond that no filter
travels: the shards name the hashes that they met again, and hashes (never texts) are
joined with those, which says whose lines are suspects.

Texts without a dropped line stay where they are: a Bloom filter of the documents that
lose lines splits the table, and only the others are joined with what they lose.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewise as B
from .shared import LAST_ID, partitions, scratch, small_batches, written

SHARD = 1 << 19  # bits
SALT = np.uint64(0xA0761D6478BD642F)


def _keys(data: np.ndarray, offs: np.ndarray, least: int):
    """(bytes, row, hash, start, end) of the distinct long keys of each row, compared by their bytes."""
    low = B.LOWER[data]
    start, end, row = B.lines(data, offs)
    start, end = B.stripped(data, start, end)
    points = B.code_points(data)
    long = np.flatnonzero(points[end] - points[start] >= least)
    start, end, row = start[long], end[long], row[long]
    h = B.span_hash(low, start, end)
    order = np.lexsort((h, row))
    start, end, row, h = start[order], end[order], row[order], h[order]
    new = np.ones(len(order), bool)
    again = 1 + np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]) & ((end - start)[1:] == (end - start)[:-1]))
    new[again] = ~B.same_spans(low, start[again], low, start[again - 1], (end - start)[again])
    return low, row[new], h[new], start[new], end[new]


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in its shard."""
    x = B.mix(h ^ SALT)
    return (x & np.uint64(SHARD - 1)).astype(np.int64), ((x >> np.uint64(32)) & np.uint64(SHARD - 1)).astype(np.int64)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _has(bits: np.ndarray, places, base=0) -> np.ndarray:
    out = True
    for p in places:
        at = p + base
        out = out & ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
    return out


def _put(bits: np.ndarray, places) -> None:
    for p in places:
        np.bitwise_or.at(bits, p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8)))


def _hashes(shards: int, least: int):
    """(shard, hash, in several rows) of every key, once a chunk of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in B.chunks(batch.column(0)):
                h, n = np.unique(_keys(data, offs, least)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_shard(h, shards)), pa.array(h.view(np.int64)), pa.array(n > 1)], names=["shard", "h", "several"])

    return run


def _fill(named: bool):
    """Fill one shard after the other; rows arrive sorted by shard.

    Yields the bits of what was seen twice, or the hashes that were (``named``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = -1, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["shard", "bits"])

        for batch in batches:
            shard, h, several = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edge = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(shard)], strict=True):
                if a == b:
                    continue
                if shard[a] != now:
                    if now >= 0 and not named:
                        yield out()
                    now, once, twice = int(shard[a]), np.zeros(SHARD >> 3, np.uint8), np.zeros(SHARD >> 3, np.uint8)
                own, n = np.unique(h[a:b].view(np.uint64), return_counts=True)
                more = np.isin(own, h[a:b][several[a:b].astype(bool)].view(np.uint64))
                places = _places(own)
                again = more | (n > 1) | _has(once, places)
                _put(once, places)
                if named:
                    yield pa.RecordBatch.from_arrays([pa.array(own[again].view(np.int64))], names=["h"])
                else:
                    _put(twice, [p[again] for p in places])
        if now >= 0 and not named:
            yield out()

    return run


def _by_shard(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "shard").sortWithinPartitions("shard")


def _collected(shards_of: DataFrame, shards: int) -> bytes:
    """The bits of all shards: ``shards * SHARD / 8`` bytes on the driver."""
    whole = np.zeros(shards * SHARD >> 3, np.uint8)
    for shard, bits in shards_of.toLocalIterator():
        whole[shard * SHARD >> 3 : (shard + 1) * SHARD >> 3] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return whole.tobytes()


def _suspects(filter_of, shards: int, least: int):
    """(owner, part, h, key) of the keys in the filter; of all keys where it is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filter_of.value, np.uint8) if filter_of else None
        for batch in batches:
            for a, b, data, offs in B.chunks(batch.column(2)):
                low, row, h, start, end = _keys(data, offs, least)
                if twice is not None:
                    hit = np.flatnonzero(_has(twice, _places(h), _shard(h, shards) * SHARD))
                    row, h, start, end = row[hit], h[hit], start[hit], end[hit]
                raw = low.tobytes()
                keys = [raw[s:e].decode() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a).take(at) for c in batch.columns[:2]), pa.array(h.view(np.int64)), pa.array(keys, pa.string())], names=["owner", "part", "h", "key"])

    return run


class _Holders:
    """A Bloom filter of (owner, part), of ``max_bits`` at most; fuller beyond, so more rows are joined."""

    def __init__(self, holders: DataFrame, count: int, max_bits: int):
        spark = holders.sparkSession
        self.shards = shards = max(1, min(max_bits, 16 * count) // SHARD)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = B.mix(batch.column(0).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(_shard(h, shards)), pa.array(h.view(np.int64)), pa.array(np.ones(len(h), bool))], names=["shard", "h", "several"])

        sent = _by_shard(holders.select(F.xxhash64("owner", "part")).mapInArrow(rows, "shard long, h long, several boolean")).mapInArrow(_fill(False), "shard long, bits binary")
        self.bits = spark.sparkContext.broadcast(_collected(sent, shards))

    def may_hold(self, owner: Column, part: Column) -> Column:
        bits, shards = self.bits, self.shards

        @F.arrow_udf(T.BooleanType())
        def test(key: pa.Array) -> pa.Array:
            h = B.mix(key.to_numpy(zero_copy_only=False).view(np.uint64))
            return pa.array(_has(np.frombuffer(bits.value, np.uint8), _places(h), _shard(h, shards) * SHARD))

        return test(F.xxhash64(owner, part))


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_dropped", T.LongType())])


@F.arrow_udf(_CUT)
def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Each text without the lines whose key is in ``gone``: keys meet by a hash of row and
    key, and are compared by their bytes. The text is null where all lines stay."""
    out, counts = [], [np.zeros(0, np.int64)]
    at_gone = np.concatenate([[0], np.cumsum(np.array(pa.compute.fill_null(pa.compute.list_value_length(gone), 0), np.int64))])
    keys, ends = B.column(gone.flatten())
    owner = np.searchsorted(at_gone, np.arange(len(ends) - 1), side="right") - 1
    h = B.mix(B.span_hash(keys, ends[:-1], ends[1:]) ^ B.mix(owner.astype(np.uint64)))
    by = np.argsort(h, kind="stable")
    h, begin, size, owner = h[by], ends[:-1][by], np.diff(ends)[by], owner[by]
    ties = int(np.unique(h, return_counts=True)[1].max(initial=1))
    for a, b, data, offs in B.chunks(text):
        low = B.LOWER[data]
        start, end, row = B.lines(data, offs)
        s, e = B.stripped(data, start, end)
        drop = np.zeros(len(start), bool)
        if len(h):
            mine = B.mix(B.span_hash(low, s, e) ^ B.mix((row + a).astype(np.uint64)))
            k = np.searchsorted(h, mine)
            for step in range(ties):  # hashes that are equal lie side by side
                j = np.minimum(k + step, len(h) - 1)
                hit = np.flatnonzero((h[j] == mine) & (size[j] == e - s) & (owner[j] == row + a))
                drop[hit[B.same_spans(low, s[hit], keys, begin[j[hit]], size[j[hit]])]] = True
        lines, lost = np.bincount(row, minlength=b - a), np.bincount(row[drop], minlength=b - a)
        counts.append(lost)
        raw, first, texts = data.tobytes(), np.cumsum(lines) - lines, [None] * (b - a)
        for i in np.flatnonzero(lost).tolist():
            stay = first[i] + np.flatnonzero(~drop[first[i] : first[i] + lines[i]])
            texts[i] = b"\n".join(raw[x:y] for x, y in zip(start[stay].tolist(), end[stay].tolist(), strict=True)).decode()
        out += texts
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(np.concatenate(counts).astype(np.int64))], names=["text", "n_dropped"])


def dedup_lines(docs: DataFrame, *, least: int = 10, bits: int | None = None, lines_per_doc: int = 16, bits_per_line: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """Drop each repeated line except in the document with the smallest ``doc_id``.

    A line's key is the line without white space at both ends, A-Z lower-cased.
    Keys of at least ``least`` code points in two or more documents lose all
    lines outside the smallest ``doc_id`` that holds them. Other lines stay.
    ``bits``: of one filter; by default from the number of rows.

    Returns every column of ``docs`` with ``text`` shortened, and ``n_lines`` and
    ``n_dropped`` (columns of those names are replaced).

    Defined cases: a null or empty text is one empty line and stays as it is; rows
    with the same ``doc_id`` count as one document and keep their own rows; rows with
    a null ``doc_id`` count as one document that comes after all others (their work is
    split by text); an empty table gives an empty table; other columns may have any name.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")]).alias("row"))
    owner = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    part = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    if bits is None:
        bits = max(1, docs.count()) * lines_per_doc * bits_per_line
    shards = max(1, -(-bits // SHARD))
    keyed = rows.select(owner.alias("owner"), part.alias("part"), "text")
    found = "owner long, part long, h long, key string"
    with scratch(spark) as keep, small_batches(spark):
        hashes = _by_shard(keyed.select("text").mapInArrow(_hashes(shards, least), "shard long, h long, several boolean"))
        if shards * SHARD <= max(max_bits, SHARD):
            sent = spark.sparkContext.broadcast(_collected(hashes.mapInArrow(_fill(False), "shard long, bits binary"), shards))
            suspects = written(keyed.mapInArrow(_suspects(sent, shards, least), found).drop("h"), "suspects")
        else:
            again = written(hashes.mapInArrow(_fill(True), "h long").distinct(), "again")
            own = written(keyed.mapInArrow(_suspects(None, shards, least), found).drop("key").join(again, "h", "left_semi").select("owner", "part").distinct(), "own")
            holders = _Holders(own, own.count(), max_bits)
            some = keyed.filter(holders.may_hold(F.col("owner"), F.col("part")))
            suspects = written(some.mapInArrow(_suspects(None, shards, least), found).join(again, "h", "left_semi").drop("h"), "suspects")
        counted = suspects.groupBy("key").agg(F.min("owner").alias("first"), F.max("owner").alias("last"))
        # read from a table, both sides of the join are dealt anew, so Spark can split a hot key
        repeated = written(counted.filter("first < last").select("key", "first"), "repeated")
        gone = written(suspects.join(repeated, "key").filter("owner <> first").groupBy("owner", "part").agg(F.collect_set("key").alias("gone")), "gone")
        loses = _Holders(gone, gone.count(), max_bits).may_hold(owner, part)
        marked = rows.withColumn("loses", loses)
        changed = marked.filter("loses").withColumn("owner", owner).withColumn("part", part).join(gone, ["owner", "part"], "left")
        changed = keep(written(changed.select("row", _without("text", "gone").alias("new")), "changed"))
    fields = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n_lines = lambda t: (F.octet_length(F.coalesce(t, F.lit(""))) - F.octet_length(F.replace(F.coalesce(t, F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
    stay = [F.col("row")[c].alias(c) for c in fields]
    cut = [F.coalesce("new.text", "row.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in fields]
    same = marked.filter("not loses").select(*stay, n_lines(F.col("text")), F.lit(0).cast("long").alias("n_dropped"))
    return same.unionByName(changed.select(*cut, n_lines(F.col("row.text")), F.col("new.n_dropped").alias("n_dropped")))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line),
repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, (r.first IS NOT NULL AND r.first <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
