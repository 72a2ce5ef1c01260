"""N-gram Jaccard join by parity sketches (operator 4).

Every distinct shingle flips one bit of a sketch, so bits of shingles that two sets share
cancel and the Hamming distance of two sketches never exceeds the sets' symmetric
difference. Two sketches serve every set:

- a wide one for each size band that its partners can be in, cut into parts of 2**16 bits.
  The threshold bounds the difference of two linking sets by D, so at most D of the parts
  differ. A set sends the D + 1 best of its parts, and since the order depends only on what
  a part holds, the best of the parts that two linking sets share is sent by both
  (pigeonhole). A part travels as a digest of its odd bits: the XOR of a code for each,
  which cancels just as the bits do. The best parts are those that a bounded sample does
  not find frequent, then those with the most bits; no result hangs on the sample.
- a narrow one of about two bits a shingle. Pairs that share a part are compared by the
  popcount of the XOR of their narrow sketches, and only pairs within their bound are
  tested on the sets themselves, by two independent 64-bit hashes of every shingle.

First each set meets the smallest document of most of its buckets, which joins large
groups of copies at a cost in proportion to their size. Buckets that still hold several
components are then searched whole, in tiles of bounded size whatever a bucket's size:
each set's closest partners in other components are tested, more of them each round,
until every pair within its bound is tested or joined. Equal sets are one class from the
start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytewise as B
from .shared import LAST_ID, partitions, release, scratch, small_batches, table, written

ROWS = 256  # in a chunk: a row's number and 56 bits of a hash share 64 bits of a sort key
BYTES = 1 << 20
SEEN = 100_000  # sets that a task remembers, to send each once
SPREAD = 2  # size of a band: largest over smallest
PLACES = np.uint64((1 << 16) - 1)  # bits of a part of the wide sketch, less one
MARKS = 1 << 20
NULL_IDS = 1 << 46  # numbers from the top that stand for rows without an id, by their text
TILE = 256  # sets of a bucket that meet in one tile, about


class Bands:
    """Size bands of a threshold ``num / den``; the parts of a band's wide sketch."""

    def __init__(self, num: int, den: int, most: int = 1 << 31):
        self.num, self.den = num, den
        high = [1]
        while high[-1] < most:
            high.append(high[-1] * SPREAD)
        self.high = np.array(high, np.int64)
        apart = self.apart(self.high)
        self.parts = apart + 1 + apart // 2

    def apart(self, n: np.ndarray) -> np.ndarray:
        """The difference of two linking sets is at most this if the smaller has n shingles at most."""
        return (self.den - self.num) * n // self.num

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, n)

    def lowest(self, n: np.ndarray) -> np.ndarray:
        """The band of the smallest set that can link with one of n shingles."""
        return self.of(np.maximum(1, -(-n * self.num // self.den)))

    def bits(self, n: np.ndarray) -> np.ndarray:
        """The width of the narrow sketch: a power of two from twice to four times n."""
        return np.maximum(64, 2 * self.high[self.of(np.maximum(n, 1))])


def shingles(texts: pa.Array, k: int) -> Iterator[tuple]:
    """For each chunk: (first row, rows, row, hash, other hash) of the distinct shingles, by row."""
    for a, b, data, offs in B.chunks(texts, BYTES):
        for c in range(0, b - a, ROWS):
            d = min(c + ROWS, b - a)
            low, o = B.LOWER[data[offs[c] : offs[d]]], offs[c : d + 1] - offs[c]
            start, end, row = B.spans(B.NOT_SPACE[low], o)
            words = B.span_hashes(low, start, end)
            few = np.flatnonzero(np.isin(row, np.flatnonzero(np.bincount(row, minlength=d - c) < k)))
            pair, of = [], np.zeros(0, np.int64)
            for h in words:
                values, at = B.windows(h, row, k)
                of = row[at]
                if len(few):  # fewer than k words: the whole sequence is the one shingle
                    first = np.flatnonzero(np.diff(row[few], prepend=-1))
                    place = np.arange(len(few)) - np.repeat(first, np.diff(np.append(first, len(few))))
                    whole = np.add.reduceat(B.mix(h[few] + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), first)
                    values, of = np.concatenate([values, B.mix(whole)]), np.concatenate([of, row[few][first]])
                pair.append(values)
            one, other = pair
            key = (of.astype(np.uint64) << np.uint64(56)) | (one >> np.uint64(8))
            by = np.argsort(key)
            for _ in range(2):
                key, x, y = key[by], one[by], other[by]
                close = key[1:] == key[:-1]
                same = close & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
                if (close == same).all():
                    break
                key, by = (of.astype(np.uint64) << np.uint64(56)) | (one >> np.uint64(8)), np.lexsort((other, one, of))
            new = np.ones(len(key), bool)
            new[1:] = ~same
            yield a + c, d - c, (key[new] >> np.uint64(56)).astype(np.int64), x[new], y[new]


def parts_of(rows: int, row: np.ndarray, h: np.ndarray, band: np.ndarray, use: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, bits) of all parts of each used row's wide sketch in ``band`` of that row."""
    parts = np.where(use, bands.parts[band], 0)
    base = np.concatenate([[0], np.cumsum(parts)])
    mine = use[row]
    row, h = row[mine], h[mine]
    bit = B.mix(h ^ B.mix(band[row].astype(np.uint64) + np.uint64(77)))
    part = ((bit >> np.uint64(32)) % parts[row].astype(np.uint64)).astype(np.int64) + base[row]
    odd = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(odd, part, B.mix((bit & PLACES) | np.uint64(1 << 40)))
    owner = np.repeat(np.arange(rows), parts)
    digest = B.mix(odd ^ B.mix((np.arange(base[-1]) - base[owner]).astype(np.uint64) + (band[owner].astype(np.uint64) << np.uint64(40))))
    return owner, digest, np.bincount(part, minlength=base[-1])


def signatures(rows: int, n: np.ndarray, row: np.ndarray, h: np.ndarray, use: np.ndarray, bands: Bands, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of the parts that the used rows send; of all their parts without ``marks``."""
    own, lowest = bands.of(np.maximum(n, 1)), bands.lowest(np.maximum(n, 1))
    owners, digests = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for down in range(int((own - lowest).max(initial=0)) + 1):
        band = np.maximum(own - down, 0)
        apart = np.where(use & (own - down >= lowest), bands.apart(np.minimum(n, bands.high[band])), 0)
        if not (apart > 0).any():  # without a difference only equal sets link, and they are one class
            continue
        owner, digest, bits = parts_of(rows, row, h, band, apart > 0, bands)
        if marks is not None:
            by = np.lexsort((digest, -bits, marks[(digest & np.uint64(MARKS - 1)).astype(np.int64)], owner))
            count = np.bincount(owner, minlength=rows)
            rank = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            by = by[rank <= apart[owner]]
            owner, digest = owner[by], digest[by]
        owners.append(owner)
        digests.append(digest)
    return np.concatenate(owners), np.concatenate(digests)


def narrow(rows: int, n: np.ndarray, row: np.ndarray, h: np.ndarray, bands: Bands) -> list[bytes]:
    """The narrow sketch of each row as bytes, 64 bits a word."""
    bits = bands.bits(n)
    base = np.concatenate([[0], np.cumsum(bits >> 6)])
    at = B.mix(h ^ np.uint64(0x3C6EF372FE94F82B)) & (bits[row] - 1).astype(np.uint64)
    out = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(out, base[row] + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    raw, base = out.astype("<u8").tobytes(), (base * 8).tolist()
    return [raw[x:y] for x, y in zip(base[:-1], base[1:], strict=True)]


def _lists(rows: int, owner: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sketcher(k: int, bands: Bands, marks_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = marks_var.value
        seen: set = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            for a, rows, row, one, other in shingles(batch.column(1), k):
                n = np.bincount(row, minlength=rows)
                first, some = (np.cumsum(n) - n), n > 0
                h1, h2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                if len(one):
                    h1[some] = np.bitwise_xor.reduceat(B.mix(one), first[some])
                    h2[some] = np.add.reduceat(B.mix(other ^ np.uint64(0x5851F42D4C957F2D)), first[some])
                new = some.copy()
                for i, x in enumerate(zip(n.tolist(), h1.tolist(), h2.tolist(), strict=True)):
                    if x in seen:
                        new[i] = False  # an equal set of this task stands for it
                    seen.add(x)
                owner, digest = signatures(rows, n, row, one, new, bands, marks)
                digest = digest[np.argsort(owner, kind="stable")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, rows), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(narrow(rows, n, row, one, bands), pa.binary()), _lists(rows, owner, digest)],
                    names=["owner", "n", "h1", "h2", "narrow", "sigs"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, rows, row, one, other in shingles(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows), _lists(rows, row, one), _lists(rows, row, other)], names=["owner", "one", "other"])

    return run


def frequent_parts(texts: DataFrame, k: int, bands: Bands, *, sample: int = 3000, least: int = 3) -> np.ndarray:
    """Marks, by digest, of parts that several documents of a bounded sample hold.

    Only what is sent depends on them, never a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, row, one, _ in shingles(batch.column(1), k):
                n = np.bincount(row, minlength=rows)
                yield pa.RecordBatch.from_arrays([pa.array(signatures(rows, n, row, one, n > 0, bands, None)[1].view(np.int64))], names=["sig"])

    share = min(1.0, sample / max(1, texts.count()))
    some = texts.filter(F.pmod(F.xxhash64("owner", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    marks = np.zeros(MARKS, bool)
    counted = some.mapInArrow(run, "sig long").groupBy("sig").count().filter(F.col("count") >= least)
    for (slot,) in counted.select(F.col("sig").bitwiseAND(MARKS - 1)).distinct().collect():  # MARKS rows at most
        marks[slot] = True
    return marks


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    for k in range(0, len(nodes), 1 << 16):
        some = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, *, in_one_task: int = 500_000) -> DataFrame:
    """(node, label) with the smallest node of each connected component; edges (a, b).

    Up to ``in_one_task`` edges are joined by one executor's task. With more, every node
    points to its smallest neighbour, pointers jump once, and edges move to what their
    ends point to, so the graph shrinks each round until no edge is left.
    """
    edges = written(edges.select("a", "b").distinct(), "edges")
    if edges.count() <= in_one_task:
        labels = written(edges.coalesce(1).mapInArrow(_union_find, "node long, label long"), "labels")
        release(edges)
        return labels
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    left = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "left")
    release(edges)
    while left.limit(1).count():
        least = written(left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("from"), F.least("a", "m").alias("mid")), "least")
        to = written(least.join(least.select(F.col("from").alias("mid"), F.col("mid").alias("to")), "mid").select("from", "to"), "to")
        at = lambda c: to.select(F.col("from").alias(c), F.col("to").alias(f"_{c}"))  # noqa: B023, E731
        before, labels = labels, written(labels.join(at("label"), "label", "left").select("node", F.coalesce("_label", "label").alias("label")), "labels")
        earlier, left = left, written(left.join(at("a"), "a").join(at("b"), "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "left")
        for used in (before, earlier, least, to):
            release(used)
    release(left)
    return labels


def _small(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Broadcast ids if they are few; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def _words(sketch: bytes, words: int) -> np.ndarray:
    """A narrow sketch folded to fewer words: halves cancel bit by bit."""
    out = np.frombuffer(sketch, "<u8")
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def hamming(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The distance of each two narrow sketches, at the width of the smaller."""
    size = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    out = np.zeros(len(size), np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        for k in range(0, len(at), max(1, BYTES // n)):
            some = at[k : k + max(1, BYTES // n)].tolist()
            x, y = (np.stack([_words(side[i], n >> 3) for i in some]) for side in (a, b))
            out[some] = np.bitwise_count(x ^ y).sum(1)
    return out


def _within(num: int, den: int):
    """Rows (a, b, an, bn, as, bs) -> the pairs (a, b, apart) that may link by their narrow sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = hamming(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ok = pa.array(np.flatnonzero(apart * (num + den) <= n * (den - num)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok), pa.array(apart).take(ok)], names=["a", "b", "apart"])

    return run


TILED = "sig long, low int, high int, words int, slot int, node long, label long, n long, narrow binary"
CLOSE = "sig long, a long, b long, apart long, more boolean"


def _tiles(num: int, den: int, share: int):
    """Rows sorted by tile -> each set's ``share`` closest partners of other components in its tile.

    ``more`` says that a set has further ones. All tiles of a width advance together:
    step d compares every row with the one d places on.
    """

    def search(rows: dict) -> pa.RecordBatch:
        n = len(rows["node"])
        tile = np.ones(n, bool)
        tile[1:] = (np.diff(rows["sig"]) != 0) | (np.diff(rows["low"]) != 0) | (np.diff(rows["high"]) != 0)
        number = np.cumsum(tile)
        left, right, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for words in np.unique(rows["words"]).tolist():
            at = np.flatnonzero(rows["words"] == words)
            sketch = np.stack([_words(rows["narrow"][i], words) for i in at.tolist()])
            own, label, size, slot, cross = number[at], rows["label"][at], rows["n"][at], rows["slot"][at], (rows["low"] != rows["high"])[at]
            live, d = np.arange(len(at)), 0
            while True:
                d += 1
                live = live[live + d < len(at)]
                live = live[own[live] == own[live + d]]
                if not len(live):
                    break
                i = live[(label[live] != label[live + d]) & (~cross[live] | (slot[live] != slot[live + d]))]
                for k in range(0, len(i), max(1, 8 * BYTES // (8 * words))):
                    x = i[k : k + max(1, 8 * BYTES // (8 * words))]
                    apart = np.bitwise_count(sketch[x] ^ sketch[x + d]).sum(1, dtype=np.int64)
                    ok = apart * (num + den) <= (size[x] + size[x + d]) * (den - num)
                    left.append(at[x[ok]])
                    right.append(at[x[ok] + d])
                    far.append(apart[ok])
        left, right, far = np.concatenate(left), np.concatenate(right), np.concatenate(far)
        a, b = np.minimum(rows["node"][left], rows["node"][right]), np.maximum(rows["node"][left], rows["node"][right])
        by = np.lexsort((a, far, b, number[left]))
        left, a, b, far = left[by], a[by], b[by], far[by]
        same = np.zeros(len(b), bool)
        same[1:] = (b[1:] == b[:-1]) & (number[left][1:] == number[left][:-1])
        first = np.flatnonzero(~same)
        count = np.diff(np.append(first, len(b)))
        keep = np.arange(len(b)) - np.repeat(first, count) < share
        return pa.RecordBatch.from_arrays([pa.array(rows["sig"][left][keep]), pa.array(a[keep]), pa.array(b[keep]), pa.array(far[keep]), pa.array(np.repeat(count > share, count)[keep])], names=["sig", "a", "b", "apart", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            now = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in now}
            # the last tile may go on in the next batch
            edge = np.flatnonzero((np.diff(held["sig"]) != 0) | (np.diff(held["low"]) != 0) | (np.diff(held["high"]) != 0))
            if len(edge):
                cut = int(edge[-1]) + 1
                yield search({c: v[:cut] for c, v in held.items()})
                held = {c: v[cut:] for c, v in held.items()}
        if held is not None and len(held["sig"]):
            yield search(held)

    return run


class _Join:
    def __init__(self, texts: DataFrame, sketches: DataFrame, k: int, num: int, den: int):
        self.texts, self.sketches, self.k, self.num, self.den = texts, sketches, k, num, den

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that may link by their narrow sketches: (a, b, apart)."""
        side = lambda c: self.sketches.select(F.col("node").alias(c), F.col("n").alias(f"{c}n"), F.col("narrow").alias(f"{c}s"))
        return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "an", "bn", "as", "bs").mapInArrow(_within(self.num, self.den), "a long, b long, apart long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets link, tested on the sets by both hashes."""
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("owner")).distinct(), "ids")
        with small_batches(pairs.sparkSession):
            sets = written(self.texts.join(_small(ids), "owner", "left_semi").mapInArrow(_sets(self.k), "owner long, one array<long>, other array<long>"), "sets")
        side = lambda c: sets.select(F.col("owner").alias(c), F.col("one").alias(f"{c}1"), F.col("other").alias(f"{c}2"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        total = (F.size("a1") + F.size("b1")).cast("long")
        # a shared shingle agrees in both hashes, so neither count is below the true one
        enough = lambda k: F.size(F.array_intersect(f"a{k}", f"b{k}")).cast("long") * (self.num + self.den) >= total * self.num
        out = written(both.filter((F.size("a1") > 0) & (F.size("b1") > 0) & enough(1) & enough(2)).select("a", "b"), "links")
        release(sets)
        release(ids)
        return out


def _slots(sizes: DataFrame, rows: int, key: str) -> DataFrame:
    """Keys that hold many rows, with the slots among which they are dealt: a few for each partition at most."""
    many = max(200, rows // (4 * partitions(sizes.sparkSession)))
    return written(sizes.filter(F.col("count") > many).groupBy(F.col(key).alias("_hot")).agg((F.max("count") / many + 1).cast("int").alias("_slots")), "hot")


def _dealt(rows: DataFrame, hot: DataFrame, key: str, by: str | None) -> DataFrame:
    """``rows`` with ``_slot``: by a hash of ``by`` for hot keys, or in every slot without ``by``."""
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    slots = F.coalesce("_slots", F.lit(1))
    slot = F.pmod(F.xxhash64(by), slots).cast("int") if by else F.explode(F.sequence(F.lit(0), slots - 1))
    return out.withColumn("_slot", slot).drop("_hot", "_slots")


def similarity_classes(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, sample: int = 3000, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    A row's set: the distinct shingles of k words ``[^\\x20\\x09-\\x0D]+`` of the whole
    text with A-Z lower-cased; with fewer words, the whole sequence as one. Two rows
    link when ``den * |intersection| >= num * |union|``. ``component_id`` is the
    smallest ``doc_id`` reachable by links.

    Defined cases: null texts and texts without words have an empty set, link with
    nothing and are their own component; rows that share a ``doc_id`` are one document
    with several sets; rows without a ``doc_id`` are documents after all others, one for
    each text, with a null id, and a null ``component_id`` unless they reach a document
    that has one; ids lie below 2**63 - 2**46; an empty table gives an empty table; other
    columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        found = keep(written(_classes(docs, k, num, den, sample, tile), "classes"))
    back = lambda c: F.when(F.col(c) <= LAST_ID - NULL_IDS, F.col(c))
    return found.select(back("owner").alias("doc_id"), F.col("n").alias("n_shingles"), back("label").alias("component_id"))


def owner_of(doc_id: Column, text: Column) -> Column:
    """The id of a row, or a number from the top for its text."""
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID) - F.coalesce(F.xxhash64(text), F.lit(0)).bitwiseAND(NULL_IDS - 1))


def _classes(docs: DataFrame, k: int, num: int, den: int, sample: int, tile: int) -> DataFrame:
    """(owner, n, label) of every row."""
    texts = docs.select(owner_of(F.col("doc_id"), F.col("text")).alias("owner"), "text")
    spark, bands = docs.sparkSession, Bands(num, den)
    with small_batches(spark):
        marks = spark.sparkContext.broadcast(frequent_parts(texts, k, bands, sample=sample))
        made = written(texts.mapInArrow(_sketcher(k, bands, marks), "owner long, n long, h1 long, h2 long, narrow binary, sigs array<long>"), "sketches")
    classes = written(made.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("owner").alias("node"), F.count("*").alias("count")).withColumn("class", F.xxhash64("n", "h1", "h2")), "classes")
    sets = made.select("owner", "n", "h1", "h2")
    # a large group of equal sets is dealt among slots
    copied = _slots(classes, classes.agg(F.sum("count")).first()[0] or 0, "class")
    dealt = _dealt(sets.filter("n > 0").withColumn("class", F.xxhash64("n", "h1", "h2")), copied, "class", "owner")
    named = dealt.join(_dealt(classes.drop("count"), copied, "class", None), ["n", "h1", "h2", "class", "_slot"]).select("owner", "n", "node")
    nodes = written(named.unionByName(sets.filter("n = 0").select("owner", "n", F.col("owner").alias("node"))), "nodes")
    # a document with several sets joins their classes
    several = nodes.groupBy("owner").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("owner", "a")
    same = nodes.join(several, "owner").filter("node <> a").select("a", F.col("node").alias("b")).distinct()

    sent = made.select("owner", F.explode("sigs").alias("sig"))
    sizes = written(sent.groupBy("sig").count().filter("count > 1"), "sizes")
    hot = _slots(sizes, sizes.agg(F.sum("count")).first()[0] or 0, "sig")
    members = _dealt(sent, hot, "sig", "owner").join(_dealt(sizes.select("sig"), hot, "sig", None), ["sig", "_slot"]).select("owner", "sig")
    held = written(members.join(nodes.filter("n > 0").select("owner", "node").distinct(), "owner").select("sig", "node").distinct(), "members")
    own = held.select(F.col("node").alias("owner")).distinct()
    sketches = written(made.filter("n > 0").join(own, "owner", "left_semi").select(F.col("owner").alias("node"), "n", "narrow").distinct(), "narrow")
    leads = written(held.groupBy("sig").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last").select("sig", "lead"), "leads")
    release(made)

    join = _Join(texts, sketches, k, num, den)
    # each set with the leaders that most of its buckets have
    led = _dealt(held, hot, "sig", "node").join(_dealt(leads, hot, "sig", None), ["sig", "_slot"])
    votes = led.filter("node <> lead").groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
    tested = written(join.close(votes.withColumn("_rank", best).filter("_rank <= 2")).select("a", "b").distinct(), "pairs")
    found = same.unionByName(join.links(tested))
    labels = components(found)
    state, share = leads.select("sig"), 2
    while True:
        # members of a hot bucket meet its row in every slot, so that no task holds the bucket
        known = _dealt(held, hot, "sig", "node").join(_dealt(state, hot, "sig", None), ["sig", "_slot"], "left_semi").join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
        known = written(known, "known")
        open_ = written(known.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("count")).filter("x < y").select("sig", (F.col("count") / tile + 1).cast("int").alias("slots")), "open")
        if not open_.limit(1).count():
            break
        rows = known.join(sketches, "node")
        dealt = _dealt(rows, hot, "sig", "node").join(_dealt(open_, hot, "sig", None), ["sig", "_slot"])
        slot = F.pmod(F.xxhash64("node", F.lit(5)), F.col("slots")).cast("int")
        tiled = dealt.withColumn("slot", slot).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        tiled = tiled.select("sig", F.least("slot", "with").alias("low"), F.greatest("slot", "with").alias("high"), (F.length("narrow") / 8).cast("int").alias("words"), "slot", "node", "label", "n", "narrow")
        # a tile is compared at the least width in it
        least = F.min("words").over(Window.partitionBy("sig", "low", "high"))
        tiled = tiled.repartition("sig", "low", "high").withColumn("words", least).sortWithinPartitions("sig", "low", "high", "node")
        close = written(tiled.mapInArrow(_tiles(num, den, share), CLOSE), "close")
        fresh = written(close.join(tested, ["a", "b"], "left_anti"), "fresh")
        rank = F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))
        picked = written(fresh.groupBy("a", "b").agg(F.min("apart").alias("apart")).withColumn("_rank", rank).filter(F.col("_rank") <= share).select("a", "b"), "pairs")
        # a bucket is done when all its close pairs of different components are tested
        waiting = close.filter("more").select("sig").unionByName(fresh.join(picked, ["a", "b"], "left_anti").select("sig")).distinct()
        state = written(waiting, "state")
        for used in (known, open_, close, fresh):
            release(used)
        some = picked.limit(1).count()
        if not some and not state.limit(1).count():
            break
        if some:
            tested = tested.unionByName(picked)
            found = found.unionByName(join.links(picked))
            labels = components(found)
        share *= 4
    return nodes.join(labels, "node", "left").select("owner", "n", F.coalesce("label", "node").alias("label"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with the smallest ``doc_id`` of their component.

    Of rows that share a ``doc_id`` one stays, the first by text. Rows with a null
    ``doc_id`` stay unless they link with a document that has one. Columns may have any name.
    """
    settings = {"k": 5, "num": 80, "den": 100, "sample": 3000, "tile": TILE} | options
    with scratch(docs.sparkSession) as keep:
        found = keep(written(_classes(docs, **settings), "classes"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), owner_of(F.col("doc_id"), F.col("text")).alias("owner"), F.col("text").alias("said"))
    last = LAST_ID - NULL_IDS
    gone = written(found.filter((F.col("label") <= last) & (F.col("owner") != F.col("label"))).select("owner").distinct(), "gone")
    kept = rows.join(_small(gone), "owner", "left_anti")
    twice = written(found.filter(F.col("owner") <= last).groupBy("owner").count().filter("count > 1").select("owner"), "twice")
    if not twice.limit(1).count():
        return kept.select("row.*")
    twice = _small(twice)
    first = F.row_number().over(Window.partitionBy("owner").orderBy("said"))
    one = kept.join(twice, "owner", "left_semi").withColumn("place", first).filter("place = 1")
    return kept.join(twice, "owner", "left_anti").select("row").unionByName(one.select("row")).select("row.*")


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, num=85, den=100)


# Documents are small in number where DuckDB runs this; shingle pairs are counted by an equi-join.
OP4_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM dw WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT x AS node, x AS seen FROM edge
  UNION
  SELECT r.node, e.y FROM reach r JOIN edge e ON e.x = r.seen),
comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN size s USING (doc_id) LEFT JOIN comp c ON c.node = d.doc_id
"""
