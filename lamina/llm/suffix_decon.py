"""Benchmark decontamination by suffix arrays over the training shards (operator 3).

Some megabytes of training texts are a shard. Its words become small integers, and the
text is cut wherever two neighbouring words are neighbours in no benchmark item, since no
match can go on there. Ranks of the first 1, 2, 4, ... words, over the stretches that are
left of the shard and of the items, sort the shard's suffixes and the items' suffixes
alike; each level is one sort, however repetitive a text is. Every suffix of every item
is then binary-searched in the shard's suffix array:

- the range of suffixes that begin with its window (13 words, or the whole item) gives the
  words hit and the items found. A range stays a range: places and items are joined by
  distinct windows, never place by place;
- the neighbours in the order give the longest verbatim match at each place that is hit.

The benchmark doesn't grow with the corpus, but its size is checked: it travels in blocks
of ``block_bytes``, as many in one pass over the texts as ``pass_bytes`` holds. No row of
the corpus is shuffled.
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

WINDOW = 13
SHARD = 4 << 20  # bytes of text; one longer text is a shard of its own
SLICE = 1 << 22  # pairs of window and item expanded at once
MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_start", T.IntegerType()), T.StructField("doc_start", T.IntegerType()), T.StructField("length", T.IntegerType())]))
HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])
_HIT = pa.struct([("start", pa.int32()), ("end", pa.int32())])
OWN = ("n_words", "hits", "items", "matches")


def _words(texts: pa.Array, limit: int = SHARD) -> Iterator[tuple]:
    """For each chunk: (first row, rows, lower-case bytes, start, end, row) of the words."""
    for a, b, data, offs in B.chunks(texts, limit):
        low = B.LOWER[data]
        yield a, b - a, low, *B.spans(B.ALNUM[low], offs)


def block_of(items: list[tuple[str, str]], window: int) -> dict:
    """What a search needs of some items: their vocabulary, and their words with a 0 after each item."""
    spelled: dict[bytes, int] = {}
    seq, item, place, width = [], [], [], []
    for a, n, low, start, end, row in _words(pa.array([x[1] for x in items], pa.string())):
        raw, count = low.tobytes(), np.bincount(row, minlength=n)
        at = 0
        for i in range(n):
            own = [spelled.setdefault(raw[s:e], len(spelled) + 1) for s, e in zip(start[at : at + count[i]].tolist(), end[at : at + count[i]].tolist(), strict=True)]
            at += int(count[i])
            seq += [*own, 0]
            item += [a + i] * (len(own) + 1)
            place += range(len(own) + 1)
            width += [min(len(own), window)] * (len(own) + 1)
    data = np.frombuffer(b"".join(spelled), np.uint8)
    size = np.array([len(w) for w in spelled], np.int64)
    start = np.cumsum(size) - size
    h = B.span_hash(data, start, start + size)
    by = np.argsort(h, kind="stable")
    ints = lambda x: np.array(x, np.int64)
    seq, item, place, width = ints(seq), ints(item), ints(place), ints(width)
    pairs = np.unique((seq[:-1] << 32) | seq[1:]) if len(seq) else seq
    return {
        "names": [x[0] for x in items], "hash": h[by], "id": by + 1, "data": data, "start": start[by], "size": size[by], "plain": None if len(np.unique(h)) == len(h) else spelled,
        "seq": seq, "item": item, "place": place, "width": width, "pairs": pairs[((pairs >> 32) > 0) & ((pairs & 0xFFFFFFFF) > 0)],
        "widths": sorted({int(w) for w in np.unique(width) if w}),
    }


def _ids(block: dict, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The item word that each word is, byte for byte; 0 for none."""
    out = np.zeros(len(start), np.int64)
    if not len(block["hash"]) or not len(start):
        return out
    if block["plain"] is not None:  # two item words with one hash
        raw = low.tobytes()
        return np.array([block["plain"].get(raw[s:e], 0) for s, e in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
    h = B.span_hash(low, start, end)
    k = np.minimum(np.searchsorted(block["hash"], h), len(block["hash"]) - 1)
    some = np.flatnonzero((block["hash"][k] == h) & (block["size"][k] == end - start))
    some = some[B.same_spans(low, start[some], block["data"], block["start"][k[some]], block["size"][k[some]])]
    out[some] = block["id"][k[some]]
    return out


def stretches(seq: np.ndarray, pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, left): the words of stretches of ``least`` words or more in which all
    neighbours are in ``pairs``, and how many words are left there; left is 0 after each."""
    if len(seq) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = B.contains(pairs, (seq[:-1] << 32) | seq[1:])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2] + 1
    start, size = start[size >= least], size[size >= least]
    base = np.cumsum(size + 1) - size - 1
    within = np.arange(int((size + 1).sum())) - np.repeat(base, size + 1)
    left = np.repeat(size, size + 1) - within
    return np.repeat(start, size + 1) + np.minimum(within, np.repeat(size, size + 1) - 1), left


def prefix_ranks(words: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Level k ranks every place by its first 2**k words, or by all that are left."""
    n, k = len(words), 1
    rank = np.unique(np.where(left > 0, words, 0), return_inverse=True)[1].astype(np.int64)
    levels, each, most = [rank.astype(np.int32)], np.arange(n), int(left.max(initial=0))
    while k < most:
        then = np.where(left > k, rank[np.minimum(each + k, n - 1)], 0)
        known, rank = np.unique((rank << 32) | then, return_inverse=True)
        levels.append(rank.astype(np.int32))
        k *= 2
        if len(known) > np.count_nonzero(left):  # all differ
            break
    return levels


def common_prefix(levels: list[np.ndarray], left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words the suffixes at x and y share."""
    x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        on = (levels[k][x] == levels[k][y]) & (left[x] >= 1 << k) & (left[y] >= 1 << k)
        for v in (out, x, y):
            v[on] += 1 << k
    return out


def search(block: dict, seq: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """What a shard has of a block: (hit or not by word, row and item of what was found, matches).

    ``seq`` holds the item words of the shard with a 0 after each row, ``begin`` each
    row's first place. Matches: (place, length, place in the block's words).
    """
    edge = np.zeros(len(seq) + 1, np.int64)
    rows, found, starts, lengths, froms = [], [], [], [], []
    row_of = lambda at: np.searchsorted(begin, at, side="right") - 1

    def add(key: np.ndarray, at: np.ndarray, query: np.ndarray, item: np.ndarray, width: int) -> np.ndarray:
        """Note the places ``at`` whose window ``key`` is one of the queries; which ones."""
        order = np.argsort(key, kind="stable")  # the suffix array keeps these in order already
        ranked = key[order]
        low, high = np.searchsorted(ranked, query, "left"), np.searchsorted(ranked, query, "right")
        cover = np.cumsum(np.bincount(low, minlength=len(key) + 1) - np.bincount(high, minlength=len(key) + 1))[:-1] > 0
        hit = order[cover]
        np.add.at(edge, at[hit], 1)
        np.add.at(edge, at[hit] + width, -1)
        if not len(hit):
            return hit
        # distinct (window, item) and distinct (window, row) meet in their window
        held = np.unique(np.stack([query, item], 1), axis=0)
        seen = np.unique(np.stack([key[hit], row_of(at[hit])], 1), axis=0)
        first, last = np.searchsorted(held[:, 0], seen[:, 0], "left"), np.searchsorted(held[:, 0], seen[:, 0], "right")
        total = np.cumsum(last - first)
        a = 0
        while a < len(seen):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SLICE)))
            n = (last - first)[a:b]
            k = np.repeat(first[a:b], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            both = np.unique((np.repeat(seen[a:b, 1], n) << 32) | held[k, 1])
            rows.append(both >> 32)
            found.append(both & 0xFFFFFFFF)
            a = b
        return hit

    if 1 in block["widths"]:
        one = np.flatnonzero((block["width"] == 1) & (block["seq"] > 0))
        at = np.flatnonzero(B.contains(np.unique(block["seq"][one]), seq))
        if len(at):
            add(seq[at], at, block["seq"][one], block["item"][one], 1)
            by = one[np.argsort(block["seq"][one], kind="stable")]
            starts.append(at)
            lengths.append(np.ones(len(at), np.int64))
            froms.append(by[np.searchsorted(block["seq"][by], seq[at])])
    widths = [w for w in block["widths"] if w > 1]
    if widths:
        place, left = stretches(seq, block["pairs"], widths[0])
        mine = np.unique((seq[place[:-1]] << 32) | seq[place[1:]]) if len(place) else place
        item_place, item_left = stretches(block["seq"], mine, widths[0]) if len(place) else (place, left)
        if len(item_place):
            n = len(place)
            words, both = np.concatenate([seq[place], block["seq"][item_place]]), np.concatenate([left, item_left])
            levels = prefix_ranks(words, both)
            last = levels[-1]
            shard, query = np.flatnonzero(left), n + np.flatnonzero(item_left)
            array = shard[np.argsort(last[shard], kind="stable")]  # the shard's suffix array
            begins = np.zeros(n, bool)
            for w in widths:
                k = w.bit_length() - 1
                if k >= len(levels):
                    continue
                window = lambda p: (levels[k][p].astype(np.int64) << 32) | levels[k][p + w - (1 << k)]  # noqa: B023, E731
                at = array[left[array] >= w]
                q = query[(both[query] >= w)]
                of = item_place[q - n]
                mine = block["width"][of] == w  # the rest of a short item is shorter than its window
                q, of = q[mine], of[mine]
                hit = add(window(at), place[at], window(q), block["item"][of], w)
                begins[at[hit]] = True
            p = np.flatnonzero(begins)
            if len(p):
                ordered = query[np.argsort(last[query], kind="stable")]
                k = np.searchsorted(last[ordered], last[p])
                before, after = ordered[np.maximum(k - 1, 0)], ordered[np.minimum(k, len(ordered) - 1)]
                x, y = common_prefix(levels, both, p, before), common_prefix(levels, both, p, after)
                best, length = np.where(x > y, before, after), np.maximum(x, y)
                # a match that only goes on is told by its first place
                goes_on = np.zeros(len(p), bool)
                goes_on[1:] = (p[1:] == p[:-1] + 1) & (length[1:] < length[:-1])
                starts.append(place[p[~goes_on]])
                lengths.append(length[~goes_on])
                froms.append(item_place[best[~goes_on] - n])
    join = lambda x: np.concatenate([*x, np.zeros(0, np.int64)])
    return np.cumsum(edge)[:-1] > 0, join(rows), join(found), (join(starts), join(lengths), join(froms))


def _searcher(sent: list, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = [k for k in names if k not in OWN]
        for batch in batches:
            column = dict(zip(names, batch.columns, strict=True))
            for a, n, low, start, end, row in _words(column["text"]):
                counts = np.bincount(row, minlength=n)
                begin = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
                hits, items, matches = ([[] for _ in range(n)] for _ in range(3))
                for one in sent:
                    block = one.value
                    seq = np.zeros(len(start) + n, np.int64)
                    seq[np.arange(len(start)) + row] = _ids(block, low, start, end)
                    hit, rows, found, (at, length, of) = search(block, seq, begin)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    r = np.searchsorted(begin, edge[::2], side="right") - 1
                    for i, x, y in zip(r.tolist(), (edge[::2] - begin[r]).tolist(), (edge[1::2] - begin[r]).tolist(), strict=True):
                        hits[i].append({"start": x, "end": y})
                    for i, k in zip(rows.tolist(), found.tolist(), strict=True):
                        items[i].append(block["names"][k])
                    by = np.argsort(at, kind="stable")
                    r = np.searchsorted(begin, at[by], side="right") - 1
                    for i, x, m, k, p in zip(r.tolist(), (at[by] - begin[r]).tolist(), length[by].tolist(), block["item"][of[by]].tolist(), block["place"][of[by]].tolist(), strict=True):
                        matches[i].append({"item_id": block["names"][k], "item_start": p, "doc_start": x, "length": m})
                new = {"hits": hits, "items": items, "matches": matches}
                if "hits" in names:  # an earlier pass
                    for k, more in new.items():
                        new[k] = [x + y for x, y in zip(column[k].slice(a, n).to_pylist(), more, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(column[k].slice(a, n) for k in keep), pa.array(counts.astype(np.int64)), pa.array(new["hits"], pa.list_(_HIT)), pa.array(new["items"], pa.list_(pa.string())), pa.array(new["matches"], pa.list_(_MATCH))], names=[*keep, *OWN]
                )

    return run


def _blocks(items: DataFrame, block_bytes: int, window: int) -> Iterator[dict]:
    held, size = [], 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").filter("text is not null")
    for name, text in rows.toLocalIterator():
        if held and size + len(text) > block_bytes:
            yield block_of(held, window)
            held, size = [], 0
        held.append((name, text))
        size += len(text)
    yield block_of(held, window)


def find_matches(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, columns: list[str] | None = None, block_bytes: int = 8 << 20, pass_bytes: int = 64 << 20) -> DataFrame:
    """Add ``n_words``, ``hits``, ``items`` and ``matches`` to every row.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A window
    is ``window`` consecutive words of an item, or a whole item of fewer. ``hits`` are the
    ranges of words inside an occurring window, ``items`` the items with one. ``matches``
    are the longest verbatim passages that begin where a window does: at each place the
    longest one of any item, unless it only goes on from the place before.
    ``columns`` names the columns that stay (all by default).

    Defined cases: null and empty texts have no words and no matches; every row is
    searched by itself, so repeated rows and ids stay; items without words match
    nothing, repeated item ids count as one item, a null item id reads as ''; empty
    tables on either side work; columns with the names of the added ones are replaced.
    Time follows words times the logarithm of the longest match, also where a text and
    an item repeat one word.
    """
    keep = [c for c in (columns or docs.columns) if c not in OWN]
    out = docs.select(*dict.fromkeys([*keep, "text"]))
    added = [T.StructField("n_words", T.LongType()), T.StructField("hits", HITS), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", MATCHES)]
    schema = T.StructType([*out.schema.fields, *added])
    context, held = docs.sparkSession.sparkContext, []
    for block in _blocks(items, block_bytes, window):
        held.append(context.broadcast(block))
        if len(held) * block_bytes >= pass_bytes:
            out, held = out.mapInArrow(_searcher(held, out.columns), schema), []
    if held:
        out = out.mapInArrow(_searcher(held, out.columns), schema)
    return out.select(*keep, "n_words", "hits", F.sort_array(F.array_distinct("items")).alias("items"), "matches")


def hit_words(hits: Column) -> Column:
    """Words inside any range: the length of their union."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, r: F.struct(F.greatest(s["end"], r["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(s["end"], r["start"]))).alias("n"))
    return F.aggregate(F.sort_array(hits), zero, step, lambda s: s["n"]).cast("long")


def contamination(docs: DataFrame, items: DataFrame, *, share: int = 20, **options) -> DataFrame:
    """``find_matches`` with ``n_hit`` and ``contaminated`` added.

    A row is contaminated when ``n_hit > 0`` and ``share * n_hit >= n_words``.
    """
    out = find_matches(docs, items, **options).drop("n_hit", "contaminated")
    out = out.withColumn("n_hit", F.when(F.size("hits") > 0, hit_words(F.col("hits"))).otherwise(F.lit(0).cast("long")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns."""
    if clash := {*OWN, "n_hit", "contaminated"} & set(docs.columns):
        plain = {c: f"_{i}_{c}" for i, c in enumerate(sorted(clash))}
        out = contamination(docs.withColumnsRenamed(plain), items, **options).filter("not contaminated")
        return out.select(*[F.col(plain.get(c, c)).alias(c) for c in docs.columns])
    return contamination(docs, items, **options).filter("not contaminated").select(*docs.columns)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS key FROM (
    SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS key FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM iwin) WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.i, d.n, w.item FROM dwin d JOIN iwin w ON d.n = w.n AND d.key = w.key),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id
"""
