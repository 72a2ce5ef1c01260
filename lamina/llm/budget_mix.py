"""Mixing sources to target weights by hierarchical budgeting (operator 7).

Weights go down a tree of domain, language and source. A node that can't use its share
leaves the rest to its siblings; only what a whole family can't use goes to the
siblings of its parent. A leaf takes whole epochs and then a token prefix of the next
one, in an order seeded by epoch. Prefix sums run over buckets of the order's hash, a few
bits at a time, so no leaf is ever sorted as a whole: its cut is found in one small bucket,
and the corpus is then selected by a filter without any shuffle of texts.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import scratch, table, written

LEVELS = ("domain", "lang", "source")
MAX_LEAVES = 1_000_000
PER_BUCKET = 200  # rows of a leaf that are put in order
BITS = 4  # of the order's hash that one step of the search for a cut looks at


def split_budget(budget: int, shares: list[tuple[Fraction, int]]) -> list[int]:
    """Water-filling: (weight, capacity) of siblings -> integer budgets, in order.

    What a full sibling can't use goes to the open ones by weight; siblings of weight
    0 get something only when no weighted one is open. Units lost by rounding go to
    the first siblings with room.
    """
    out = [0] * len(shares)
    for group in ([i for i, (w, _) in enumerate(shares) if w > 0], [i for i, (w, _) in enumerate(shares) if w <= 0]):
        open_ = [i for i in group if shares[i][1] > out[i]]
        while open_ and budget > 0:
            weights = {i: (shares[i][0] if shares[i][0] > 0 else Fraction(1)) for i in open_}
            total = sum(weights.values())
            full = [i for i in open_ if budget * weights[i] >= shares[i][1] * total]
            if full:
                for i in full:
                    out[i] = shares[i][1]
                budget -= sum(shares[i][1] for i in full)
                open_ = [i for i in open_ if i not in set(full)]
                continue
            for i in open_:
                out[i] = int(budget * weights[i] / total)
            left = budget - sum(out[i] for i in open_)
            for i in open_:
                more = min(left, shares[i][1] - out[i])
                out[i] += more
                left -= more
            budget = 0
    return out


def allocate(available: dict[tuple, int], weights: dict[tuple, float], budget: int, max_epochs: int) -> dict[tuple, int]:
    """Token budgets of the leaves. ``weights``: path prefix -> weight among siblings.

    Siblings without a weight share equally what the listed weights of their family leave
    of 1. If these reach 1 the others have weight 0 and only get what the listed ones can't
    use. A family without any listed weight shares equally.
    """

    def down(prefix: tuple, leaves: list[tuple], budget: int) -> dict[tuple, int]:
        if len(leaves) == 1 and leaves[0] == prefix:
            return {prefix: budget}
        depth = len(prefix) + 1
        families: dict[tuple, list[tuple]] = {}
        for leaf in leaves:
            families.setdefault(leaf[:depth], []).append(leaf)
        listed = [Fraction(str(w)) for k, w in weights.items() if len(k) == depth and k[:-1] == prefix]
        unlisted = sum(k not in weights for k in families)
        rest = max(Fraction(0), 1 - sum(listed)) / max(1, unlisted)
        shares = [(Fraction(str(weights[k])) if k in weights else rest, max_epochs * sum(available[x] for x in v)) for k, v in families.items()]
        out: dict[tuple, int] = {}
        for (k, v), b in zip(families.items(), split_budget(budget, shares), strict=True):
            out |= down(k, v, b)
        return out

    leaves = sorted(available)
    return down((), leaves, budget) if leaves else {}


def order_key(seed: int, epoch: Column, doc_id: Column, tie: Column) -> Column:
    """The seeded order of a row in an epoch, as a long."""
    return F.xxhash64(F.lit(seed), epoch, doc_id, tie)


def tie_of(doc_id: Column, text: Column) -> Column:
    """What sets rows without an id apart: a hash of their text."""
    return F.when(doc_id.isNull(), F.xxhash64(text))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def plan_of(rows: DataFrame, weights: dict[tuple, float], budget: int | None, share: float, seed: int, max_epochs: int) -> list[tuple]:
    """(level..., whole epochs, cut) of each leaf from rows (level..., doc_id, n_tokens).

    ``cut`` is the greatest order key taken from epoch ``whole``; null takes none.
    """
    spark = rows.sparkSession
    stats = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).filter("n > 0").limit(MAX_LEAVES + 1).collect()
    if len(stats) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves; join small sources before mixing")
    available = {tuple(r[x] for x in LEVELS): r["n"] for r in stats}
    total = sum(available.values()) if budget is None else budget
    given = allocate(available, weights, int(total * Fraction(str(share))) if budget is None else budget, max_epochs)
    part = {k: (b // available[k], b % available[k]) for k, b in given.items()}
    open_ = [(*k, whole, rest) for k, (whole, rest) in part.items() if rest > 0]
    strings = [T.StructField(x, T.StringType()) for x in LEVELS]
    longs = lambda *names: [T.StructField(x, T.LongType()) for x in names]
    # each step looks at BITS more bits of the order: 2**BITS sums a leaf, whatever its size
    bits, at = 0, [(*x, 0, 0) for x in open_]
    most = max((r["rows"] for r in stats), default=0)
    schema = T.StructType([*strings, *longs("whole", "rest", "prefix", "before")])
    key = order_key(seed, F.col("whole"), F.col("doc_id"), F.col("tie"))
    # of the sign and the top bits: a prefix that grows with every step
    top = lambda n: F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - n) if n else F.lit(0).cast("long")
    while at and most > PER_BUCKET and bits < 56:
        frame = F.broadcast(spark.createDataFrame(at, schema))
        keyed = rows.join(frame, list(LEVELS)).withColumn("key", key).filter(top(bits) == F.col("prefix")).withColumn("next", top(bits + BITS))
        sums = keyed.groupBy(*LEVELS, "whole", "rest", "before", "next").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"))
        upto = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("next").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = sums.withColumn("upto", upto).filter("upto <= rest and upto + n > rest").select(*LEVELS, "whole", "rest", "next", "upto", "rows").collect()  # one row a leaf
        at, bits = [tuple(r)[:-1] for r in found], bits + BITS
        most = max((r["rows"] for r in found), default=0)
    cuts: dict[tuple, int | None] = {}
    if at:
        edge = rows.join(F.broadcast(spark.createDataFrame(at, schema)), list(LEVELS)).withColumn("key", key).filter(top(bits) == F.col("prefix"))
        upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        fits = edge.withColumn("fits", upto <= F.col("rest")).groupBy(*LEVELS, "prefix").agg(F.max(F.when(F.col("fits"), F.col("key"))).alias("cut"))
        for r in fits.collect():  # one row a leaf
            # no key of the bucket fits: the prefix ends before it
            first = (r["prefix"] << (64 - bits)) - (1 << 63) if bits else -(1 << 63)
            cuts[tuple(r[x] for x in LEVELS)] = r["cut"] if r["cut"] is not None else (first - 1 if first > -(1 << 63) else None)
    return [(*k, whole, cuts.get(k)) for k, (whole, _) in part.items()]


def mix(docs: DataFrame, *, domain: Column, weights: dict[tuple, float], budget: int | None = None, share: float = 0.6, seed: int = 17, max_epochs: int = 3, tokens: Column | None = None) -> DataFrame:
    """Rows of ``docs`` with ``epoch`` and ``n_tokens``, one row for each time one is taken.

    ``budget``: tokens in all; null: ``share`` of the corpus. ``tokens``: the token count
    of a row (words by default). A leaf's tokens in its last epoch never exceed its
    budget; rows whose order keys tie are taken or left together.

    Defined cases: null languages and sources read as '' ; rows without tokens are never
    taken; rows that share a ``doc_id`` tie in the order, rows without one go by their text;
    an empty table gives an empty table; if all leaves together can't fill the budget each
    is taken ``max_epochs`` times; columns ``epoch`` and ``n_tokens`` of ``docs`` are
    replaced, others may have any name.
    """
    spark = docs.sparkSession
    names = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    levels = [F.coalesce(names[x].cast("string"), F.lit("")).alias(x) for x in LEVELS]
    keep = [c for c in docs.columns if c not in ("epoch", "n_tokens")]
    count = (word_count(F.col("text")) if tokens is None else tokens).cast("long")
    with scratch(spark):
        narrow = written(docs.select(*levels, "doc_id", tie_of(F.col("doc_id"), F.col("text")).alias("tie"), count.alias("n_tokens")).filter("n_tokens > 0"), "tokens")
        plan = plan_of(narrow, weights, budget, share, seed, max_epochs)
    fields = [*[T.StructField(x, T.StringType()) for x in LEVELS], T.StructField("whole", T.LongType()), T.StructField("cut", T.LongType())]
    frame = F.broadcast(spark.createDataFrame(plan, T.StructType(fields)))  # MAX_LEAVES rows at most
    row = docs.select(F.struct(*keep).alias("row"), *levels, (F.lit(0) if tokens is None else count).alias("given"))
    if tokens is None:  # words are counted again only for rows that are taken
        row = row.filter(F.col("row.text").rlike("[^\\x20\\x09-\\x0D]"))
    else:
        row = row.filter("given > 0")
    taken = row.join(frame, list(LEVELS))
    key = order_key(seed, F.col("whole"), F.col("row")["doc_id"], tie_of(F.col("row")["doc_id"], F.col("row")["text"]))
    times = F.col("whole") + (F.col("cut").isNotNull() & (key <= F.col("cut"))).cast("long")
    n_tokens = word_count(F.col("row")["text"]) if tokens is None else F.col("given")
    out = taken.withColumn("times", times).filter("times > 0").select("row", "times", n_tokens.alias("n"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch"), F.col("n").alias("n_tokens"))


# The mixture of the registered query and of the pipeline: source number -> domain, and weights.
# Sources without a number are in no listed domain, whose weights reach 1.
def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int")
    return F.when(number < 10, "web").when(number < 15, "reference").when(number.isNotNull(), "forum").otherwise("other")


DOMAIN_WEIGHTS = {("web",): 0.5, ("reference",): 0.3, ("forum",): 0.2}
LANG_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
WEIGHTS = DOMAIN_WEIGHTS | {(*d, lang): w for d in DOMAIN_WEIGHTS for lang, w in LANG_WEIGHTS.items()}
SHARE = 0.6


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, domain=domain_of(F.col("source")), weights=WEIGHTS, share=SHARE).select("doc_id", "lang", "source", "epoch", "n_tokens")
