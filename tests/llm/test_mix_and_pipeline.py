import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import budget_mix as M
from lamina.llm.shared import table, written

from . import brute

SF = "/root/testdata/sf0.001"


def water(budget, weights, caps):
    """Continuous water-filling by bisection over the level."""
    if budget >= sum(caps):
        return list(caps)
    low, high = 0.0, max(c / w for c, w in zip(caps, weights, strict=True)) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(c, w * mid) for c, w in zip(caps, weights, strict=True)) < budget:
            low = mid
        else:
            high = mid
    return [min(c, w * low) for c, w in zip(caps, weights, strict=True)]


def test_budgets_go_to_siblings_before_ancestors():
    rng = random.Random(4)
    from fractions import Fraction

    for _ in range(60):
        n = rng.randrange(1, 7)
        weights, caps = [rng.randrange(1, 9) for _ in range(n)], [rng.randrange(0, 1000) for _ in range(n)]
        budget = rng.randrange(0, 3000)
        got = M.split_budget(budget, [(Fraction(w), c) for w, c in zip(weights, caps, strict=True)])
        assert sum(got) == min(budget, sum(caps)) and all(0 <= g <= c for g, c in zip(got, caps, strict=True))
        assert all(abs(g - x) <= n + 1 for g, x in zip(got, water(budget, weights, caps), strict=True))
    tree = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "1"): 1000, ("b", "x", "1"): 1000}
    got = M.allocate(tree, {("a", "x"): 0.5, ("a", "y"): 0.5}, 800, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "1"): 200, ("b", "x", "1"): 400}


def brute_mix(spark, docs, budget_share, max_epochs, seed=17):
    """[(doc_id, epoch)] with plain sorting of each leaf."""
    keyed = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(M.domain_of(F.col("source")), F.lit("")).alias("domain"), *[F.xxhash64(F.lit(seed), F.lit(e).cast("long"), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).alias(f"k{e}") for e in range(max_epochs + 1)])
    leaves = {}
    for r in keyed.collect():
        n = len(brute.split_words(r["text"]))
        if n:
            leaves.setdefault((r["domain"], r["lang"], r["source"]), []).append((r, n))
    have = {k: sum(n for _, n in v) for k, v in leaves.items()}
    given = M.allocate(have, M.WEIGHTS, int(sum(have.values()) * M.Fraction(str(budget_share))), max_epochs)
    out = []
    for leaf, b in given.items():
        whole, rest = divmod(b, have[leaf])
        out += [(r["doc_id"], e) for e in range(whole) for r, _ in leaves[leaf]]
        used, ordered = 0, sorted(leaves[leaf], key=lambda x: x[0][f"k{whole}"])
        for r, n in ordered:
            used += n
            if used > rest:
                break
            out.append((r["doc_id"], whole))
    return sorted(out)


@pytest.mark.parametrize("share,epochs,per_bucket", [(0.6, 3, 2000), (0.05, 1, 2), (0.9, 2, 1), (5.0, 2, 2000)])
def test_mix(spark, monkeypatch, share, epochs, per_bucket):
    monkeypatch.setattr(M, "PER_BUCKET", per_bucket)
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    docs = docs.unionByName(spark.createDataFrame([(90_000, None, "en", "src1"), (90_001, "a b c", None, None), (90_002, "", "de", "odd")], docs.schema))
    out = M.mix(docs.withColumn("epoch", F.lit("mine")), domain=M.domain_of(F.col("source")), weights=M.WEIGHTS, share=share, max_epochs=epochs)
    assert sorted((r["doc_id"], r["epoch"]) for r in out.select("doc_id", "epoch").collect()) == brute_mix(spark, docs, share, epochs)


def test_mix_edges(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    mix = lambda d: M.mix(d, domain=M.domain_of(F.col("source")), weights=M.WEIGHTS)
    assert mix(nothing).count() == 0
    ties = spark.createDataFrame([(1, "a b", "en", "src1")] * 3 + [(None, "a", "en", "src1")], nothing.schema)
    assert mix(ties).filter("doc_id = 1").count() in (0, 3)


def test_pipeline_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    extra = docs.withColumn("epoch", F.lit("mine")).withColumn("n_hit", F.lit(7)).withColumn("kept", F.lit(None).cast("string"))
    now = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in now.select("doc_id", "text").collect()]
        now = written(stage(spark, now, SF), name)
        assert now.columns == extra.columns
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "quality_rules":
            assert not [i for i, t in before if i in after and brute.quality(t)[5]]
        elif name == "line_dedup":
            assert after == {i: kept for i, (_, _, kept) in brute.line_dedup(before).items()}
        elif name == "ngram_jaccard":
            assert set(after) == {i for i, (_, c) in brute.classes(before, 5, 80, 100).items() if c == i}
        else:
            items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
            assert set(after) == {i for i, x in brute.contamination(before, items).items() if not x[4]}
    last = stages["source_mix"](spark, now, SF)
    assert sorted((r["doc_id"], r["epoch"]) for r in last.select("doc_id", "epoch").collect()) == brute_mix(spark, now.select("doc_id", "text", "lang", "source"), M.SHARE, 3)


def test_pipeline_with_nulls_and_an_empty_table(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "src1", 0), (1, "word " * 30, None, None, 5), (1, "word " * 30, None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (odd, odd.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, SF), name)
            assert set(frame.columns) <= set(now.columns)
