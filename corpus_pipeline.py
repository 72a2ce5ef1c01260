"""The corpus pipeline: STAGES applied one after the other to ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps with the
columns of documents; the last returns the chosen rows with their epoch and tokens.
``run`` writes every stage as Parquet in the shared folder and reads it back, so a
lost executor costs one stage at most.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import budget_mix, line_bloom, parity_join, quality_rules, suffix_decon
from lamina.llm.shared import release, scratch, table, written


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def with_any_columns(stage):
    """Give further columns of ``docs`` neutral names while a stage runs, so none can clash."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        neutral = {c: f"_extra_{i}" for i, c in enumerate(docs.columns) if c not in CORE}
        out = stage(spark, docs.withColumnsRenamed(neutral), sf_dir)
        back = {v: k for k, v in neutral.items()}
        own = [c for c in out.columns if c not in CORE and c not in back]
        return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns if back.get(c) not in own])

    return run


@with_any_columns
def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go.

    Null and empty texts are rejected; repeated rows are judged alike; an empty table
    stays empty. Columns of any name stay, as in every stage.
    """
    return quality_rules.keep_good(docs)


@with_any_columns
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines stay in the first document only; n_chars follows.

    No row goes: a text may become empty, a null text stays null and its n_chars null.
    Rows without ``doc_id`` come after all others; an empty table stays empty.
    """
    out = line_bloom.dedup_lines(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


@with_any_columns
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, five words and 0.8: one document of each group stays.

    It is the one with the smallest ``doc_id``; of rows that share an id the first by text
    stays. Rows without words, or without an id and a linked document that has one, stay.
    """
    return parity_join.one_of_each(docs, k=5, num=80, den=100).select(*docs.columns)


@with_any_columns
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with enough benchmark passages go.

    Texts without words stay, repeated rows fare alike, an empty benchmark removes nothing.
    """
    return suffix_decon.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@with_any_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: one row for each time a document is taken.

    ``epoch`` and ``n_tokens`` are added, in place of columns with those names.
    """
    return budget_mix.mix(docs, domain=budget_mix.domain_of(F.col("source")), weights=budget_mix.WEIGHTS, share=budget_mix.SHARE)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
]
# The mixture's water-filling has no bounded SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns; each stage's table goes when the next is written."""
    docs = before = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            docs = keep(written(stage(spark, before, sf_dir), name))
        if i:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
