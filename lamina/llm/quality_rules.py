"""Quality rules compiled into one projection (operator 10).

``RULES`` is a table: each row fails a document when ``scale * part`` is above or
below ``bound * whole``. ``compiled`` turns the table into Column expressions, so
the whole verdict is one projection of built-in functions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS, ascii_lower, table

WINDOW = 5


class Rule(NamedTuple):
    name: str
    part: str
    relation: str  # "above" or "below"
    bound: int
    whole: str | None  # None: a plain count
    scale: int = 1
    from_words: int = 0  # texts with fewer words are not judged
    needs: str | None = None  # a flag without which the rule says nothing


# The base rules of the contract.
BASE = (
    Rule("too_few_words", "n_words", "below", 10, None),
    Rule("repeated_words", "n_repeat_words", "above", 20, "n_words", 100),
)
# The thresholds of the method, wide enough for prose of any topic.
RULES = (
    Rule("short_words", "word_chars", "below", 2, "n_words"),
    Rule("long_words", "word_chars", "above", 20, "n_words"),
    Rule("symbols", "n_symbols", "above", 30, "n_words", 100),
    Rule("repeated_lines", "n_dup_lines", "above", 50, "n_text_lines", 100),
    Rule("no_stop_words", "n_stop_words", "below", 1, "n_words", 100, 50, "has_stop_list"),
)
# Common function words of these languages.
STOP_LANGUAGES = ("de", "en", "es", "fr")
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it its of on or that the this to was were which will with "
    "aber als am auch auf aus bei das dem den der des die ein eine einen einer er es für ich im ist mit nach nicht sich sie sind und von war wie zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il je la le les leur ne nous on ou par pas pour que qui sa se ses son sur un une vous "
    "al como con del el ella en entre es esta este la las lo los más me no para pero por que se sin sobre su sus un una y"
).split()


def _count(part: Column) -> Column:
    return part.cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The counts that need only the text."""
    solid = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    return {
        "word_chars": _count(F.length(solid)),
        "n_symbols": _count(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))),
        "n_text_lines": _count(F.size(lines)),
        "n_dup_lines": _count(F.size(lines) - F.size(F.array_distinct(lines))),
    }


def repeat_words(words: Column, keys: Column) -> Column:
    """Words inside a window that occurs twice or more; ``keys``: the windows' hashes."""
    ordered = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, j: F.coalesce(F.get(F.col("_ordered"), j)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("_ordered", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")), lambda s: s["n"])
    return ordered, covered


def fails(rule: Rule) -> Column:
    part = F.col(rule.part) * rule.scale
    bound = F.lit(rule.bound).cast("long") * (F.col(rule.whole) if rule.whole else F.lit(1))
    out = part > bound if rule.relation == "above" else part < bound
    out = out & (F.col("n_words") >= rule.from_words) if rule.from_words else out
    return out & F.col(rule.needs) if rule.needs else out


def compiled(rules: tuple[Rule, ...]) -> Column:
    """True for a row that fails one rule of the table or more."""
    out = F.lit(False)
    for rule in rules:
        out = out | fails(rule)
    return out


OWN = ["n_words", "word_chars", "n_symbols", "n_text_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"]


def judge(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, stop_words=STOP_WORDS, stop_languages=STOP_LANGUAGES) -> DataFrame:
    """Add the counts and ``base_failed`` and ``kept`` to every row.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]``. ``kept`` is false
    if ``base_failed``, or if a rule of the table fails. Stop words are asked for only
    where ``lang`` is one of ``stop_languages``.

    Defined cases: a null or empty text has no words, so it fails; every row is
    judged by itself, so repeated rows and null or repeated ids change nothing; without a
    column ``lang``, or where it is null, no stop words are asked for; an empty table gives
    an empty table; columns of ``docs`` with the names of the added ones are replaced,
    others may have any name.
    """
    kept = [c for c in docs.columns if c not in OWN]
    has_list = F.coalesce(F.col("lang").isin(*stop_languages), F.lit(False)) if "lang" in docs.columns else F.lit(False)
    # the user's columns travel as one, so no name of theirs can clash
    out = docs.select(F.struct(*kept).alias("row") if kept else F.struct(F.lit(0)).alias("row"), F.coalesce("text", F.lit("")).alias("text"), has_list.alias("has_stop_list"))
    text = F.col("text")
    out = out.withColumn("_words", F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    w = F.col("_words")
    key = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    some = F.size(w) >= WINDOW
    out = out.withColumn("_keys", F.when(some, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0))), key)))
    ordered, covered = repeat_words(w, F.col("_keys"))
    out = out.withColumn("_ordered", F.when(some & (F.size(F.array_distinct("_keys")) < F.size("_keys")), ordered))
    counts = measures(text) | {
        "n_words": _count(F.size(w)),
        "n_repeat_words": _count(F.when(F.col("_ordered").isNull(), 0).otherwise(covered)),
        "n_stop_words": _count(F.size(F.filter(w, lambda x: ascii_lower(x).isin(*stop_words)))),
    }
    out = out.select("row", "has_stop_list", *[c.alias(k) for k, c in counts.items()])
    out = out.withColumn("base_failed", compiled(base))
    return out.withColumn("kept", ~F.col("base_failed") & ~compiled(rules)).select(*[F.col("row")[c].alias(c) for c in kept], *OWN)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns, whatever their names."""
    judged = judge(docs.select(F.struct(*docs.columns).alias("_row"), "text", *(["lang"] if "lang" in docs.columns else [])), **options)
    # a filter right above the projection would be pushed into it, where its expressions multiply
    once = judged.select(F.inline(F.array(F.struct("_row", "kept"))))
    return once.filter("kept").select("_row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_LANGUAGES = ", ".join(f"'{x}'" for x in STOP_LANGUAGES)
OP10_SQL = rf"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang IN ({_LANGUAGES}), false) AS has_stop_list FROM documents),
word AS (
  SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
    SELECT doc_id, unnest(parts) AS word, generate_subscripts(parts, 1) AS i
    FROM (SELECT doc_id, string_split_regex(text, '[\x20\x09-\x0D]+') AS parts FROM doc))
  WHERE word <> ''),
win AS (
  SELECT *, CASE WHEN lead(word, 4) OVER w IS NULL THEN NULL ELSE
    [word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w] END AS key
  FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
flagged AS (
  SELECT *, CASE WHEN key IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, key) > 1 THEN 1 ELSE 0 END AS again FROM win),
covered AS (
  SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM flagged),
by_word AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(hit) AS n_repeat_words,
         count(*) FILTER (WHERE translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOPS})) AS n_stop_words
  FROM covered GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc),
by_line AS (
  SELECT doc_id, count(*) AS n_text_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM line WHERE trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) <> '' GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, has_stop_list, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_text_lines, 0)::BIGINT AS n_text_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stop_words, 0)::BIGINT AS n_stop_words
  FROM doc d LEFT JOIN by_word USING (doc_id) LEFT JOIN by_line USING (doc_id)),
based AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_symbols > 30 * n_words
         OR 100 * n_dup_lines > 50 * n_text_lines OR (has_stop_list AND n_words >= 50 AND 100 * n_stop_words < n_words)) AS kept
FROM based
"""
