"""Personal data by weak supervision (operator 8), with built-in functions only.

Patterns propose candidate spans. Four labelers vote on each: the strict form of its kind,
a gazetteer (card issuers, dial codes, reserved networks, mail domains, first names, bank
countries, key prefixes), the words before it and the signs after it; any may abstain. The
counts of cells (kind, votes and context features), whose number is bounded by the
features and not by the corpus, go to the driver, where expectation maximisation estimates
each labeler's reliability for each kind and a logistic span classifier is trained on the
posteriors. The classifier sees more than its teachers: the characters on both sides, the
length and the mix of digits and letters. It returns as a Column over the candidates.

A span's place comes from the lengths of the pieces between matches, so Spark's own
regular expressions give positions. Patterns read every run of characters once: repeated
groups are possessive where nothing that follows could use what they give back, and an
attempt begins where a run does, or where the last match ended.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, written

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "person")
BASE_KINDS = 4
# The patterns of the contract, and those of the further kinds.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?:(?<![A-Za-z0-9_-])|\G)[A-Za-z0-9_-]{24,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "person": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra)\.?\x20\p{Lu}\p{L}{1,30}+(?:\x20\p{Lu}\p{L}{1,30}+)?",
}
# Cheap tests that fail only where the pattern has no match that could count.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9_-]{24}"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    "person": lambda t: t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra)\.?\x20\p{Lu}"),
}
# The gazetteers.
MAIL_DOMAINS = ("gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com", "icloud.com", "aol.com", "gmx.de", "gmx.net", "web.de", "t-online.de", "orange.fr", "free.fr", "laposte.net", "wanadoo.fr", "mail.ru", "proton.me", "protonmail.com")
RESERVED_NETS = r"^(?:0|10|127|255|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9])\."
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38)"
DIAL_CODES = r"^(?:1|7|2[07]|3[0123469]|4[013456789]|5[12345678]|6[0123456]|8[1246]|9[0123458])"
KEY_PREFIXES = r"^(?:sk[_-]|pk[_-]|gh[pousr]_|xox[abp]-|AKIA|AIza|eyJ)"
BANK_COUNTRIES = r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)"
FIRST_NAMES = ("Anna", "Maria", "Peter", "Paul", "John", "James", "Mary", "Robert", "Michael", "David", "Thomas", "Hans", "Klaus", "Jean", "Marie", "Pierre", "Sophie", "Carlos", "Juan", "Jose", "Carmen", "Ana", "Luis", "Laura", "Julia", "Martin", "Andreas", "Stefan", "Claire", "Emma")
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|login|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|telephone|llame|anruf)\b",
    "secret": r"(?i)(?:token|key|secret|password|passwort|apikey|bearer|auth)\b",
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b",
    "person": r"(?i)\b(?:dear|name|contact|signed|by|von|par|por)\b",
}
COUNTER_CUES = {
    "email": r"(?i)\b(?:noreply|no-reply)\b",
    "ip": r"(?i)\b(?:version|v|section|release|kapitel|chapter)\b",
    "card": r"(?i)\b(?:isbn|order|invoice|serial|article|tracking|rechnung)\b",
    "phone": r"(?i)\b(?:score|offset|utc|gmt)\b",
    "secret": r"(?i)\b(?:sha1|sha256|md5|commit|checksum|hash|uuid|digest|etag)\b",
    "iban": r"(?i)\b(?:part|model|serial|article)\b",
    "person": r"(?i)\b(?:street|school|university|hospital)\b",
}
AFTER = {  # what follows: (speaks for it, speaks against it)
    "email": (r"^[\s,;)>\"']", r"^[/:]"), "ip": (r"^(?::[0-9]|[\s,;)\"'])", r"^[.]?[0-9A-Za-z-]"), "card": (r"^[\s,;.)\"']", r"^[A-Za-z0-9/]"), "phone": (r"^[\s,;.)\"']", r"^[A-Za-z0-9%]"),
    "secret": (r"^[\"'`]", r"^[./]"), "iban": (r"^[\s,;.)\"']", r"^[-/]"), "person": (r"^[\s,;.)\"']", r"^(?:'s|-)"),
}
BEFORE_CHARS, AFTER_CHARS = 32, 16
CHUNK = 256  # matches that are summed at once


def prefix_sums(lengths: Column) -> Column:
    """Sums of all earlier lengths, in two levels, so the cost stays near the number of matches."""
    none = F.array().cast("array<int>")
    state = lambda: F.struct(F.lit(0).alias("at"), none.alias("sums"))
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums"))
    last = F.floor((F.size(lengths) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK)), state(), add))
    bases = F.aggregate(chunks, state(), lambda s, c: add(s, c["at"]), lambda s: s["sums"])
    sums = F.flatten(F.zip_with(chunks, bases, lambda c, b: F.transform(c["sums"], lambda x: x + b)))
    return F.when(F.size(lengths) == 0, none).otherwise(sums)


_MATCHES = "array<struct<said:string,before:string,after:string,step:int,gap:int>>"


def _matches(text: Column, kind: str) -> Column:
    """The leftmost matches, what stands around them, and the distance from the last one's end."""
    said = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between, n = F.split(text, PATTERNS[kind], -1), F.size(said)
    first = F.zip_with(said, F.slice(between, F.lit(1), n), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    out = F.zip_with(
        first, F.slice(between, F.lit(2), n),
        lambda x, g: F.struct(
            x["m"].alias("said"), F.substring(x["g"], -BEFORE_CHARS, BEFORE_CHARS).alias("before"), F.substring(g, 1, AFTER_CHARS).alias("after"),
            (F.length(x["g"]) + F.length(x["m"])).alias("step"), F.length(x["g"]).alias("gap"),
        ),
    )
    return F.when(GUARDS[kind](text), out.cast(_MATCHES)).otherwise(F.array().cast(_MATCHES))


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(said: Column) -> Column:
    """The check of an account number: its first four signs go last, letters count from 10."""
    plain = F.regexp_replace(said, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c == "", s).when(value(c) > 9, (s * 100 + value(c)) % 97).otherwise((s * 10 + value(c)) % 97))
    return rest == 1


def strict(kind: str, said: Column) -> Column:
    """The contract's test of a match; for other kinds the form of a sound one."""
    d = _digits(said)
    if kind == "ip":
        return F.forall(F.split(said, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(10, 15)
    if kind == "secret":
        return said.rlike("[0-9]") & said.rlike("[A-Za-z]")
    if kind == "iban":
        return mod97(said)
    if kind == "person":
        return said.rlike(r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$")
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, 0, or -1 where the labeler abstains."""
    return F.when(yes, 1).when(no, 0).otherwise(-1) if no is not None else F.when(yes, 1).otherwise(-1)


LABELERS = ("form", "lists", "context", "after")


def votes(kind: str, x: Column, fits: Column) -> dict[str, Column]:
    said, d = x["said"], _digits(x["said"])
    form = _vote(said.rlike(r"\.[A-Za-z]{2,24}$"), ~said.rlike(r"\.[A-Za-z]{2,24}$")) if kind == "email" else _vote(fits) if kind == "person" else _vote(fits, ~fits)
    lists = {
        "email": _vote(F.lower(F.substring_index(said, "@", -1)).isin(*MAIL_DOMAINS)),
        "ip": _vote(F.lit(False), said.rlike(RESERVED_NETS)),
        "card": _vote(d.rlike(CARD_ISSUERS) & F.length(d).between(14, 19), ~d.rlike(CARD_ISSUERS)),
        "phone": _vote(d.rlike(DIAL_CODES), ~d.rlike(DIAL_CODES)),
        "secret": _vote(said.rlike("^[0-9a-f]{32,}$") | said.rlike(KEY_PREFIXES), ~said.rlike("[0-9]")),
        "iban": _vote(said.rlike(BANK_COUNTRIES), ~said.rlike(BANK_COUNTRIES)),
        "person": _vote(F.arrays_overlap(F.split(said, " "), F.array(*[F.lit(n) for n in FIRST_NAMES]))),
    }[kind]
    return {"form": form, "lists": lists, "context": _vote(x["before"].rlike(CUES[kind]), x["before"].rlike(COUNTER_CUES[kind])), "after": _vote(x["after"].rlike(AFTER[kind][0]), x["after"].rlike(AFTER[kind][1]))}


# Features of the classifier beyond the votes, and how many values each has.
CONTEXT = {"size": 8, "left": 6, "right": 6, "digits": 4, "variety": 4}


def _sign(c: Column) -> Column:
    """The class of a character: none, space, letter or digit, quote, colon or equals, other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^[\p{L}0-9]"), 2).when(c.rlike("^[\"'`]"), 3).when(c.rlike("^[:=]"), 4).otherwise(5)


def features(x: Column) -> dict[str, Column]:
    said, n = x["said"], F.length(x["said"])
    quarter = lambda part: F.least(F.lit(3), (part * 4 / n).cast("int"))
    return {
        "size": F.least(F.lit(7), n / 8).cast("int"), "left": _sign(F.substring(x["before"], -1, 1)), "right": _sign(F.substring(x["after"], 1, 1)),
        "digits": quarter(F.length(_digits(said))), "variety": quarter(F.size(F.array_distinct(F.split(said, "")))),
    }


_FIELDS = ["start", "kind", "end", "base", *LABELERS, *CONTEXT]
_SPANS = "array<struct<" + ",".join(f"{f}:{'boolean' if f == 'base' else 'int'}" for f in _FIELDS) + ">>"


def _voted(kind: str):
    def cast(p: Column) -> Column:
        x, start = p["x"], p["s"]
        fits, number = strict(kind, x["said"]), KINDS.index(kind)
        known = {"start": start + x["gap"], "kind": F.lit(number), "end": start + x["step"], "base": fits & F.lit(number < BASE_KINDS)} | votes(kind, x, fits) | features(x)
        return F.struct(*[known[f].alias(f) for f in _FIELDS])

    return cast


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row, spans): the kept columns, and all candidate spans with their votes; ``base`` marks those of the contract."""
    text = F.coalesce("text", F.lit(""))
    wanted = {"card": lambda p: F.length(_digits(p["x"]["said"])).between(13, 19), "secret": lambda p: p["x"]["said"].rlike("[0-9]")}
    found = docs.select(F.struct(*keep).alias("row"), *[_matches(text, kind).alias(kind) for kind in KINDS])
    # places need all matches of a kind, so they are found before any is dropped
    placed = found.select("row", *[F.zip_with(k, prefix_sums(F.transform(k, lambda x: x["step"])), lambda x, s: F.struct(x.alias("x"), s.alias("s"))).alias(k) for k in KINDS])
    parts = []
    for kind in KINDS:
        some = F.filter(kind, wanted[kind]) if kind in wanted else F.col(kind)
        parts.append(F.transform(some, _voted(kind)).cast(_SPANS))
    return placed.select("row", F.sort_array(F.concat(*parts)).alias("spans"))


def em(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the cells, and reliabilities [kind, labeler, truth, vote 0 or 1].

    Labelers are independent given the truth; each kind has its own prior. The
    start takes every labeler for mostly right, and so do the pseudo-counts.
    """
    kinds = int(kind.max(initial=0)) + 1
    rel = np.tile(np.array([[0.8, 0.2], [0.2, 0.8]]), (kinds, vote.shape[1], 1, 1))
    prior = np.full(kinds, 0.5)
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        log = np.stack([np.log(1 - prior[kind]), np.log(prior[kind])], 1)
        for j in range(vote.shape[1]):
            cast = vote[:, j] >= 0
            log[cast] += np.log(rel[kind[cast], j, :, vote[cast, j]])
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        for k in range(kinds):
            mine = kind == k
            prior[k] = np.clip((n[mine] @ post[mine] + 1) / (n[mine].sum() + 2), 0.02, 0.98)
            for j in range(vote.shape[1]):
                for v in (0, 1):
                    cast = mine & (vote[:, j] == v)
                    rel[k, j, 1, v], rel[k, j, 0, v] = n[cast] @ post[cast] + (4 if v else 1), n[cast] @ (1 - post[cast]) + (1 if v else 4)
                rel[k, j] /= rel[k, j].sum(1, keepdims=True)
    return post, rel


# (fields, values) of each weight: a kind, a kind's vote, a context feature.
FEATURES = [(("kind",), (k,)) for k in range(len(KINDS))] + [(("kind", x), (k, v)) for k in range(len(KINDS)) for x in LABELERS for v in (0, 1)] + [((x,), (v,)) for x, n in CONTEXT.items() for v in range(n)]


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -4, 4)
    return w


def train(found: DataFrame) -> np.ndarray:
    """The classifier's weights, from the counts of cells over the whole corpus."""
    names = ["kind", *LABELERS, *CONTEXT]
    # values of a cell: 7 kinds, 3 of each vote, 8 * 6 * 6 * 4 * 4 of the context, whatever the corpus
    cells = found.select(F.explode("spans").alias("s")).select(*[f"s.{x}" for x in names]).groupBy(*names).count().collect()
    if not cells:
        return np.zeros(len(FEATURES))
    rows = np.array([tuple(r) for r in cells], np.int64)
    n, at = rows[:, -1].astype(float), {x: i for i, x in enumerate(names)}
    post, _ = em(rows[:, 0], rows[:, 1 : 1 + len(LABELERS)], n)
    x = np.stack([np.all([rows[:, at[f]] == v for f, v in zip(fields, values, strict=True)], axis=0) for fields, values in FEATURES], 1).astype(float)
    return logistic(x, post, n)


def chosen(weights: np.ndarray):
    """Of a candidate: base, or likelier than not by the classifier."""

    def test(s: Column) -> Column:
        logit = F.lit(0.0)
        for (fields, values), w in zip(FEATURES, weights.tolist(), strict=True):
            hit = F.lit(True)
            for f, v in zip(fields, values, strict=True):
                hit = hit & (s[f] == v)
            logit = logit + F.when(hit, float(w)).otherwise(0.0) if abs(w) > 1e-9 else logit
        return s["base"] | (logit > 0)

    return test


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, *, columns: list[str] | None = None) -> DataFrame:
    """Add ``spans``: array<struct<start, kind, end, base, votes..., features...>>.

    ``start`` and ``end`` are code points, ``kind`` counts in ``KINDS``; sorted by start,
    then kind. Base spans always stay; the classifier adds others. ``columns``: those
    that stay (all by default). The classifier is trained on all rows of ``docs``.

    Defined cases: null and empty texts have no spans; every row is searched by itself;
    a corpus without candidates trains nothing; an empty table gives an empty table; a
    column ``spans`` is replaced; others may have any name. Time follows the length of a
    text, also for long runs of one character and for many matches.
    """
    keep = [c for c in (columns or docs.columns) if c != "spans"]
    found = written(candidates(docs, keep), "candidates")
    return found.select(*[F.col("row")[c].alias(c) for c in keep], F.filter("spans", chosen(train(found))).alias("spans"))


def _of(kind: int, base: bool = True):
    return lambda s: (s["base"] | F.lit(not base)) & (s["kind"] == kind)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"), columns=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE_KINDS])]
    more = [F.size(F.filter("spans", _of(k, False))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS) if k >= BASE_KINDS]
    every = [*more, F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("has_pii")]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *every)
