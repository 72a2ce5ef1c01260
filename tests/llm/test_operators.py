import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lamina.llm import arc_convert, bytewise, chat_windows, cotrain, langid_viterbi, line_bloom, parity_join, pii_weak, quality_rules, suffix_decon
from lamina.llm import queries as registry

from . import brute

SF = "/root/testdata/sf0.01"
LONG = "eins zwei drei vier " * 9000
TEXTS = [
    (1, "One line that repeats here\n  ONE LINE that repeats here \nshort\nsomething else entirely"), (2, "one line that repeats here\nother words"), (3, None), (4, ""), (5, "\n\n \t\n"),
    (6, LONG), (7, LONG + "fünf"), (8, "ä ö ü ß 中文 字符 " * 6), (9, "One line that repeats here\r\nßtraße"), (10, "a b c d e a b c d e a b c d e f"), (11, "ok"),
    (12, "call +1 (415) 555-2671 or mail me.now@mail.example.org, 10.0.0.255 and 1.2.3.256; 4111 1111-1111 1111 4111111111111112 +44 20"),
    (13, "\U0001f600 x@y.zz 4012888888881881 " * 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n_lines", F.lit("mine")).withColumn("kept", F.lit("mine")).withColumn("spans", F.lit("mine"))


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_line_dedup(docs):
    got = rows(line_bloom.dedup_lines(docs), "n_lines", "n_dropped", "text")
    for i, (n, dropped, kept) in brute.line_dedup(TEXTS).items():
        assert got[i][:2] == (n, dropped)
        assert (got[i][2] or "") == kept


def test_line_dedup_small_filter_and_edges(spark, docs):
    got = rows(line_bloom.dedup_lines(docs, bits=line_bloom.SHARD), "n_dropped")
    assert {i: (x[1],) for i, x in brute.line_dedup(TEXTS).items()} == got
    assert line_bloom.dedup_lines(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a line to repeat"), (1, "a line to repeat"), (None, "A LINE to repeat"), (None, "a line to repeat\nx")], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_dropped"], r["text"]) for r in line_bloom.dedup_lines(twice).collect())
    assert found == [(0, 1, ""), (0, 1, "x"), (1, 0, "a line to repeat"), (1, 0, "a line to repeat")]


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_lines_without_a_filter_and_with_one_algebra(spark, docs):
    """Beyond max_bits hashes are joined; lines that a polynomial hash would take for equal stay apart."""
    s, t = thue_morse(2048), thue_morse(2048, "b", "a")
    texts = TEXTS + [(20, f"{s}\n{t}\n{s}"), (21, t), (22, s + "\nhead"), (24, "\n".join(f"line number {i} of many" for i in range(20_000))), (25, "\n".join(f"line number {i} of many" for i in range(0, 20_000, 2)))]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = {i: (n, d, kept) for i, (n, d, kept) in brute.line_dedup(texts).items()}
    for options in ({}, {"bits": 4 * line_bloom.SHARD, "max_bits": line_bloom.SHARD}):
        got = rows(line_bloom.dedup_lines(frame, **options), "n_lines", "n_dropped", "text")
        assert {i: (a, b, c or "") for i, (a, b, c) in got.items()} == want


def test_lines_of_many_rows_without_id_and_odd_columns(spark):
    texts = [(None, f"a shared line of text\nown line number {i}") for i in range(40)] + [(3, "A shared line of text")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for c in ("_owner", "owner", "part", "gone", "row", "loses", "new", "n_dropped"):
        frame = frame.withColumn(c, F.lit("mine"))
    for options in ({"bits": 4 * line_bloom.SHARD, "max_bits": line_bloom.SHARD}, {}):
        out = line_bloom.dedup_lines(frame, **options)
        assert sorted((r["doc_id"] or 0, r["n_dropped"], r["gone"]) for r in out.collect()) == [(0, 1, "mine")] * 40 + [(3, 0, "mine")]
    assert out.columns == ["doc_id", "text", "_owner", "owner", "part", "gone", "row", "loses", "new", "n_lines", "n_dropped"]
    assert sorted((r["doc_id"] or 0, r["n_dropped"], r["gone"]) for r in out.collect()) == [(0, 1, "mine")] * 40 + [(3, 0, "mine")]


def test_quality_rules(spark, docs):
    out = quality_rules.judge(docs)
    assert out.columns.count("kept") == 1
    got = rows(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.quality(t) for i, t in TEXTS}
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and {r["kept"] for r in good.collect()} <= {"mine"}
    assert quality_rules.judge(empty(spark)).count() == 0


def test_contamination(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "naïve"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([1, 3, 13, 14, 40, 60, 12])] + [(7, None), (8, "..."), (9, "W1 w2!")]
    texts = []
    for i in range(60):
        w = say(rng.choice([0, 2, 30, 200]))
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1] or ""
            part = part.split()
            a = rng.randrange(len(part) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = part[a : a + rng.randrange(5, 50)]
        texts.append((i, rng.choice([" ", ", "]).join(w).upper() if i % 2 else " ".join(w)))
    texts += [(100, None), (101, "")]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(texts, items)
    for size in (8 << 20, 100):  # one block, and several
        out = suffix_decon.contamination(frame, bench, block_bytes=size)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"])), r["contaminated"]) for r in out.collect()}
        assert got == want
    kept = suffix_decon.decontaminate(frame.withColumn("n_hit", F.lit("x")), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in want.items() if not x[4]} and kept.columns == ["doc_id", "text", "n_hit"]
    assert suffix_decon.contamination(empty(spark), bench).count() == 0
    assert suffix_decon.contamination(frame, bench.limit(0)).filter("contaminated").count() == 0


def test_longest_matches_have_places(spark):
    item = " ".join(f"t{i}" for i in range(30))
    text = "x y " + " ".join(f"t{i}" for i in range(5, 25)) + " z"
    out = suffix_decon.find_matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(4, item)], "item_id long, text string"))
    assert [tuple(m) for m in out.first()["matches"]] == [("4", 5, 2, 20)]


def test_one_word_many_times(spark):
    """Ranges of hits stay ranges: no place of the text meets every place of the item."""
    frame = spark.createDataFrame([(1, "w " * 100_000), (2, "w " * 9_999 + "v"), (3, "w w w"), (4, "a b " * 30_000), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "w " * 10_000), (2, "b a " * 6_000), (3, "b")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], max((m["length"] for m in r["matches"]), default=0)) for r in suffix_decon.contamination(frame, bench).collect()}
    assert got == {1: (100_000, 100_000, ["1"], 10_000), 2: (10_000, 9_999, ["1"], 9_999), 3: (3, 0, [], 0), 4: (60_000, 60_000, ["2", "3"], 12_000), 5: (0, 0, [], 0)}


def test_words_with_one_hash(spark, monkeypatch):
    """Equal hashes of different words change nothing: words are compared by their bytes."""
    import numpy as np

    monkeypatch.setattr(bytewise, "span_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    block = suffix_decon.block_of([("1", "red green blue"), ("2", "one")], 13)
    low = np.frombuffer(b"red green blue pink one", np.uint8)
    start, end, _ = bytewise.spans(bytewise.ALNUM[low], np.array([0, len(low)]))
    assert suffix_decon._ids(block, low, start, end).tolist() == [1, 2, 3, 0, 4]


def test_longest_match_of_random_texts():
    import numpy as np

    rng = random.Random(8)
    for _ in range(40):
        texts, items = ([" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(n)] for n in (4, 5))
        block = suffix_decon.block_of([(str(i), t) for i, t in enumerate(items)], 4)
        seq, begin = [], []
        for t in texts:
            begin.append(len(seq))
            low = np.frombuffer(t.encode(), np.uint8)
            start, end, _ = bytewise.spans(bytewise.ALNUM[low], np.array([0, len(low)]))
            seq += [*suffix_decon._ids(block, low, start, end).tolist(), 0]
        seq = np.array(seq, np.int64)
        at, length, of = suffix_decon.search(block, seq, np.array(begin))[3]
        for p, n, q in zip(at.tolist(), length.tolist(), of.tolist(), strict=True):
            assert (seq[p : p + n] == block["seq"][q : q + n]).all() and (seq[p : p + n] > 0).all()
            longest = 0
            for k in range(len(block["seq"])):
                m = 0
                while p + m < len(seq) and k + m < len(block["seq"]) and seq[p + m] == block["seq"][k + m] > 0:
                    m += 1
                longest = max(longest, m)
            assert n in (longest, 1)


def near_copies(seed, groups=12):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    out = []
    for _ in range(groups):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([3, 6, 9, 30, 80, 250]))]
        if rng.random() < 0.5:
            base[2:2] = passage
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out.append((len(out) * 3 + 1, " ".join(w)))
    return out


@pytest.mark.parametrize("seed,k,num", [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_similarity_classes(spark, seed, k, num):
    texts = near_copies(seed) + [(9001, None), (9002, ""), (9003, "A b"), (9004, "a B"), (9005, LONG), (9006, LONG + "x")]
    got = rows(parity_join.similarity_classes(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), k=k, num=num, den=100), "n_shingles", "component_id")
    assert got == brute.classes(texts, k, num, 100)


def test_similarity_classes_edges(spark):
    rows_ = [(5, "one two three four five six"), (5, "an other text of five words here"), (2, "an other text of five words here"), (None, "one two three four five six"), (None, None)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string")
    found = sorted(((r["doc_id"] or -1), r["component_id"] or 0) for r in parity_join.similarity_classes(frame).collect())
    assert found == [(-1, 0), (-1, 2), (2, 2), (5, 2), (5, 2)]
    assert parity_join.similarity_classes(empty(spark)).count() == 0
    one = parity_join.one_of_each(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "z")], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in one.collect()) == [1, 3]
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "z"), (None, "a b c d e f"), (None, "y")], "doc_id long, text string")
    for name in ("_gone", "_twice", "_rank", "owner", "id", "row", "place", "said"):
        odd = odd.withColumn(name, F.lit("mine"))
    out = parity_join.one_of_each(odd)
    assert out.columns == odd.columns and sorted((r["doc_id"] or 0, r["text"], r["row"]) for r in out.collect()) == [(0, "y", "mine"), (1, "a b c d e f", "mine"), (3, "z", "mine")]


def test_frequent_shingles_change_no_result(spark):
    texts = near_copies(7)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute.classes(texts, 4, 85, 100)
    for sample in (1, 10**6):
        assert rows(parity_join.similarity_classes(frame, k=4, num=85, sample=sample), "n_shingles", "component_id") == want


def test_components_beyond_one_task(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)] + [(1000 + i, 1001 + i) for i in range(60)]
    frame = spark.createDataFrame(edges, "a long, b long")
    one = {r["node"]: r["label"] for r in parity_join.components(frame).collect()}
    assert one == {r["node"]: r["label"] for r in parity_join.components(frame, in_one_task=0).collect()}
    assert one[1060] == 1000


def test_warc(spark):
    big = "<p>é</p>" * 40
    pages = [(3, "http://a/ b", big), (1, "http://c", big), (2, None, None), (4, "http://d", "x" * 99), (5, "http://e", "x" * 99), (6, "http://f", "WARC/1.0\r\n\r\nhttp://x 0 1 2 3\n" * 9), (None, "u", big), (7, "", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = {r["page_id"]: r for r in arc_convert.archive(frame).collect()}
    for i, _, html in pages:
        body = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {3: ("revisit", 1), None: ("revisit", 1)}
    assert arc_convert.archive(frame.limit(0)).count() == 0
    same = arc_convert.archive(spark.createDataFrame([(1, "u", big), (1, "u", big)], "page_id long, url string, html string")).collect()
    assert sorted((r["record_type"], r["refers_to"]) for r in same) == [("response", None), ("revisit", 1)]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(spark, tmp_path, version):
    pages = spark.createDataFrame([(1, "http://a/é x", "<b>hi</b>\n\n"), (2, "http://b", None)], "page_id long, url string, html string").coalesce(1)
    arc_convert.write_arc(pages, f"file://{tmp_path}/arc", version=version, date="20010203040506")
    found = arc_convert.read_arc(spark, f"file://{tmp_path}/arc").orderBy("source").collect()
    assert [(r["type"], r["source"], r["size"]) for r in found][1:] == [("response", 1, 11), ("response", 2, 0)]
    assert found[0]["type"] == "warcinfo" and f"{version} 0 lamina" in bytes(found[0]["payload"]).decode()
    assert {r["date"] for r in found} == {"2001-02-03T04:05:06Z"} and " " not in found[1]["url"]


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a " * 700), (1, 2, "assistant", "b " * 900), (1, 3, "user", "<|x|> <s></s> \\ [INST] |>"), (1, 4, "assistant", "[/INST] <<SYS>> \\\\ é\n<|>"),
    (2, 0, "user", None), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (3, None, None, ""), (None, 1, "assistant", "<|turn|>user<|says|>no<|end|>"), (4, 0, "system", "alone"),
]


def test_chat_windows(spark):
    frame = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    windows = chat_windows.format_windows(frame, budget=300, history=60)
    got = {r["conv_id"]: r for r in chat_windows.read_windows(windows).collect()}
    by = {}
    for conv, turn, role, text in TURNS:
        by.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want = (len(turns), brute.sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), brute.sha(loss))
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == want
    for w in windows.collect():
        inner = [t for pair in chat_windows._READ.findall(w["text"]) for t in pair]
        assert not any(c in t for t in inner for c in chat_windows.CONTROL)
        own = w["n_new"] - (w["window"] == 0 and w["text"].startswith("<|turn|>system"))
        assert w["n_tokens"] <= 300 or own == 1
    assert chat_windows.format_windows(frame.limit(0)).count() == 0


def test_windows_repeat_history_and_system(spark):
    turns = [(1, 0, "system", "s")] + [(1, i, "assistant" if i % 2 == 0 else "user", f"word{i} " * 20) for i in range(1, 21)]
    out = chat_windows.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget=120, history=40).orderBy("window").collect()
    assert len(out) > 3 and all(w["text"].startswith("<|turn|>system") for w in out) and all(w["n_repeated"] >= 2 for w in out[1:])
    assert sum(w["n_new"] for w in out) == 21


@pytest.mark.parametrize("text", ["", "\\", "<|>", "<<SYS>>>", "[INST][INST]", "</s></s>\\<s>", "<\\|", "|>|>"])
def test_escape_is_reversible(text):
    assert chat_windows.unescape(chat_windows.escape(text)) == text
    assert not any(c in chat_windows.escape(text) for c in chat_windows.CONTROL)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid_viterbi.op6_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() / out.count() > 0.97
    model = langid_viterbi.fit(docs.select("doc_id", "text", "lang"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "½ — …"), (5, "x" * 100_000)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = rows(langid_viterbi.identify(odd, model), "lang_pred", "score", "spans")
    assert all(got[i] == ("und", 0.0, []) for i in (1, 2, 3, 4)) and got[5][0] in model["langs"] and 0 <= got[5][1] <= 1
    none = langid_viterbi.fit(empty(spark))
    assert rows(langid_viterbi.identify(odd, none), "lang_pred")[5] == ("und",)
    assert langid_viterbi.identify(empty(spark).drop("lang"), model).count() == 0


def test_language_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid_viterbi.fit(docs.select("doc_id", "text", "lang"))
    # invented words: the two halves are whole texts of two languages
    half = {r["lang"]: r["text"] for r in docs.filter("n_chars between 800 and 1500 and lang in ('en', 'de')").orderBy("doc_id").select("lang", "text").collect()}
    mixed = half["de"] + " " + half["en"]
    spans = langid_viterbi.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()["spans"]
    right = sum(max(0, min(s["end"], len(half["de"])) - s["start"]) for s in spans if s["lang"] == "de") + sum(max(0, s["end"] - max(s["start"], len(half["de"]))) for s in spans if s["lang"] == "en")
    assert len(spans) < 12 and right / len(mixed) > 0.85


def test_personal_data(spark, docs):
    found = pii_weak.find_personal_data(docs)
    for r in found.collect():
        text = dict(TEXTS)[r["doc_id"]]
        base = [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["base"]]
        assert base == brute.base_spans(text)
    assert pii_weak.find_personal_data(empty(spark)).count() == 0


def test_personal_data_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in pii_weak.op8_pii(spark, SF).collect():
        base = brute.base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in brute.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        said = [f"{brute.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == brute.sha(",".join(said)) and set(said) <= set(r["spans"].split(","))


def test_reliabilities_by_em():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < q, truth, ~truth) for q in (0.95, 0.8, 0.6)], 1).astype(int)
    cells, n = np.unique(votes, axis=0, return_counts=True)
    _, rel = pii_weak.em(np.zeros(len(cells), int), cells, n.astype(float))
    assert [round(float(rel[0, j, 1, 1]), 1) for j in range(3)] == pytest.approx([0.95, 0.8, 0.6], abs=0.1)


def test_quality_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    held = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)) == 0
    model = cotrain.fit(docs, labels.filter(~held), labelled=1500)
    out = cotrain.score_quality(docs, model, columns=["doc_id"]).join(labels.filter(held), "doc_id")
    right = out.filter(F.col("kept") == (F.col("quality") == 1)).count() / out.count()
    assert right > 0.93
    odd = empty(spark).unionByName(spark.createDataFrame([(1, None, None, None), (2, "", "en", "s"), (2, LONG, None, "s")], "doc_id long, text string, lang string, source string"))
    assert all(0 <= r["score"] <= 1 for r in cotrain.score_quality(odd, model).collect())
    none = cotrain.fit(odd, labels.limit(0))
    assert {(r["score"], r["kept"]) for r in cotrain.score_quality(odd, none).collect()} == {(0.5, True)}
    assert cotrain.score_quality(empty(spark), model).count() == 0


def test_byte_kernels():
    import pyarrow as pa

    data, offs = bytewise.column(pa.array(["a b", None, "", "c\nd"]))
    start, end, row = bytewise.spans(bytewise.NOT_SPACE[data], offs)
    assert row.tolist() == [0, 0, 3, 3] and [bytes(data[s:e]) for s, e in zip(start, end, strict=True)] == [b"a", b"b", b"c", b"d"]
    start, end, row = bytewise.lines(data, offs)
    assert row.tolist() == [0, 1, 2, 3, 3] and [bytes(data[s:e]) for s, e in zip(start, end, strict=True)] == [b"a b", b"", b"", b"c", b"d"]
    assert len({int(h) for h in bytewise.span_hash(data, start, end)}) == 4


def test_registry():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 11)) and set(registry.oracle_sql()) <= set(registry.queries())
