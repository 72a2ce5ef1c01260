"""Registered queries and odd inputs against independent plain versions."""

import base64
import gzip
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import arc_convert, budget_mix, chat_windows, cotrain, langid_viterbi, parity_join, pii_weak, quality_rules
from lamina.llm import shared
from lamina.llm.shared import table

from . import brute

SF = "/root/testdata/sf0.001"


def clashing(frame, *names):
    for name in names:
        frame = frame.withColumn(name, F.lit("mine"))
    return frame


# --- 1


def test_chat_query(spark):
    by = {}
    for r in table(spark, SF, "conversations").collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    by[-1] = [(0, "user", said), (1, "assistant", said)]
    for vocabulary in (chat_windows.VOCABULARY, "/no/such/file"):
        got = {r["conv_id"]: r for r in chat_windows.op1_chat_formatting(spark, SF, vocabulary).collect()}
        assert set(got) == set(by)
        for conv, turns in by.items():
            turns.sort(key=lambda t: t[0])
            loss = "".join(t for _, r, t in turns if r == "assistant")
            want = (len(turns), brute.sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), brute.sha(loss))
            assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == want


def test_windows_in_any_order(spark):
    turns = [(1, i, ("user", "assistant")[i % 2], f"word{i} " * 30) for i in range(30)] + [(2, 0, "user", "x" * 300_000), (2, 1, "assistant", "y " * 200_000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat_windows.format_windows(frame, budget=150, history=50)
    want = sorted(map(tuple, chat_windows.read_windows(windows).collect()))
    assert sorted(map(tuple, chat_windows.read_windows(windows.repartition(3).orderBy(F.desc("window"))).collect())) == want and len(want) == 2


def test_vocabulary_is_counted_as_bytes(tmp_path):
    ranks = "\n".join(f"{base64.b64encode(bytes([k])).decode()} {k}" for k in range(256))
    assert chat_windows.counter_of(ranks.encode())("abc é") == 6


# --- 2


def test_sure_documents_come_from_all_rows(spark):
    rows = [(i, ("good text of words " if i % 3 else "BAD!!! ") * (1 + i % 7), "en", f"s{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    rng = np.random.default_rng(3)
    weights = [rng.normal(size=cotrain.CONTENT).astype(np.float32) * 4, rng.normal(size=cotrain.META).astype(np.float32) * 2]
    sent = spark.sparkContext.broadcast(weights)
    found = docs.select("text", "lang", "source", F.xxhash64("doc_id").alias("key")).mapInArrow(cotrain._sure(sent, 0.8, 500, 7), "view int, label int, place long, content binary, meta binary").collect()
    import pyarrow as pa

    from lamina.llm import bytewise as B

    data, offs = B.column(pa.array([r[1] for r in rows]))
    views = cotrain.content_view(data, offs), cotrain.meta_view(data, offs, [r[2] for r in rows], [r[3] for r in rows])
    for v in (0, 1):
        p = cotrain._p(views[v] @ weights[v])
        for y, score in ((1, p), (0, 1 - p)):
            assert sum(r["view"] == v and r["label"] == y for r in found) == int((score >= 0.8).sum())


def test_quality_query_against_its_model(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels").select("doc_id", "quality")
    a = cotrain.fit(docs, labels, labelled=100, rounds=2)
    b = cotrain.fit(docs.repartition(7), labels.repartition(3), labelled=100, rounds=2)
    assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(a["weights"], b["weights"], strict=True))  # the order of rows plays no part
    out = cotrain.score_quality(clashing(docs, "row", "_text", "_lang", "score"), a)
    assert out.columns.count("score") == 1 and {r["row"] for r in out.collect()} == {"mine"}
    assert cotrain.op2_quality_classifier(spark, SF).count() == docs.count()


# --- 4


def test_long_words_of_two_letters(spark):
    s = "".join("b" if bin(i).count("1") % 2 else "a" for i in range(2048))
    t = s.translate(str.maketrans("ab", "ba"))
    texts = [(1, f"x y z {s} x y z {t}"), (2, f"x y z {s} x y z {s}"), (3, f"x y z {t} x y z {s}")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.similarity_classes(spark.createDataFrame(texts, "doc_id long, text string"), k=4, num=85).collect()}
    assert got == brute.classes(texts, 4, 85, 100) and got[1][0] == 5


def test_groups_that_share_a_passage_in_small_tiles(spark):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(90)]
    texts = []
    for g in range(40):  # most of every text is the passage; groups hardly link
        own = [f"g{g}w{i}" for i in range(14)]
        for _ in range(3):
            w = passage + own
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(w)))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = brute.classes(texts, 4, 85, 100)
    for tile in (4, 256):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.similarity_classes(frame, k=4, num=85, tile=tile).collect()} == want


def test_narrow_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    bands = parity_join.Bands(85, 100)
    for _ in range(60):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in rng.integers(1, 400, 3))
        one, other = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        sketches = [parity_join.narrow(1, np.array([len(x)]), np.zeros(len(x), np.int64), x, bands) for x in (one, other)]
        apart = len(np.setxor1d(one, other))
        assert parity_join.hamming(sketches[0], sketches[1])[0] <= apart
        assert parity_join.hamming(sketches[0], sketches[0])[0] == 0


# --- 5


def arc_bytes(records):
    head = f"1 0 test\n{arc_convert.ARC_FIELDS[1]}\n".encode()
    out = f"filedesc://a.arc 0.0.0.0 20200101000000 text/plain {len(head)}\n".encode() + head + b"\n"
    for url, block in records:
        out += f"{url} 1.2.3.4 20200102030405 text/html {len(block)}\n".encode() + block + b"\n"
    return out


def test_broken_and_plain_archives(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n" + b"payload " * 30
    whole = arc_bytes([("http://a", block), ("http://b c", block)])
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "plain.arc").write_bytes(whole)
    (folder / "short.arc").write_bytes(whole[:-50])
    (folder / "noise.arc").write_bytes(whole.replace(b"http://b c 1.2.3.4", b"no header here 1.2", 1).replace(b"20200102030405 text/html 275\nHTTP/1.1 200 OK\r\nX-Page-Id: 7", b"x\nx", 2) + arc_bytes([("http://z", block)])[120:])
    (folder / "cut.arc.gz").write_bytes(gzip.compress(whole)[:-20])
    (folder / "twice.arc.gz").write_bytes(gzip.compress(whole[:200]) + gzip.compress(whole[200:]))
    (folder / "empty.arc").write_bytes(b"")
    (folder / "junk.arc").write_bytes(bytes(range(256)) * 4)
    found = arc_convert.read_arc(spark, f"file://{folder}").collect()
    assert {r["defect"] for r in found} == {None, "short", "damaged"}
    arc_convert.convert(spark, f"file://{folder}", f"file://{tmp_path}/warc")
    out = arc_convert.read_warc(spark, f"file://{tmp_path}/warc").collect()
    assert len(out) == sum(r["type"] != "warcinfo" for r in found)
    digest = hashlib.sha256(b"payload " * 30).hexdigest()
    same = [r for r in out if r["digest"] == digest]
    assert sum(r["type"] == "response" for r in same) == 1 and len(same) >= 6
    assert list(arc_convert.warc_records(b"WARC/1.0\r\nbroken")) == []


@pytest.mark.parametrize("data", [b"", b"\n\n", b"x", b"a b c", b"filedesc://x 0 0 0 notanumber\n", b"http://a 1 20200101000000 t 99999\nshort", b"a" * 100_000])
def test_odd_arc_bytes(data):
    assert sum(len(r.block) for r in arc_convert.arc_records(data)) <= len(data)


# --- 6


def plain_viterbi(score, penalty):
    best, back = [list(score[0])], []
    for row in score[1:]:
        top = max(range(len(row)), key=lambda k: (best[-1][k], -k))
        now, come = [], []
        for k, x in enumerate(row):
            switch = best[-1][top] - penalty > best[-1][k]
            come.append(top if switch else k)
            now.append((best[-1][top] - penalty if switch else best[-1][k]) + x)
        best.append(now)
        back.append(come)
    out = [max(range(len(best[-1])), key=lambda k: (best[-1][k], -k))]
    for come in reversed(back):
        out.append(come[out[-1]])
    return out[::-1]


def test_viterbi_against_a_plain_one():
    rng = np.random.default_rng(0)
    count = rng.integers(0, 30, 25)
    score = rng.normal(size=(int(count.sum()), 4)) * 3
    got, at = langid_viterbi.viterbi(score, count, 4.0), 0
    for n in count.tolist():
        if n:
            assert got[at : at + n].tolist() == plain_viterbi(score[at : at + n].tolist(), 4.0)
        at += n


def test_scripts_by_code_point(spark):
    text = "a é Ω Я Ա ש ع अ ก ა 한 か 漢 \U00020000 \U0001f600"
    data = np.frombuffer(text.encode(), np.uint8)
    at = [len(text[:k].encode()) for k in range(len(text))]
    assert langid_viterbi.scripts_of(data)[at][::2].tolist() == [0, 0, 1, 2, 3, 4, 5, 6, 16, 20, 21, 24, 25, 25, 0]
    words = [("хорошо привет мир", "ru"), ("नमस्ते दुनिया", "hi"), ("สวัสดี ชาว โลก", "th"), ("good morning world", "en")] * 5
    model = langid_viterbi.fit(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(words)], "doc_id long, text string, lang string"))
    odd = [(1, "«привет» — мир…"), (2, "“good morning”—world’s"), (3, "सुप्रभात"), (4, "ลาก่อน"), (5, "— … « »")]
    frame = clashing(spark.createDataFrame(odd, "doc_id long, text string"), "_lang", "_score", "_spans", "row")
    out = {r["doc_id"]: r for r in langid_viterbi.identify(frame, model).collect()}
    assert [out[k]["lang_pred"] for k in range(1, 6)] == ["ru", "en", "hi", "th", "und"] and out[1]["_lang"] == "mine"
    assert [(s["start"], s["end"]) for s in out[1]["spans"]] == [(1, 14)]


# --- 7


def waterline(budget, weights, caps):
    """Continuous water-filling by bisection; weightless siblings only get what is left."""
    out = [0.0] * len(caps)
    for group in ([i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(weights) if w <= 0]):
        left = budget - sum(out)
        if left <= 0 or not group:
            continue
        w = [weights[i] or 1.0 for i in group]
        high = max(caps[i] / x for i, x in zip(group, w, strict=True)) + 1 if any(caps[i] for i in group) else 1.0
        low = 0.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(caps[i], x * mid) for i, x in zip(group, w, strict=True)) < left else (low, mid)
        for i, x in zip(group, w, strict=True):
            out[i] = min(caps[i], x * high)
    return out


def test_mix_query_tokens_by_leaf(spark):
    """Budgets of the registered query against water-filling written anew, with its own table of weights."""
    docs = [(r["doc_id"], r["lang"] or "", r["source"] or "", len(brute.split_words(r["text"]))) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    domain = lambda s: "web" if (n := int("".join(filter(str.isdigit, s[-2:])) or -1)) in range(10) else "reference" if n in range(10, 15) else "forum" if n >= 0 else "other"
    have = {}
    for _, lang, source, n in docs:
        if n:
            have.setdefault(domain(source), {}).setdefault(lang, {}).setdefault(source, []).append(n)
    total = lambda t: sum(t) if isinstance(t, list) else sum(total(x) for x in t.values())
    weights = {"web": 0.5, "reference": 0.3, "forum": 0.2}, {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
    want = {}

    def down(tree, budget, depth, path):
        if isinstance(tree, list):
            want[path] = budget
            return
        names = sorted(tree)
        w = [weights[depth].get(k, 0) if depth < 2 else 1 / len(names) for k in names]
        for k, b in zip(names, waterline(budget, w, [3 * total(tree[k]) for k in names]), strict=True):
            down(tree[k], b, depth + 1, (*path, k))

    down(have, 0.6 * total(have), 0, ())
    got = {}
    for r in budget_mix.op7_source_mix(spark, "/root/testdata/sf0.01").collect():
        key = (domain(r["source"] or ""), r["lang"] or "", r["source"] or "")
        got[key] = got.get(key, 0) + r["n_tokens"]
    for path, budget in want.items():
        longest = max(have[path[0]][path[1]][path[2]])
        assert budget + 8 >= got.get(path, 0) > budget - longest - 8


def test_unlisted_siblings_and_clashing_names(spark):
    available = {("web", "en", "s"): 10**6, ("web", "zh", "s"): 10**6, ("web", "", "s"): 10**6}
    weights = {("web",): 1.0, ("web", "en"): 0.5}
    assert budget_mix.allocate(available, weights, 1000, 1) == {("web", "", "s"): 250, ("web", "en", "s"): 500, ("web", "zh", "s"): 250}
    assert budget_mix.allocate(available, weights | {("web", "de"): 0.5}, 1000, 1) == {("web", "", "s"): 0, ("web", "en", "s"): 1000, ("web", "zh", "s"): 0}
    rows = [(None, f"text number {i} of the leaf", "en", "src1") for i in range(60)]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "domain", "_domain", "_lang", "_whole", "_cut", "row", "whole", "cut", "times", "tie")
    out = budget_mix.mix(frame, domain=budget_mix.domain_of(F.col("source")), weights=budget_mix.WEIGHTS, share=0.5, max_epochs=1)
    n = out.count()
    assert 20 <= n <= 30 and {r["domain"] for r in out.collect()} == {"mine"}  # rows without an id are taken one by one


# --- 8


def test_added_spans_by_kind(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 36, 40])))

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        digits = lambda s: "".join(str(int(c, 36)) for c in s)
        return f"DE{98 - int(digits(body + 'DE00')) % 97:02d}{body}"

    rows, want = [], {"secret": set(), "iban": set(), "person": set()}
    decoys = set()
    for i in range(600):
        kind = rng.choice(["secret", "iban", "person", "hash", "part", None, None])
        said = {"secret": lambda: f'token = "{token()}"', "iban": lambda: f"Konto {iban()}", "person": lambda: f"Dear Mr. {rng.choice(pii_weak.FIRST_NAMES)} {word().title()}", "hash": lambda: f"commit sha256 {token()}/x", "part": lambda: f"part {iban()[:2]}99{rng.randrange(10**13, 10**14)}-7"}
        middle = said[kind]() if kind else word()
        before = text(rng.randrange(3, 20))
        rows.append((i, f"{before} {middle}, {text(5)}"))
        if kind in want:
            want[kind].add(i)
        elif kind:
            decoys.add(i)
    found = pii_weak.find_personal_data(clashing(spark.createDataFrame(rows, "doc_id long, text string"), "row", "kind", "s")).collect()
    got = {k: {r["doc_id"] for r in found if any(s["kind"] == pii_weak.KINDS.index(k) for s in r["spans"])} for k in want}
    for k, ids in want.items():
        assert len(got[k] & ids) >= 0.9 * len(ids) and len(got[k] - ids) <= 0.1 * len(ids), k
    assert not [r for r in found if r["doc_id"] not in decoys and not any(r["doc_id"] in ids for ids in want.values()) and r["spans"]]


def test_planted_data_of_the_documents_is_caught(spark):
    import re

    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()}
    planted = {i for i, t in docs.items() if brute.base_spans(t) or re.search(r'token = "[0-9a-f]{32,40}"', t)}
    got = {r["doc_id"] for r in pii_weak.op8_pii(spark, "/root/testdata/sf0.01").filter("has_pii").collect()}
    assert len(got & planted) >= 0.95 * len(planted) and len(got - planted) <= 0.02 * len(docs)


@pytest.mark.parametrize("text,plain", [("1" * 200_000, False), ("a" * 200_000, False), ("1." * 100_000, True), ("+1" + "(" * 200_000, True), ("a-b_" * 50_000, False), ("1 " * 100_000, True), ("a@b.c " * 20_000, True), ("A1 " * 60_000, True)])
def test_long_runs_take_linear_time(spark, text, plain):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    found = pii_weak.find_personal_data(frame).first()
    assert time.perf_counter() - start < 40
    assert [(s["start"], s["kind"], s["end"]) for s in found["spans"] if s["base"]] == (brute.base_spans(text) if plain else [])


def test_matches_next_to_each_other(spark):
    texts = [(1, "a@b.c_d@e.f x@y.z@q.w"), (2, "1.2.3.4.5.6.7.8 1.2.3.4_5.6.7.8"), (3, "\U0001f600a@b.cd\U0001f600+49 (0)30 123456-78+1 415 555 2671"), (4, "a@b.c " * 700)]
    for r in pii_weak.find_personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["base"]] == brute.base_spans(dict(texts)[r["doc_id"]])


# --- 10


def test_rules_by_language_and_names(spark):
    said = " ".join(f"слово{i} другое{i} третье{i}" for i in range(30))
    rows = [(1, said, "ru"), (2, said, "en"), (3, said, None), (4, "the word of a text " + said, "en")]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "_words", "_keys", "_ordered", "row", "has_stop_list")
    out = {r["doc_id"]: r for r in quality_rules.judge(frame).collect()}
    assert [out[k]["kept"] for k in (1, 2, 3, 4)] == [True, False, True, True] and out[1]["_words"] == "mine"
    assert quality_rules.keep_good(frame).columns == frame.columns
    assert quality_rules.judge(frame.drop("lang")).filter("kept").count() == 4


# --- the shared folder


def test_scratch_tables_go(spark):
    import os

    with shared.scratch(spark) as keep:
        a, b = shared.written(spark.range(3), "a"), keep(shared.written(spark.range(4), "b"))
    local = lambda df: df._lamina_path.removeprefix("file://").removeprefix("file:")
    assert not os.path.exists(local(a)) and b.count() == 4
    shared.release(b)
    assert not os.path.exists(local(b))
