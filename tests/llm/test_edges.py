"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and forced roads."""

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from flowloom.llm import (
    chat, decontaminate, graph, jaccard_join, language, mixing, pii, quality, repeats, seed_extend, suffix, token_count,
)

CLASH = {c: 7 for c in "row size rank slice n h ph of hits runs node token item_id shard window left right spans terms start".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)


def made():
    rng = random.Random(5)
    vocab = ["w" + str(i) for i in range(300)] + ["été", "straße", "的", "The", "of"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = prose(300), prose(60)
    out = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", "a"), (5, "a b c d", "en", "b"), (6, "a b c d", "en", "b")]
    out += [(10, base, "en", "a"), (11, base, "fr", "b"), (11, base, "fr", "b"), (None, base, "en", None), (None, prose(50), None, "a")]
    for i in range(12):
        ws = base.split()
        for _ in range(rng.randint(1, 12)):
            ws[rng.randrange(len(ws))] = "x" + str(rng.random())
        out.append((20 + i, "\n".join(ws) if i % 2 else " ".join(ws), "en", rng.choice("abc")))
    out += [(40 + i, prose(rng.randint(5, 60)) + " " + passage + " " + prose(20), "de", "c") for i in range(10)]
    out += [(60, prose(20000), "en", "d"), (61, "y" * 30000, "en", "d"), (62, "ab " * 400, "en", "d"), (63, prose(40), "en", "d"), (63, prose(44), "en", "d")]
    return [(*r, len(r[1] or ""), *CLASH.values()) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def pairs():
    return [(brute.LAST if r[0] is None else r[0], r[1]) for r in made()]


def named(got, *ids):
    """Rows with null ids as the largest."""
    return sorted(tuple(brute.LAST if k in ids and v is None else v for k, v in r.asDict().items()) for r in got.collect())


def test_quality(docs, empty):
    out = quality.quality(docs)
    assert out.count() == len(made())
    want = brute.kept([(r[0] or 0, r[1], r[2]) for r in made()], set(quality.COMMON), 0.25, 0.3, 200, 100)
    got = out.select(F.coalesce("row.doc_id", F.lit(0)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert rows(got) == sorted(want)
    assert quality.quality(empty).count() == 0 and quality.quality_filter(docs).columns == docs.columns
    assert quality.quality(docs.withColumn("lang", F.lit(None).cast("string"))).where("class_distance is not null").count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["<|im_start|>", "<|im_end|>", "</s>", "[INST]", "<", "|", "\\", "\n", "\\\\", "é", "a ", "<<SYS>>", "<|im_", "end|>", "\x00", "s>"]
    turns = []
    for conv in [None, *range(40)]:
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "to\nol", None, "<|im_end|>"]) if conv and conv % 2 else ("user", "assistant")[t % 2]
            turns.append((conv, t, role, None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    by = {}
    for conv, _, role, text in turns:
        by.setdefault(conv, []).append((role, text))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    assert {k: tuple(r)[:5] for k, r in got.items()} == {k: brute.op2_row(k, v) for k, v in by.items()}
    for r in got.values():
        roles = [x[0] for x in by[r.conv_id]]
        body = roles[1:] if roles[0] == "system" else roles
        assert r.valid == (len(body) > 0 and len(body) % 2 == 0 and body == ["user", "assistant"] * (len(body) // 2))
    for s in chat.format_chat(df).where("part in (1, 3)").collect():
        assert not re.search(r"<\|im_(start|end)\|>|</?s>|\[/?INST\]|<</?SYS>>", s.text)
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0
    assert chat.read_back(chat.format_chat(df.union(df))).agg(F.sum("n_turns")).first()[0] == 2 * len(turns)


def test_substring(docs, empty, pairs, monkeypatch):
    def digest(s):
        import hashlib

        return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()

    want8, want3 = sorted(brute.keep_first(pairs)), sorted(brute.remove_repeats(pairs))
    op8 = lambda: seed_extend._kept(docs, 13, 5, "doc_id", "text", "n_words long, n_removed long, kept_sha256 string", digest)
    op3 = lambda: suffix._remaining(docs, 200, 80, "doc_id", "text", suffix.COLUMNS + ", kept_sha256 string", digest)
    assert named(op8(), "doc_id") == want8 and named(op3(), "doc_id") == want3
    assert seed_extend.keep_first(empty).count() == 0 and suffix.remove_repeats(empty).count() == 0
    # windows of crowded anchors by an aggregate, and every table by a shuffle
    monkeypatch.setattr(seed_extend, "MOST_PIECES", 1)
    monkeypatch.setattr(suffix, "MOST_PIECES", 2)
    monkeypatch.setattr(repeats, "MOST_ENTRIES", 0)
    monkeypatch.setattr(repeats, "MOST_ANCHORS", 0)
    assert named(op8(), "doc_id") == want8 and named(op3(), "doc_id") == want3


def test_bwt_core():
    rng = random.Random(1)
    for _ in range(150):
        length, letters = rng.choice([8, 9, 12, 20, 40]), rng.choice([b"a", b"ab", b"abcdefgh \n"])
        some = lambda n: bytes(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        base, pieces = some(rng.randint(0, 120)), []
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, len(base))
            pieces.append(some(rng.randint(0, 30)) + base[a:rng.randint(a, len(base))] + some(rng.randint(0, 30)))
        count = brute.Counter(p[i:i + length] for p in pieces for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if count[p[i:i + length]] > 1] for p in pieces]
        assert [x.tolist() for x in suffix.repeated_starts(pieces, length)] == want


def shares(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by repeated sharing: sizes in source order."""
    want, full, targets = share * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        rest = want - sum(cap * sizes[i] for i in full)
        total = sum(weights[i % 3] for i in range(len(sizes)) if i not in full)
        for i in range(len(sizes)):
            targets[i] = cap * sizes[i] if i in full else rest * weights[i % 3] / total
        over = {i for i in range(len(sizes)) if targets[i] > cap * sizes[i]} - full
        if not over:
            return targets
        full |= over


def test_targets(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 12, 40):
        sizes = [rng.choice([0, 1, 10, 100, 1000]) + rng.randint(0, 50) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = [r.target for r in mixing.source_targets(df).orderBy("source").collect()]
        assert got == pytest.approx(shares(sizes)) and sum(got) == pytest.approx(1.5 * sum(sizes))


def test_mix(spark, docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(made()) and mixing.mix(empty).count() == 0
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert all(r.taken <= 2 * r.size for r in out)
    assert mixing.mixed_documents(docs).columns == [*docs.columns, "copies"]
    assert mixing.mix(docs.where("doc_id < 4")).agg(F.sum("taken")).first()[0] == 0
    # a large even source, and the cap
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") < 3900, "b").when(F.col("id") < 3950, "a").alias("source"))
    totals = {r.source: r for r in mixing.mix(many).join(many, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.first("source_size").alias("s")).collect()}
    assert totals["a"].want == 2 * totals["a"].s and totals[None].want == 2 * totals[None].s
    assert sum(r.want for r in totals.values()) == pytest.approx(18000) and all(abs(r.t - r.want) <= 3 for r in totals.values())


def test_decontaminate(spark, docs, empty, pairs, monkeypatch):
    passage = " ".join(made()[28][1].split()[-50:-20])
    items = [(1, passage), (2, None), (3, ""), (4, "ONE"), (5, passage), (10, "w1 W2, w3"), (None, "a b c d")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    listed = [(i, t) for i, t in items if i is not None]

    def check():
        got = decontaminate.hit_counts(decontaminate.contamination(docs, bench))
        got = [(r[0], *r[1:]) for r in named(got.withColumn("items", F.array_join("items", ",")), "doc_id")]
        want = brute.contamination(pairs, items)
        only = brute.contamination(pairs, listed)
        assert [r[:3] for r in got] == sorted(r[:3] for r in want)
        assert sorted(brute.sha(r[3]) for r in got) == sorted(r[4] for r in only)

    check()
    monkeypatch.setattr(decontaminate, "BENCHMARK_BLOCK", 100)
    monkeypatch.setattr(decontaminate, "MOST_TERMS", 1)
    check()
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.hit_counts(decontaminate.contamination(docs, bench.limit(0))).where("n_hit > 0").count() == 0
    assert decontaminate.clean_documents(docs, bench).columns == docs.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma"), (2, "alpha beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta x y z gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    hits = {r.doc_id: [h.exact for h in r.hits] for r in decontaminate.contamination(docs, items, slop=1).collect()}
    assert hits == {1: [False], 2: [True], 3: [], 4: []}


def test_language(spark, docs, empty):
    model = language.fit(docs)
    out = language.identify(docs.select("doc_id", "text"), model)
    assert out.count() == len(made()) and language.identify(empty.select("doc_id", "text"), model).count() == 0
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[4].lang_pred in ("en", "fr", "de")
    nobody = language.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in language.identify(docs.select("text"), nobody).collect()} == {"und"}
    names = [f"l{i:03d}" for i in range(100)]  # more languages than bits of a word
    texts = [f"q{i:03d}".translate(str.maketrans("0123456789", "abcdefghij")) * 3 for i in range(100)]
    grams = [language.letter_grams([t], (3, 4))[0] for t in texts]
    big = language.LanguageFilter.build(names, np.repeat(np.arange(100), [len(g) for g in grams]), np.concatenate(grams), (3, 4))
    assert big.predict(texts)[0] == names


@pytest.mark.parametrize("light", [None, 0, 40, 10_000])
def test_jaccard(docs, pairs, monkeypatch, light):
    short = [(d, t) for d, t in pairs if len(t or "") < 2000]
    rng = random.Random(9)
    monkeypatch.setattr(jaccard_join, "IN_ALL", 6)
    monkeypatch.setattr(jaccard_join, "IN_BATCH", 2)
    for i in range(60):  # small sets near the threshold
        ws = [f"s{i % 6}w{j}" for j in range(rng.randint(8, 30))]
        for _ in range(rng.randint(0, 2)):
            ws[rng.randrange(len(ws))] = f"z{rng.randint(0, 3)}"
        short.append((1000 + i, " ".join(ws)))
    df = docs.sparkSession.createDataFrame(short, "doc_id long, text string").repartition(2)
    got = jaccard_join.jaccard_groups(df, light=light)
    assert named(got, "doc_id", "component_id") == sorted(brute.jaccard_components(short))


def test_jaccard_edges(docs, empty):
    assert jaccard_join.jaccard_groups(empty).count() == 0
    kept = jaccard_join.first_of_groups(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 10 in ids and 11 not in ids and 6 not in ids and {1, 2, 3, 4, 5} <= set(ids) and ids.count(63) == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_count(spark, docs, empty, tmp_path):
    files = token_count.write_tokens(docs, block=64).cache()
    counted = token_count.count_tokens(files)
    names = files.select("file", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    got = counted.join(names, ["file", "block", "place"]).select("doc_id", "n_tokens")
    assert rows(got.select(F.coalesce("doc_id", F.lit(-1)), "n_tokens")) == sorted((-1 if r[0] is None else r[0], len(brute.words(r[1]))) for r in made())
    assert token_count.count_tokens(token_count.write_tokens(empty)).count() == 0
    ids = [5, 5, 0, 0, 7] + [9] * 40 + [0, 3, 3]
    np.array(ids, "<u2").tofile(tmp_path / "a.bin")
    np.array([0] * 3, "<u2").tofile(tmp_path / "b.bin")
    out = token_count.count_tokens(token_count.read_tokens(spark, str(tmp_path), block=8), dtype="<u2")
    a = sorted((r.document, r.n_tokens, r.ended) for r in out.collect() if r.file.endswith("a.bin"))
    assert a == [(0, 2, True), (1, 0, True), (2, 41, True), (3, 2, False)]
    assert out.where("file like '%b.bin' and n_tokens = 0 and ended").count() == 3


NASTY = [
    "a@b.c_d@e.f", "x@y", "x@y.", "..@..a.b", "mail me: joe.doe+x@ex-ample.co.uk, or not@", "é@ü.de a@b.c.d.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256",
    "001.002.003.0255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111  1111 1111 1111", "0" * 16, "0" * 20, "79927398713", "+1 (555) 123-4567",
    "+1", "+12345678", "+1234567", "++49 30 1234567 x", "+49 30 1234567-", "+1 2+3 45678901", "\x01+49 30 1234567\x01 \x02 a@b.c", "a" * 5000, "1" * 5000, "1 " * 3000,
    "1." * 3000, "a@" * 3000, "日本 a@b.jp 日本 10.0.0.1 日本", "", None, "4111 1111 1111 1111 +49 30 1234567 a@b.c 10.0.0.1",
]


def test_personal_data_base(spark, docs, empty):
    df = spark.createDataFrame(list(enumerate(NASTY)), "doc_id long, text string")
    out = pii.personal_data(df).collect()
    for r in out:
        got = [(k, s.start, s.end) for k in pii.KINDS for s in r[k]]
        assert got == brute.base_spans(NASTY[r.doc_id]), NASTY[r.doc_id]
    assert pii.personal_data(docs).count() == len(made()) and pii.personal_data(empty).count() == 0
    assert pii.sanitised(docs).columns == docs.columns and pii.sanitised(docs).schema == docs.schema
    clean = {r.doc_id: r for r in pii.sanitised(df.withColumn("n_chars", F.length("text"))).collect()}
    assert clean[10].text == "[CARD]" and clean[10].n_chars == 6 and clean[30].text == "" and clean[31].text is None
    assert clean[29].text == "日本 [EMAIL] 日本 [IP] 日本"


def test_disclosing_terms(spark):
    filler = ["wrote", "report", "meeting", "with", "from", "about", "plan"]
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(filler) for _ in range(30)), None) for i in range(200)]
    docs += [(500 + i, f"{' '.join(rng.choice(filler) for _ in range(8))} Zebulon wrote to zeb@corp.example {' '.join(rng.choice(filler) for _ in range(8))}. ZEBULON!", None) for i in range(5)]
    docs += [(600, "Zebulon alone", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, terms string")
    terms = {(r.entity, r.term) for r in pii.disclosing_terms(df, threshold=0.8).collect()}
    assert terms == {("email:zeb@corp.example", "zebulon")}
    clean = {r.doc_id: r.text for r in pii.sanitised(df, threshold=0.8).collect()}
    assert clean[500].count("[TERM]") == 2 and clean[500].count("[EMAIL]") == 1 and clean[600] == "Zebulon alone" and clean[3] == docs[3][1]
