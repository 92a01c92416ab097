"""Whole jobs: rare entities, rows without an id of their own."""

import hashlib
import itertools
import random
import time

import brute
from pyspark.sql import functions as F

from flowloom.llm import common, decontaminate, jaccard_join, mixing, pii, seed_extend, suffix


def test_terms_near_rare_entities(spark):
    """A name near an address that is seen once or twice, at the defaults; chance neighbours stay."""
    rng = random.Random(8)
    filler = ["wrote", "report", "meeting", "with", "from", "about", "plan", "budget", "office", "again"]
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    docs = [(i, prose(40)) for i in range(400)]
    docs += [(500, f"{prose(20)} Zebulon, zeb@corp.example, {prose(20)}")]
    docs += [(501 + i, f"{prose(20)} Kim {prose(2)} kim@corp.example {prose(20 + i)} Kim") for i in range(2)]
    docs += [(510, f"{'的' * 6}王小明{'的' * 2} wang@corp.example {'的' * 6}"), *((700 + i, "的" * 40) for i in range(20))]
    docs += [(520 + i, f"{prose(9)} Osgood osg@corp.example") if i else (520, prose(9)) for i in range(2)]
    docs += [(530 + i, "Tabitha tab@corp.example ran") for i in range(30)]  # copies
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert "[TERM], [EMAIL]," in clean[500] and "Zebulon" not in clean[500]
    assert "Kim" not in clean[501].split("[EMAIL]")[0] and "王" not in clean[510] and "明" not in clean[510] and "的的" in clean[510]
    assert "Osgood" not in clean[521] and "Tabitha" not in clean[540]
    assert all(w in filler for w in clean[3].split()) and clean[500].count("[TERM]") == 1


def test_chance_neighbours_stay(spark):
    """Where nearly every word is rare, a rare word near an address tells nothing; one that returns with it does."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, prose(60)) for i in range(300)]
    docs += [(500 + i, f"{prose(20)} once{i}@corp.example {prose(20)}") for i in range(20)]
    docs += [(600 + i, f"{prose(20)} Zebulon twice@corp.example {prose(20)}") for i in range(2)]
    terms = {(r.entity, r.term) for r in pii.disclosing_terms(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert terms == {("email:twice@corp.example", "zebulon")}


def test_substring_many_texts_of_one_id(spark):
    """Thousands of texts without an id, each with a repeat at a place of its own, and equal rows among them."""
    rng = random.Random(10)
    passage = " ".join(f"shared{i}" for i in range(40))
    docs = []
    for i in range(3000):
        own = [f"w{rng.random()}" for _ in range(rng.randint(1, 30))]
        docs.append((None if i % 3 else 7, " ".join(own) + " " + passage + " " + " ".join(own[:3])))
    docs += [(None, "x " + passage)] * 300 + [(3, passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    plain = [(brute.LAST if d is None else d, t) for d, t in docs]
    digest = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
    named = lambda got: sorted((brute.LAST if r[0] is None else r[0], *r[1:]) for r in map(tuple, got.collect()))
    op8 = seed_extend._kept(df, 13, 5, "doc_id", "text", "n_words long, n_removed long, kept_sha256 string", digest)
    op3 = suffix._remaining(df, 200, 80, "doc_id", "text", suffix.COLUMNS + ", kept_sha256 string", digest)
    assert named(op8) == sorted(brute.keep_first(plain)) and named(op3) == sorted(brute.remove_repeats(plain))


def test_rows_decide_not_ids(spark):
    """A third of the rows without an id, a third under one id: each row stays or goes by itself."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.random()}" for _ in range(n))
    ids = lambda i: (None, 7, i + 100)[i % 3]
    docs = [(ids(i), prose(30), "ab"[i % 2]) for i in range(120)]
    item = prose(10)
    bad = [(ids(i), f"{prose(5)} {item} {prose(5)}", "a") for i in range(3)]
    schema = "doc_id long, text string, source string"
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.clean_documents(spark.createDataFrame(docs + bad, schema).repartition(3), bench)
    assert kept.columns == ["doc_id", "text", "source"] and key(kept.collect()) == key(docs)
    copies = [(None, docs[0][1], "a"), (None, docs[0][1] + " more", "b"), (7, docs[1][1], "a"), (5, docs[2][1] + " more", "a")]
    got = jaccard_join.one_of_each_group(spark.createDataFrame(docs + copies, schema).repartition(3)).collect()
    assert len(got) == len(docs) and sorted(r.text.split()[0] for r in got) == sorted(d[1].split()[0] for d in docs)
    assert copies[3] in [tuple(r) for r in got] and docs[2] not in [tuple(r) for r in got]
    df = spark.createDataFrame(docs, schema).repartition(3)
    taken = mixing.mix(df).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(df).collect()
    assert sum(r.copies * len(r.text.split()) for r in out) == taken and len(out) <= len(docs)


def test_rows_by_their_place_in_files(spark, tmp_path):
    """Rows read from files are numbered without being written, and a mix of them takes the same words."""
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    docs = [(None if i % 3 else i % 9, f"w{i} " * (1 + i % 40), "abc"[i % 3]) for i in range(600)]
    docs += [(None, "same words each time", "a")] * 300
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    numbered = common.keyed(df, "unused", scanned=True)
    assert numbered.select(common.KEY).distinct().count() == len(docs) and numbered.columns == [*df.columns, common.KEY]
    assert key(numbered.drop(common.KEY)) == key(df)
    assert common.keyed(df.union(df), "twice", scanned=True).select(common.KEY).distinct().count() == 2 * len(docs)
    out = mixing.mixed_documents(df, scanned=True)
    assert key(out) == key(mixing.mixed_documents(df, scanned=True))
    taken = {s: 0 for s in "abc"}
    for r in out.collect():
        taken[r.source] += r.copies * len(r.text.split())
    per = mixing.mix(df).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    # equal rows are taken in part, rows without an id one by one: no source is off by more than a text
    assert len(per) == 3 and all(abs(r.taken - r.target) <= 40 for r in per)
    assert all(abs(a - b) <= 40 for a, b in zip(sorted(taken.values()), sorted(r.target for r in per)))


def test_terms_stay_with_their_text(spark):
    """Rows without an id, or of one id, do not share terms: each is masked by its own entities."""
    filler = [(i + 10, " ".join(f"common{(i * 7 + k) % 50}" for k in range(60))) for i in range(300)]
    for of in (None, 7):
        near = [(of, f"write to Zebulon zeb{of}@mail.example now, said note {k}") for k in range(3)]
        apart = [(of, "the name Zebulon alone")]
        df = spark.createDataFrame(filler + near + apart, "doc_id long, `a.text` string")
        out = [r[1] for r in pii.sanitised(df, text="a.text", threshold=0.5, chance=1e9).collect()]
        assert "the name Zebulon alone" in out and not any("@" in t for t in out)


def test_many_places_in_one_text(spark):
    """Replacement and runs grow with the text, not with its square."""
    n = 20000
    text = " ".join(f"u{i}@h{i % 7}.org é\U0001F600" for i in range(n))
    one = spark.createDataFrame([(None, text), (1, "x@y.z 10.0.0.1@y.z")], "doc_id long, text string")
    began = time.time()
    got = [r.text for r in pii.sanitised(one, n_chars=None).collect()]
    assert got == ["[EMAIL] é\U0001F600 " * (n - 1) + "[EMAIL] é\U0001F600", "[EMAIL] [EMAIL]"]
    window = " ".join(f"q{i}" for i in range(13))
    pair = spark.createDataFrame([(1, window), (2, " ".join(f"{window} z{i}" for i in range(n)))], "doc_id long, text string")
    kept = seed_extend.keep_first(pair).where("doc_id = 2").first()
    assert kept.n_removed == 13 * n and kept.kept == " ".join(f"z{i}" for i in range(n))
    assert time.time() - began < 120


def test_running_totals(spark):
    df = spark.createDataFrame([(list(range(n, 0, -1)),) for n in (0, 1, 2, 3, 10, 17, 100)], "v array<int>")
    got = df.select("v", common.running(F.col("v"), "int", lambda a, b: a + b).alias("t"), common.running(F.col("v"), "int", F.greatest).alias("m")).collect()
    assert all(r.t == list(itertools.accumulate(r.v)) and r.m == list(itertools.accumulate(r.v, max)) for r in got)
