"""Every query of the training-data operators against SQL or a brute-force version, over whole tables."""

import os
import sys
import zlib

import brute
import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as contract
from check_queries import TABLES, compare
from flowloom import llm
from flowloom.llm import quality
from conftest import rows


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_sql(spark, sf_dir, tables, name):
    note, _, ok = compare(spark, tables, name, llm.QUERIES[name], llm.ORACLES[name], sf_dir)
    assert ok, note


def test_all_registered():
    names = [n for n in contract.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries()


def test_divergence(spark, sf_dir, docs):
    want = brute.kept(docs, set(quality.COMMON), 0.25, 0.3, 200, 100)
    assert rows(llm.QUERIES["op1_divergence"](spark, sf_dir)) == sorted(want)


def test_suffix_repeats(spark, sf_dir, docs):
    assert rows(llm.QUERIES["op3_suffix_repeats"](spark, sf_dir)) == sorted(brute.remove_repeats([d[:2] for d in docs]))


def test_language(spark, sf_dir, docs):
    out = llm.QUERIES["op6_language"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    lang = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out) and len(out) == len(lang)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in out)


def test_jaccard(spark, sf_dir, docs):
    assert rows(llm.QUERIES["op7_jaccard_join"](spark, sf_dir)) == sorted(brute.jaccard_components([d[:2] for d in docs]))


def test_seed_extend(spark, sf_dir, docs):
    assert rows(llm.QUERIES["op8_seed_extend"](spark, sf_dir)) == sorted(brute.keep_first([d[:2] for d in docs]))


def test_personal_data(spark, sf_dir, docs):
    out = llm.QUERIES["op10_sanitise"](spark, sf_dir)
    assert rows(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(brute.op10_row(*d[:2]) for d in docs)
    for doc, text, _ in docs:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(text))
        spans = out.where(f"doc_id = {doc}").first().spans if base and doc < 40 else base
        assert spans.startswith(base)


def test_pipeline(spark, sf_dir, docs):
    """Brute force up to the personal data, whose base spans must be gone; the mix must come near its targets."""
    import corpus_pipeline

    full = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r[0] for r in brute.kept(docs, set(quality.COMMON), 0.25, 0.3, 200, 100) if r[-1]}
    left = [d[:2] for d in docs if d[0] in good]
    left = [d for d, (doc, _, root) in zip(left, brute.jaccard_components(left)) if doc == root]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in brute.contamination(left, items) if not r[-1]}
    assert 0 < len(clean) < len(left) < len(good) < len(docs)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]
    got = out.collect()
    assert {r.doc_id for r in got} <= clean and len(got) > 0.5 * len(clean)
    sizes = dict.fromkeys((full[d].source for d in clean), 0)
    for r in got:
        assert not brute.base_spans(r.text) and len(r.text) == r.n_chars and r.copies in (1, 2)
        assert brute.base_spans(full[r.doc_id].text) or r.text == full[r.doc_id].text or "[TERM]" in r.text
        sizes[r.source] += r.copies * len(brute.words(r.text))
    assert sum(sizes.values()) > 0
