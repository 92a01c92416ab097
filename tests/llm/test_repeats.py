"""Substring operators where tables are shuffled and anchors are crowded."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from flowloom.llm import repeats, seed_extend, suffix


def made():
    """Copies, near copies with an edit each, passages in other texts, short and missing texts."""
    rng = random.Random(3)
    some = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    base, docs = some(90), [None, "", "a b"]
    docs += [base] * 3 + [base[:k] + "#" + base[k + 1:] for k in rng.sample(range(len(base)), 40)]
    docs += [f"{some(30)} {base[k:k + 300]} {some(40)} {base[k + 200:k + 420]}" for k in range(0, 200, 20)]
    docs += [some(60) for _ in range(20)]
    return docs


@pytest.mark.parametrize("ids", ["own", "repeated"])
def test_texts_with_runs_only(spark, monkeypatch, ids):
    rows = [(i if ids == "own" else i // 2, t) for i, t in enumerate(made())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    digest = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
    op8 = lambda: sorted(map(tuple, seed_extend._kept(df, 13, 5, "doc_id", "text", "n_words long, n_removed long, kept_sha256 string", digest).collect()))
    op3 = lambda: sorted(map(tuple, suffix._remaining(df, 200, 80, "doc_id", "text", suffix.COLUMNS + ", kept_sha256 string", digest).collect()))
    want3, want8 = sorted(brute.remove_repeats(rows)), sorted(brute.keep_first(rows))
    assert op3() == want3 and op8() == want8
    for module in (suffix, seed_extend):
        monkeypatch.setattr(module, "MOST_PIECES", 3)
    monkeypatch.setattr(suffix, "PART", 1 << 10)  # several parts for an anchor
    monkeypatch.setattr(repeats, "MOST_ENTRIES", 0)
    assert op3() == want3 and op8() == want8


def test_runs_are_maximal(spark):
    """Neighbouring pieces of one text give one run, so that lists stay short."""
    w = repeats.Windows(200, 80, words=False)
    place = lambda start, n: (start << repeats.COUNT_BITS) | n
    found = [(1, 0, place(0, 50), None), (1, 0, place(50, 100), None), (1, 0, place(150, 40), [0, 1, 39]), (1, 0, place(900, 9), [3]), (2, 0, place(5, 1), None)]
    got = repeats.runs_by_document(spark.createDataFrame(found, "doc_id long, number long, place long, ws array<int>"), w)
    assert sorted((r.of, list(r.runs)) for r in got.collect()) == [(1, [0, 389, 903, 1103]), (2, [5, 205])]
    assert got.where(F.size("runs") > 4).count() == 0
