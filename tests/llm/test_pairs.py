"""What the Jaccard join compares whole: pairs that their parities leave, and lists that both sides share."""

import random

import brute
from pyspark.sql import functions as F

from flowloom.llm import jaccard_join


def long_docs():
    """Texts of 40 to 3,000 words that share a fifth, half, or nearly all of their words with another."""
    rng, docs = random.Random(7), []
    for n in (40, 300, 600, 1500, 3000):
        base = [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
        for share in (1.0, 0.97, 0.95, 0.93, 0.5, 0.2):
            kept = int(n * share)
            docs.append(base[:kept] + [f"v{rng.randint(0, 10**9)}" for _ in range(n - kept)])
            docs.append(base[:kept])
    return list(enumerate(dict.fromkeys(" ".join(d) for d in docs)))


def test_long_sets_are_parted_by_their_parities(spark):
    docs = long_docs()
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    signed = jaccard_join.signatures(spark.createDataFrame(docs, "doc_id long, text string"), 5)
    nodes = signed.select("doc_id", "node", "n", "odd").cache()
    ids = nodes.select("doc_id", "node", "n")
    side = lambda x: ids.select(F.col("doc_id").alias(f"id_{x}"), F.col("node").alias(x), F.col("n").alias(f"m_{x}"))
    pairs = side("a").crossJoin(side("b")).where("id_a < id_b and 100 * least(m_a, m_b) >= 75 * greatest(m_a, m_b)")
    of = {r.node: r.doc_id for r in ids.collect()}
    tried = {(r.id_a, r.id_b) for r in pairs.collect() if sets[r.id_a] != sets[r.id_b]}
    left = {tuple(sorted((of[r.a], of[r.b]))) for r in jaccard_join._alike(pairs.select("a", "b"), nodes, 75).collect()}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    links = {p for p in tried if share(*p) >= 0.75}
    apart = {p for p in tried if share(*p) < 0.4 and len(sets[p[0]]) > 250}
    assert links and apart
    assert links <= left, sorted((p, share(*p)) for p in links - left)
    assert not apart & left, sorted((p, share(*p)) for p in apart & left)


def test_whole_and_dealt_lists(spark, monkeypatch):
    docs = long_docs()[:36]
    docs += [(100 + i, f"{t} tail{i}") for i, t in docs]
    df, want = spark.createDataFrame(docs, "doc_id long, text string"), sorted(brute.jaccard_components(docs))
    got = lambda: sorted(tuple(r) for r in jaccard_join.jaccard_groups(df).collect())
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)  # all links come from lists
    assert got() == want
    monkeypatch.setattr(jaccard_join, "LIST_PART", 1)
    assert got() == want
