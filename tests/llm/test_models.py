"""Hard negatives, language-model scores and the prefix trie against plain Python, and their edges."""

import hashlib
import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from flowloom.llm import context_mixing as cm
from flowloom.llm import negatives, trie
from flowloom.llm.common import KEY, keyed


# Prefix trie -----------------------------------------------------------------

def plain_trie(convs):
    """{conv_id: [(role, text), ...]} -> rows of the contract, ends as text."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n and m for m in members)]
        saved = sum((len(members[n]) - 1) * len(brute.words(n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved, ends))
    return sorted(out, key=str)


def spark_trie(t):
    nodes = t.nodes.join(trie.ends_digest(t.ends, 4), ["k1", "k2", "depth"], "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(trie.EMPTY_SHA)))


def hashed(want):
    return sorted(((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest()) for r in want), key=str)


@pytest.mark.parametrize("width", [2, 8])
def test_trie_against_plain_python(spark, width):
    """Long conversations over many blocks, copies, prefixes of others, repeated turns, nulls, turnless members."""
    rng = np.random.default_rng(5)
    convs = {}
    for c in range(60):
        n = int(rng.integers(1, 12))
        convs[c] = [("u", f"w{int(rng.integers(0, 2))} x" * (i + 1)) for i in range(n)]
    convs |= {100 + i: [("u", "hi"), ("a", "ho")] * 9 for i in range(30)}
    convs |= {-7: [("u", "hi")], 300: [("u", "hi"), ("a", "ho")] * 9 + [("u", "")], 301: [("", "")]}
    table = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    table = [(c, None if c == 301 else i, None if c == 301 else r, x or None) for c, i, r, x in table] + [(None, 0, "u", "lost")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1)).repartition(5)
    members = spark.createDataFrame([(c,) for c in [*convs, 999]], "conv_id long")
    got = sorted(map(tuple, spark_trie(trie.prefix_trie(df, members, width)).collect()), key=str)
    assert got == hashed(plain_trie(convs | {999: []}))


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert spark_trie(trie.prefix_trie(df)).count() == 0
    alone = trie.prefix_trie(df, spark.createDataFrame([(4,), (2,)], "conv_id long"))
    assert rows(spark_trie(alone).drop("coalesce(ends_sha256, x)").select("conv_id", "depth", "n_convs", "n_leaves")) == [(2, 0, 2, 1)]


def test_turn_order(spark):
    """Null turns come first; equal turns in an order of their own, the same for equal conversations."""
    df = spark.createDataFrame([(c, t, "u", x) for c in (1, 2) for t, x in ((5, "b"), (None, "z"), (5, "a"))], "conv_id long, turn long, role string, text string")
    assert rows(trie.prefix_trie(df).nodes, "conv_id", "depth", "n_convs") == [(1, d, 2) for d in range(4)]


# Hard negatives --------------------------------------------------------------

def plain_negatives(table, anchors):
    fine = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in table
            if None not in (i, v, g) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a, g in fine:
        if not anchors(i):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a, v)), j, h) for j, v, h in fine if j != i))
        for s, j, _ in [x for x in scored if x[2] == g][:5]:
            hard = [(t, k) for t, k, h in scored if h != g and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(hard)]
    return sorted(out)


def vectors(spark, table):
    return spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")


def test_negatives_against_plain_python(spark):
    """Copies of one vector, ties, zeros, nulls, infinite parts, large numbers, few positives, a narrow and a wide space."""
    rng = np.random.default_rng(3)
    for width in (3, 70):
        table = [(i, [float(x) for x in rng.normal(size=width)], int(rng.integers(0, 3))) for i in range(150)]
        table += [(200 + i, table[0][1], i % 2) for i in range(60)] + [(300 + i, [0.0] * width, i % 3) for i in range(4)]
        table += [(400, None, 1), (401, table[1][1], None), (402, [math.nan] * width, 1), (403, [math.inf] + [0.0] * (width - 1), 1), (None, table[2][1], 1)]
        table += [(404, [None] * width, 1), (500, [3e4] * width, 9), (510, [1.0] * width, 8)]
        got = negatives.hard_negatives(vectors(spark, table).repartition(4), F.col("vec_id") % 10 == 0)
        assert rows(got) == plain_negatives(table, lambda i: i % 10 == 0)


def test_negatives_edges(spark):
    none = vectors(spark, [])
    assert negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    some = vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)])
    assert negatives.hard_negatives(some, F.lit(False)).count() == 0
    assert negatives.hard_negatives(some, F.lit(None).cast("boolean")).count() == 0
    # Shorter vectors end in zeros; equal ids are rows of their own; scores past a long stay at its end.
    odd = vectors(spark, [(1, [1.0, 5.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [1e300], 1), (4, [1e300], 2)])
    got = rows(negatives.hard_negatives(odd, F.col("vec_id") == 1))
    assert (1, 1, 1, 2, 65536, 58880) in got and len([g for g in got if g[4] > 1 << 62]) > 0


def test_intervals_hold_every_score():
    rng = np.random.default_rng(8)
    x, q = rng.integers(-90, 90, (300, 70)).astype(float), rng.integers(-90, 90, (20, 70)).astype(float)
    x[0], q[0] = 0, 0
    low, high = negatives.intervals(negatives.Queries(q), slice(0, 20), negatives.Codes(x))
    exact = q @ x.T
    lengths = np.sqrt((q ** 2).sum(axis=1))[:, None] * np.sqrt((x ** 2).sum(axis=1))
    assert (low <= exact).all() and (exact <= high).all() and (high - low)[1:, 1:].mean() < 1.3 * lengths.mean()


# Language model --------------------------------------------------------------

def test_base_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(None, None), (None, "Aa aA"), (-1, "")], "doc_id long, text string")
    docs = docs.unionByName(more)
    learns = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1, F.lit(True))
    table = [tuple(r) for r in docs.collect()]
    tokens = [brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [""] for _, text in table]
    train = [doc is None or zlib.crc32(str(doc).encode()) % 5 != 1 for doc, _ in table]
    count = Counter(t for ts, k in zip(tokens, train) if k for t in ts)
    n, v = sum(count.values()), len(count)
    want = [(len(ts), sum(count[t] > 0 for t in ts), n, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for ts in tokens]
    stored = keyed(docs, "docs")
    for common in (cm.COMMON, 50):  # few tokens broadcast: the rest by shuffle
        got = rows(cm.token_scores(stored, learns, common=common), "n_tokens", "n_known", "train_tokens", "base_score")
        assert len(got) == len(want)
        assert all(a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9) for a, b in zip(got, sorted(want)))


def plain_mix(counts, mixer, text, bits):
    """One bit after the other, in a plain loop; only the hashes are the operator's."""
    (_, flat, starts, lengths, hashes), = cm.texts(__import__("pyarrow").RecordBatch.from_arrays([[text]], names=["text"]))
    weights, refined, total = mixer.weights.astype(float).copy(), mixer.refined.astype(float).copy(), 0.0
    for t in range(starts[0], starts[0] + lengths[0]):
        byte = int(flat[t])
        slots = cm._slots(hashes[:, t:t + 1], flat[t:t + 1], bits)[:, :, 0]
        opinions = []
        for place in range(8):
            views = []
            for c in range(cm.CONTEXTS):
                zeros, ones = (2 ** (min(255, round(16 * math.log2(1 + k))) / 16) - 1 for k in counts[c][slots[c, place]])
                views.append(max(-127, min(127, round(12 * math.log((ones + cm.DELTA) / (zeros + cm.DELTA))))))
            opinions.append(views)
        gate = sum(x != 0 for x in opinions[0])
        for place, views in enumerate(opinions):
            bit = byte >> (7 - place) & 1
            odds = max(-11, min(11, sum(w * x for w, x in zip(weights[:, place, gate], views))))
            p = 1 / (1 + math.exp(-odds))
            weights[:, place, gate] += float(cm.LEARNING) * (bit - p) * np.array(views)
            step = round(max(-8, min(8, odds)) * 2) + cm.STEPS // 2
            finer = refined[place, step]
            refined[place, step] += float(cm.REFINING) * (bit - finer)
            total += math.log(abs(1 - bit - (p + finer) / 2))
    return total


def test_mixing_against_a_plain_loop(spark):
    import pyarrow as pa

    texts = ["the cat sat on the mat. " * 3, "The dog sat on the log", "é ñ 日本語 the", "", "zq"]
    docs = spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(4)
    bits = 18
    rows_ = cm.count_bits(docs, bits)
    assert rows_.count() > 0
    counts = [dict() for _ in range(cm.CONTEXTS)]
    for t in texts * 3:
        (_, flat, starts, lengths, hashes), = cm.texts(pa.RecordBatch.from_arrays([[t]], names=["text"]))
        for at in range(starts[0], starts[0] + lengths[0]):
            slots = cm._slots(hashes[:, at:at + 1], flat[at:at + 1], bits)[:, :, 0]
            for c in range(cm.CONTEXTS):
                for place in range(8):
                    pair = counts[c].setdefault(slots[c, place], [0, 0])
                    pair[int(flat[at]) >> (7 - place) & 1] += 1
    levels = cm.levels_of(rows_, bits)
    for c in range(cm.CONTEXTS):
        filled = {int(s): list(map(int, (levels[(c << bits) + s] >> 8, levels[(c << bits) + s] & 255))) for s in np.flatnonzero(levels[c << bits:(c + 1) << bits])}
        assert filled == {int(s): [int(x) for x in cm._levels(np.array(k))] for s, k in counts[c].items()}
    for c in counts:
        c.update({s: k for s, k in c.items()})
    counts = [Default(c) for c in counts]
    mixer = cm.fitted(levels, bits, texts)
    for t in [*texts, "a new text, the cat"]:
        batch = pa.RecordBatch.from_arrays([[t]], names=["text"])
        (_, flat, starts, lengths, hashes), = cm.texts(batch)
        got, _ = cm.mix(cm.OPINION_12[levels], bits, mixer, flat, hashes, starts, lengths)
        assert math.isclose(got[0], plain_mix(counts, mixer, t, bits), rel_tol=1e-3, abs_tol=1e-2)


class Default(dict):
    def __missing__(self, key):
        return 0, 0


def test_scores_of_rows(spark):
    """Repeated and null ids, null and empty texts, a very long text, names of its own columns; the same again."""
    long = "the quick brown fox jumps over the lazy dog " * 3000
    table = [(1, "the quick brown fox", 0), (1, "the quick brown fox", 1), (None, None, 2), (2, "", 3), (3, long, 4), (4, "xqz jvk wpf", 5)]
    df = spark.createDataFrame(table, "doc_id long, text string, score int")
    out = cm.lm_scores(df, F.col("doc_id") != 4, ("doc_id", "score")).toPandas()
    assert list(out.columns[:2]) == ["doc_id", "score"] and len(out) == 6
    out.columns = ["doc_id", "no", *out.columns[2:-3], "logs", *out.columns[-2:]]
    out = out.sort_values("no").reset_index(drop=True)
    assert (out["logs"] < 0).all() and out["logs"][0] == out["logs"][1] and out["logs"][2] == out["logs"][3]
    assert list(out["n_bytes"]) == [19, 19, 0, 0, len(long), 11] and out["bits_per_byte"][4] < 1 < out["bits_per_byte"][5]
    again = cm.lm_scores(df.repartition(3), F.col("doc_id") != 4, ("doc_id",)).select("score").toPandas()["score"]
    assert sorted(again) == sorted(out["logs"])
    nobody = cm.lm_scores(df, F.lit(None).cast("boolean")).toPandas()
    assert (nobody["train_tokens"] == 0).all() and (nobody["n_known"] == 0).all() and len(nobody) == 6
    assert cm.lm_scores(df.limit(0), F.lit(True)).count() == 0


def test_held_out_bits(spark, sf_dir):
    """On held-out documents the mix beats the frequencies of single bytes by a third."""
    from flowloom import llm

    out = llm.QUERIES["op12_context_mixing"](spark, sf_dir).toPandas()
    docs = {r.doc_id: (r.text or "").lower().encode() + b"\xff" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    train = Counter(b for r in out[~out.held_out].doc_id for b in docs[r])
    n = sum(train.values())
    held = out[out.held_out]
    single = sum(-math.log2((train[b] + 0.5) / (n + 128)) for r in held.doc_id for b in docs[r])
    assert len(out) == len(docs) and -held["score"].sum() * math.log2(10) < 0.67 * single
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in out.itertuples())


def test_mixer_learns_from_all_texts(spark):
    """Every stretch of every training text counts, not some texts' first ones."""
    texts = [f"text {i} " + chr(97 + i % 26) * (i % 90) for i in range(450)] + ["a long one, " * 500, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    bits = cm.LEAST_BITS
    levels = cm.levels_of(cm.count_bits(df, bits), bits)
    mixer = cm.Mixer()
    batch = cm.pa.RecordBatch.from_arrays([cm.pa.array(texts, cm.pa.string())], names=["text"])
    for _ in range(2):
        for _, flat, starts, lengths, hashes in cm.texts(batch, size=1 << 30):
            _, at, n = cm._stretches(starts, lengths)
            _, mixer = cm.mix(levels, bits, mixer, flat, hashes, at, n, fit=True)
    got = cm.fitted_on_all(df, levels, bits)
    assert np.allclose(got.weights, mixer.weights, atol=1e-5) and np.allclose(got.refined, mixer.refined, atol=1e-5)


def test_slots_are_read_by_halves_of_bytes():
    """Four slots a look-up, as the slots one by one; a stretch learns the same alone and beside more than ``LANES``."""
    import numpy as np

    bits, rng = cm.LEAST_BITS, np.random.default_rng(5)
    levels = (rng.integers(0, 90, cm.CONTEXTS << bits) * rng.integers(0, 2, cm.CONTEXTS << bits)).astype(np.uint16) * 257
    texts = ["a", "bc " * 900, None, ""] + [f"text {i} " * (i % 7) for i in range(cm.LANES + 9)]
    batch = cm.pa.RecordBatch.from_arrays([cm.pa.array(texts, cm.pa.string())], names=["text"])
    (_, flat, starts, lengths, hashes), = cm.texts(batch, size=1 << 30)
    slots = cm._slots(hashes, flat, bits, (np.arange(cm.CONTEXTS) << bits)[:, None, None, None])
    line, half = slots[:, ::4] >> 4, cm.HALVES[::4, flat]
    opinions = cm.OPINION_12[levels]
    assert (cm.by_halves(opinions)[line << 4 | half].view(np.int8).reshape(cm.CONTEXTS, 2, -1, 4).swapaxes(2, 3).reshape(slots.shape) == opinions[slots]).all()
    left_out = np.where(cm.BITS[:, flat] > 0, 12 * cm.LEFT_OUT[1][levels[slots]], 12 * cm.LEFT_OUT[0][levels[slots]])
    found = cm.by_halves(levels)[line << 4 | half].view(np.float32).reshape(cm.CONTEXTS, 2, -1, 4).swapaxes(2, 3).reshape(slots.shape)
    assert np.allclose(found, left_out) and ((found.view(np.int32) == cm.UNSEEN) == (levels[slots] == 0)).all()
    _, at, n = cm._stretches(starts, lengths)
    together, _ = cm.mix(opinions, bits, cm.Mixer(), flat, hashes, at, n)
    _, whole = cm.mix(levels, bits, cm.Mixer(), flat, hashes, at, n, fit=True)
    tables, total = (cm.by_halves(opinions), cm.by_halves(levels)), 0
    for i in range(len(at)):
        if i < 40:
            assert cm.mix(tables[0], bits, cm.Mixer(), flat, hashes, at[i:i + 1], n[i:i + 1])[0][0] == together[i]
        total = total + cm.mix(tables[1], bits, cm.Mixer(), flat, hashes, at[i:i + 1], n[i:i + 1], fit=True)[1].weights * n[i]
    assert np.allclose(whole.weights, total / n.sum(), atol=1e-6)


def test_context_hashes_do_not_depend_on_pieces(monkeypatch):
    """Words longer than a piece, pieces of one byte, the first bytes of a text."""
    import numpy as np

    rng = np.random.default_rng(6)
    flat = rng.choice(np.frombuffer(b"abc \n\x00\xff", np.uint8), 3000, p=[0.4, 0.3, 0.24, 0.02, 0.02, 0.01, 0.01])
    want = cm.contexts(flat)
    for piece in (1, 7, 64):
        monkeypatch.setattr(cm, "PIECE", piece)
        assert (cm.contexts(flat) == want).all()
    alone = cm.contexts(flat[:50])
    assert (alone == want[:, :50]).all()


def test_tokens_are_not_exploded(spark):
    """Tokens are counted in Arrow batches: no row for each of them, and what is rare is a row per text."""
    df = spark.createDataFrame([("a B b  é\u00a0x",), (None,), ("",), ("b a",)], "text string")
    counts = cm.token_counts(df)
    plan = counts._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert sorted(r.c for r in counts.collect()) == [1, 2, 3, 4]
