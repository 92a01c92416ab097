"""Language-model scores by online logistic context mixing over bits, beside word counts as a base.

Every bit of a text is predicted from several contexts: the 2 and the 4 bytes before it, and the word
so far. A hash of context and half byte names a line of 16 slots, the bits before within the half byte a
slot; the slot's counts of zeros and ones in all training texts are one predictor's opinion, taken as
log odds, so that few counts weigh little. A mixer adds the opinions by weights, chosen by a gate (the
bit's place in its byte, and how many contexts have been seen), and learns from each byte as it passes.
A table over the mixer's output refines the result, adaptively as well. The logarithms of all bits add
up to the text's.

Counting is a job over all training texts: tasks count into tables of their own, which are merged in
groups of ``FAN_IN``, so that no task sees all of them. The merged tables are the only thing sent to the
tasks: a byte a slot, the number of slots following the size of the training texts up to
``MOST_BITS``. Mixer and refinement start from a fit on all training texts (the opinions leave the
bit itself out there; the ends of all stretches are averaged by their bytes) and go on learning within each stretch of ``STRETCH`` bytes of a text; a stretch
sees the bytes before it as context. So a score depends on the training texts and on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import KEY, keyed, query, stored, table
from .units import BYTE_VALUES, LOWER, WORD_BYTES, blocks, mixed, row_of, spans, sums, word_bounds, word_hashes

ORDERS = (2, 4)
CONTEXTS = len(ORDERS) + 1
#: Slots of a context, as a power of two: one for each ``BYTES_PER_SLOT`` training bytes, within bounds.
LEAST_BITS, MOST_BITS, BYTES_PER_SLOT = 18, 21, 64
#: Slots of a context that travel together; with a bit each, they are numbered in 16 bits.
SHARD_BITS = 15
FAN_IN = 64
STRETCH = 2048
#: Bytes of text handled at once.
BLOCK = 1 << 20
#: Bytes whose contexts are hashed at once, more only within a word; stretches side by side; bytes looked up ahead of mixing.
PIECE, LANES, AHEAD = 1 << 15, 1024, 1 << 13
LEARNING, REFINING = np.float32(0.005 / 144), np.float32(0.02)
#: Fewer tokens than this can have more than this part of all occurrences: those are broadcast.
COMMON = 500_000
#: Before a text, and the end of it: bytes that UTF-8 never has.
PAD, END = 8, 0xFF
PLACES = np.arange(8)
GAPS = ~WORD_BYTES
GAPS[[0, END]] = True

#: By place and byte: the bit, and its slot in its line. By half byte: what the second line depends on.
BITS = ((np.arange(256) >> (7 - PLACES)[:, None]) & 1).astype(np.float32)
HALVES = np.where(PLACES[:, None] < 4, np.arange(256) >> 4, np.arange(256) & 15)
NODES = (16 | HALVES) >> (4 - PLACES[:, None] % 4)
#: By byte: its bits. By half byte: the slots of its bits within a line.
BIT_ROWS = np.ascontiguousarray(BITS.T)
HALF_SLOTS = (16 | np.arange(16)[:, None]) >> (4 - np.arange(4))
FIRST = mixed(np.arange(1, 17, dtype=np.uint64)).astype(np.uint32)
ODD = np.uint32(0x9E3779B1)

#: Counts are kept as 16ths of a power of two; opinions are looked up by both counts' levels.
COUNTS = 2.0 ** (np.arange(256) / 16) - 1
DELTA = 0.35
OPINION = np.log((COUNTS[None, :] + DELTA) / (COUNTS[:, None] + DELTA)).astype(np.float32).ravel()
#: Opinions where one observation, of a zero or of a one, is left out.
LEFT_OUT = [np.log((np.maximum(COUNTS[None, :] - bit, 0) + DELTA) / (np.maximum(COUNTS[:, None] - (1 - bit), 0) + DELTA)
                   ).astype(np.float32).ravel() for bit in (0, 1)]
#: The same in 12ths; minus zero tells a slot that no text has reached.
LEFT_OUT_12 = [12 * left for left in LEFT_OUT]
for _left in LEFT_OUT_12:
    _left[0] = -0.0
UNSEEN = np.float32(-0.0).view(np.int32)
GATES = CONTEXTS + 1
STEPS = 33
#: The weights of one context in a gate travel as a whole.
WEIGHTS = np.dtype("V32")
#: Added to a small float, it leaves the nearest whole number in the low bits.
ROUND = np.float32(3 << 22)
#: Opinions are whole 12ths.
OPINION_12 = np.clip(np.rint(OPINION * 12), -127, 127).astype(np.int8)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(16 * np.log2(1.0 + counts)), 255).astype(np.uint16)


def texts(batch: pa.RecordBatch, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, lower-cased bytes with ``PAD`` zeros before and ``END`` behind each text, starts, lengths, contexts."""
    for row, data, bounds in blocks(batch, "text", size):
        sizes = np.diff(bounds)
        flat = np.zeros(len(data) + len(sizes) * (PAD + 1), np.uint8)
        starts = bounds[:-1] + np.arange(len(sizes)) * (PAD + 1) + PAD
        filled = np.ones(len(flat), bool)
        filled[starts[:, None] - np.arange(1, PAD + 1)] = False
        filled[starts + sizes] = False
        flat[filled] = LOWER.take(data)
        flat[starts + sizes] = END
        yield row, flat, starts, sizes + 1, contexts(flat)


def contexts(flat: np.ndarray) -> np.ndarray:
    """A hash of each context (first axis) of each byte."""
    out = np.empty((CONTEXTS, len(flat)), np.uint32)
    gap = GAPS.take(flat)
    behind = np.flatnonzero(gap) + 1
    low = 0
    while low < len(flat):
        # a piece ends behind a gap, so that words are whole
        at = np.searchsorted(behind, low + PIECE, "right") - 1
        if at < 0 or behind[at] <= low:
            at += 1
        high = int(behind[at]) if at < len(behind) else len(flat)
        begin = max(0, low - max(ORDERS))
        bytes_ = flat[begin:high].astype(np.uint64)
        past = np.zeros(high - low, np.uint64)
        column = 0
        for k in range(1, max(ORDERS) + 1):
            before = bytes_[max(0, low - begin - k):max(0, high - begin - k)]
            past[len(past) - len(before):] |= before << np.uint64(8 * (k - 1))
            if k in ORDERS:
                out[column, low:high] = mixed(past + np.uint64(k << 56)) >> np.uint64(32)
                column += 1
        own = np.arange(high - low)
        word = np.zeros(high - low, np.int64)
        word[1:] = np.where(gap[low:high - 1], own[1:], 0)
        out[column, low:high] = spans(sums(BYTE_VALUES.take(flat[low:high]), 0), 0, np.maximum.accumulate(word), own) >> np.uint64(32)
        low = high
    return out


def _slots(hashes: np.ndarray, byte: np.ndarray, bits: int, at: np.ndarray | int = 0) -> np.ndarray:
    """By context, place and byte: the slot of each bit, counted from ``at``. A byte has two lines of 16 in each context."""
    lines = np.empty((len(hashes), 2, 1, len(byte)), np.int64)
    lines[:, 0, 0] = hashes >> np.uint32(36 - bits)
    lines[:, 1, 0] = ((hashes + FIRST[byte >> 4]) * ODD) >> np.uint32(36 - bits)
    lines <<= 4
    lines += at
    return (lines + NODES[:, byte].reshape(2, 4, len(byte))).reshape(len(hashes), 8, len(byte))


def count_bits(docs: DataFrame, bits: int) -> DataFrame:
    """``context, shard, counts``: per slot of a shard, the zeros and ones of all texts (column ``text``)."""
    shards = 1 << max(0, bits - SHARD_BITS)
    wide = (1 << bits) // shards

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((CONTEXTS, 2 << bits), np.uint32)
        for batch in batches:
            for _, flat, starts, lengths, hashes in texts(batch):
                at = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
                byte = flat[at].astype(np.uint64)
                for c in range(CONTEXTS):
                    # Equal bytes in equal contexts count together; in this order, lines come one after the other.
                    pairs = hashes[c].take(at).astype(np.uint64)
                    pairs <<= np.uint64(8)
                    pairs |= byte
                    pairs.sort()
                    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
                    seen = (pairs[first] & np.uint64(255)).astype(np.uint8)
                    keys = _slots((pairs[first] >> np.uint64(8)).astype(np.uint32)[None, :], seen, bits)[0]
                    keys <<= 1
                    keys += BITS.take(seen, axis=1).astype(np.int64)
                    times = np.diff(np.r_[first, len(pairs)]).astype(np.uint32)
                    np.add.at(own[c], keys.ravel(), np.tile(times, 8))
        rows = [(c, s, part) for c in range(CONTEXTS) for s, part in enumerate(own[c].reshape(shards, wide * 2)) if part.any()]
        for c, s, part in rows:
            yield _counts_row(c, s, part)

    out = docs.mapInArrow(count, _COUNTS).withColumn("bundle", F.spark_partition_id())
    while True:
        out = out.withColumn("bundle", F.floor(F.col("bundle") / FAN_IN).cast("int")).groupBy("context", "shard", "bundle").applyInArrow(
            lambda key, rows: _merged(key, rows, wide), _COUNTS + ", bundle int")
        out = stored(out, "bit-counts")
        if not out.agg(F.max("bundle")).first()[0]:
            return out


_COUNTS = "context int, shard int, slots binary, counts binary"


def _counts_row(context: int, shard: int, part: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(part)
    counts = part[some]
    kind = np.uint8 if counts.max(initial=0) < 256 else np.uint32
    return pa.RecordBatch.from_arrays(
        [pa.array([context], pa.int32()), pa.array([shard], pa.int32()), pa.array([some.astype(np.uint16).tobytes()]),
         pa.array([counts.astype(kind).tobytes()])], names=["context", "shard", "slots", "counts"])


def _dense(rows, wide: int) -> np.ndarray:
    out = np.zeros(2 * wide, np.uint64)
    for slots, counts in rows:
        at = np.frombuffer(slots, np.uint16)
        out[at] += np.frombuffer(counts, np.uint8 if len(counts) == len(at) else np.uint32)
    return np.minimum(out, np.uint64((1 << 32) - 1)).astype(np.uint32)


def _merged(key, rows: pa.Table, wide: int) -> pa.Table:
    total = _dense(zip(rows.column("slots").to_pylist(), rows.column("counts").to_pylist()), wide)
    row = _counts_row(key[0].as_py(), key[1].as_py(), total)
    return pa.Table.from_batches([row.append_column("bundle", pa.array([key[2].as_py()], pa.int32()))])


def levels_of(counts: DataFrame, bits: int) -> np.ndarray:
    """The tables as levels of both counts, 2 bytes a slot: ``CONTEXTS << bits`` of them, a bounded size."""
    wide = 1 << min(bits, SHARD_BITS)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for slots, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both = _levels(_dense([(slots, counts)], wide)).reshape(wide, 2)
                packed.append((both[:, 0] << 8 | both[:, 1]).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["context", "shard", "levels"])

    out = np.zeros((CONTEXTS, 1 << bits), np.uint16)
    for row in counts.select("context", "shard", "slots", "counts").mapInArrow(level, "context int, shard int, levels binary").toLocalIterator():
        out[row.context, row.shard * wide:(row.shard + 1) * wide] = np.frombuffer(row.levels, np.uint16)
    return out.ravel()


class Mixer:
    """What mixing starts from: weights per gate and context, and the refinement per place and step."""

    def __init__(self):
        self.weights = np.full((CONTEXTS, 8, GATES), 0.3 / 12, np.float32)
        odds = (np.arange(STEPS) - STEPS // 2) / 2
        self.refined = np.tile((1 / (1 + np.exp(-odds))).astype(np.float32), (8, 1))


def by_halves(table: np.ndarray) -> np.ndarray:
    """By line and half byte: the opinions of the half byte's four slots, side by side. Of levels, with the bits left out."""
    lines, places = table.reshape(-1, 16), HALF_SLOTS
    kind = np.dtype(np.int8 if table.dtype == np.int8 else np.float32)
    if kind != np.int8:
        places = places + 16 * (BITS[4:, :16].T > 0)
    out = np.empty((len(lines), 16, 4), kind)
    for low in range(0, len(lines), 1 << 11):
        some = lines[low:low + (1 << 11)]
        if kind != np.int8:
            some = np.concatenate([left.take(some) for left in LEFT_OUT_12], axis=1)
        some.take(places, axis=1, out=out[low:low + (1 << 11)], mode="clip")
    return out.reshape(-1, 4).view(f"V{4 * kind.itemsize}").ravel()


def mix(table: np.ndarray, bits: int, mixer: Mixer, flat: np.ndarray, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
        fit: bool = False) -> tuple[np.ndarray | None, Mixer]:
    """Natural logarithms of the probabilities of stretches, each learning on its own from ``mixer``; or for ``fit`` their mean end.

    ``table`` holds opinions in 12ths, or for ``fit`` levels of counts, by slot or ``by_halves``.
    """
    if table.dtype.kind != "V":
        table = by_halves(table)
    order = np.argsort(-lengths, kind="stable")
    logs, end, ends = np.zeros(len(starts)), Mixer(), []
    for low in range(0, len(order), LANES):
        some = order[low:low + LANES]
        if fit:
            ends.append(_side_by_side(table, bits, mixer, flat, hashes, starts[some], lengths[some]))
        else:
            _side_by_side(table, bits, mixer, flat, hashes, starts[some], lengths[some], some, logs)
    if ends:
        share = (lengths[order] / lengths.sum()).astype(np.float32)
        weights, refined = np.concatenate([w for w, _ in ends], axis=1), np.concatenate([r for _, r in ends])
        end.weights = np.einsum("l,cplg->cpg", share, np.ascontiguousarray(weights.transpose(0, 3, 1, 2)))
        end.refined = np.einsum("l,pls->ps", share, np.ascontiguousarray(refined.transpose(1, 0, 2)))
    return None if fit else logs, end


def _side_by_side(table: np.ndarray, bits: int, mixer: Mixer, flat: np.ndarray, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                  lanes: np.ndarray | None = None, logs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and refinement after each stretch, the longest first; logarithms are added to the ``lanes`` of ``logs``.

    Stretches go side by side, a byte of each at a time. The bits of a byte share the weights. Slots do not
    depend on what is learnt, so they are looked up for many bytes at once.
    """
    many = len(starts)
    weights, refined = np.empty((CONTEXTS, many, GATES, 8), np.float32), np.empty((many, 8, STEPS), np.float32)
    weights[:], refined[:] = mixer.weights.transpose(0, 2, 1)[:, None], mixer.refined
    weights_in, refined_in = weights.reshape(-1, 8).view(WEIGHTS).ravel(), refined.ravel()
    gate_at = np.arange(many) * GATES
    context_at = np.arange(0, CONTEXTS * many * GATES, many * GATES)[:, None]
    step_at = ((np.arange(many)[:, None] * 8 + PLACES) * STEPS + STEPS // 2 - int(ROUND.view(np.int32))).astype(np.int32)
    one, half, two, top = np.float32(1), np.float32(0.5), np.float32(2), np.uint32(36 - bits)
    active = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), "left")
    t = 0
    while t < len(active):
        here = active[t:t + max(1, AHEAD // int(active[t]))]
        at = np.concatenate([starts[:n] + u for u, n in enumerate(here, t)])
        byte = flat.take(at)
        upper, lower = (byte >> 4).astype(np.uint32), (byte & 15).astype(np.uint32)
        firsts = FIRST.take(upper)
        found = np.empty((CONTEXTS, len(at), 2), table.dtype)
        for c in range(CONTEXTS):
            context = hashes[c].take(at)
            found[c, :, 0] = table.take(((context >> top) + np.uint32(c << bits - 4) << np.uint32(4)) + upper)
            context += firsts
            context *= ODD
            found[c, :, 1] = table.take(((context >> top) + np.uint32(c << bits - 4) << np.uint32(4)) + lower)
        bit = BIT_ROWS.take(byte, axis=0)
        if logs is None:
            opinions = found.view(np.float32)
            seen = opinions.view(np.int32)[:, :, 0] != UNSEEN
        else:
            opinions = found.view(np.int8).astype(np.float32)
            seen = opinions[:, :, 0] != 0
            chances = np.empty((len(at), 8), np.float32)
        gates = seen.sum(axis=0)
        low = 0
        for n in here.tolist():
            now = slice(low, low + n)
            low += n
            opinion, mine = opinions[:, now], bit[now]
            which = context_at + (gate_at[:n] + gates[now])
            weight = weights_in.take(which).view(np.float32).reshape(CONTEXTS, n, 8)
            voices = weight * opinion
            odds = voices[0]
            for c in range(1, CONTEXTS):
                odds += voices[c]
            np.clip(odds, -11, 11, out=odds)
            p = np.negative(odds)
            np.exp(p, out=p)
            p += one
            np.divide(one, p, out=p)
            miss = mine - p
            miss *= LEARNING
            opinion *= miss
            weight += opinion
            weights_in.put(which, weight.view(WEIGHTS), mode="clip")
            np.clip(odds, -8, 8, out=odds)
            odds *= two
            odds += ROUND
            step = (odds.view(np.int32) + step_at[:n]).astype(np.intp)
            finer = refined_in[step]
            if logs is not None:
                np.add(p, finer, out=chances[now])
            np.subtract(mine, finer, out=miss)
            miss *= REFINING
            finer += miss
            refined_in[step] = finer
        if logs is not None:
            chances *= half
            bit -= one
            chances += bit
            chance = np.abs(chances, out=chances).reshape(-1, 2, 4)
            own = np.log(chance[..., 0] * chance[..., 1] * chance[..., 2] * chance[..., 3]).astype(float)
            own = own[:, 0] + own[:, 1]
            low = 0
            for n in here.tolist():
                logs[lanes[:n]] += own[low:low + n]
                low += n
        t += len(here)
    return weights, refined


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into stretches: row, start and length of each."""
    pieces = -(-lengths // STRETCH)
    row = np.repeat(np.arange(len(starts)), pieces)
    offset = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
    return row, starts[row] + offset, np.minimum(lengths[row] - offset, STRETCH)


def fitted(levels: np.ndarray, bits: int, sample: list[str], rounds: int = 2) -> Mixer:
    """A mixer that has seen the first stretch of each text of the sample."""
    mixer = Mixer()
    batch = pa.RecordBatch.from_arrays([pa.array([s.encode()[:STRETCH - 1].decode(errors="ignore") for s in sample], pa.string())], names=["text"])
    for _ in range(rounds):
        for _, flat, starts, lengths, hashes in texts(batch, size=1 << 30):
            _, mixer = mix(levels, bits, mixer, flat, hashes, starts, lengths, fit=True)
    return mixer


def fitted_on_all(docs: DataFrame, levels: np.ndarray, bits: int, rounds: int = 2) -> Mixer:
    """A mixer that has seen every stretch of all texts (column ``text``)."""
    shared, mixer = docs.sparkSession.sparkContext.broadcast(levels), Mixer()
    shape, cut = mixer.weights.shape, mixer.weights.size
    for _ in range(rounds):
        def learn(batches: Iterator[pa.RecordBatch], start: Mixer = mixer) -> Iterator[pa.RecordBatch]:
            size, total, own = 0, np.zeros(cut + start.refined.size), None
            for batch in batches:
                own = by_halves(shared.value) if own is None else own
                for _, flat, starts, lengths, hashes in texts(batch):
                    _, at, n = _stretches(starts, lengths)
                    _, end = mix(own, bits, start, flat, hashes, at, n, fit=True)
                    total += np.r_[end.weights.ravel(), end.refined.ravel()] * float(n.sum())
                    size += int(n.sum())
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total),
                                                  pa.array([size] * len(total), pa.int64())], names=["place", "total", "size"])

        means = docs.mapInArrow(learn, "place int, total double, size long").groupBy("place").agg(
            (F.sum("total") / F.sum("size")).alias("mean")).orderBy("place").collect()  # some hundred numbers
        if means:
            mean, mixer = np.array([r.mean for r in means], np.float32), Mixer()
            mixer.weights, mixer.refined = mean[:cut].reshape(shape), mean[cut:].reshape(mixer.refined.shape)
    return mixer


def mixed_scores(docs: DataFrame, learns: Column, text: str = "text") -> DataFrame:
    """``KEY, n_bytes, score`` of ``docs`` (from ``keyed``): bytes of the lower-cased text and its log10 probability."""
    spark = docs.sparkSession
    plain = docs.select(KEY, F.col(f"`{text}`").alias("text"), learns.alias("learns"))
    size = plain.where("learns").agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_PER_SLOT).bit_length()))
    known = plain.where("learns").select("text")
    levels = levels_of(count_bits(known, bits), bits)
    model = spark.sparkContext.broadcast((OPINION_12[levels], fitted_on_all(known, levels, bits)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mixer = model.value
        table = by_halves(table)
        for batch in batches:
            score, size = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for first, flat, starts, lengths, hashes in texts(batch):
                row, at, n = _stretches(starts, lengths)
                logs, _ = mix(table, bits, mixer, flat, hashes, at, n)
                score[first:first + len(starts)] = np.bincount(row, logs, len(starts)) / np.log(10)
                size[first:first + len(starts)] = lengths - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(score)], names=[KEY, "n_bytes", "score"])

    return plain.select(KEY, "text").mapInArrow(score, f"`{KEY}` long, n_bytes long, score double")


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, hashes of the tokens of successive blocks of rows, and the row of each. The end's hash is that of no byte."""
    for first, data, bounds in blocks(batch, "text", BLOCK):
        data = LOWER.take(data)
        starts, ends, of_rows = word_bounds(data, bounds)
        row = np.arange(len(bounds) - 1)
        yield first, np.r_[word_hashes(data, starts, ends), np.zeros(len(row), np.uint64)].view(np.int64), np.r_[row_of(of_rows), row]


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, c``: hashes of the tokens of all texts (column ``text``), and how often each occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, _ in tokens(batch):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(hashes, return_counts=True)], names=["token", "c"])

    return docs.select("text").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def token_scores(docs: DataFrame, learns: Column, text: str = "text", common: int = COMMON) -> DataFrame:
    """``KEY, n_tokens, n_known, train_tokens, base_score``: log10 probability of the tokens by smoothed counts.

    Tokens are lower-cased words and one end, known by 64-bit hashes. The counts of the commonest, fewer
    than ``common`` by their share of all, are broadcast; what is rarer meets its count in a shuffle, where
    no token is frequent.
    """
    plain = docs.select(KEY, F.col(f"`{text}`").alias("text"), learns.alias("learns"))
    counts = stored(token_counts(plain.where("learns")), "tokens")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size = whole.n + 0.5 * (whole.v + 1)
    often = counts.where(F.col("c") > whole.n / common).orderBy("token").toArrow()  # fewer than ``common`` rows
    shared = docs.sparkSession.sparkContext.broadcast([often.column(c).to_numpy() for c in ("token", "c")])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        known, logs = np.r_[known, np.int64(0)], np.log10((np.r_[counts, 0] + 0.5) / size)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, hashes, row in tokens(batch):
                distinct, which = np.unique(hashes, return_inverse=True)
                at = np.searchsorted(known[:-1], distinct)
                near = ((known[at] == distinct) & (at < len(counts)))[which]
                k = np.bincount(row[near])
                s = np.bincount(row[near], logs[at][which[near]])
                own = np.flatnonzero(k)
                pairs, times = np.unique(row[~near] * len(distinct) + which[~near], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first + np.r_[own, pairs // len(distinct)]]),
                     pa.array(np.r_[np.zeros(len(own), np.int64), distinct[pairs % len(distinct)]], mask=np.arange(len(own) + len(pairs)) < len(own)),
                     pa.array(np.r_[k[own], times]), pa.array(np.r_[s[own], np.zeros(len(pairs))])], names=[KEY, "token", "k", "s"])

    own = stored(plain.select(KEY, "text").mapInArrow(look_up, f"`{KEY}` long, token long, k long, s double"), "own-tokens")
    logs = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / size)
    near = own.where("token IS NULL").select(KEY, "k", F.col("k").alias("known"), "s")
    far = own.where("token IS NOT NULL").join(counts.hint("merge"), "token", "left").select(
        KEY, "k", F.when(F.col("c") > 0, F.col("k")).otherwise(0), F.col("k") * logs)
    return near.union(far).groupBy(KEY).agg(
        F.sum("k").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("s").alias("base_score"),
        F.lit(whole.n).cast("long").alias("train_tokens"))


def lm_scores(docs: DataFrame, learns: Column, keep: Sequence[str] = ("doc_id",), text: str = "text", common: int = COMMON) -> DataFrame:
    """A row per row of ``docs``: ``keep``, ``n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``.

    ``learns`` (true or false, null is false) marks the rows that counts come from. Null text is empty; an
    empty text is its end alone. ``bits_per_byte`` counts the end as a byte. Rows are told apart by a
    number of their own, so ids may repeat or be null. Without training rows all counts are 0.
    """
    learns = F.coalesce(learns, F.lit(False))
    rows = keyed(docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"), learns.alias("learns")), "texts")
    base, model = token_scores(rows, F.col("learns"), common=common), mixed_scores(rows, F.col("learns"))
    out = rows.drop("text", "learns").join(base, KEY).join(model, KEY)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes",
                      (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


@query("op12_context_mixing")
def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 1
    out = lm_scores(docs.withColumn("held_out", held), ~held, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
