"""Suffix-array dedup by threshold-bounded interval expansion.

Pieces of text that meet on an anchor (see ``repeats``) are put together in buckets of bounded size.
A bucket's suffixes are sorted by their first ``length`` bytes, which gives its Burrows-Wheeler
transform. From the intervals of short prefixes, a breadth-first search goes one byte to the left at
a time: the right end of an interval reached after k steps is where the longest common prefix of two
neighbours is k, unless a smaller value is known there. Common prefixes so come out by increasing
value. The search stops at ``length``; neighbours that have no value by then share a long string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import query, stored, table
from .repeats import Windows, _requested, _texts, _window_hashes, bucketed, piece_groups, runs_by_document, without_runs

#: Bytes of pieces that are sorted together, and pieces per anchor up to which they share one bucket.
BUCKET, MOST_PIECES = 256 << 10, 1000
#: Bytes of window hashes of one anchor that are counted together.
PART = 1 << 20
#: Not a byte of UTF-8: parts pieces, and stands behind the last one.
END = 0xFF
#: The prefix by which suffixes are sorted first, in one number.
PACKED = 8


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``length`` bytes or more, and their packed first bytes in that order.

    Sorting starts from packed bytes and doubles the prefix until it is long enough or no two agree.
    """
    n = len(text)
    padded = np.concatenate([text, np.full(PACKED, END, np.uint8)])
    packed = np.zeros(n, np.uint64)
    for k in range(PACKED):
        packed = (packed << np.uint64(8)) | padded[k:k + n]
    order = np.argsort(packed)

    def ranked(keys, order):
        fresh = np.zeros(n, np.int64)
        fresh[1:] = keys[order][1:] != keys[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        return rank

    rank, reach = ranked(packed, order), PACKED
    while reach < length and rank[order[-1]] < n - 1:
        behind = np.zeros(n, np.int64)
        behind[:n - reach] = rank[reach:] + 1
        keys = rank * (n + 2) + behind
        order = np.argsort(keys)
        rank, reach = ranked(keys, order), 2 * reach
    return order, packed[order]


def long_prefix_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place whether it shares ``length`` bytes with the one before it."""
    n = len(text)
    order, packed = suffix_order(text, length)
    before = text[order - 1]  # the transform; what stands before the first byte is the end mark behind the last
    before[order == 0] = END
    back = np.empty(n, np.int64)  # of the suffix one byte longer, its place
    back[np.argsort(before, kind="stable")] = np.arange(n)
    parted = np.zeros(n + 1, bool)  # a common prefix below ``length`` is known between place i - 1 and i
    parted[[0, n]] = True
    parted[1:n] = packed[1:] != packed[:-1]
    bounds = np.flatnonzero(parted)
    # those that share all packed bytes but the last are where the search begins
    near = np.zeros(len(bounds) - 1, bool)
    inner = bounds[1:-1]
    near[:-1] = (packed[inner] >> np.uint64(8)) == (packed[inner - 1] >> np.uint64(8))
    lo, hi = bounds[:-1][near], bounds[1:][near]
    for _ in range(PACKED, length):
        if not len(lo):
            break
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which]
        place, byte = back[at], before[at]
        # within an interval, equal bytes lead to successive places: the first and the last bound the new one
        by = np.argsort(which * 256 + byte, kind="stable")
        key = (which * 256 + byte)[by]
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        starts = np.append(0, ends[:-1] + 1)
        left, right = place[by[starts]], place[by[ends]] + 1
        new = ~parted[right] & (byte[by[starts]] != END)
        parted[right[new]] = True
        lo, hi = left[new], right[new]
    return order, ~parted[:n]


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, the starts of its windows of ``length`` bytes that start elsewhere in the bucket too."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(p + bytes([END]) for p in pieces), np.uint8)
    order, joined = long_prefix_groups(text, length)
    shared = joined.copy()
    shared[:-1] |= joined[1:]
    found = np.sort(order[shared])
    begins = np.cumsum(sizes + 1) - sizes - 1
    piece = np.searchsorted(begins, found, "right") - 1
    start = found - begins[piece]
    fits = start + length <= sizes[piece]
    piece, start = piece[fits], start[fits].astype(np.int32)
    cuts = np.searchsorted(piece, np.arange(len(pieces) + 1))
    return [start[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def repeated_in_parts(docs: DataFrame, many: DataFrame, w: Windows) -> DataFrame:
    """``h, ph, ws``: repeated windows of pieces whose anchor has very many.

    A piece gives its window hashes in a row for each part that some of them fall into. Equal windows are in one part
    of their anchor; parts are as many as keep the largest anchor's within ``PART`` bytes.
    """
    most = many.agg(F.max("variants")).first()[0]
    parts = -(-most * w.seeds * 8 // PART)

    def opened(data, values, start, count, h, ph, ids):
        window = _window_hashes(values, start, count, w)
        row = np.repeat(np.arange(len(start)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        part = ((window.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((part, row))
        cuts = np.flatnonzero(np.append(True, np.diff(row[order] * parts + part[order]) != 0))
        listed = lambda x: pa.ListArray.from_arrays(pa.array(np.append(cuts, len(x)), pa.int32()), pa.array(x[order]))
        of = row[order][cuts]
        return [pa.array(h[of]), pa.array(ph[of]), pa.array(part[order][cuts]), listed(inner.astype(np.int32)), listed(window)]

    def repeated(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).combine_chunks() for c in ("h", "ph", "ws", "windows")}
        _, which, times = np.unique(np.asarray(columns["windows"].flatten()), return_inverse=True, return_counts=True)
        again = times[which] > 1
        row = np.repeat(np.arange(table.num_rows), np.asarray(columns["ws"].value_lengths()))
        ends = np.append(0, np.cumsum(np.bincount(row[again], minlength=table.num_rows)))
        ws = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.asarray(columns["ws"].flatten())[again], pa.int32()))
        return pa.table([columns["h"], columns["ph"], ws], names=["h", "ph", "ws"])

    rows = _requested(docs, many, "part long, ws array<int>, windows array<long>", w, opened)
    found = rows.groupBy("h", "part").applyInArrow(repeated, "h long, ph long, ws array<int>").where("size(ws) > 0")
    return found.groupBy("h", "ph").agg(F.flatten(F.collect_list("ws")).alias("ws"))


def repeated_bytes(docs: DataFrame, w: Windows) -> DataFrame:
    """``doc_id, number, place, ws``: windows that start somewhere else too.

    A piece that occurs twice is repeated as a whole. One that occurs once is looked into where its
    anchor has other pieces. An anchor with more than ``MOST_PIECES`` of them could outgrow a bucket:
    its windows are counted by hash, in parts of bounded size, with the same result.
    """
    occurrences, pieces = piece_groups(docs, w)
    pieces = stored(pieces, "piece-variants")
    few, many = pieces.where(F.col("variants") <= MOST_PIECES), pieces.where(F.col("variants") > MOST_PIECES)

    def opened(data, values, start, count, h, ph, ids):
        raw, ends = data.tobytes(), start + count - 1 + w.length
        return [pa.array(h), pa.array(ph), pa.array(ids), pa.array([raw[a:b] for a, b in zip(start.tolist(), ends.tolist())], pa.binary())]

    solve = lambda h, first, content: repeated_starts(content, w.length)
    found = bucketed(_requested(docs, few, "first long, content binary", w, opened), solve, BUCKET)
    if not many.isEmpty():
        found = found.unionByName(repeated_in_parts(docs, many, w))
    found = stored(found, "repeated-windows")
    # written down, so that the join with all occurrences is one whose hot keys can be split
    verdict = stored(pieces.select("h", "ph", F.col("n").alias("times")).join(found, ["h", "ph"], "left"), "piece-verdicts")
    marked = occurrences.join(verdict, ["h", "ph"])
    whole = F.col("times") > 1
    return marked.where(whole | F.col("ws").isNotNull()).select("doc_id", "number", "place", F.when(~whole, F.col("ws")).alias("ws"))


COLUMNS = "n_bytes long, n_removed long, n_spans long"


def remove_repeats(docs: DataFrame, length: int = 200, seed: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept``.

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes over it starts anywhere else
    too, in the same text or another, judged on the input; matches do not cross texts. ``kept`` is
    what remains, as binary: a cut may fall inside a character. Null and empty texts, and those below
    ``length``, lose nothing. Rows that repeat an id are texts of their own; equal ones remove each
    other. Null ids are kept apart from others. An empty table gives no rows. Other columns are not
    looked at.
    """
    return _remaining(docs, length, seed, doc_id, text, f"{COLUMNS}, kept binary", lambda b: b)


def _remaining(docs, length, seed, doc_id, text, columns, result) -> DataFrame:
    w, texts = Windows(length, seed, words=False), _texts(docs, doc_id, text)

    def finish(data, begin, end, removed):
        runs = int(removed[:1].sum()) + int((removed[1:] & ~removed[:-1]).sum())
        return len(removed), int(removed.sum()), runs, result(data[~removed].tobytes())

    return without_runs(texts, runs_by_document(repeated_bytes(texts, w), w), w, columns, finish)


@query("op3_suffix_repeats")
def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda kept: hashlib.sha256(kept).hexdigest()
    return _remaining(table(spark, sf_dir, "documents"), 200, 80, "doc_id", "text", f"{COLUMNS}, kept_sha256 string", digest)
