"""Substring dedup on winnowed anchors.

Documents meet on winnowed anchors (see ``repeats``). Where an anchor's surroundings are equal as a
whole, the match covers the whole piece. Where they differ, the windows that keep the anchor are
compared by hash, instead of a match grown from the seed to both sides; the repeated windows are the
same. Those that touch run together into maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import query, stored, table
from .repeats import (
    Windows, _requested, _texts, _window_hashes, bucketed, piece_groups, runs_by_document, window_rows, without_runs,
)

#: Bytes of window hashes that are compared together, and pieces per anchor up to which they share one
#: bucket; the windows of larger anchors are compared by an aggregate over all tasks.
BUCKET, MOST_PIECES = 1 << 20, 20_000


def extended(h, first, content) -> list[np.ndarray]:
    """For each piece, the windows that a piece of the same anchor in an earlier document has too."""
    sizes = np.array([len(c) // 8 for c in content])
    window = np.frombuffer(b"".join(content), np.int64)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    anchor, doc = np.array(h, np.int64)[piece], np.array(first, np.int64)[piece]
    order = np.lexsort((doc, window, anchor))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (window[order][1:] != window[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    least = doc[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    found = np.sort(order[least < doc[order]])
    begins = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(piece[found], np.arange(len(sizes) + 1))
    return [(found[a:b] - begins[i]).astype(np.int32) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


def later_repeats(docs: DataFrame, w: Windows) -> DataFrame:
    """``doc_id, number, place, ws``: windows that a document with a smaller id has too.

    A later occurrence of a piece is repeated as a whole. Of the first one, each window is compared
    with the first document that has it in any piece of the same anchor.
    """
    occurrences, pieces = piece_groups(docs, w)
    pieces = stored(pieces, "piece-variants")
    few, many = pieces.where(F.col("variants") <= MOST_PIECES), pieces.where(F.col("variants") > MOST_PIECES)

    def opened(data, values, start, count, h, ph, ids):
        raw, ends = _window_hashes(values, start, count, w).tobytes(), np.cumsum(count) * 8
        content = [raw[a:b] for a, b in zip((ends - count * 8).tolist(), ends.tolist())]
        return [pa.array(h), pa.array(ph), pa.array(ids), pa.array(content, pa.binary())]

    earlier = bucketed(_requested(docs, few, "first long, content binary", w, opened), extended, BUCKET)
    if not many.isEmpty():
        windows = stored(window_rows(docs, many, w), "open-windows")
        least = windows.groupBy("h", "window").agg(F.min("first").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
        more = windows.join(least, ["h", "window"]).where("least < first").groupBy("h", "ph").agg(F.collect_list("w").alias("ws"))
        earlier = earlier.unionByName(more)
    # written down, so that the join with all occurrences is one whose hot keys can be split
    firsts = stored(pieces.select("h", "ph", F.col("doc_id").alias("first")).join(earlier, ["h", "ph"], "left"), "piece-verdicts")
    found = occurrences.join(firsts, ["h", "ph"])
    later = F.col("doc_id") > F.col("first")
    return found.where(later | F.col("ws").isNotNull()).select("doc_id", "number", "place", F.when(~later, F.col("ws")).alias("ws"))


def keep_first(docs: DataFrame, length: int = 13, seed: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept``.

    A word goes if a window of ``length`` words over it also starts in a document with a smaller id,
    judged on the input. ``kept`` is the remaining words joined by spaces. Null and empty texts have no
    words; texts below ``length`` words lose none. Rows that repeat an id are one document as to
    order: they do not remove each other's words. Null ids count as one document after all others.
    An empty table gives no rows. Other columns are not looked at.
    """
    return _kept(docs, length, seed, doc_id, text, "n_words long, n_removed long, kept string", lambda s: s)


def _kept(docs, length, seed, doc_id, text, columns, result) -> DataFrame:
    w, texts = Windows(length, seed, words=True), _texts(docs, doc_id, text)

    def finish(data, begin, end, removed):
        raw = data.tobytes()
        kept = b" ".join([raw[a:b] for a, b, gone in zip(begin.tolist(), end.tolist(), removed.tolist()) if not gone])
        return len(removed), int(removed.sum()), result(kept.decode("utf-8", "replace"))

    return without_runs(texts, runs_by_document(later_repeats(texts, w), w), w, columns, finish)


@query("op8_seed_extend")
def op8_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda kept: hashlib.sha256(kept.encode()).hexdigest()
    return _kept(table(spark, sf_dir, "documents"), 13, 5, "doc_id", "text", "n_words long, n_removed long, kept_sha256 string", digest)
