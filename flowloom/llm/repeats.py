"""Repeated windows of a corpus: what the two substring operators share.

A window is ``length`` successive units of one text. Of the seeds in it, runs of ``seed`` units, the
one with the least hash is its anchor: equal windows have equal anchors at equal offsets. Successive
windows with the same anchor make up a piece. So equal windows are found among pieces of equal
anchors, and a piece that occurs again as a whole need not be opened at all.

Anchors and pieces are compared by 64-bit hashes, a piece within its anchor, so by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import units
from .common import in_small_batches, let, sized, stored

#: Positions are packed as start, windows: 36 and 8 bits.
START_BITS, COUNT_BITS = 36, 8
#: Beside its start, a run within a piece has its number of units in so many bits.
RUN_BITS = 24
LAST = (1 << 63) - 1
#: List entries up to which a table with one row per document is broadcast.
MOST_ENTRIES = 4_000_000
#: Above that: bits for each text with a list, and words of 64 of them that are broadcast at most.
MARK_BITS, MOST_MARKS = 16, 1 << 20
#: Anchors up to which a table of them is broadcast.
MOST_ANCHORS = 3_000_000


@dataclass(frozen=True)
class Windows:
    length: int
    seed: int
    words: bool

    @property
    def seeds(self) -> int:
        return self.length - self.seed + 1

    def units(self, data: np.ndarray, bounds: np.ndarray):
        """Unit values, the bounds of each row's units, and where units start and end in the bytes."""
        if not self.words:
            return units.BYTE_VALUES[data], bounds, None, None
        starts, ends, rows = units.word_bounds(data, bounds)
        return units.word_hashes(data, starts, ends), rows, starts, ends


def pieces_of(values: np.ndarray, bounds: np.ndarray, w: Windows, whole: bool = True):
    """Anchor hash, piece hash, row, start and number of windows of each piece of a block.

    A tie for the least hash goes to the seed on the left, which equal windows agree on. The hash is
    cut to 32 bits for that, to have the position beside it.
    """
    counts = np.maximum(np.diff(bounds) - w.length + 1, 0)
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    if not offsets[-1]:
        return None
    running = units.sums(values, 1)
    at = np.arange(len(values) - w.seed + 1)
    seeds = units.spans(running, 1, at, at + w.seed)
    keys = (seeds & units.U64(0xFFFFFFFF00000000)) | at.astype(units.U64)
    row = units.row_of(offsets)
    window = np.arange(offsets[-1]) - offsets[:-1][row] + bounds[:-1][row]
    anchor = (units.window_minima(keys, w.seeds)[window] & units.U64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    n = np.diff(np.append(first, len(anchor)))
    start, row = window[first], row[first]
    if not whole:
        return seeds[anchor[first]]
    piece = units.spans(units.sums(values, 2), 2, start, start + n - 1 + w.length)
    place = ((start - bounds[:-1][row]) << COUNT_BITS) | n
    return seeds[anchor[first]], piece, row, place


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, number, text``. A text is known by its id and its number: a 64-bit hash of it, or 0 if no id repeats."""
    ids = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("doc_id"))
    unique = ids.groupBy("doc_id").count().where("count > 1").isEmpty()
    number = F.lit(0).cast("long") if unique else F.xxhash64(f"`{text}`")
    return in_small_batches(docs).select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("doc_id"), number.alias("number"), F.col(f"`{text}`").alias("text"))


def _anchors(docs: DataFrame, w: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in units.blocks(batch, "text"):
                values, rows, _, _ = w.units(data, bounds)
                found = pieces_of(values, rows, w, whole=False)
                if found is not None:
                    yield pa.record_batch([pa.array(found.view(np.int64))], ["h"])

    return docs.select("text").mapInArrow(run, "h long")


def _occurrences(docs: DataFrame, w: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = np.asarray(batch.column("doc_id")), np.asarray(batch.column("number"))
            for at, data, bounds in units.blocks(batch, "text"):
                values, rows, _, _ = w.units(data, bounds)
                found = pieces_of(values, rows, w)
                if found is not None:
                    h, ph, row, place = found
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(ph.view(np.int64)), pa.array(ids[at + row]), pa.array(numbers[at + row]), pa.array(place)], ["h", "ph", "doc_id", "number", "place"])

    return docs.mapInArrow(run, "h long, ph long, doc_id long, number long, place long")


def _requested(docs: DataFrame, wanted: DataFrame, columns: str, w: Windows, opened: Callable) -> DataFrame:
    """What ``opened`` makes of each wanted piece, read from the text that holds it first: ``h, ph`` and ``columns``.

    ``wanted`` has one row per piece, with ``doc_id, number, place``. Of rows with one id and one text
    one is read. The pieces of those texts are cut again,
    which is cheaper than to carry their hashes there.
    """
    lists = wanted.groupBy(F.col("doc_id").alias("of"), F.col("number").alias("of_number")).agg(F.collect_list("place").alias("places"))
    joined = _by_document(docs, stored(lists, "piece-requests"), "places", "inner").select("doc_id", "number", "text", "places")
    if not docs.groupBy("doc_id", "number").count().where("count > 1").isEmpty():
        joined = joined.dropDuplicates(["doc_id", "number"])
    joined = joined.select("doc_id", "text", "places")
    names = ["h", "ph", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            offsets, flat, ids = np.asarray(places.offsets), np.asarray(places.values), np.asarray(batch.column("doc_id"))
            for at, data, bounds in units.blocks(batch, "text"):
                values, rows, _, _ = w.units(data, bounds)
                found = pieces_of(values, rows, w)
                if found is None:
                    continue
                h, ph, row, place = found
                asked = flat[offsets[at]:offsets[at + len(bounds) - 1]]
                asked_row = units.row_of(offsets[at:at + len(bounds)])
                keys = (asked_row << (START_BITS + COUNT_BITS)) | asked
                pick = np.isin((row << (START_BITS + COUNT_BITS)) | place, keys)
                if pick.any():
                    start = (place[pick] >> COUNT_BITS) + rows[:-1][row[pick]]
                    count = place[pick] & ((1 << COUNT_BITS) - 1)
                    more = opened(data, values, start, count, h[pick].view(np.int64), ph[pick].view(np.int64), ids[at + row[pick]])
                    yield pa.record_batch(more, names)

    return joined.mapInArrow(run, f"h long, ph long, {columns}")


def _by_document(docs: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """Texts with their list. Lists are broadcast if all their entries together are few, else shuffled with the texts.

    A text without a list is not shuffled: marks of those with one are broadcast, a bit for each slot of a
    hash of id and number. Texts that share a slot go along and find no list.
    """
    total = lists.agg(F.sum(F.size(column) + 2).alias("n")).first()["n"] or 0
    same = (docs.doc_id == lists.of) & (docs.number == lists.of_number)
    if total <= MOST_ENTRIES:
        return docs.join(F.broadcast(lists), same, how).drop("of", "of_number")
    words = min(MOST_MARKS, 1 << max(0, (MARK_BITS * lists.count() // 64).bit_length()))
    word = lambda slot: F.shiftrightunsigned(slot, 6).bitwiseAND(words - 1)
    bit = lambda slot: slot.bitwiseAND(63).cast("int")
    mine, theirs = F.xxhash64("doc_id", "number"), F.xxhash64("of", "of_number")
    bits = lists.select(word(theirs).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(theirs)).alias("bit"))
    marks = F.broadcast(stored(bits.groupBy("word").agg(F.bit_or("bit").alias("marks")), "marks"))
    flagged = docs.join(marks, word(mine) == marks.word, "left").withColumn("near", F.coalesce(F.getbit("marks", bit(mine)) == 1, F.lit(False)))
    near = flagged.where("near").select(*docs.columns)
    joined = near.join(lists, (near.doc_id == lists.of) & (near.number == lists.of_number), how).drop("of", "of_number")
    if how == "inner":
        return joined
    return joined.unionByName(flagged.where("not near").select(*docs.columns, F.lit(None).cast(lists.schema[column].dataType).alias(column)))


def _window_hashes(values, start, count, w: Windows) -> np.ndarray:
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(start, count) + inner
    return units.spans(units.sums(values, 1), 1, begin, begin + w.length).view(np.int64)


def window_rows(docs: DataFrame, wanted: DataFrame, w: Windows) -> DataFrame:
    """``h, ph, first, w, window``: one row per window of the wanted pieces, and the id of the text they are in."""

    def opened(data, values, start, count, h, ph, ids):
        row = np.repeat(np.arange(len(start)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return [pa.array(h[row]), pa.array(ph[row]), pa.array(ids[row]), pa.array(inner.astype(np.int32)), pa.array(_window_hashes(values, start, count, w))]

    return _requested(docs, wanted, "first long, w int, window long", w, opened)


def bucketed(rows: DataFrame, solve: Callable, size: int) -> DataFrame:
    """``h, ph, ws``: what ``solve`` finds in buckets of pieces, with all pieces of an anchor in one bucket.

    ``rows`` has ``h, ph, first, content``. A bucket is closed once it holds ``size`` bytes of content.
    ``solve`` gets the columns of a bucket as lists and gives an array per piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(held):
            h, ph, first, content = zip(*held)
            return pd.DataFrame({"h": h, "ph": ph, "ws": solve(h, first, content)})

        held, total = [], 0
        for batch in batches:
            for row in zip(batch["h"], batch["ph"], batch["first"], batch["content"]):
                if total >= size and row[0] != held[-1][0]:
                    yield solved(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[3])
        if held:
            yield solved(held)

    return rows.repartition("h").sortWithinPartitions("h").mapInPandas(run, "h long, ph long, ws array<int>").where("size(ws) > 0")


def piece_groups(docs: DataFrame, w: Windows) -> tuple[DataFrame, DataFrame]:
    """All occurrences of pieces whose anchor occurs twice or more, and those pieces.

    ``h, ph, doc_id, number, place`` and ``h, ph, n, doc_id, number, place, variants``: the number of occurrences, the
    first of them, and the number of different pieces of the anchor. Each is counted by an aggregate
    that combines before its shuffle, and joined by a join whose hot keys can be split.
    """
    again = sized(stored(_anchors(docs, w).groupBy("h").count().where("count > 1").select("h"), "repeated-anchors"), MOST_ANCHORS)
    occurrences = stored(_occurrences(docs, w).join(again, "h", "left_semi"), "piece-occurrences")
    pieces = occurrences.groupBy("h", "ph").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "number", "place")).alias("first"))
    pieces = stored(pieces.select("h", "ph", "n", "first.*"), "pieces")
    variants = pieces.groupBy("h").agg(F.count("*").alias("variants")).where("variants > 1")
    return occurrences, pieces.join(variants, "h", "left")


def runs_by_document(found: DataFrame, w: Windows) -> DataFrame:
    """Runs of units under repeated windows of each text: ``of, of_number, runs``, an array of from, to, from, to.

    ``found`` has ``doc_id, number, place`` and ``ws``: the windows of the piece that are repeated, null
    for all. The runs of a text are maximal: in the order of their starts their ends grow as well, as the
    windows of a piece come before those of the next. Rows with one id and one text give their runs once.
    """
    start = F.shiftright("place", COUNT_BITS).bitwiseAND((1 << START_BITS) - 1)
    count = F.col("place").bitwiseAND((1 << COUNT_BITS) - 1)
    # a run within a piece is one number: its start, and how many units it has
    run = lambda first, last: F.shiftleft((start + first).cast("long"), RUN_BITS) + (last - first + w.length).cast("long")
    ws = F.array_sort("ws")
    # windows whose units touch make one run; its ends are where the next window is too far away
    far = lambda a, b: F.coalesce(b - a > w.length, F.lit(True))
    begins = lambda v: F.filter(v, lambda x, i: far(F.get(v, i - 1), x))
    ends = lambda v: F.filter(v, lambda x, i: far(x, F.get(v, i + 1)))
    together = let(ws, lambda v: F.zip_with(begins(v), ends(v), run))
    each = F.when(F.col("ws").isNull(), F.array(run(F.lit(0), count - 1))).otherwise(together)
    rows = found.select(F.col("doc_id").alias("of"), F.col("number").alias("of_number"), F.explode(each).alias("run"))
    runs = rows.groupBy("of", "of_number").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    begin = lambda x: F.shiftright(x, RUN_BITS)
    end = lambda x: begin(x) + x.bitwiseAND((1 << RUN_BITS) - 1)
    apart = lambda a, b: F.coalesce(begin(b) > end(a), F.lit(True))
    first = lambda v: F.transform(F.filter(v, lambda x, i: apart(F.get(v, i - 1), x)), begin)
    last = lambda v: F.transform(F.filter(v, lambda x, i: apart(x, F.get(v, i + 1))), end)
    whole = let(F.col("runs"), lambda v: F.flatten(F.zip_with(first(v), last(v), lambda a, b: F.array(a, b))))
    return stored(runs.select("of", "of_number", whole.alias("runs")), "repeat-runs")


def without_runs(docs: DataFrame, runs: DataFrame, w: Windows, columns: str, finish: Callable) -> DataFrame:
    """``doc_id`` and what ``finish`` makes of each text and its units under runs: one row per text.

    ``finish(data, begin, end, removed, values)`` gets the bytes of one row, unit bounds relative to
    them (None for bytes), and a flag per unit.
    """
    joined = _by_document(docs, runs, "runs", "left").select("doc_id", "text", "runs")
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, out = batch.column("doc_id").to_pylist(), batch.column("runs").to_pylist(), []
            for at, data, bounds in units.blocks(batch, "text"):
                values, rows, starts, ends = w.units(data, bounds)
                for i in range(len(bounds) - 1):
                    n = rows[i + 1] - rows[i]
                    removed = np.zeros(n, bool)
                    for lo, hi in np.array(lists[at + i] or [], np.int64).reshape(-1, 2):
                        removed[lo:hi] = True
                    own = slice(rows[i], rows[i + 1])
                    begin, end = (None, None) if starts is None else (starts[own] - bounds[i], ends[own] - bounds[i])
                    out.append((None if ids[at + i] == LAST else ids[at + i], *finish(data[bounds[i]:bounds[i + 1]], begin, end, removed)))
            if out:
                yield _rows(out, names)

    return joined.mapInArrow(run, f"doc_id long, {columns}")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {int: pa.int64(), str: pa.string(), bytes: pa.binary()}
    columns = list(zip(*rows))
    kind = lambda c: next((kinds[type(x)] for x in c if x is not None), pa.int64())
    return pa.record_batch([pa.array(c, kind(c)) for c in columns], names)
