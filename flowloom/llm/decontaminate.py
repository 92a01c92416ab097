"""Benchmark decontamination over a positional inverted index.

The index is cut into shards by document. A shard holds, for every term, the positions at which it
stands in the shard's documents, counted through with a gap between documents. A phrase is looked up
by its rarest term first: its positions, less the term's offset in the phrase, are where the phrase
could begin, and the list of each further term, less its offset, is intersected with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import units
from .common import KEY, in_small_batches, keyed, query, sized, stored, table

#: Positions left free between documents; more than a phrase and its slop can span.
GAP = 1 << 10
#: Terms up to which the index is held to the terms of the benchmark, and characters of benchmark
#: text that are searched for at once. A larger benchmark is searched for in several blocks.
MOST_TERMS, BENCHMARK_BLOCK = 4_000_000, 4 << 20
MOST_DOCUMENTS = 1_000_000

INDEX = (
    "shard string, doc_ids array<long>, n_words array<int>, starts array<int>, terms array<long>, "
    "counts array<int>, postings binary"
)


def _terms(data: np.ndarray, bounds: np.ndarray):
    """Term hashes of the words of lower-cased texts, and the bounds of each row's words."""
    lowered = units.LOWER[data]
    starts, ends, rows = units.word_bounds(lowered, bounds, units.ALNUM_BYTES)
    return units.word_hashes(lowered, starts, ends), rows


def benchmark_terms(items: DataFrame, text: str = "text") -> np.ndarray | None:
    """The sorted term hashes of a benchmark, or None if there are more than ``MOST_TERMS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in units.blocks(batch, "text"):
                yield pa.record_batch([pa.array(np.unique(_terms(data, bounds)[0]).view(np.int64))], ["term"])

    terms = items.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "term long").distinct()
    got = np.array([r[0] for r in terms.limit(MOST_TERMS + 1).collect()], np.int64)
    return np.sort(got.view(np.uint64)) if len(got) <= MOST_TERMS else None


def build_index(docs: DataFrame, terms: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard of some 2 MB of text: its documents, its terms, and their posting lists.

    ``starts`` are the positions of the documents' first words. ``postings`` has the lists one after
    the other, as differences, compressed. With ``terms``, other terms are not indexed; their words
    count as positions all the same. Null texts are documents without words.
    """
    spark = docs.sparkSession
    only = None if terms is None else spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        wanted = None if only is None else only.value
        for batch in batches:
            ids = batch.column("doc_id")
            for at, data, bounds in units.blocks(batch, "text"):
                found, rows = _terms(data, bounds)
                position = np.arange(len(found)) + units.row_of(rows) * GAP
                if wanted is not None:
                    place = np.searchsorted(wanted, found)
                    known = place < len(wanted)
                    known[known] = wanted[place[known]] == found[known]
                    found, position = found[known], position[known]
                order = np.argsort(found, kind="stable")
                term, first, count = np.unique(found[order], return_index=True, return_counts=True)
                listed = position[order].astype(np.int32)
                listed[1:] -= listed[:-1].copy()
                starts = rows[:-1] + np.arange(len(rows) - 1) * GAP
                row = [
                    [f"{part}-{number}"], [ids.slice(at, len(rows) - 1).to_pylist()], [np.diff(rows)], [starts], [term.view(np.int64)], [count],
                    [zlib.compress(listed.tobytes(), 1)],
                ]
                kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                yield pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds)], [c.split()[0] for c in INDEX.split(", ")])
                number += 1

    named = in_small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, INDEX)


def phrases(items: list[tuple], length: int = 10) -> dict[tuple, list]:
    """The windows of ``length`` terms of each (id, text), with the ids that have them. A shorter text is one window."""
    out: dict[tuple, list] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        found = _terms(raw, np.array([0, len(raw)]))[0].tolist()
        for i in range(max(1, len(found) - length + 1) if found else 0):
            holders = out.setdefault(tuple(found[i:i + length]), [])
            if item not in holders[-1:]:
                holders.append(item)
    return out


HITS = "array<struct<item_id:string,start:int,length:int,exact:boolean>>"


def search(index: DataFrame, items: list[tuple], length: int = 10, slop: int = 0) -> DataFrame:
    """One row per indexed document: ``shard, ordinal, doc_id, n_words, hits``.

    A hit is exact if every term of the phrase stands at its offset, and a proximity match if each
    stands within ``slop`` words of it. ``start`` counts the document's words from 0.
    """
    spark = index.sparkSession
    wanted = phrases(items, length)
    keys = sorted(wanted)
    terms = np.unique(np.array([t for k in keys for t in k], np.uint64))
    width = max([len(k) for k in keys], default=1)
    table_ = np.full((len(keys), width), len(terms), np.int64)  # beyond a short phrase: a term always there
    for i, k in enumerate(keys):
        table_[i, :len(k)] = np.searchsorted(terms, np.array(k, np.uint64))
    sent = spark.sparkContext.broadcast((terms, table_, [len(k) for k in keys], [[None if x is None else str(x) for x in wanted[k]] for k in keys]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, windows, sizes, holders = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda name: batch.column(name)[i]  # noqa: B023, E731
                have = np.asarray(cell("terms").values).view(np.uint64)
                counts, starts = np.asarray(cell("counts").values), np.asarray(cell("starts").values)
                n_words, ids = np.asarray(cell("n_words").values), cell("doc_ids").as_py()
                flat, ends = np.frombuffer(zlib.decompress(cell("postings").as_py()), np.int32), np.cumsum(counts)
                # differences run on through the lists
                flat = np.cumsum(flat, dtype=np.int64)
                place = np.searchsorted(have, terms)
                found = place < len(have)
                found[found] = have[place[found]] == terms[found]
                present = np.append(found, True)
                hits = [[] for _ in ids]
                for w in np.flatnonzero(present[windows].all(axis=1)):
                    lists = []
                    for offset, term in enumerate(windows[w, :sizes[w]]):
                        at = place[term]
                        lists.append((counts[at], offset, flat[ends[at] - counts[at]:ends[at]]))
                    lists.sort(key=lambda x: x[:2])  # the rarest first
                    begin = lists[0][2] - lists[0][1]
                    exact = np.ones(len(begin), bool)
                    for _, offset, positions in lists[1:]:
                        if not len(begin):
                            break
                        spot = np.searchsorted(positions, begin + offset - slop)
                        nearest = positions[np.minimum(spot, len(positions) - 1)]
                        near = np.abs(nearest - begin - offset) <= slop
                        if slop:
                            spot = np.searchsorted(positions, begin + offset)
                            exact &= positions[np.minimum(spot, len(positions) - 1)] == begin + offset
                        begin, exact = begin[near], exact[near]
                    row = np.searchsorted(starts, begin, "right") - 1
                    for b, r, e in zip(begin.tolist(), row.tolist(), exact.tolist()):
                        for item in holders[w]:
                            hits[r].append({"item_id": item, "start": b - int(starts[r]), "length": sizes[w], "exact": e})
                kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("exact", pa.bool_())]))
                yield pa.record_batch(
                    [pa.array([cell("shard").as_py()] * len(ids)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids, pa.int64()), pa.array(n_words.astype(np.int64)), pa.array(hits, kind)],
                    ["shard", "ordinal", "doc_id", "n_words", "hits"])

    return index.mapInArrow(run, f"shard string, ordinal int, doc_id long, n_words long, hits {HITS}")


def contamination(
    docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 0, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, hits``, searched in an index that is built and stored first.

    Words are runs of digits, lower-cased ASCII letters and characters beyond ASCII. Null and empty
    texts have no words and no hits; null and empty items, or an empty benchmark, match nothing.
    Repeated rows are indexed apart. Items with the same words all match. Hits come in no fixed order.
    """
    bench = items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    index = stored(build_index(docs, benchmark_terms(bench), doc_id, text), "positional-index")
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BENCHMARK_BLOCK) or 1
    out = None
    for k in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        found = search(index, [tuple(r) for r in block.sort("item_id").collect()], length, slop)
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        out = out.groupBy("shard", "ordinal", "doc_id", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return out.select("doc_id", "n_words", "hits")


def hit_counts(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, items``: words under exact hits, and the sorted ids of their items.

    An item with a null id hits words and is not listed.
    """
    exact = F.filter("hits", lambda h: h.getField("exact"))
    spans = F.array_sort(F.transform(exact, lambda h: F.struct(h.getField("start").alias("a"), (h.getField("start") + h.getField("length")).alias("b"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            (acc.getField("n") + F.greatest(F.lit(0), s.getField("b") - F.greatest(acc.getField("at"), s.getField("a")))).alias("n"),
            F.greatest(acc.getField("at"), s.getField("b")).alias("at")),
        lambda acc: acc.getField("n"))
    listed = F.array_sort(F.array_compact(F.array_distinct(F.transform(exact, lambda h: h.getField("item_id")))))
    return found.select("doc_id", "n_words", covered.alias("n_hit"), listed.alias("items"))


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", scanned: bool = False, **settings) -> DataFrame:
    """The rows of ``docs`` without an exact hit. Each row is judged by its own text, whatever its id ``doc_id``.

    Where ``docs`` is ``scanned`` from files no text is written again (see ``keyed``).
    """
    rows = keyed(docs, "documents-to-clean", scanned)
    hit = hit_counts(contamination(rows, items, doc_id=KEY, **settings)).where("n_hit > 0")
    hit = sized(stored(hit.select(F.col("doc_id").alias(KEY)), "contaminated"), MOST_DOCUMENTS)
    return rows.join(hit, KEY, "left_anti").select(*[f"`{c}`" for c in docs.columns])


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM item_words WHERE len(ws) > 0)
),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM words, lengths WHERE len(ws) >= n)
),
matches AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows w USING (phrase, n)),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM matches) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed
  FROM (SELECT DISTINCT doc_id, item_id FROM matches) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op5_positional_index", OP5_SQL)
def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hit_counts(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
