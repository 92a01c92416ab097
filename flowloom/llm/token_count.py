"""Token counts by separator scan.

A flat token file is nothing but token ids of fixed width, with a separator behind each document.
Blocks of it are searched for the separator as arrays, each on its own. A block reports the tokens
before its first separator, between separators, and behind its last one; what a document has in
earlier blocks is added by a prefix scan over the reports.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import units
from .common import in_small_batches, query, stored, table

#: Id of the separator, and ids that words are hashed to, 1 to this less 1, when no tokenizer is given.
END, VOCABULARY = 0, 1 << 17
#: Bytes of a block.
BLOCK = 1 << 20


def write_tokens(docs: DataFrame, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as flat token streams, one per task, cut into blocks without regard to documents.

    ``file, block, data, doc_ids``: 32-bit ids, and beside them the ids of the documents that end in the
    block, which the scan does not see. Tokens are words, hashed into a vocabulary. A null or empty
    text is a separator alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, number, size = f"part-{TaskContext.get().partitionId():05d}", 0, block // 4
        rest, ends, ids = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

        def cut(n):
            nonlocal rest, ends, ids, number
            done = int(np.searchsorted(ends, n))
            out = pa.record_batch(
                [[file], pa.array([number], pa.int32()), [rest[:n].tobytes()], pa.array([ids[:done]], pa.list_(pa.int64()))],
                ["file", "block", "data", "doc_ids"])
            rest, ends, ids, number = rest[n:], ends[done:] - n, ids[done:], number + 1
            return out

        for batch in batches:
            names = batch.column("doc_id")
            for at, data, bounds in units.blocks(batch, "text"):
                starts, stops, rows = units.word_bounds(data, bounds)
                token = (units.word_hashes(data, starts, stops) % units.U64(VOCABULARY - 1)).astype(np.uint32) + 1
                ends = np.append(ends, len(rest) + rows[1:] + np.arange(len(rows) - 1))
                rest = np.append(rest, np.insert(token, rows[1:], END))
                ids += names.slice(at, len(rows) - 1).to_pylist()
                while len(rest) >= size:
                    yield cut(size)
        if len(rest):
            yield cut(len(rest))

    named = in_small_batches(docs).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, "file string, block int, data binary, doc_ids array<long>")


def read_tokens(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Flat token files as blocks: ``file, block, data``. Files hold up to 2 GB each, the limit of a binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                raw = memoryview(content.as_buffer())
                for k in range(0, len(raw), block):
                    yield pa.record_batch([[file.as_py()], pa.array([k // block], pa.int32()), [raw[k:k + block].tobytes()]], ["file", "block", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, block int, data binary")


def count_tokens(blocks: DataFrame, end: int = END, dtype: str = "<u4") -> DataFrame:
    """One row per document of ``file, block, data``: ``file, document, block, place, n_tokens, ended``.

    ``document`` counts the file's documents from 0; ``block`` and ``place`` say where it ends. Tokens
    behind a file's last separator are a document that is not ``ended``, if there are any. Two
    separators in a row enclose a document of no tokens. An empty table gives no rows. A block whose
    size is not a multiple of the width of ``dtype`` is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column("data"):
                tokens = np.frombuffer(data.as_buffer() if data.is_valid else b"", dtype)
                at = np.flatnonzero(tokens == end)
                head = int(at[0]) if len(at) else 0
                found.append((head, np.diff(at) - 1, len(tokens) - 1 - int(at[-1]) if len(at) else len(tokens), len(at)))
            head, inner, tail, n = zip(*found) if found else ((), (), (), ())
            yield pa.record_batch(
                [batch.column("file"), batch.column("block"), pa.array(head, pa.int64()), pa.array(inner, pa.list_(pa.int64())), pa.array(tail, pa.int64()), pa.array(n, pa.int64())],
                ["file", "block", "head", "inner", "tail", "ends"])

    reports = blocks.select("file", "block", "data").mapInArrow(run, "file string, block int, head long, inner array<long>, tail long, ends long")
    order = Window.partitionBy("file").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # blocks since and with the last separator make up one stretch, whose tails add up
    stretch = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    scanned = (
        reports.withColumn("stretch", F.count_if(F.col("ends") > 0).over(upto))
        .withColumn("open", F.sum("tail").over(stretch))
        .withColumn("carried", F.coalesce(F.lag("open").over(order), F.lit(0)))
        .withColumn("before", F.sum("ends").over(upto) - F.col("ends"))
        .withColumn("last", F.lead("block").over(order).isNull())
    )
    closed = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), "inner")).otherwise(F.array().cast("array<long>"))
    done = scanned.select("file", "block", "before", F.posexplode(closed).alias("place", "n_tokens"), F.lit(True).alias("ended"))
    left = scanned.where("last and open > 0").select(
        "file", "block", "before", F.col("ends").cast("int").alias("place"), F.col("open").alias("n_tokens"), F.lit(False).alias("ended"))
    return done.unionByName(left).select("file", (F.col("before") + F.col("place")).alias("document"), "block", "place", "n_tokens", "ended")


OP9_SQL = r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents"


@query("op9_separator_scan", OP9_SQL)
def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(write_tokens(table(spark, sf_dir, "documents")), "token-files")
    names = files.select("file", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    return count_tokens(files).join(names, ["file", "block", "place"]).select("doc_id", "n_tokens")
