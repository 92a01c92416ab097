"""Language identification by language-bitmask n-gram filters.

One Bloom filter serves all languages: a slot holds a bit per language, so that the slots of an n-gram,
taken together by AND, give every language that has it at one look. A text's n-grams are looked up,
the hits of each language are counted, and the counts are corrected for the filter's false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import in_small_batches, query, stored, table
from .units import mixed

U64 = np.uint64
#: Characters of text that are looked at together.
CHUNK = 1 << 20
LETTERS = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not LETTERS[97]:
        LETTERS[:] = [chr(c).isalpha() for c in range(0x110000)]
    return LETTERS


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        yield at, texts[at:stop]
        at = stop


def letter_grams(texts: list[str], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text's words, the text of each, and whether each text has letters.

    Words are runs of letters with a boundary on both sides; an n-gram lies in one word.
    """
    whole = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    row = np.repeat(np.arange(len(texts) + 1), [1, *[len(t) + 1 for t in texts]])[:len(points)]
    row = np.maximum(row - 1, 0)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # a run of other characters leaves one boundary
    kept[0] = True
    symbols, row = np.where(letter, points, 0)[kept].astype(U64), row[kept]
    has = np.zeros(len(texts), bool)
    has[row[symbols > 0]] = True
    grams, rows = [], []
    for n in orders:
        m = len(symbols) - n + 1
        if m <= 0:
            continue
        h, inner = np.full(m, n, U64), np.ones(m, bool)
        for j in range(n):
            part = symbols[j:j + m]
            h = mixed(h ^ (part * U64(0x9E3779B97F4A7C15)))
            if 0 < j < n - 1:
                inner &= part > 0
        # the boundary in front of a text's first word belongs to the text before it
        grams.append(h[inner])
        rows.append(row[1:m + 1][inner])
    return np.concatenate(grams or [np.zeros(0, U64)]), np.concatenate(rows or [np.zeros(0, np.int64)]), has


@dataclass
class LanguageFilter:
    """``planes[p, slot]`` has bit b set if language 64 p + b may have an n-gram of that slot."""

    languages: list[str]
    planes: np.ndarray
    orders: tuple[int, ...]
    hashes: int

    @classmethod
    def build(cls, languages: list[str], of: np.ndarray, grams: np.ndarray, orders: tuple[int, ...], hashes: int = 4) -> LanguageFilter:
        slots = 1 << max(10, int(8 * len(np.unique(grams))).bit_length())
        planes = np.zeros((max(1, -(-len(languages) // 64)), slots), U64)
        out = cls(languages, planes, orders, hashes)
        for place in out.places(grams):
            np.bitwise_or.at(planes, (of // 64, place), U64(1) << (of % 64).astype(U64))
        return out

    def places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        step, size = mixed(grams) | U64(1), U64(self.planes.shape[1] - 1)
        for k in range(self.hashes):
            yield ((grams + U64(k) * step) >> U64(7)) & size

    def false_positives(self) -> np.ndarray:
        """Per language, the chance that an n-gram it lacks is reported: its share of set slots, for each hash."""
        share = [np.mean((self.planes[i // 64] >> U64(i % 64)) & U64(1)) for i in range(len(self.languages))]
        return np.array(share) ** self.hashes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of lower-cased texts; ``und`` and 0 where there are no letters or no languages.

        The score is the language's share of all corrected counts. A tie goes to the first language.
        """
        grams, row, has = letter_grams(texts, self.orders)
        n = np.bincount(row, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        for p in range(len(self.planes)):
            masks = np.full(len(grams), ~U64(0), U64)
            for place in self.places(grams):
                masks &= self.planes[p][place]
            for b in range(min(64, len(self.languages) - 64 * p)):
                hits[:, 64 * p + b] = np.bincount(row, (masks >> U64(b)) & U64(1), len(texts))
        wrong = self.false_positives() if len(self.languages) else np.zeros(0)
        true = np.maximum(hits - n[:, None] * wrong, 0) / np.maximum(1 - wrong, 1e-9)
        if not len(self.languages):
            return ["und"] * len(texts), np.zeros(len(texts))
        best, total = true.argmax(axis=1), true.sum(axis=1)
        score = np.where(has & (total > 0), true.max(axis=1) / np.maximum(total, 1e-12), 0.0)
        return [self.languages[b] if h else "und" for b, h in zip(best, has)], score


def fit(
    labelled: DataFrame, orders: tuple[int, ...] = (3, 4), rows_per_language: int = 4000, per_language: int = 40_000,
    share: float = 0.1, text: str = "text", lang: str = "lang", key: str = "doc_id",
) -> LanguageFilter:
    """The filter learned from texts with a language; rows without either are not used.

    Learning is bounded by ``rows_per_language``: of a language with more rows, those with the least
    hash of ``key``, about that many. Texts are used whole. A language has its ``per_language``
    most frequent n-grams, but for those that are more frequent elsewhere by a factor of ``1 / share``.
    """
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.lower(F.col(f"`{text}`")).alias("text"), F.col(f"`{key}`").cast("string").alias("key"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros((1, 1024), U64), orders, 4)
    part = F.pmod(F.xxhash64(F.coalesce("key", F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    limit = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / sizes[k]))]), F.col("lang"))
    rows = rows.where(part < limit).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby("lang"):
                for _, texts in _chunks(own["text"].tolist()):
                    gram, n = np.unique(letter_grams(texts, orders)[0], return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": gram.view(np.int64), "n": n})

    counts = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "gram-counts")
    totals = counts.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), F.col("lang") == F.col("of")).withColumn("rate", F.col("n") / F.col("total"))
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
    usual = rates.join(most, "gram").where(F.col("rate") >= share * F.col("most"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = usual.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(per_language, 4_000_000 // len(languages)))
    got = top.select("lang", "gram").toPandas()
    index = {x: i for i, x in enumerate(languages)}
    return LanguageFilter.build(languages, got["lang"].map(index).to_numpy(np.int64), got["gram"].to_numpy(np.int64).view(U64), orders)


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """The columns of ``docs``, which may not include ``lang_pred`` and ``score``, and those two.

    Only the text is looked at. Null and letterless texts are ``und`` with score 0.
    """
    sent = in_small_batches(docs).sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != text]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = pc.fill_null(pc.utf8_lower(batch.column(at)), "").to_pylist()
            langs, scores = [], []
            for _, chunk in _chunks(texts):
                lang, score = sent.value.predict(chunk)
                langs += lang
                scores.append(score)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())]
            yield pa.record_batch(columns, [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{kinds}{', ' if kinds else ''}lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning: a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
