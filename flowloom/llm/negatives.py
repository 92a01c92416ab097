"""Hard negatives for every anchor, by inner product: one-bit codes bound each score, integers decide.

Index. Vectors are rotated at random, each keeps the signs of its rotated components as code, its norm,
and its alignment: the length of its projection on the code's direction o. With x = a*o + r, where r is
orthogonal to o and |r|^2 = |x|^2 - a^2, the product with a query q is a*<o,q> + <r,q>. The rotated
query is rounded to ``PLANES`` bit planes, so that <o,q> follows from popcounts of code and planes, up to
the known norm of the rounding error; and by Cauchy-Schwarz |<r,q>| <= |r| * |q - <o,q>o|. Both together
are an interval that holds the score for certain. Only pairs whose interval reaches into the result are
scored, in integers; so results are exact, and the codes only save work.

Anchors are a set of queries against all rows, in blocks: rows and anchors are packed into blocks of
bounded size, and every pair of blocks is one row of a join, whichever task it falls to. A pair of blocks
returns a few candidates per anchor; the best of them are found by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import query, stored, table

#: Vectors of a block; anchors of a block.
BLOCK, ANCHORS = 2000, 1000
#: Bits that a rotated query's components are rounded to.
PLANES = 6
#: Pairs of an anchor and a row that are handled at once.
PAIRS = 1 << 20
SEED = 20240229
LONGEST = (1 << 63) - 1


def rotation(width: int) -> np.ndarray:
    """An orthogonal matrix, drawn at random but the same everywhere."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


class Codes:
    """Signs of rotated vectors as 64-bit words, with what bounds their products."""

    def __init__(self, vectors: np.ndarray):
        width = vectors.shape[1]
        turned = vectors.astype(float) @ rotation(width)
        words = -(-width // 64)
        signs = np.zeros((len(vectors), words * 64), np.uint8)
        signs[:, :width] = turned >= 0
        self.width, self.bits = width, np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
        self.aligned = np.abs(turned).sum(axis=1) / np.sqrt(width)
        self.norm2 = (turned ** 2).sum(axis=1)
        self.residual = np.sqrt(np.maximum(self.norm2 - self.aligned ** 2, 0))


class Queries:
    """Rotated queries in bit planes."""

    def __init__(self, vectors: np.ndarray):
        width = vectors.shape[1]
        turned = vectors.astype(float) @ rotation(width)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint64)
        near = self.low[:, None] + level * self.step[:, None]
        self.total, self.norm2 = near.sum(axis=1), (turned ** 2).sum(axis=1)
        self.error = np.sqrt(((turned - near) ** 2).sum(axis=1))
        words = -(-width // 64)
        self.planes = []
        for k in range(PLANES):
            bits = np.zeros((len(vectors), words * 64), np.uint8)
            bits[:, :width] = (level >> np.uint64(k)) & np.uint64(1)
            self.planes.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))


def intervals(q: Queries, some: slice, x: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the products of some queries with all coded vectors."""
    def common(plane: np.ndarray) -> np.ndarray:
        out = np.zeros((len(plane), len(x.bits)), np.int32)
        for w in range(plane.shape[1]):
            out += np.bitwise_count(plane[:, w, None] & x.bits[None, :, w])
        return out

    col = lambda v: v[some][:, None]
    ones = np.bitwise_count(x.bits).sum(axis=1, dtype=np.int32)[None, :]
    above = sum((common(p[some]) << k for k, p in enumerate(q.planes)), start=np.zeros((1, 1), np.int32))
    # sum of the rounded query over the code's ones, twice, less its sum over all
    along = (2 * (col(q.low) * ones + col(q.step) * above) - col(q.total)) / np.sqrt(x.width)
    least = np.maximum(np.abs(along) - col(q.error), 0)
    rest = x.residual[None, :] * np.sqrt(np.maximum(col(q.norm2) - least ** 2, 0)) + x.aligned[None, :] * col(q.error)
    rest += 1e-9 * (1 + np.sqrt(col(q.norm2) * x.norm2[None, :]))  # rounding of this arithmetic
    middle = x.aligned[None, :] * along
    low, high = middle - rest, middle + rest
    # numbers too large to square bound nothing
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def products(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of rows i of a with rows j of x; those beyond a long stay at its ends."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if most < 2 ** 62:
        p, y = a.astype(np.int64), x.astype(np.int64)
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), 1 << 16):
            some = slice(k, k + (1 << 16))
            np.einsum("nd,nd->n", p[i[some]], y[j[some]], out=out[some])
        return out
    exact = ((sum(int(u) * int(v) for u, v in zip(a[m], x[n])) for m, n in zip(i, j)))
    return np.fromiter((max(-LONGEST, min(LONGEST, v)) for v in exact), np.int64, len(i))


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or minus infinity."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _first(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each owner by score, then smaller id."""
    order = np.lexsort((ids, -score, owner))
    owner = owner[order]
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
    return order[rank < k]


def _unpacked(row: dict, width: int) -> tuple[np.ndarray, ...]:
    ints = [np.frombuffer(row[c], np.int64) for c in ("uids", "ids", "groups")]
    kind = np.float32 if len(row["vectors"]) == 4 * row["n"] * width else np.float64
    return *ints, np.frombuffer(row["vectors"], kind).reshape(row["n"], width).astype(float)


def packed(vectors: DataFrame, size: int, width: int, extra: tuple = ()) -> tuple[DataFrame, int]:
    """Blocks of ``size`` vectors or so, ``uid, id, grp, v`` (and long columns) as bytes; and how many blocks there are.

    The rows are dealt out evenly, so no block grows with any group. Blocks are numbered from 0; one that
    comes out a little longer is two rows of one number.
    """
    names = {"uids": "uid", "ids": "id", "groups": "grp"} | {c: c for c in extra}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                column = lambda c: part.column(part.schema.get_field_index(c))
                flat = np.zeros((len(part), width))
                lists = column("v")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                inside = np.arange(width)[None, :] < sizes[:, None]
                flat[inside] = lists.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict(
                    {"n": pa.array([len(part)], pa.int32())}
                    | {k: pa.array([column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]) for k, c in names.items()}
                    | {"vectors": pa.array([(flat.astype(np.float32) if np.abs(flat).max(initial=0) < 1 << 24 else flat).tobytes()])})

    layout = "n int, " + ", ".join(f"{k} binary" for k in names) + ", vectors binary"
    pieces = max(1, -(-vectors.count() // size))
    rows = vectors.select("uid", "id", "grp", *extra, "v").repartition(pieces)
    return stored(rows.mapInArrow(pack, layout).withColumn("block", F.spark_partition_id()), "blocks"), pieces


def _pairs(rows: DataFrame, pieces: int, anchors: DataFrame) -> DataFrame:
    """Every block of rows beside every block of anchors: these are copied to each block's number, then met by it."""
    left = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "block"])
    spread = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return rows.join(spread.hint("merge"), "block")  # the copies are many: never a broadcast


def _scored(pairs: DataFrame, width: int, choose, names: str) -> DataFrame:
    """Candidates out of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in names.split()])
        for batch in batches:
            for row in batch.to_pylist():
                x = _unpacked(row, width)
                left = {k[2:]: v for k, v in row.items() if k.startswith("a_")}
                a = _unpacked(left, width)
                with np.errstate(over="ignore", invalid="ignore"):
                    found = [out for out in choose(left, a, Queries(a[3]), x, Codes(x[3])) if len(out[0])]
                for out in found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return pairs.mapInArrow(run, ", ".join(f"{c} long" for c in names.split()))


def _chunks(n_queries: int, n_rows: int) -> Iterator[slice]:
    step = max(1, PAIRS // max(n_rows, 1))
    for at in range(0, n_queries, step):
        yield slice(at, min(at + step, n_queries))


def _positive_choice(k: int):
    def choose(left, a, q, x, codes):
        uid, ids, groups, vectors = x
        for some in _chunks(len(a[0]), len(uid)):
            fit = (groups[None, :] == a[2][some, None]) & (uid[None, :] != a[0][some, None])
            low, high = intervals(q, some, codes)
            # k rows reach the k-th best lower bound for certain; whatever stays below it is out.
            bar = _kth(np.where(fit, low, -np.inf), k)
            i, j = np.nonzero(fit & (high >= bar[:, None]))
            i += some.start
            score = products(a[3], vectors, i, j)
            best = _first(i, score, ids[j], k)
            i, j = i[best], j[best]
            yield a[0][i], ids[j], uid[j], score[best]

    return choose


def _negative_choice(k: int, most: int, floor: int, whole: int):
    def choose(left, a, q, x, codes):
        uid, ids, groups, vectors = x
        tops = np.frombuffer(left["tops"], np.int64).reshape(len(a[0]), most)
        for some in _chunks(len(a[0]), len(uid)):
            other = groups[None, :] != a[2][some, None]
            low, high = intervals(q, some, codes)
            wanted = np.zeros(other.shape, bool)
            spans = []
            for p in range(most):
                top = tops[some, p]
                given = top > -LONGEST
                # floor * top <= whole * score <= whole * top
                under = floor / whole * top.astype(float)
                slack = 1e-9 * (1 + np.abs(under))
                fit = other & given[:, None] & (high >= (under - slack)[:, None]) & (low <= (top + 1e-9 * np.abs(top))[:, None])
                sure = fit & (low >= (under + slack)[:, None]) & (high <= (top - 1e-9 * np.abs(top))[:, None])
                bar = _kth(np.where(sure, low, -np.inf), k)
                fit &= high >= bar[:, None]
                wanted |= fit
                spans.append((top, given))
            i, j = np.nonzero(wanted)
            score = products(a[3], vectors, i + some.start, j)
            for p, (top, given) in enumerate(spans):
                fits = _within(score, top[i], floor, whole) & given[i]
                m, n, s = i[fits], j[fits], score[fits]
                best = _first(m, s, ids[n], k)
                yield a[0][m[best] + some.start], np.full(len(best), p), ids[n[best]], s[best]

    return choose


def _within(score: np.ndarray, top: np.ndarray, floor: int, whole: int) -> np.ndarray:
    """floor * top <= whole * score and score <= top, without overflow."""
    if max(np.abs(score).max(initial=0), np.abs(top).max(initial=0)) < 2 ** 52:
        return (floor * top <= whole * score) & (score <= top)
    return np.fromiter((floor * int(t) <= whole * int(s) and s <= t for s, t in zip(score, top)), bool, len(score))


def hard_negatives(
    vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 5, floor: int = 80, whole: int = 100, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says which rows are anchors. Each component becomes floor(scale * component), a score is
    the integer product with the anchor. An anchor's positives are its first ``positives`` other rows of
    its label; the negatives of a positive are the first ``negatives`` rows of other labels with a score
    from ``floor``/``whole`` of the positive's to all of it. Higher scores come first, then smaller ids.

    Rows with a null id or label, a null vector or a null or non-finite component take no part. Shorter
    vectors end in zeros. Rows that repeat an id are rows of their own, so an anchor may have its own id
    as a positive. Scores beyond a long stay at its ends. No rows or no anchors: no result.
    """
    c = lambda n: F.col(f"`{n}`")
    fine = F.forall(c(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    # beyond 2^53 all doubles are whole
    scaled = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    rows = vectors.where(c(vec_id).isNotNull() & c(label).isNotNull() & c(vector).isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("uid"), c(vec_id).cast("long").alias("id"), c(label).cast("long").alias("grp"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(c(vector), lambda v: scaled(v.cast("double") * scale)).alias("v"))
    rows = stored(rows, "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    anchors = rows.where("anchor")
    index = packed(rows, BLOCK, width)
    near = _scored(_pairs(*index, packed(anchors, ANCHORS, width)[0]), width, _positive_choice(positives), "uid id other score")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "id", "other")
    near = stored(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    tops = near.groupBy("uid").agg(*[
        F.coalesce(F.max(F.when(F.col("place") == p + 1, F.col("score"))), F.lit(-LONGEST)).alias(f"top{p}") for p in range(positives)])
    known = anchors.join(tops, "uid")
    asked = _with_tops(known, width, positives)
    far = _scored(_pairs(*index, asked), width, _negative_choice(negatives, positives, floor, whole), "uid place id score")
    order = Window.partitionBy("uid", "place").orderBy(F.desc("score"), "id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return far.select("uid", (F.col("place") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        near.select("uid", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["uid", "place"]).join(
        anchors.select("uid", F.col("id").alias("anchor_id")), "uid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _with_tops(anchors: DataFrame, width: int, most: int) -> DataFrame:
    """Blocks of anchors that carry the scores of their positives as a further array."""
    names = tuple(f"top{p}" for p in range(most))
    blocks, _ = packed(anchors, ANCHORS, width, names)

    def woven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            tops = [np.stack([np.frombuffer(r[n], np.int64) for n in names], axis=1).tobytes() for r in rows]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("n", "uids", "ids", "groups", "vectors")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(tops, pa.binary())], names=["n", "uids", "ids", "groups", "vectors", "tops"])

    return blocks.mapInArrow(woven, "n int, uids binary, ids binary, groups binary, vectors binary, tops binary")


OP11_SQL = """
WITH kept AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS other_id, a.label = x.label AS alike, CAST(list_dot_product(a.v, x.v) AS BIGINT) AS score
  FROM kept a JOIN kept x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", changed), F.col("vec_id") % 100 == 0)
