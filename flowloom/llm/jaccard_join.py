"""N-gram Jaccard join: size-aware, with light and heavy sets.

A document is its set of word shingles. Sets that agree to ``percent`` share two tokens of their
prefixes, and one of shorter prefixes. Light sets, up to a boundary, are joined on the fixed-size
subsets (pairs) of their prefix; heavy ones scan the inverted lists of their prefix tokens. The
boundary is the size at which pairs would cost more rows than scans.

All orders of tokens give the same links. Frequent tokens are put last, to keep lists short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import units
from .common import KEY, in_small_batches, keyed, query, sized, stored, table
from .graph import components

U64 = np.uint64
#: Ids up to which a table of them is broadcast.
MOST_IDS = 1_000_000
#: Tokens of lists that are searched, up to which a table of them is broadcast.
MOST_LISTS = 3_000_000
#: Before lists are searched: rounds in which sets are tied by a least token, to so many of those that
#: have it; and orders of tokens whose least ones are compared first.
ROUNDS, HEADS, ORDERS = 3, 12, 16
#: Least words of 64 bits of a set's parities. Entries of one list on the left of a task, above which it is dealt to several.
WORDS, LIST_PART = 8, 1_000
#: Two hashes of a token for two hashes of its set.
NODE, CHECK = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: Frequent tokens that are put last, by falling count, and what is counted as frequent: in a batch, in all.
MOST_FREQUENT, IN_BATCH, IN_ALL = 1_000_000, 3, 32


def _sets(data: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; what has fewer words is one shingle."""
    lowered = units.LOWER[data]
    starts, ends, rows = units.word_bounds(lowered, bounds)
    hashes, cuts = units.grams(units.word_hashes(lowered, starts, ends), rows, size)
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, U64).view(np.int64))


def _node(s: np.ndarray) -> int:
    """A set's name: a sum of mixed token hashes."""
    return int(units.mixed(s ^ NODE).sum(dtype=U64))


def _parities(sets: list[np.ndarray]) -> pa.Array:
    """For each set, whether each of its slots holds an odd number of its tokens, as 64-bit words.

    There is a slot for each token at least, their number being ``64 * WORDS`` or that doubled several
    times: folded to the fewer slots, two sets differ in at least as many tokens as slots of theirs differ.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    slots = 64 * WORDS << np.ceil(np.log2(np.maximum(sizes / (64 * WORDS), 1))).astype(np.int64)
    ends = np.cumsum(slots)
    slot = (np.concatenate(sets) >> U64(32)).astype(np.int64) % np.repeat(slots, sizes) if sets else np.zeros(0, np.int64)
    odd = np.bincount(np.repeat(ends - slots, sizes) + slot, minlength=slots.sum()) & 1
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends // 64), pa.int32()), _long(np.packbits(odd.astype(np.uint8)).view(U64)))


def _folded(odd: Column, words: Column) -> Column:
    """Parities of fewer slots: as many words as asked for, a power of two of them."""
    return F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.aggregate(
        F.sequence(i, F.size(odd) - 1, words), F.lit(0).cast("long"), lambda all, j: all.bitwiseXOR(F.get(odd, j))))


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``a, b`` of nodes whose parities do not show that too many tokens differ. No link is dropped."""
    two = pairs
    for x in "ab":
        two = two.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")), x)
    words = F.least(F.size("odd_a"), F.size("odd_b"))
    apart = F.zip_with(_folded(F.col("odd_a"), words), _folded(F.col("odd_b"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    differ = F.aggregate(apart, F.lit(0).cast("long"), lambda all, k: all + k)
    return two.where((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, node, check, lows, odd``: set size, two hashes of the set, its least token in ``ORDERS`` orders, parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in units.blocks(batch, "text"):
                sets = _sets(data, bounds, size)
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                columns = np.zeros((2 + ORDERS, len(sets)), U64)
                if len(some):
                    tokens, first = np.concatenate(sets), (np.cumsum(n) - n)[some]
                    columns[0, some] = np.add.reduceat(units.mixed(tokens ^ NODE), first)
                    columns[1, some] = np.add.reduceat(units.mixed(tokens ^ CHECK), first)
                    for k in range(ORDERS):
                        columns[2 + k, some] = np.minimum.reduceat(units.mixed(tokens ^ U64(k)), first)
                each = lambda k, values: pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * k, pa.int32()), _long(values.ravel()))  # noqa: B023, E731
                yield pa.record_batch(
                    [batch.column("doc_id").slice(at, len(sets)), pa.array(n), _long(columns[0]), _long(columns[1]),
                     each(ORDERS, columns[2:].T), _parities(sets)],
                    ["doc_id", "n", "node", "check", "lows", "odd"])

    return docs.mapInArrow(run, "doc_id long, n long, node long, check long, lows array<long>, odd array<long>")


def frequent_tokens(docs: DataFrame, size: int) -> np.ndarray:
    """Tokens in many sets, at most ``MOST_FREQUENT``; counted over all texts, in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [s for _, data, bounds in units.blocks(batch, "text") for s in _sets(data, bounds, size)]
            token, n = np.unique(np.concatenate(held) if held else np.zeros(0, U64), return_counts=True)
            often = n >= IN_BATCH
            yield pa.record_batch([_long(token[often]), pa.array(n[often])], ["token", "n"])

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= IN_ALL).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT)
    return np.sort(np.array([r[0] for r in top.select("token").collect()], np.int64).view(U64))


def _entries(docs: DataFrame, size: int, percent: int, frequent, light: int) -> DataFrame:
    """``token, single, at, node, n, comp``: prefix tokens of heavy sets, with their place, and pairs of them of light sets.

    Light sets close enough to the boundary to match a heavy one have entries of both kinds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in batches:
            comps = batch.column("comp").to_pylist()
            for at, data, bounds in units.blocks(batch, "text"):
                out = []
                for i, s in enumerate(_sets(data, bounds, size)):
                    n = len(s)
                    if n < 3:  # such sets match equal ones only, which are one node
                        continue
                    if len(late):
                        spot = np.minimum(np.searchsorted(late, s), len(late) - 1)
                        last = late[spot] == s
                        s = np.concatenate([s[~last], s[last]])
                    node = np.int64(np.array(_node(s), U64).view(np.int64))
                    comp = node if comps[at + i] is None else comps[at + i]
                    prefix = n + (-percent * n // 100) + 1
                    if 100 * n >= percent * light:
                        out.append((s[:prefix], True, node, n, comp, np.arange(prefix)))
                    if n <= light:
                        a, b = np.triu_indices(prefix + 1 if prefix < n else n, 1)
                        out.append((units.mixed(s[a] * U64(0x9E3779B97F4A7C15) + units.mixed(s[b])), False, node, n, comp, np.zeros(len(a), np.int64)))
                if out:
                    k = [len(x[0]) for x in out]
                    column = lambda j, kind: pa.array(np.repeat(np.array([x[j] for x in out], kind), k))  # noqa: B023, E731
                    yield pa.record_batch([_long(np.concatenate([x[0] for x in out])), column(1, bool), column(2, np.int64), column(3, np.int32), column(4, np.int64), pa.array(np.concatenate([x[5] for x in out]), pa.int32())], ["token", "single", "node", "n", "comp", "at"])

    return docs.select("text", "comp").mapInArrow(run, "token long, single boolean, node long, n int, comp long, at int")


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, percent: int, unique: bool) -> DataFrame:
    """Those pairs ``a, b`` of nodes whose sets agree to ``percent``, compared whole.

    A pair takes both sets along, so the parities are compared first.
    """
    ends = lambda pairs: pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    own = stored(nodes.join(sized(stored(ends(pairs), "pair-nodes"), MOST_IDS), "node", "left_semi").select("node", "rep", "n", "odd"), "pair-parities")
    pairs = stored(_alike(pairs, own, percent), "near-pairs")
    ids = sized(stored(own.join(ends(pairs), "node", "left_semi").select(F.col("rep").alias("of")).distinct(), "pair-ids"), MOST_IDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in units.blocks(batch, "text"):
                sets = _sets(data, bounds, size)
                values = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(s) for s in sets])), pa.int32()), _long(np.concatenate(sets)))
                yield pa.record_batch([_long([_node(s) for s in sets]), values], ["node", "tokens"])

    texts = docs.join(ids, docs.doc_id == ids.of, "left_semi")
    sets = texts.select("text").mapInArrow(run, "node long, tokens array<long>")
    sets = stored(sets, "pair-sets")
    if not unique:  # an id repeats: a node may be there twice
        sets = sets.dropDuplicates(["node"])
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("left")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("right")), "b")
    both = F.size(F.array_intersect("left", "right"))
    return two.where(100 * both >= percent * (F.size("left") + F.size("right") - both)).select("a", "b")


def _stars(nodes: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs to try: nodes with one least token in order ``k``, tied to ``HEADS`` of them in two steps of bounded width.

    Linear in the nodes. Whom they are tied to depends on hashes alone. Pairs within a component
    ``comp`` are left out, and those that share few of their other least tokens.
    """
    low = F.get("lows", F.lit(k)).alias("low")
    whole = ["n", "node", "comp", "lows"]
    first = lambda j: F.min(F.struct(F.xxhash64("low", "node", F.lit(j)).alias("turn"), *whole)).alias(f"h{j}")
    rows = nodes.select(low, F.shiftrightunsigned("node", 56).alias("slot"), *whole)
    # a node whose least token is no other node's is tied to itself only
    shared = sized(stored(rows.groupBy("low").count().where("count > 1").select("low"), "shared-tokens"), MOST_LISTS)
    rows = rows.join(shared, "low", "left_semi")

    def heads(df: DataFrame, *by: str) -> DataFrame:
        found = df.groupBy(*by).agg(*[first(j) for j in range(HEADS)])
        each = found.select(*by, F.explode(F.array_distinct(F.transform(
            F.array(*[f"h{j}" for j in range(HEADS)]), lambda h: h.dropFields("turn")))).alias("head"))
        return each

    def tied(df: DataFrame, to: DataFrame, *by: str) -> DataFrame:
        return df.join(to, list(by)).select(*whole, "head")

    near = heads(rows, "low", "slot")
    flat = near.select("low", "slot", "head.*")
    pairs = tied(rows, near, "low", "slot").union(tied(flat, heads(flat, "low"), "low"))
    head = F.col("head")
    alike = F.size(F.filter(F.zip_with("lows", head["lows"], lambda x, y: x == y), lambda same: same))
    fits = 100 * F.least(F.col("n"), head["n"]) >= percent * F.greatest(F.col("n"), head["n"])
    pairs = pairs.where(fits & (F.col("comp") != head["comp"]) & (100 * alike >= (percent - 15) * ORDERS))
    return pairs.select(F.least("node", head["node"]).alias("a"), F.greatest("node", head["node"]).alias("b")).distinct()


def boundary(nodes: DataFrame, percent: int) -> int:
    """The largest size at which sets are light: up to there, pairs of prefix tokens are the cheaper way.

    A light set of prefix p costs its p (p + 1) / 2 pairs, a heavy one p entries and the scan of their
    lists. The mean length of a list is that of the lists of least tokens, each set having one.
    """
    n, lists = nodes.agg(F.count("*"), F.approx_count_distinct(F.get("lows", F.lit(0)))).first()
    scan = 1 + n / max(lists, 1)
    sizes = sorted((r["n"], r["count"]) for r in nodes.groupBy("n").count().collect())
    best, total, least = 0, 0.0, 0.0
    for size, many in sizes:
        p = size + (-percent * size // 100) + 1
        total += many * (p * (p + 1) / 2 - p * scan)
        if total < least:
            best, least = size, total
    return best


def _met(lists: DataFrame, nodes: DataFrame, percent: int, light: int) -> DataFrame:
    """``a, b``: nodes of different components that meet in a list and may agree to ``percent``; may repeat.

    A pair is made only where the sizes allow the overlap, the parities of the sets do not show that too
    many tokens differ, and the token lies in both of the prefixes that the overlap of these two sizes
    leaves, shorter than those listed. Two light sets meet by pairs of tokens alone. None of these tests
    drops a link. A list of more than ``LIST_PART`` entries is dealt to several tasks.
    """
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    odd = nodes.select("node", _folded(F.col("odd"), F.lit(WORDS)).alias("odd"))
    odd = lists.select("node").distinct().join(odd, "node").dropDuplicates(["node"])
    entries = stored(lists.join(odd, "node"), "list-entries")

    def dealt(df: DataFrame, *by: Column) -> DataFrame:
        words = [F.get("odd", F.lit(k)).alias(f"odd{k}") for k in range(WORDS)]
        return df.select("token", "single", *by, "node", "n", "comp", "at", *words).repartition(tasks, "token", "single", *["part" for _ in by])

    def meet(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
        side = lambda df, x: df.select(*by, *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in by])
        return side(left, "a").join(side(right, "b"), list(by)).where(possible).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    both = F.col("n_a") + F.col("n_b")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    overlap = F.ceil(percent * both / (100 + percent))
    early = (F.col("at_a") <= F.col("n_a") - overlap) & (F.col("at_b") <= F.col("n_b") - overlap)
    placed = F.when(F.col("single"), early & (F.greatest("n_a", "n_b") > light)).otherwise(True)
    differ = sum((F.bit_count(F.col(f"odd{k}_a").bitwiseXOR(F.col(f"odd{k}_b"))) for k in range(WORDS)), F.lit(0))
    close = (100 + percent) * differ <= (100 - percent) * both
    possible = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & fits & placed & close
    # where a list is not dealt, both sides are one shuffle
    whole, long = dealt(entries.where("parts = 1")), entries.where("parts > 1")
    left = dealt(long, F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    right = dealt(long, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return meet(whole, whole, "token", "single").union(meet(left, right, "token", "single", "part"))


def jaccard_groups(
    docs: DataFrame, percent: int = 75, size: int = 5, doc_id: str = "doc_id", text: str = "text", light: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two documents link if 100 times their common shingles are at least ``percent`` times all their
    shingles; ``component_id`` is the least id that links lead to. Words are lower-cased in ASCII.
    Documents with no text or no words have an empty set and link with nothing, so are alone. Equal
    sets are one node. Rows that repeat an id are documents of their own. A null id is larger than all
    others and comes back as null. An empty table gives no rows. Other columns are not looked at.

    First, in a few rounds, the nodes of one least token are tied to one of them, and compared: each
    round in another order of the tokens, and without what is one component by then. Then lists are
    searched for pairs of different components only: a list within one component is dropped before
    any pair is made, and a pair goes on to be compared only if it passes the tests of ``_met``. Every link is either found or lies within a component.
    """
    last = (1 << 63) - 1
    texts = in_small_batches(docs).select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(last)).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    spark = docs.sparkSession
    signed = stored(signatures(texts, size), "shingle-sets")
    nodes = stored(signed.where("n > 0").groupBy("node", "check").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("lows").alias("lows"), F.first("odd").alias("odd")), "set-nodes")
    # Texts of nodes only: ids under which no node is represented are copies.
    of = signed.where("n > 0").select("doc_id").distinct().join(nodes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_anti")
    copies = sized(stored(of.withColumnRenamed("doc_id", "copy"), "copies"), MOST_IDS)
    texts = texts.join(copies, texts.doc_id == copies.copy, "left_anti")

    repeated = stored(signed.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("of")), "repeated-ids")
    unique = repeated.isEmpty()
    edges, known = None, nodes.drop("odd").withColumn("comp", F.col("node"))
    for k in range(ROUNDS):
        pairs = stored(_stars(known, percent, k), "pairs")
        if pairs.isEmpty():
            continue
        found = _verified(texts, pairs, nodes, size, percent, unique)
        edges = stored(found if edges is None else edges.union(found), "links")
        roots = components(edges)
        known = stored(nodes.drop("odd").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "known-components")
    edges = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false") if edges is None else edges
    comps = known.where("comp != node").select(F.col("rep").alias("of"), "comp")
    if not unique:  # one id, several sets: no component is known by id there
        comps = comps.join(repeated, "of", "left_anti")
    comps = sized(stored(comps, "component-ids"), MOST_IDS)
    labelled = texts.join(comps, texts.doc_id == comps.of, "left").drop("of")

    limit = boundary(nodes, percent) if light is None else light
    frequent = spark.sparkContext.broadcast(frequent_tokens(texts, size))
    entries = _entries(labelled, size, percent, frequent, limit)
    mixed = entries.groupBy("token").agg(
        F.min("comp").alias("one"), F.max("comp").alias("other"), F.ceil(F.count("*") / LIST_PART).cast("int").alias("parts")).where("one < other")
    mixed = sized(stored(mixed.select("token", "parts"), "mixed-lists"), MOST_LISTS)
    lists = stored(entries.join(mixed, "token"), "lists")
    met = _met(lists, nodes, percent, limit)
    pairs = stored(met.select("a", "b").distinct(), "pairs")
    more = _verified(texts, pairs, nodes, size, percent, unique)
    final = stored(components(edges.union(stored(more, "links"))), "components")

    grouped = signed.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = grouped.where("n > 0")
    least = linked.groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("component_id"))
    out = linked.join(least, F.col("root") == F.col("of")).select("doc_id", "n", "component_id")
    out = out.union(grouped.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    null = lambda c: F.when(F.col(c) != last, F.col(c)).alias(c)
    return out.select(null("doc_id"), F.col("n").alias("n_shingles"), null("component_id"))


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs`` that bear the least id of their group; of rows that repeat an id, one.

    Rows without an id cannot be told apart and all stay. See ``one_of_each_group`` for rows whose ids
    may repeat or be missing.
    """
    groups = jaccard_groups(docs, doc_id=doc_id, **settings)
    later = groups.where("component_id < doc_id").select(F.col("doc_id").alias("later_id"))
    firsts = groups.where("component_id = doc_id").select(F.col("doc_id").alias("later_id"))
    gone = sized(stored(later.join(firsts, "later_id", "left_anti").distinct(), "later-copies"), MOST_IDS)
    kept = docs.join(gone, docs[f"`{doc_id}`"] == gone.later_id, "left_anti")
    once = groups.groupBy("doc_id").count().where("count > 1 and doc_id is not null")
    if once.isEmpty():
        return kept
    named = kept.where(F.col(f"`{doc_id}`").isNotNull()).dropDuplicates([doc_id])
    return named.unionByName(kept.where(F.col(f"`{doc_id}`").isNull()))


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", scanned: bool = False, **settings) -> DataFrame:
    """One row of ``docs`` of each group: the one with the least id, null last; of equal ids, one of the rows.

    Groups are of rows: different texts of one id, or without one, all stay, and near copies of each
    other without an id leave one. Where ``docs`` is ``scanned`` from files no text is written again
    (see ``keyed``).
    """
    rows = keyed(docs, "documents-to-group", scanned)
    groups = jaccard_groups(rows, doc_id=KEY, **settings).select(F.col("doc_id").alias(KEY), F.col("component_id").alias("of"))
    ids = rows.select(KEY, F.col(f"`{doc_id}`").alias("id"))
    groups = stored(groups.join(ids, KEY), "row-groups")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", KEY)).getField(KEY).alias(KEY)
    firsts = groups.groupBy("of").agg(first).select(KEY)
    gone = sized(stored(groups.select(KEY).join(firsts, KEY, "left_anti"), "later-rows"), MOST_IDS)
    return rows.join(gone, KEY, "left_anti").select(*[f"`{c}`" for c in docs.columns])


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
