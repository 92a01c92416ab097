"""Conversation prefix trie: all prefixes of all conversations from ROLLUPs over columns of turns.

Conversations are cut into blocks of ``width`` turns, one row each, with a column per position and the
node that the block hangs from. ``GROUP BY block, node above, ROLLUP(t1, ..., tn)`` then yields every
prefix that ends in the block; ``grouping_id`` tells how deep it is. A long conversation simply has more
rows, so depth costs rows and not rounds.

A node is known by a sum of hashes over the (position, turn) pairs on its path, which a row can start
from without its forerunners: two numbers of 64 bits. Turns are known by two hashes of role and text.

Totals over subtrees need no walk down the tree. Every node is owned by its least member; along a
conversation the members only get fewer, so a conversation owns its path from some depth on. That depth
comes out of a first rollup. In the second one each conversation brings what it does not own (the words
it would save), the children and the leaf that it owns, and sums over members are sums over subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import row_numbers, running_totals
from .common import n_words, query, stored, table
from .lookup import looked_up

#: Turns per block of columns.
WIDTH = 8
LOW = (1 << 32) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row per node. ``ends``: ``conv_id`` and the node (``k1, k2, depth``) it ends at."""

    nodes: DataFrame
    ends: DataFrame


def turn_ids(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """``conv_id, turn, a, b, words``: each turn as two hashes of role and text, and its number of words.

    Null role and text are empty. Rows without a conversation id belong to none and are left out.
    """
    said = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text)]
    return conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.xxhash64(F.lit(1), *said).alias("a"), F.xxhash64(F.lit(2), *said).alias("b"), n_words(said[1]).alias("words"))


def in_order(turns: DataFrame) -> DataFrame:
    """``turns`` with ``at``, the place of each in its conversation from 1: by turn, null first, equal turns by hash."""
    return row_numbers(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "at")


def _lanes(at: Column, a: Column, b: Column) -> list[Column]:
    """Four numbers below 2^32 for a turn at a place."""
    return [part for h in (F.xxhash64(at, a, b), F.xxhash64(at, b, a))
            for part in (h.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h, 32))]


def _packed(lanes: list[Column]) -> list[Column]:
    """Sums of lanes as two longs."""
    low = [c.bitwiseAND(F.lit(LOW)) for c in lanes]
    return [F.shiftleft(low[1], 32).bitwiseOR(low[0]), F.shiftleft(low[3], 32).bitwiseOR(low[2])]


def _unpacked(k1: Column, k2: Column) -> list[Column]:
    return [part for k in (k1, k2) for part in (k.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(k, 32))]


def _blocks(turns: DataFrame, members: DataFrame | None, width: int) -> DataFrame:
    """A stored row per conversation and block: node above, columns of turns, words before, totals, end node."""
    at = F.col("at")
    lanes = _lanes(at.cast("long"), F.col("a"), F.col("b"))
    spot = F.pmod(at - 1, F.lit(width))
    pick = {f"{c}{i}": F.max(F.when(spot == i, F.col(c))) for i in range(width) for c in ("a", "b", "words")}
    sums = {f"l{i}": F.sum(x) for i, x in enumerate(lanes)} | {"w": F.sum("words"), "n": F.count("*")}
    rows = in_order(turns).groupBy("conv_id", F.floor((at - 1) / width).cast("long").alias("block")).agg(
        *[c.alias(n) for n, c in (pick | sums).items()])
    rows = running_totals(rows, ["conv_id"], [F.col("block")], {f"r_{n}": F.col(n) for n in sums})
    above = [F.col(f"r_l{i}") - F.col(f"l{i}") for i in range(4)]
    k1, k2 = _packed(above)
    e1, e2 = _packed([F.col(f"r_l{i}_all") for i in range(4)])
    turn = [F.when(F.col(f"a{i}").isNotNull(), F.struct(
        F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"words{i}").alias("words"))).alias(f"t{i + 1}") for i in range(width)]
    rows = rows.select("conv_id", "block", k1.alias("k1"), k2.alias("k2"), *turn, (F.col("r_w") - F.col("w")).alias("before"),
                       F.col("r_w_all").alias("total"), F.col("r_n_all").alias("len"), e1.alias("e1"), e2.alias("e2"))
    rows = stored(rows, "trie-blocks")
    if members is None:
        return rows
    bare = members.select(F.col("conv_id").cast("long")).where("conv_id IS NOT NULL").distinct().join(
        rows.where("block = 0").select("conv_id"), "conv_id", "left_anti")
    bare = bare.select("conv_id", *[(F.lit(None) if c[0] == "t" and c != "total" else F.lit(0)).cast(rows.schema[c].dataType).alias(c)
                                    for c in rows.columns[1:]])
    return rows.unionByName(stored(bare, "turnless"))


def _rolled(blocks: DataFrame, width: int, aggregates: str) -> DataFrame:
    """Every prefix in every block, with ``level`` (turns of the block in it) and ``path``, its turns in the block."""
    turns = ", ".join(f"t{i + 1}" for i in range(width))
    out = blocks.sparkSession.sql(
        f"SELECT block, k1, k2, {turns}, {width} - bit_count(grouping_id()) AS level, {aggregates} "
        f"FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP({turns})", blocks=blocks)
    out = out.withColumn("path", F.array(*[f"t{i + 1}" for i in range(width)]))
    # A level beyond the conversation's end repeats the end; the top of a block is the end of the one above.
    last = F.get("path", F.col("level") - 1).isNotNull()
    return out.where(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last)).select(
        "*", (F.col("block") * width + F.col("level")).alias("depth"))


def _keys(width: int) -> list[Column]:
    """Keys of a rolled row's node and of its parent."""
    lanes = [_lanes(F.col("block") * width + i + 1, F.col(f"t{i + 1}.a"), F.col(f"t{i + 1}.b")) for i in range(width)]

    def upto(level: Column) -> list[Column]:
        parts = [[F.when(level > i, x).otherwise(0) for x in lane] for i, lane in enumerate(lanes)]
        return _packed([sum(xs, start) for start, *xs in zip(_unpacked(F.col("k1"), F.col("k2")), *parts)])

    return upto(F.col("level")) + upto(F.col("level") - 1)


def trie_of(turns: DataFrame, members: DataFrame | None = None, width: int = WIDTH) -> Trie:
    """The trie of conversations given as ``turn_ids`` gives them.

    ``members`` may list conversations (``conv_id``) of which some have no turns; these end at the root.
    Node columns: ``k1, k2`` (key), ``depth``, ``conv_id`` (least member), ``parent_conv_id`` (the
    parent's, null at the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes below it or
    itself), ``saved_tokens`` (over the subtree: members but one, times words of the turn). No
    conversation at all: no node. Repeated turns count as turns; conversations that are alike share all
    nodes. Ids are numbers; a conversation may be of any length.
    """
    blocks = _blocks(turns, members, width)
    words = F.aggregate(F.slice("path", 1, F.greatest(F.col("level") - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, t: s + t["words"])
    first = _rolled(blocks, width, "min(conv_id) AS owner, max(len) AS longest, min(before) AS before")
    facts = first.select("owner", "depth", "longest", (F.col("before") + words).alias("before")).groupBy("owner").agg(
        F.min("depth").alias("f"), F.min_by("before", "depth").alias("g"), F.bool_or(F.col("depth") == F.col("longest")).alias("leaf"))
    facts = stored(facts.withColumnRenamed("owner", "conv_id"), "owned")

    rows = looked_up(blocks, facts, ["conv_id"])
    # Words before each column, and of those the conversation does not own, what lies from there on.
    reached, gain = F.col("before"), F.coalesce("g", "total")
    more = {}
    for i in range(width):
        more[f"s{i + 1}"] = F.greatest(gain - reached, F.lit(0))
        reached = reached + F.coalesce(F.col(f"t{i + 1}.words"), F.lit(0))
    for i in range(width + 1):
        child = F.col("block") * width + i + 1
        more[f"c{i}"] = F.coalesce((F.col("f") <= child) & (F.col("len") >= child), F.lit(False)).cast("int")
    rows = rows.withColumns(more)
    sums = ", ".join(f"sum({n}) AS {n}" for n in more)
    out = _rolled(rows, width, f"count(*) AS n_convs, min(conv_id) AS owner, min_by(f, conv_id) AS f, count_if(leaf) AS n_leaves, {sums}")
    k1, k2, p1, p2 = _keys(width)
    nodes = stored(out.select(
        k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "depth", F.col("owner").alias("conv_id"), "f", "n_convs",
        F.get(F.array(*[f"c{i}" for i in range(width + 1)]), F.col("level")).alias("n_children"), "n_leaves",
        F.get(F.array(*[f"s{i + 1}" for i in range(width)]), F.greatest(F.col("level") - 1, F.lit(0))).alias("saved_tokens")), "nodes")
    # A node's owner owns the parent too, but where its ownership begins.
    begins = (F.col("depth") > 0) & (F.col("depth") == F.col("f"))
    usual = nodes.where(~begins).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    branch = stored(nodes.where(begins).withColumn("above", F.col("depth") - 1), "branches")
    upper = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    told = usual.unionByName(looked_up(branch, upper, ["p1", "p2", "above"]).drop("above"))
    ends = blocks.where("block = 0").select("conv_id", F.col("e1").alias("k1"), F.col("e2").alias("k2"), F.col("len").alias("depth"))
    return Trie(told.select("k1", "k2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends)


def prefix_trie(conversations: DataFrame, members: DataFrame | None = None, width: int = WIDTH, conv_id: str = "conv_id",
                turn: str = "turn", role: str = "role", text: str = "text") -> Trie:
    """The trie of a table of turns; see ``turn_ids`` for nulls and ``trie_of`` for the rest."""
    return trie_of(turn_ids(conversations, conv_id, turn, role, text), members, width)


def ends_digest(ends: DataFrame, span: int = 1024) -> DataFrame:
    """``k1, k2, depth, ends_sha256``: the ids that end at each node, ascending, comma-joined, hashed.

    Ids meet first in runs of ``span`` values, so a node of very many ends is a stream of few strings;
    a hash is one sequence, and memory holds a string at a time.
    """
    key = ["k1", "k2", "depth"]
    runs = ends.groupBy(*key, F.floor(F.col("conv_id") / span).alias("run")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for batch in batches:
            done = []
            for k1, k2, depth, _, ids in batch.itertuples(index=False):
                if (k1, k2, depth) == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = (k1, k2, depth), hashlib.sha256(ids.encode())
            if done:
                yield pd.DataFrame(done, columns=[*key, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*key, "ends_sha256"])

    return runs.repartition(*key).sortWithinPartitions(*key, "run").mapInPandas(
        digest, "k1 long, k2 long, depth long, ends_sha256 string")


def rebuilt(ids: DataFrame, every: int = 20, kinds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns in which conversation c begins with the first h = crc32(c) % ``kinds`` of c - c % ``every``, and all ids."""
    own = stored(in_order(ids), "turns")
    at = F.col("at")
    heads = stored(own.where((F.col("conv_id") % every == 0) & (at < kinds)).select(
        F.col("conv_id").alias("base"), *own.columns[1:]), "heads")
    convs = own.where(at == 1).select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
        F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(kinds)).alias("h"))
    convs = stored(convs.join(heads.groupBy("base").agg(F.max("at").alias("have")), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("taken")), "plans")
    words = ["a", "b", "words"]
    first = convs.join(heads, "base").where(at <= F.col("h")).select("conv_id", at.alias("turn"), *words)
    rest = looked_up(own, convs.select("conv_id", "h", "taken"), ["conv_id"]).where(at > F.col("h"))
    return first.union(rest.select("conv_id", at - F.col("h") + F.col("taken"), *words)), convs.select("conv_id")


OP13_SQL = """
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
own AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
    lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc
),
joined AS (
  SELECT c.conv_id, 0 AS part, o.pos, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, md5(length(role) || ':' || role || text) AS id,
    length(regexp_replace(regexp_replace(text, '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')) AS words
  FROM joined
),
paths AS (
  SELECT conv_id, d, words, md5(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
),
linked AS (
  SELECT *, lag(node) OVER w AS up, lead(node) OVER w IS NULL AS is_end FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY d)
),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(up) AS up,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM linked GROUP BY node, d
),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
own_values AS (SELECT n.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * words AS own FROM nodes n LEFT JOIN kids k ON k.up = n.node),
lines AS (SELECT DISTINCT a.node AS top, b.node AS below FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.d <= b.d),
totals AS (
  SELECT top, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM lines JOIN own_values ON below = node GROUP BY top
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children,
  t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM own_values n JOIN totals t ON t.top = n.node LEFT JOIN nodes p ON p.node = n.up
"""


@query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = rebuilt(turn_ids(table(spark, sf_dir, "conversations")))
    trie = trie_of(turns, members)
    return trie.nodes.join(ends_digest(trie.ends), ["k1", "k2", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
