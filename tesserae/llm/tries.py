"""A prefix trie over conversations, its subtree sums by heavy-path decomposition.

Each distinct sequence of a conversation's first turns is a node. A node is known by its depth and the XOR of two 64-bit
hashes of (place, turn), so a prefix costs a running XOR and no texts are shuffled: what moves is a few longs a turn.

Heavy paths: of a node's children the one with the most members (then the least conversation) is the heavy one, so a light
child has at most half of its parent's members and no way to the root has more light edges than log2 of the conversations.
A path is named after the smallest conversation that ends in its lowest node; of that conversation's nodes the path has
those below its last light edge. Sums of subtrees are suffix sums along the paths. What hangs on a path by light edges is
added first, in rounds: each path hands its sum to the node that its top hangs on, that node's path hands the sums it was
given on to the next, and so on, a grouped sum and two joins on unique keys a round, until the root's path has all.

No group of unbounded size is one task's: rows that repeat are counted before they are ordered; places in a conversation
come from a range partitioning, counted by piece; running XORs and suffix sums go by blocks of BLOCK places; members of a
node are joined to texts of PIECE ids over a range partitioning, and only these texts pass, one by one, through the task
that feeds a node's digest, since SHA-256 has an order. Joins of turns with nodes that very many share are left to
adaptive skew splitting.

Edge cases: rows without conv_id belong to no conversation and are left out. A null role or text is an empty one. Turns
with equal numbers (null numbers are first) follow in the order of hashes of role and text, so reruns agree; a repeated
row is a turn each time. The remainder of a negative conv_id is negative or zero, as in SQL. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import ranks
from .scratch import Scratch
from .words import tidy

BLOCK, PIECE = 4096, 4096  # places of a running sum; ids of a text
HUNDRED, HEADS = 100, 6  # the contract's groups of conversations, and how many lengths of shared beginnings there are
NODE = ["depth", "p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(table: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 1), t1 and t2 (hashes of role and text) and points (code points of the text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = table.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), role, text).alias("t2"), F.length(text).cast("long").alias("points"))
    key = ["turn", "t1", "t2", "points"]
    counted = rows.groupBy("conv_id", *key).agg(F.count("*").alias("n"))
    # A range partition's number grows with the order, so it is the coarse cell of its rows; fixed once it is written.
    cells = scratch.save(counted.repartitionByRange("conv_id", *key).withColumn("piece", F.spark_partition_id()), "cells")
    placed = ranks.copies(ranks.before(cells, ["conv_id"], key, F.col("piece")), "n", "k")
    return scratch.save(placed.select("conv_id", (F.col("base") + F.col("k") + 1).alias("pos"), "t1", "t2", "points"), "turns")


def shared_head() -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS


def rebuilt(said: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``said`` with the heads that conversations of a hundred share: conv_id, length, pos, t1, t2 and points; and every
    conversation with its length, of those without turns too."""
    sizes = scratch.save(said.groupBy("conv_id").agg(F.count("*").alias("size")), "sizes")
    bases = scratch.load("sizes", sizes).where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    plan = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED).withColumn("head", shared_head()).join(bases, "base", "left")
    taken = F.least("head", F.coalesce("base_size", F.lit(0)))
    plan = plan.select("conv_id", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("size") - F.col("head"), F.lit(0))).alias("length"))
    plan = scratch.save(plan, "plan")
    turn = ["t1", "t2", "points"]
    own = said.join(plan, "conv_id").where("pos > head").select("conv_id", "length", (F.col("taken") + F.col("pos") - F.col("head")).alias("pos"), *turn)
    heads = scratch.load("turns", said).where((F.col("pos") < HEADS) & (F.col("conv_id") % HUNDRED == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(scratch.load("plan", plan), "base").where("pos <= taken").select("conv_id", "length", "pos", *turn)
    return own.unionByName(heads), plan.select("conv_id", "length")


def running(df: DataFrame, group: str, place: str, down: bool, values: dict[str, Callable[[str], Column]]) -> DataFrame:
    """``df`` with the running aggregate of each of ``values`` (its function by column) along the group, upwards or
    ``down`` from the last place, in blocks."""
    way = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    df = df.withColumn("_block", F.expr(f"{place} div {BLOCK}"))
    inner = Window.partitionBy(group, "_block").orderBy(way(place)).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("_group").orderBy(way("_of")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(F.col(group).alias("_group"), F.col("_block").alias("_of")).agg(*[f(c).alias(f"_{c}") for c, f in values.items()])
    above = blocks.select("_group", "_of", *[f(f"_{c}").over(outer).alias(f"_{c}") for c, f in values.items()])
    above = above.where(F.col(f"_{next(iter(values))}").isNotNull())  # blocks that others come before: few groups have any
    df = df.withColumns({c: f(c).over(inner) for c, f in values.items()})
    return df.join(above, (F.col(group) == F.col("_group")) & (F.col("_block") == F.col("_of")), "left").drop("_group", "_of", "_block")


def prefixes(made: DataFrame, everyone: DataFrame) -> DataFrame:
    """Every conversation's nodes: conv_id, length, depth, p1 and p2, the parent's q1 and q2, points of the last text."""
    step = {"p1": F.xxhash64("pos", "t1", "t2"), "p2": F.xxhash64(F.lit(1), "pos", "t1", "t2")}
    rows = made.select("conv_id", "length", F.col("pos").alias("depth"), "points", *[c.alias(n) for n, c in step.items()], *[c.alias(f"g{n[1]}") for n, c in step.items()])
    rows = running(rows, "conv_id", "depth", False, {"p1": F.bit_xor, "p2": F.bit_xor})
    whole = [F.coalesce(F.col(f"p{k}").bitwiseXOR(F.col(f"_p{k}")), f"p{k}") for k in (1, 2)]
    rows = rows.select("conv_id", "length", "depth", whole[0].alias("p1"), whole[1].alias("p2"), whole[0].bitwiseXOR(F.col("g1")).alias("q1"), whole[1].bitwiseXOR(F.col("g2")).alias("q2"), "points")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = everyone.select("conv_id", "length", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), zero.alias("points"))
    return rows.unionByName(roots)


def _pieces(tables):
    """Joins runs of one node's ids, sorted in the partition, to texts of at most PIECE ids each."""
    from pyspark import TaskContext

    piece, seq, key, ids = TaskContext.get().partitionId(), 0, None, []

    def flush():
        return pa.RecordBatch.from_pylist([{"depth": key[0], "p1": key[1], "p2": key[2], "piece": piece, "seq": seq, "ids": ",".join(ids)}], schema=_PIECES)

    for t in tables:
        for *now, conv in zip(*[t.column(k).to_pylist() for k in range(4)], strict=True):
            if ids and (now != key or len(ids) == PIECE):
                yield flush()
                seq, ids = seq + 1, []
            key = now
            ids.append(str(conv))
    if ids:
        yield flush()


_PIECES = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("piece", pa.int32()), ("seq", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])


def _digests(tables):
    """SHA-256 of each node's texts, which follow each other in their order."""
    key, sha = None, None
    for t in tables:
        out = []
        for *now, ids in zip(*[t.column(k).to_pylist() for k in range(4)], strict=True):
            if now == key:
                sha.update(b",")
            else:
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = now, hashlib.sha256()
            sha.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)
    if key:
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, (*key, sha.hexdigest()), strict=True))], schema=_DIGESTS)


def digests(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """depth, p1, p2 and ends_sha256 of the nodes in which conversations end."""
    ends = rows.where("depth = length").select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = scratch.save(ends.mapInArrow(tidy(_pieces), "depth long, p1 long, p2 long, piece int, seq long, ids string"), "pieces")
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece", "seq").select(*NODE, "ids")
    return ordered.mapInArrow(tidy(_digests), "depth long, p1 long, p2 long, ends_sha256 string")


def linked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie's nodes: conv_id (with depth, a node's name), parent_conv_id, n_convs, n_children, heavy (it is its
    parent's heavy child), and its own leaf and saved, which are summed over subtrees."""
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("points").alias("points"))
    nodes = scratch.save(nodes, "nodes")
    parents = scratch.load("nodes", nodes).select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    named = scratch.save(nodes.join(parents, ["depth", "q1", "q2"], "left").drop("q1", "q2"), "named")
    children = named.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = scratch.save(children.agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"))).alias("best")), "children")
    heavy = scratch.load("children", children).select((-F.col("best.col2")).alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("heavy"))
    both = scratch.load("named", named).join(children.drop("best"), ["conv_id", "depth"], "left").join(heavy, ["conv_id", "depth"], "left")
    n = F.coalesce("n_children", F.lit(0).cast("long"))
    out = both.select("conv_id", *NODE, "parent_conv_id", "n_convs", n.alias("n_children"), F.coalesce("heavy", F.lit(False)).alias("heavy"), (n == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    return scratch.save(out, "linked")


def paths(rows: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes by heavy path: path, depth, conv_id, parent_conv_id, heavy (all but a path's top are), leaf and saved."""
    leaves = nodes.where("leaf = 1").select("conv_id")
    known = scratch.load("linked", nodes).select(*NODE, F.col("conv_id").alias("node"), "parent_conv_id", "heavy", "leaf", "saved")
    walks = rows.join(leaves, "conv_id", "left_semi").select(F.col("conv_id").alias("path"), *NODE).join(known, NODE)
    walks = scratch.save(walks.select("path", "depth", F.col("node").alias("conv_id"), "parent_conv_id", "heavy", "leaf", "saved"), "walks")
    tops = walks.where("not heavy").groupBy("path").agg(F.max("depth").alias("top"))
    return scratch.save(scratch.load("walks", walks).join(tops, "path").where("depth >= top").drop("top"), "paths")


def subtrees(on: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth, n_leaves and saved_tokens: the sums of leaf and saved over each node's subtree."""
    load = lambda: scratch.load("paths", on)
    sums = [F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")]
    tops = load().where("not heavy and parent_conv_id is not null").select("path", F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))

    def handed(by_path: DataFrame, k: int) -> DataFrame:
        """What paths hand to the nodes that they hang on."""
        return scratch.save(by_path.groupBy("path").agg(*sums).join(tops, "path").groupBy("conv_id", "depth").agg(*sums), f"handed-{k}")

    rounds = [handed(on, 0)]
    while rounds[-1].limit(1).count():
        on_its_path = rounds[-1].join(load().select("path", "conv_id", "depth"), ["conv_id", "depth"])
        rounds.append(handed(on_its_path, len(rounds)))
    given = rounds[0]
    for r in rounds[1:-1]:
        given = given.unionByName(r)
    given = given.groupBy("conv_id", "depth").agg(F.sum("leaf").alias("more"), F.sum("saved").alias("more_saved"))
    zero = F.lit(0).cast("long")
    total = load().join(given, ["conv_id", "depth"], "left")
    total = total.select("path", "depth", "conv_id", (F.col("leaf") + F.coalesce("more", zero)).alias("leaf"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"))
    out = running(total, "path", "depth", True, {"leaf": F.sum, "saved": F.sum})
    return out.select("conv_id", "depth", (F.col("leaf") + F.coalesce("_leaf", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("_saved", zero)).alias("saved_tokens"))


def prefix_trie(table: DataFrame, share_heads: bool = True) -> DataFrame:
    """Every node of the trie over the conversations of ``table`` (conv_id, turn, role, text), each with the head that the
    first conversation of its hundred lends it, or as it is without ``share_heads``."""
    scratch = Scratch(table.sparkSession, "tries")
    ship(table.sparkSession)
    said = turns(table, scratch)
    if share_heads:
        made, everyone = rebuilt(said, scratch)
    else:
        everyone = scratch.save(said.groupBy("conv_id").agg(F.count("*").alias("length")), "sizes")
        made = said.join(scratch.load("sizes", everyone), "conv_id")
    rows = scratch.save(prefixes(made, everyone), "rows")
    nodes = linked(rows, scratch)
    sums = subtrees(paths(scratch.load("rows", rows), nodes, scratch), scratch)
    ends = digests(scratch.load("rows", rows), scratch)
    out = scratch.load("linked", nodes).join(sums, ["conv_id", "depth"]).join(ends, NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = """
WITH said AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT c, count(*) AS size, xor(4294967295::BIGINT, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda acc, b: list_reduce(range(8), lambda a, i:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, xor(acc, b)), 4294967295::BIGINT)) % 6 AS h FROM said GROUP BY c
), plan AS (SELECT a.c, a.h, a.c - a.c % 100 AS base, least(a.h, coalesce(b.size, 0)) AS taken FROM sizes a LEFT JOIN sizes b ON b.c = a.c - a.c % 100),
made AS (
  SELECT p.c, p.taken + s.pos - p.h AS pos, role, text FROM said s JOIN plan p ON s.c = p.c WHERE s.pos > p.h
  UNION ALL SELECT p.c, s.pos, role, text FROM said s JOIN plan p ON s.c = p.base WHERE s.pos <= p.taken
), steps AS (SELECT c, 0 AS depth, '' AS key, '' AS up, 0 AS points FROM plan
  UNION ALL SELECT c, pos, CAST(list([role, text]) OVER (PARTITION BY c ORDER BY pos) AS VARCHAR), CAST(list([role, text]) OVER (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR), length(text) FROM made
), steps2 AS (SELECT c, depth, md5(key) AS key, CASE WHEN depth > 0 THEN md5(CASE WHEN depth = 1 THEN '' ELSE up END) END AS up, points FROM steps),
nodes AS (SELECT depth, key, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, min(points) AS points FROM steps2 GROUP BY depth, key),
kids AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
ends AS (SELECT s.depth, s.key, string_agg(s.c::VARCHAR, ',' ORDER BY s.c) AS ids FROM steps2 s JOIN (SELECT c, max(depth) AS depth FROM steps2 GROUP BY c) m ON s.c = m.c AND s.depth = m.depth GROUP BY ALL),
own AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * points AS saved FROM nodes n LEFT JOIN kids k ON n.depth = k.depth AND n.key = k.key),
sums AS (SELECT s.depth, s.key, sum(o.leaf) AS n_leaves, sum(o.saved) AS saved_tokens FROM own o JOIN steps2 s ON s.c = o.conv_id AND s.depth <= o.depth GROUP BY ALL)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, CAST(o.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM own o JOIN sums s ON o.depth = s.depth AND o.key = s.key LEFT JOIN nodes p ON p.depth = o.depth - 1 AND p.key = o.up LEFT JOIN ends e ON e.depth = o.depth AND e.key = o.key
"""
