"""Sharding by best-fit decreasing: indivisible groups into shards of a fixed capacity.

Groups are sorted by size, and each enters the shard with the least room that still holds it, found in a balanced tree
(a treap) of remaining capacities; a new shard opens when none does. For a given number of shards the least capacity
that suffices is searched for.

Groups of one size are alike to best fit: the tightest shard that holds one of them takes them until it has no room for
another. So the packing works on the histogram of sizes, exactly as it would on the groups one by one. The histogram has
no more than sqrt(2 * bytes) rows, since distinct sizes add up; that is all the driver sees. Its result says which
stretch of the groups of each size goes where, and groups find their stretch by their rank within the size, counted per
cell of hashes.

A group larger than a shard's share cannot stay whole; only of such a group, of which there are fewer than shards, each
row is an item of its own. So equal texts share a shard unless they overflow it. Slots are counts per cell of hashes,
summed up in order, plus a rank within the cell.

Edge cases: null and empty texts are one group, of size 1 a row. Rows that repeat are counted first and are rows of their
own in the result. Ties in size go by group hash, so reruns agree. An empty table gives an empty result. Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import before, bounded, copies
from .scratch import Scratch

SHARDS, CELL_ROWS = 16, 10_000


class Treap:
    """A balanced tree of distinct keys; priorities come from a fixed sequence."""

    def __init__(self):
        self.root, self.state = None, 0x9E3779B9

    def add(self, key) -> None:
        self.state = (self.state * 1103515245 + 12345) & 0x7FFFFFFF
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self.state, None, None]), high)

    def remove_least_from(self, key):
        """Takes out and returns the least key that is not below ``key``, or None."""
        low, high = self._split(self.root, key)
        if high is None:
            self.root = low
            return None
        path, node = [], high
        while node[2] is not None:
            path.append(node)
            node = node[2]
        if path:
            path[-1][2] = node[3]
        else:
            high = node[3]
        self.root = self._join(low, high)
        return node[0]

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b


def best_fit_runs(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """Best-fit decreasing over (size, count) pairs of descending sizes: (index of the pair, shard, number of its items)
    in the order of placing. No size may exceed the capacity."""
    runs, tree, opened = [], Treap(), 0
    for i, (size, count) in enumerate(sizes):
        if size > capacity:
            raise ValueError("an item exceeds the capacity")
        while count:
            found = tree.remove_least_from((size, -1))
            room, k = found if found else (capacity, opened)
            opened += not found
            n = min(count, room // size)  # none has less room and holds one, so it stays the tightest
            runs.append((i, k, n))
            count -= n
            tree.add((room - n * size, k))
    return runs


def pack_into(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Best-fit decreasing at the least capacity, to 1 in 4096, that needs no more than ``shards``."""
    if not sizes:
        return []
    least = max(-(-sum(s * n for s, n in sizes) // shards), sizes[0][0])
    fits = lambda runs: max(k for _, k, _ in runs) < shards
    step, runs = max(1, least >> 12), best_fit_runs(sizes, least)
    high = least
    while not fits(runs):  # a capacity that surely suffices comes within a few doublings of the excess
        least, high = high, high + step
        step *= 2
        runs = best_fit_runs(sizes, high)
    while high - least > max(1, least >> 12):
        middle = (least + high) // 2
        trial = best_fit_runs(sizes, middle)
        if fits(trial):
            high, runs = middle, trial
        else:
            least = middle
    return runs


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the group, two hashes of the text, and n, the number of rows equal in these."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(1), text).alias("g2"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def ranked(items: DataFrame, total: int) -> DataFrame:
    """``items`` (bytes, over, h1, h2, id, n) with rank, that of an item's first copy among those of equal bytes and over."""
    cells = max(1, total // CELL_ROWS)
    items = items.withColumn("cell", F.pmod(F.xxhash64("h1", "h2", "id"), F.lit(cells)))
    same = ["bytes", "over"]
    base = before(items.groupBy(*same, "cell").agg(F.sum("n").alias("n")), same, "cell", F.expr("cell div 1024")).drop("n")
    inner = Window.partitionBy(*same, "cell").orderBy("h1", "h2", "id").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("n").over(inner), F.lit(0))
    return items.withColumn("rank", rank).join(base, [*same, "cell"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "cell")


def assign(rows: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """doc_id, size, text_crc32, g1, n and shard of ``rows``; a row that repeats may come in several parts."""
    spark = rows.sparkSession
    groups = scratch.save(rows.groupBy("g1", "g2").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")), "groups")
    total, n_groups = groups.agg(F.sum("bytes"), F.count("*")).first()
    whole = -(-(total or 0) // shards)
    over = F.broadcast(groups.where(F.col("bytes") > whole).select("g1", "g2"))  # fewer than shards
    lone = rows.join(over, ["g1", "g2"], "left_semi").select(F.col("size").alias("bytes"), F.col("g1").alias("over"), F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.coalesce("doc_id", F.lit(-1)).alias("id"), "n", "doc_id")
    alike = groups.where(F.col("bytes") <= whole).select("bytes", F.lit(0).cast("long").alias("over"), F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.lit(0).cast("long").alias("id"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("doc_id"))
    items = scratch.save(alike.unionByName(lone), "items")
    histogram = items.groupBy("bytes", "over").agg(F.sum("n").alias("n")).orderBy(F.desc("bytes"), "over").collect()  # bounded, see above
    upto, made = [0] * len(histogram), []
    for i, k, n in pack_into([(r["bytes"], r["n"]) for r in histogram], shards):
        made.append((histogram[i]["bytes"], histogram[i]["over"], upto[i], upto[i] + n, k))
        upto[i] += n
    runs = spark.createDataFrame(made, "bytes long, over long, first long, last long, shard int")
    placed = ranked(items, n_groups).join(bounded(runs), ["bytes", "over"]).where("rank < last and rank + n > first")
    part = F.least(F.col("rank") + F.col("n"), F.col("last")) - F.greatest("rank", "first")
    placed = scratch.save(placed.select("over", F.col("h1").alias("g1"), F.col("h2").alias("g2"), "doc_id", part.alias("part"), "shard"), "places")
    of_groups = rows.join(placed.where("over = 0").select("g1", "g2", "shard"), ["g1", "g2"]).select("doc_id", "size", "text_crc32", "g1", "n", "shard")
    facts = rows.join(over, ["g1", "g2"], "left_semi").select("g1", "g2", "size", "text_crc32").distinct()
    of_rows = placed.where("over != 0").join(F.broadcast(facts), ["g1", "g2"]).select("doc_id", "size", "text_crc32", "g1", F.col("part").alias("n"), "shard")
    return of_groups.unionByName(of_rows)


def slotted(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows``, copies one by one, with slot, gapless from 0 within each shard."""
    cells = max(1, n_rows // (SHARDS * CELL_ROWS))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "g1"), F.lit(cells)))
    base = before(rows.groupBy("shard", "cell").agg(F.sum("n").alias("n")), ["shard"], "cell", F.expr("cell div 1024")).drop("n")
    inner = Window.partitionBy("shard", "cell").orderBy("doc_id", "g1").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(base, ["shard", "cell"])
    return copies(rows, "n", "copy").withColumn("slot", F.col("first") + F.col("base") + F.col("copy"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law knows no growth) of every row."""
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.save(described(docs), "rows")
    placed = scratch.save(assign(rows, shards, scratch), "placed")
    return slotted(placed, placed.count()).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of near equal bytes; equal texts together."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
