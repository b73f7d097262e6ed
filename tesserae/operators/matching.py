"""Greedy algorithms whose order of choices matters: by rounds of choices that no other can change, and group by group.

Where a group may be large, rounds of joins take all choices that stand whatever else is chosen. Where a group is what one
document states for one metric, groups lie side by side in sorted partitions and are cut out of Arrow batches, so millions
of groups cost no call each; groups of one row need no Python loop at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch
from ..shipping import ship
from .ranges import near_join, within

LOCAL = 50_000  # pairs or edges of a few longs that one task may go down
SMALL = 100  # rows of a bucket that is gone down as one sorted array


def _side_by_side(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` with a hash of its keys, partitioned by it and sorted by it and ``order``."""
    return df.withColumn("_g", F.xxhash64(*keys)).repartition("_g").sortWithinPartitions("_g", *order)


def _whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups, with the bounds of each; a group that a batch cuts waits for its rest."""

    def bounds(df):
        g = df["_g"].to_numpy()
        return np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])

    held = None
    for df in frames:
        df = df if held is None else pd.concat([held, df], ignore_index=True)
        if not len(df):
            continue
        b = bounds(df)
        held = df.iloc[b[-2] :].reset_index(drop=True)
        if b[-2]:
            yield df.iloc[: b[-2]], b[:-1]
    if held is not None and len(held):
        yield held, bounds(held)


def greedy_one_to_one(pairs: DataFrame, group: str, left: str, right: str, score: str, local: int = LOCAL) -> DataFrame:
    """Pairs by score (then ids), each id used once on its side of its group.

    A pair that is the best of both its ids is one that going down the list would take, whatever else is taken, so all
    such pairs are taken at once and what has an id of theirs goes; the rest is the same task again. A round is two
    grouped maxima and joins, so no group is one task's, however large. Once ``local`` pairs or fewer are left, counted
    first, one task goes down the list."""
    spark = pairs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "matches")
    names = {"g": group, "l": left, "r": right}
    now = scratch.again(pairs.where(F.col(score).isNotNull()).select(F.col(group).alias("g"), F.col(left).alias("l"), F.col(right).alias("r"), F.col(score).alias("s")).distinct())
    taken = []
    while now.count() > local:
        best = F.min(F.struct((-F.col("s")).alias("s"), "l", "r"))
        of_l = now.groupBy("g", "l").agg(best.alias("b")).select("g", "b.l", "b.r")
        of_r = now.groupBy("g", "r").agg(best.alias("b")).select("g", "b.l", "b.r")
        both = scratch.again(_same(of_l, of_r, ["g", "l", "r"], "left_semi"))
        taken.append(both)
        now = scratch.again(_same(_same(now, both.select("g", "l"), ["g", "l"], "left_anti"), both.select("g", "r"), ["g", "r"], "left_anti"))

    def run(frames):
        for df, at in _whole_groups(frames):
            a, b, keep = df["l"].to_numpy(), df["r"].to_numpy(), np.zeros(len(df), bool)
            for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                used_left, used_right = set(), set()
                for k in range(begin, end):
                    if a[k] not in used_left and b[k] not in used_right:
                        used_left.add(a[k])
                        used_right.add(b[k])
                        keep[k] = True
            yield df.loc[keep, ["g", "l", "r"]]

    kinds = dict(now.dtypes)
    out = _side_by_side(now, ["g"], [F.desc("s"), "l", "r"]).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names))
    for part in taken:
        out = out.unionByName(part)
    return out.withColumnsRenamed(names)


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A semi or anti join in which nulls are equal."""
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return a.join(b, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), how)


def first_come(rows: DataFrame, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """node and seed: going down the list, a node that no seed covers is a seed, and any other belongs to the first seed
    that covers it. ``rows`` has node; ``edges`` has by, to, by_rank and to_rank: the node ``by`` covers ``to`` and comes before it.

    Nodes that cover others and that no undecided node covers are seeds, whatever else is chosen, and what they cover is
    none; then both are decided and the rest is the same task again. A round is distincts and joins, so no group is one
    task's. Once ``local`` edges or fewer are undecided, counted first, one task goes down the list of them."""
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark, "groups")
    edges = scratch.again(edges.select("by", "to", "by_rank", "to_rank"))
    live, taken = edges, []
    named = lambda df, c, name="node": df.select(F.col(c).alias(name)).distinct()
    while live.count() > local:
        new = scratch.again(named(live, "by").join(named(live, "to"), "node", "left_anti"))
        gone = scratch.again(named(live.join(named(new, "node", "by"), "by", "left_semi"), "to"))
        taken.append(gone)
        decided = new.unionByName(gone)
        live = scratch.again(live.join(named(decided, "node", "by"), "by", "left_anti").join(named(gone, "node", "to"), "to", "left_anti"))

    def run(frames):
        gone = set()
        for df in frames:
            for by, to in zip(df["by"].tolist(), df["to"].tolist(), strict=True):
                if by not in gone:  # all that come before are decided, so it is a seed
                    gone.add(to)
        yield pd.DataFrame({"node": pd.Series(list(gone), dtype=object)})

    kind = dict(edges.dtypes)["by"]
    last = live.repartition(1).sortWithinPartitions("by_rank", "by").select("by", "to").mapInPandas(run, f"node {kind}")
    for part in taken:
        last = last.unionByName(part)
    last = scratch.again(last)
    seeds = edges.join(last.select(F.col("node").alias("by")), "by", "left_anti")
    owner = seeds.groupBy(F.col("to").alias("node")).agg(F.min_by("by", F.struct("by_rank", "by")).alias("seed"))
    return rows.select("node").join(owner, "node", "left").select("node", F.coalesce("seed", "node").alias("seed"))


def split_by_size(rows: DataFrame, keys: list[str], small: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """The rows of buckets (of equal ``keys``) of ``small`` rows or fewer, and those of larger ones, or None if there are
    none. Sizes are counted by a hash, so a bucket that shares its hash may count as large, never the other way round."""
    rows = scratch.again(rows.withColumn("_crowd", F.xxhash64(*keys)))
    large = scratch.again(rows.groupBy("_crowd").agg(F.count("*").alias("n")).where(F.col("n") > small).select("_crowd"))
    if large.isEmpty():
        return rows.drop("_crowd"), None
    return tuple(rows.join(large, "_crowd", how).drop("_crowd") for how in ("left_anti", "left_semi"))


def walked(df: DataFrame, keys: list[str], id_: str, value: str, tolerance: float, order: Column | None = None, zero: float = 0.0, also: list[str] = (), compatible=None) -> DataFrame:
    """``df`` with the group_id that ``tolerance_groups`` gives, for buckets of few rows: each is one sorted array that is gone
    down in place. Partitioned by some of ``keys`` before, ``df`` isn't shuffled."""
    rank = F.col(id_) if order is None else order
    rest = [c for c in df.columns if c not in keys]
    item = F.struct(rank.alias("rank"), F.col(id_).alias("id"), (F.col(value).cast("double") + F.lit(0.0)).alias("v"), F.struct(F.lit(0).alias("none"), *also).alias("w"), F.struct(*rest).alias("row"))
    buckets = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def covers(s: Column, x: Column) -> Column:
        near = within(s["v"], x["v"], tolerance, zero) & ~F.isnan(s["v"]) & ~F.isnan(x["v"])
        if compatible is not None:
            near = near & compatible(s["w"], x["w"])
        return near | (s["v"].eqNullSafe(x["v"]) & s["w"].eqNullSafe(x["w"]))

    def step(acc: Column, x: Column) -> Column:
        by = F.slice(F.filter(acc["seeds"], lambda s: covers(s, x)), 1, 1)
        # An array of one stands for a name, so that ``by`` is computed once.
        decided = lambda b: F.struct(F.when(F.size(b) == 0, F.array_append(acc["seeds"], x)).otherwise(acc["seeds"]).alias("seeds"), F.array_append(acc["ids"], F.when(F.size(b) == 0, x["id"]).otherwise(F.get(b, F.lit(0))["id"])).alias("ids"))
        return F.get(F.transform(F.array(by), decided), F.lit(0))

    bare = F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["v"].alias("v"), x["w"].alias("w")))
    start = F.struct(F.slice(bare, 1, 0).alias("seeds"), F.slice(F.col("items.id"), 1, 0).alias("ids"))
    ids = F.when(F.size("items") == 1, F.col("items.id")).otherwise(F.aggregate(bare, start, step, lambda acc: acc["ids"]))
    out = buckets.select(*keys, F.explode(F.arrays_zip(F.col("items.row").alias("row"), ids.alias("group_id"))).alias("x"))
    return out.select(*keys, *[F.col(f"x.row.{c}").alias(c) for c in rest], "x.group_id").select(*df.columns, "group_id")


def tolerance_groups(
    df: DataFrame, keys: list[str], id_: str, value: str, tolerance: float, order: Column | None = None, zero: float = 0.0, also: list[str] = (), compatible=None, local: int = LOCAL, small: int = SMALL
) -> DataFrame:
    """id and group_id: rows of equal ``keys`` (null equals null) in ``order`` (or by id; ties by id and value), each taking the later ones whose
    values it is within ``tolerance`` of (relative to theirs), unless one before it has. With ``compatible``, a condition on two structs of
    the columns ``also``, only rows that it admits are taken.

    Buckets of ``small`` rows at most are gone down in place, after one shuffle. In larger ones rows equal in keys, value and
    ``also`` share their lot with the first of them, so only firsts are compared, in rounds."""
    scratch = Scratch(df.sparkSession, "tolerance")
    rank = F.col(id_) if order is None else order
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(id_).alias("id"), F.col(value).cast("double").alias("v"), rank.alias("rank"), *also)
    few, many = split_by_size(rows, names, small, scratch)
    out = walked(few, names, "id", "v", tolerance, F.col("rank"), zero, also, compatible).select(F.col("id").alias(id_), "group_id")
    if many is None:
        return out
    rest = _in_rounds(scratch.again(many), names, tolerance, zero, also, compatible, local, scratch)
    return out.unionByName(rest.withColumnRenamed("id", id_))


def _in_rounds(rows: DataFrame, keys: list[str], tolerance: float, zero: float, also: list[str], compatible, local: int, scratch: Scratch) -> DataFrame:
    """id and group_id of rows with ``keys``, id, v, rank and ``also``, however many have equal keys."""
    same = ["bucket", "v", "w"]
    rows = rows.select("id", F.struct(*keys).alias("bucket"), (F.col("v") + F.lit(0.0)).alias("v"), F.struct(F.lit(0).alias("none"), *also).alias("w"), "rank")
    # Ids may repeat, so each class has a number of its own, fixed once it is written.
    firsts = rows.groupBy(*same).agg(F.min(F.struct("rank", "id")).alias("f")).select(*same, "f.rank", "f.id", F.monotonically_increasing_id().alias("node"))
    firsts = scratch.again(firsts.withColumn("order", F.struct("rank", "id", "v", "w")))
    other = firsts.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("v", "w", "order", "node")])
    pairs = near_join(firsts, other, ["bucket"], "v", "v2", tolerance, zero).where("order < order2")
    if compatible is not None:
        pairs = pairs.where(compatible(F.col("w"), F.col("w2")))
    edges = pairs.select(F.col("node").alias("by"), F.col("node2").alias("to"), F.col("order").alias("by_rank"), F.col("order2").alias("to_rank"))
    seeds = first_come(firsts.select("node"), edges, local)
    owner = firsts.join(seeds, "node").join(firsts.select(F.col("node").alias("seed"), F.col("id").alias("group_id")), "seed")
    owner = owner.select("group_id", *[F.col(c).alias(f"_{c}") for c in same])
    # NaN equals NaN and null equals null here, as in the grouping.
    joined = rows.select("id", *same).join(owner, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]))
    return joined.select("id", "group_id")
