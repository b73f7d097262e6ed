"""Connected components by alternating large-star and small-star steps, all of them shuffles of edges.

Each step is a grouped minimum (combined before the shuffle, so a node with very many neighbours is no hot group) and a
join that adaptive execution can split. The edges are written as a table after each round; only counts reach the driver.
Edges of LOCAL or fewer, counted first, need no rounds: a union-find in one task of an executor has the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .scratch import Scratch
from .words import tidy

LOCAL = 500_000  # edges of two longs


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Each node's chosen neighbours hang on the smallest of itself and them."""
    if large:  # all neighbours choose the minimum, larger ones are moved
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.where("a != b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def _union_find(tables):
    parts = [np.stack([t.column(0).to_numpy(), t.column(1).to_numpy()]) for t in tables if t.num_rows]
    if not parts:
        return
    nodes, flat = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    up = list(range(len(nodes)))
    for a, b in zip(*flat.reshape(2, -1).tolist(), strict=True):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a < b:  # nodes are sorted, so the root is the smallest
            up[b] = a
        else:
            up[a] = b
    for k in range(len(up)):  # parents are smaller, so they are settled
        up[k] = up[up[k]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], ["node", "component"])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links among 0 to n - 1 that a union-find needs to join what all of them join."""
    up, out = list(range(n)), []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = i, j
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[x] = y
            out.append((i, j))
    return out


def connected(edges: DataFrame, scratch: Scratch, name: str, local: int = LOCAL) -> DataFrame:
    """node and component, the smallest node reachable, for each node with an edge. ``edges`` has a and b, any order;
    loops and repeats do no harm."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now = scratch.save(now, f"{name}-0")
    ship(now.sparkSession)
    seen, step = None, 0
    while True:
        # Stars are a fixed point: the same number of edges with the same sum of hashes means nothing has moved.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] <= local:
            return scratch.save(now.repartition(1).mapInArrow(tidy(_union_find), "node long, component long"), f"{name}-done")
        if mark == seen:
            break
        seen, step = mark, step + 1
        now = scratch.save(_star(_star(now, True), False), f"{name}-{step}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
