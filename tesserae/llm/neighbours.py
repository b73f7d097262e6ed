"""Approximate nearest neighbours: a robust-pruned directed graph a shard, beam search of all queries in every shard.

Vectors go to shards of about SHARD rows by a hash, so the rows of a shard are a sample of all and its task has a bounded size.
Each shard's graph is built once and written as a table (a row a node, with its edges). The queries are cut into blocks; a
block meets a shard in one group, whose size doesn't grow with the input. The BEAM nearest nodes that the search finds by
single precision are scored by the cosine in double precision of the vectors scaled by their largest component, and the
best of all shards are a window's first rows, which Spark cuts down before the shuffle.

Equal vectors are one node, since copies would fill each other's edges: of their ids only the least few can be an answer,
and a group limit keeps no others. Equal queries are searched once.

Edge cases: rows whose vec_id is null, or whose vector is null, empty, zero or holds null or non-finite components take no
part. Vectors are near only to those of the same length. Where vec_ids repeat each row is a query and a candidate, and a
query skips one row of its own id and vector. Queries with fewer candidates have fewer rows. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import graphs, ranks
from .embeddings import unit
from .scratch import Scratch

NEAREST, EVERY, SHARD, QUERIES, BEAM = 5, 50, 8192, 2048, 96
CLASS = ["h1", "h2"]


def usable(table: DataFrame) -> DataFrame:
    """vec_id, vector, its length and two hashes of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    kind = "float" if table.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    vector = F.transform("embedding", lambda x: (x + F.lit(0.0)).cast(kind))  # -0.0 is 0.0
    rows = table.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    return rows.select("vec_id", "vector", F.size("vector").alias("size"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))


def cells(df: DataFrame, rows: int, name: str) -> DataFrame:
    """size and the number of parts of about ``rows`` rows that vectors of that length are dealt to."""
    return df.groupBy("size").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))


def build(df: pd.DataFrame) -> pd.DataFrame:
    """The shard's rows with their place, edges and whether searches enter at it."""
    df = df.sort_values(CLASS, ignore_index=True)  # the graph depends on the order
    edges, entry = graphs.build(unit(df["vector"]).astype(np.float32))
    return df.assign(node=np.arange(len(df), dtype=np.int32), edges=list(edges), entry=np.arange(len(df)) == entry)


def answer(graph: pd.DataFrame, queries: pd.DataFrame, nearest: int, beam: int) -> pd.DataFrame:
    """h1, h2, vec_id and score of each query's ``nearest`` rows in one shard."""
    out = []
    if len(graph) and len(queries):
        graph = graph.sort_values("node", ignore_index=True)
        x, q, ids = unit(graph["vector"]), unit(queries["vector"]), graph["ids"].tolist()
        edges = np.vstack([np.stack(graph["edges"]), np.full((1, len(graph["edges"][0])), -1)]).astype(np.int32)
        h1, h2 = queries["h1"].tolist(), queries["h2"].tolist()
        x32, q32, entry = x.astype(np.float32), q.astype(np.float32), int(np.flatnonzero(graph["entry"])[0])
        for at in range(0, len(q), graphs.BATCH):
            found, _, _ = graphs.search(x32, edges, entry, q32[at : at + graphs.BATCH], beam)
            for k, near in enumerate(found, at):
                near = near[near >= 0]
                score = x[near] @ q[k]
                least = np.sort(score)[-nearest:][0]  # what a node behind so many cannot change
                best = sorted((-s, i) for n, s in zip(near.tolist(), score.tolist(), strict=True) if s >= least for i in ids[n])[:nearest]
                out += [(h1[k], h2[k], int(i), -s) for s, i in best]
    return pd.DataFrame(out, columns=[*CLASS, "vec_id", "score"])


def nearest_neighbours(table: DataFrame, nearest: int = NEAREST, every: int = EVERY, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score: for the rows of vec_id and embedding whose vec_id is divisible by ``every``, the
    ``nearest`` other rows by cosine."""
    spark = table.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neighbours")
    rows = usable(table)
    few = Window.partitionBy(*CLASS).orderBy("vec_id")
    classes = rows.withColumn("k", F.row_number().over(few)).where(F.col("k") <= nearest + 1)
    classes = scratch.save(classes.groupBy(*CLASS).agg(F.first("size").alias("size"), F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = scratch.save(queries.groupBy(*CLASS).agg(F.first("size").alias("size"), F.first("vector").alias("vector")), "asked")
    parts = cells(classes, shard, "shards").join(cells(asked, QUERIES, "blocks"), "size", "left")
    parts = scratch.save(parts.select("size", "shards", F.coalesce("blocks", F.lit(1)).alias("blocks")), "parts")
    deal = lambda h, n: F.pmod(F.col(h), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = lambda: ranks.bounded(scratch.load("parts", parts))

    dealt = scratch.load("classes", classes).join(known(), "size").select(*CLASS, "size", deal("h1", "shards").alias("shard"), "vector", "ids")
    vector = classes.schema["vector"].dataType.simpleString()
    graph = dealt.groupBy("size", "shard").applyInPandas(build, f"h1 long, h2 long, size int, shard int, vector {vector}, ids array<long>, node int, edges array<int>, entry boolean")
    graph = scratch.save(graph, "graph")

    left = graph.join(known(), "size").withColumn("block", each("blocks")).drop("shards", "blocks", *CLASS)
    right = asked.join(known(), "size").withColumn("shard", each("shards")).withColumn("block", deal("h2", "blocks")).drop("shards", "blocks")
    key = ["size", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda g, q: answer(g, q, nearest + 1, beam), "h1 long, h2 long, vec_id long, score double")
    order = Window.partitionBy(*CLASS).orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= nearest + 1)
    best = scratch.save(best.groupBy(*CLASS).agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("best")), "best")

    own = F.array_position(F.transform("best", lambda b: b["vec_id"]), F.col("query_id"))
    others = F.filter("best", lambda b, i: i + 1 != F.col("own"))
    out = queries.select(F.col("vec_id").alias("query_id"), *CLASS).join(best, CLASS).withColumn("own", own)
    out = out.select("query_id", F.posexplode(F.slice(others, 1, nearest)).alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
