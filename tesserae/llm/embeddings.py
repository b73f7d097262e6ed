"""Embedding near-dedup by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

Coarse centroids, for each label with enough vectors and for all others together, and for each subspace of the residuals a
codebook are fitted by k-means on a bounded sample (SAMPLE vectors of least hash of the id; the documented bound). Every
vector is then in the list of its nearest centroid, with one byte a subspace and the error of its reconstruction.

A query probes sufficient lists: x within r of q can be in list c only if q lies no further than r behind the plane
between c and q's own centroid. That is certain, but in many dimensions x hardly ever lies straight in the direction of
that plane: its offset from q is a fall towards the origin, which is known, and a sidestep whose share in any one
direction has a standard deviation of 1 / sqrt(dimensions - 1). So a list is probed if the plane is within reach of the
fall and SIGMAS such deviations, and within reach of r. In few dimensions that leaves out nothing but what is certain.
Recall is measured against brute force in the tests, for pairs at the threshold. Of two lists that must be compared, the
members of the one with the lower number are the queries, so a pair is found once.

In a list, asymmetric distances come from a table of the query's residual and each codeword; by the triangle inequality
only vectors within r plus their own error can match. What remains is decided by the cosine in double precision, of
vectors scaled by their largest component first, so that no square overflows.

Vectors are compared only within a label (of any type) and a dimension. Equal vectors of a label are one class, so copies
cost one member. Lists and their queries are cut into blocks of bounded size; each block pair yields a count for each
vector and a spanning forest of its links, never its pairs, so a group of near copies costs no more output than its
members.

Edge cases: vectors that are null, zero or empty, hold null or non-finite components, or have no label or no vec_id
link with nothing and are kept. Repeated vec_ids count as vectors of their own in n_links. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .components import connected, forest
from .scratch import Scratch

COSINE, SAMPLE, SUBSPACES, CODES, ROUNDS = 0.93, 50_000, 8, 256, 8
SIGMAS, OWN = 4.0, 256  # deviations; vectors of a label in the sample from which on it has centroids of its own
ROWS, QUERIES = 2048, 4096  # of a block


def kmeans(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm from ``k`` distinct rows at random; an empty cluster keeps its centre."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[k : k + 4096], centres).argmin(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def n_lists(rows: float, sampled: int) -> int:
    """Lists for that many vectors, of which so many are in the sample."""
    return max(1, min(sampled // 8, round(rows**0.5 / 2)))


class Index:
    """Coarse centroids by label and codebooks for vectors of one dimension, fitted on unit vectors ``x``, which stand for
    ``share`` times as many."""

    def __init__(self, x: np.ndarray, labels: list, share: float):
        labels = np.asarray(labels, object)
        self.centres = {None: kmeans(x, n_lists(len(x) * share, len(x)))}
        rest = np.empty_like(x)
        for label in pd.unique(labels):
            own = np.flatnonzero(labels == label)
            if len(own) >= OWN:
                self.centres[label] = kmeans(x[own], n_lists(len(own) * share, len(own)))
            c = self.of(label)
            rest[own] = x[own] - c[nearest(x[own], c)]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        self.books = [kmeans(rest[:, c], CODES) for c in self.cuts]

    def of(self, label) -> np.ndarray:
        return self.centres.get(label, self.centres[None])

    def encode(self, x: np.ndarray, label) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and reconstruction error of each row."""
        centres = self.of(label)
        own = nearest(x, centres)
        rest = x - centres[own]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        error = np.zeros(len(x))
        for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            error += ((rest[:, c] - b[codes[:, m]]) ** 2).sum(1)
        return own, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, own: np.ndarray, label, cosine: float, sigmas: float = SIGMAS) -> np.ndarray:
        """Which lists can hold what has ``cosine`` or more with each row; of other lists than a row's own, those of a
        higher number only."""
        centres = self.of(label)
        at, apart = np.arange(len(x)), np.sqrt(squared(centres, centres))
        d, dot = squared(x, centres), x @ centres.T
        gap = (d - d[at, own][:, None]) / 2
        sure = (np.sqrt(2 - 2 * cosine) + 1e-6) * apart[own]
        fall = (1 - cosine) * np.maximum(0, dot[at, own][:, None] - dot)
        side = np.sqrt(1 - cosine**2) * sigmas / np.sqrt(max(1, x.shape[1] - 1)) * apart[own]
        found = gap <= np.minimum(sure, fall + side) + 1e-9
        return found & (np.arange(len(centres))[None, :] >= own[:, None]) | (np.arange(len(centres))[None, :] == own[:, None])

    def distances(self, q: np.ndarray, label, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded vectors of a list."""
        rest, total = q - self.of(label)[which], np.zeros((len(q), len(codes)), np.float32)
        for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            total += squared(rest[:, c], b).astype(np.float32)[:, codes[:, m]]
        return np.sqrt(total)


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(classes: DataFrame) -> dict[int, Index]:
    """An index for each dimension in the sample."""
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector", "label").toPandas()
    share = max(1.0, total / max(1, len(sample)))
    return {int(size): Index(unit(part["vector"]), part["label"].tolist(), share) for size, part in sample.groupby(sample["vector"].map(len))}


def search(classes: DataFrame, cosine: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For classes (rep, n, label, vector): rep and the number of vectors in other classes linked to it; and links a, b
    that join what all links join."""
    spark = classes.sparkSession
    ship(spark)
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    shared = spark.sparkContext.broadcast(fit(classes))

    def index_of(size: int) -> Index:  # a dimension that the sample missed has one list
        return shared.value.get(size) or Index(np.eye(1, size), [None], 1.0)

    def encode(frames):
        for df in frames:
            out = []
            for size, same in df.groupby(df["vector"].map(len)):
                index = index_of(int(size))
                known = list(index.centres)  # the first is for labels without centroids of their own
                place = {label: k for k, label in enumerate(known)}
                for k, part in same.groupby(same["label"].map(lambda x: place.get(x, 0)), sort=False):  # noqa: B023
                    label, u = known[k], unit(part["vector"])
                    own, codes, error = index.encode(u, label)
                    lists = [np.flatnonzero(p).astype(np.int32).tolist() for p in index.probes(u, own, label, cosine)]
                    out.append(part.assign(size=np.int32(size), list=own.astype(np.int32), codes=[c.tobytes() for c in codes], error=error, probes=lists))
            if out:
                yield pd.concat(out)

    vector = classes.schema["vector"].dataType.simpleString()
    kinds = f"rep long, n long, label string, vector {vector}, size int, list int, codes binary, error double, probes array<int>"
    coded = scratch.save(classes.select("rep", "n", "label", "vector").mapInPandas(encode, kinds), "coded")
    cell = ["label", "size", "list"]
    queries = coded.select("rep", "n", "label", "size", "vector", F.col("list").alias("own"), F.explode("probes").alias("list"))
    n_rows = coded.groupBy(*cell).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
    n_queries = queries.groupBy(*cell).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("query_blocks"))
    sizes = scratch.save(n_rows.join(n_queries, cell), "cells")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, cell).withColumn("qb", deal("query_blocks")).withColumn("b", all_("blocks")).drop("blocks", "query_blocks")
    right = scratch.load("coded", coded).drop("probes").join(sizes, cell).withColumn("b", deal("blocks")).withColumn("qb", all_("query_blocks")).drop("blocks", "query_blocks")

    def match(key, q, x):
        out = []
        if len(q) and len(x):
            label, size, which = key[0], int(key[1]), int(key[2])
            index, uq, ux = index_of(size), unit(q["vector"]), unit(x["vector"])
            codes = np.stack([np.frombuffer(c, np.uint8) for c in x["codes"]])
            most, reps, own = radius + x["error"].to_numpy() + 1e-4, x["rep"].to_numpy(), q["rep"].to_numpy()
            weight, own_weight, across = x["n"].to_numpy(), q["n"].to_numpy(), q["own"].to_numpy() != which
            ids, place = np.unique(np.concatenate([own, reps]), return_inverse=True)
            counts, ia, ib = np.zeros(len(ids), np.int64), [], []
            for k in range(0, len(q), 256):
                near = index.distances(uq[k : k + 256], label, which, codes) <= most[None, :]
                i, j = np.nonzero(near)
                good = (np.einsum("ij,ij->i", uq[k + i], ux[j]) >= cosine) & (own[k + i] != reps[j])
                i, j = i[good] + k, j[good]
                np.add.at(counts, place[i], weight[j])
                both = across[i]  # within a list each of a pair is a query
                np.add.at(counts, place[len(own) + j[both]], own_weight[i[both]])
                ia.append(place[i])
                ib.append(place[len(own) + j])
            out += [(int(ids[k]), int(counts[k]), None) for k in np.flatnonzero(counts)]
            out += [(int(ids[a]), 0, int(ids[b])) for a, b in forest(len(ids), np.concatenate(ia), np.concatenate(ib))]
        return pd.DataFrame({"a": pd.array([r[0] for r in out], "Int64"), "n_links": pd.array([r[1] for r in out], "Int64"), "b": pd.array([r[2] for r in out], "Int64")})

    key = [*cell, "b", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(match, "a long, n_links long, b long")
    found = scratch.save(found, "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("others"))
    return counts, found.where("b is not null").select("a", "b")


def near_duplicates(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vec_id, embedding, label."""
    scratch = Scratch(table.sparkSession, "embeddings")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    kind = table.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"  # what the components are, without loss
    label = F.col("label") + F.lit(0.0) if table.schema["label"].dataType.simpleString() in ("float", "double") else F.col("label")
    rows = table.select("vec_id", "embedding", label.cast("string").alias("label"), F.coalesce(fit, F.lit(False)).alias("fit"))
    # -0.0 and 0.0 are equal as components and as labels.
    rows = rows.withColumn("vector", F.when(F.col("fit"), F.transform("embedding", lambda x: (x + F.lit(0.0)).cast(kind))))
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector")).drop("embedding")
    rows = scratch.save(rows, "rows")
    same = ["label", "h1", "h2"]
    classes = rows.where("fit").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    # A number of its own for each class, as vec_ids may repeat; fixed once the table is written.
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("rep"), F.col("rep").alias("least"), "n", "vector", *same), "classes")
    counts, links = search(classes, cosine, scratch)
    owned = scratch.save(rows.where("fit").join(classes.select(*same, "rep"), same).select("vec_id", "rep"), "owned")
    several = owned.groupBy("vec_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low != high")
    loops = owned.join(several, "vec_id").select(F.col("low").alias("a"), F.col("rep").alias("b")).where("a != b").distinct()
    parts = connected(links.unionByName(loops), scratch, "parts")
    named = classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    named = named.select("least", *same, (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("part"))
    named = scratch.save(named, "named")
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    ids = scratch.load("named", named).join(least, "part").select(*same, "n_links", "component_id", F.lit(True).alias("fit"))
    out = rows.select("vec_id", "fit", *same).join(ids, [*same, "fit"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more within equal labels, over all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE ok AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN least ON e.vec_id = least.a
"""
