"""Embedding whitening: moments merged by Chan's pairwise formula, eigenvectors on the driver, and a pass that verifies.

Vectors become whole numbers, x = floor(1024 c) + 100000 for each entry c. Every Arrow batch gives its count, its sums (whole,
so means carry no error) and its scatter about its own mean; batches are merged within a partition and partitions in a
treeReduce, by M = Ma + Mb + (na nb / n) d d' with d the difference of the means. What travels is one matrix of
dimensions x dimensions a partition, which doesn't grow with the rows. The driver takes the eigenvectors of M / n. A second
pass projects all rows and merges the moments of what comes out in the same way: their covariance less the identity is the
identity error. A third pass returns the rows, so nothing is stored.

Edge cases: rows whose vector is null or holds null or non-finite entries are left out, and so are empty vectors and
components without variance (an eigenvalue under 1e-12 of the trace), so a single vector gives no rows. Vectors of
different lengths are whitened apart, each length with all of its vectors as the fit list. Entries beyond +-2^50 / 1024 count as that
bound. ``deviation`` is computed in whole numbers of any size and null where it exceeds a long. vec_ids may repeat or be
null: each row is a row. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .words import tidy

SCALE, SHIFT, BOUND, COMPONENTS = 1024.0, 100_000, 2**50, 8
LEAST = 1e-12  # of the trace: below it a component has no variance


class Moments:
    """Count, sums and centred scatter of whole or real rows."""

    def __init__(self, n: int, sums: list, scatter: np.ndarray):
        self.n, self.sums, self.scatter = n, sums, scatter

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        n, sums = len(x), total(x)
        away = centred(x, n, sums)
        return cls(n, sums, away.T @ away)

    def merged(self, other: Moments) -> Moments:
        n, m = self.n, other.n
        apart = np.array([(a * m - b * n) / (n * m) for a, b in zip(self.sums, other.sums, strict=True)], np.float64)
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (n * m / (n + m))
        return Moments(n + m, [a + b for a, b in zip(self.sums, other.sums, strict=True)], scatter)

    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def total(x: np.ndarray) -> list:
    """Sums of columns; of whole numbers without overflow."""
    if x.dtype == np.int64 and len(x) and int(np.abs(x).max()) * len(x) >= 2**62:
        return x.astype(object).sum(0).tolist()
    return x.sum(0).tolist()


def scaled(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """n x - S in whole numbers, as longs if they fit."""
    if len(x) and max(int(np.abs(x).max()) * n, *map(abs, sums)) >= 2**61:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """x less the mean: of whole numbers with one rounding only."""
    return scaled(x, n, sums).astype(np.float64) / n if x.dtype == np.int64 else x - np.array(sums) / n


def deviations(wide: np.ndarray) -> list:
    """Sums of squares of rows of whole numbers: None where one exceeds a long."""
    if wide.dtype == np.int64 and len(wide) and float(np.abs(wide).max()) ** 2 * wide.shape[1] < 2**62:
        return (wide * wide).sum(1).tolist()
    exact = (wide.astype(object) ** 2).sum(1).tolist()
    return [int(v) if v < 2**63 else None for v in exact]


def whole(flat: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(flat.astype(np.float64).reshape(-1, size) * SCALE)
    return np.clip(x, -BOUND, BOUND).astype(np.int64) + SHIFT


def blocks(table):
    """(length, vec_ids, whole numbers) for each length of vector in an Arrow batch of vec_id and vector."""
    vectors, ids = table.column(1), table.column(0)
    lengths = np.diff(vectors.offsets.to_numpy())
    for size in np.unique(lengths).tolist():
        at = pa.array(np.flatnonzero(lengths == size))
        yield size, ids.take(at), whole(vectors.take(at).flatten().to_numpy(zero_copy_only=False), size)


def merge(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return {k: a[k].merged(b[k]) if k in a and k in b else a.get(k) or b[k] for k in a.keys() | b.keys()}


def gathered(good: DataFrame, of) -> dict[int, Moments]:
    """Moments by length of what ``of`` (length, rows) makes of the rows; one pickled value a partition is reduced."""

    def local(tables):
        own: dict[int, Moments] = {}
        for t in tables:
            for size, _, x in blocks(t):
                own = merge(own, {size: Moments.of(of(size, x))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["moments"])

    parts = good.mapInArrow(tidy(local), "moments binary").rdd.map(lambda r: pickle.loads(r[0]))
    return parts.treeReduce(merge, depth=3) if parts.getNumPartitions() else {}


class Fit:
    """Components of one length's vectors: unit eigenvectors of the covariance by falling eigenvalue."""

    def __init__(self, m: Moments, most: int):
        values, vectors = np.linalg.eigh(m.covariance())
        order = np.argsort(-values, kind="stable")[:most]
        self.n, self.sums, trace = m.n, m.sums, float(np.trace(m.covariance()))
        order = [k for k in order if values[k] > LEAST * trace]
        self.values, self.vectors, self.explained = values[order], vectors[:, order], values[order] / trace if trace else values[order]
        self.error = 0.0

    def whiten(self, wide: np.ndarray) -> np.ndarray:
        return (wide.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def whiten(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of the rows of vec_id and embedding."""
    spark = table.sparkSession
    ship(spark)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vector = F.col("embedding").cast("array<double>").alias("vector")
    good = table.where(~F.coalesce(bad, F.lit(True)) & (F.size("embedding") > 0)).select("vec_id", vector)
    fits = {size: Fit(m, most) for size, m in gathered(good, lambda size, x: x).items()}
    fits = {size: f for size, f in fits.items() if len(f.values)}
    shared = spark.sparkContext.broadcast(fits)  # a mean and at most ``most`` vectors for each length

    def white(size: int, x: np.ndarray) -> np.ndarray:
        f = shared.value.get(size)
        return f.whiten(scaled(x, f.n, f.sums)) if f else np.zeros((len(x), 0))

    for size, m in gathered(good, white).items():
        if size in fits:
            fits[size].error = float(np.abs(m.covariance() - np.eye(len(m.sums))).max())
    known = spark.sparkContext.broadcast(fits)

    def rows(tables):
        for t in tables:
            for size, ids, x in blocks(t):
                f = known.value.get(size)
                if f is None:
                    continue
                wide = scaled(x, f.n, f.sums)
                k, r = len(f.values), len(x)
                out = {"component": np.tile(np.arange(1, k + 1, dtype=np.int32), r), "n": np.full(r * k, f.n, np.int64)}
                out["deviation"] = pa.array(pd.Series(deviations(wide), dtype="object").repeat(k).tolist(), pa.int64())
                out |= {"whitened": f.whiten(wide).ravel(), "explained": np.tile(f.explained, r), "identity_error": np.full(r * k, f.error)}
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(r), k))), *[c if isinstance(c, pa.Array) else pa.array(c) for c in out.values()]], ["vec_id", *out])

    kind = table.schema["vec_id"].dataType.simpleString()
    return good.mapInArrow(tidy(rows), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of all embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
