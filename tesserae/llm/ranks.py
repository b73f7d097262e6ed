"""Positions in a long order without sorting it in one task, and rows that repeat."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # of a few longs each; beyond it a join shuffles
STEP = 4096  # of a sequence that becomes rows


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only if its rows have been counted and are few."""
    return F.broadcast(df) if df.count() <= most else df


def before(counts: DataFrame, group: list[str], fine: str | list[str], coarse: Column) -> DataFrame:
    """``counts`` (group, fine, n) with base, the sum of n over the group's earlier cells. ``coarse`` grows with ``fine``:
    sums of coarse cells are added up first, so no window holds more than the coarse cells of a group or the cells of one."""
    fine = [fine] if isinstance(fine, str) else fine
    counts = counts.withColumn("_coarse", coarse)
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy(*group, "_coarse").agg(F.sum("n").alias("_m"))
    tops = tops.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_coarse").alias("_top"), F.coalesce(F.sum("_m").over(upto(*group).orderBy("_coarse")), F.lit(0)).alias("_above"))
    inner = F.coalesce(F.sum("n").over(upto(*group, "_coarse").orderBy(*fine)), F.lit(0))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], F.col("_coarse") == F.col("_top"))
    both = counts.withColumn("base", inner).join(tops, same)
    return both.select(*group, *fine, "n", (F.col("base") + F.col("_above")).alias("base"))


def copies(df: DataFrame, n: str, k: str) -> DataFrame:
    """Each row ``n`` times with ``k`` from 0, a bounded stretch of it at once."""
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {STEP}")))
    out = df.where(F.col(n) > 0).withColumn("_stretch", stretch)
    last = F.least((F.col("_stretch") + 1) * STEP, F.col(n)) - 1
    return out.withColumn(k, F.explode(F.sequence(F.col("_stretch") * STEP, last))).drop("_stretch")


def other_hash(docs: DataFrame, known: list[str]) -> Column:
    """A hash of all columns but those ``known``, which tells apart rows that are equal in these."""
    rest = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns if c not in known]
    return F.xxhash64(F.lit(3), *rest)


def one_of_each(docs: DataFrame, key: Column, repeated: DataFrame, known: list[str]) -> DataFrame:
    """doc (a struct of the columns) and k of ``docs``: one row for each key in ``repeated`` (k), and all rows of other
    keys. Of rows that differ in columns beyond ``known``, the one with the least hash stays, so reruns agree."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("k"), other_hash(docs, known).alias("h"))
    single = keyed.join(repeated, "k", "left_anti").select("doc", "k")
    several = keyed.join(repeated, "k", "left_semi").groupBy("k").agg(F.min_by("doc", "h").alias("doc"))
    return single.unionByName(several)


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the struct ``doc``."""
    return df.select(*[F.col(f"doc.`{c}`").alias(c) for c in columns])
