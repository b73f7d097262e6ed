"""Joins by nearness: of values within a tolerance, of intervals that overlap. Keys are widened by cells, so that a key with
many rows is cut along its values and only what can match meets.

The pairs themselves are the result; a caller who needs only who belongs together should take classes of equal values first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch

DAYS = 64  # of a cell of dates at least


def within(value: Column, other: Column, tolerance: float, zero: float = 0.0) -> Column:
    """Relative to ``other``; where either is zero the difference may be ``zero`` at most. Nulls are near each other only."""
    plain = F.when((value == 0) | (other == 0), F.abs(value - other) <= zero).otherwise(F.abs(value - other) <= tolerance * F.abs(other))
    return F.coalesce(plain, value.isNull() & other.isNull())


def _cell(value: Column, tolerance: float) -> Column:
    """The logarithm in steps in which values within the tolerance lie in the same or the next cell."""
    return F.floor(F.log(F.abs(value)) / -math.log(1 - tolerance)).cast("long")


def near_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, other: str, tolerance: float, zero: float = 0.0) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose ``value`` (left) is within ``tolerance`` of ``other`` (right). Null keys meet
    nobody; NaN is near to nothing."""
    place = lambda sign, cell: F.struct(sign.alias("sign"), cell.cast("long").alias("cell"))
    none, zeros = place(F.lit(-9), F.lit(0)), place(F.lit(0), F.lit(0))
    small = lambda c: F.abs(F.col(c)) <= zero
    sign = lambda c: F.signum(F.col(c)).cast("int")

    def places(c: str, steps: list[int]) -> Column:
        own = F.array(*[place(sign(c), _cell(F.col(c), tolerance) + k) for k in steps])
        found = F.when(F.col(c) == 0, F.array(zeros)).when(small(c), F.concat(own, F.array(zeros))).otherwise(own)
        return F.when(F.col(c).isNull(), F.array(none)).when(F.isnan(F.col(c)), F.array().cast(own_type)).otherwise(found)

    own_type = "array<struct<sign:int,cell:bigint>>"
    a = left.withColumn("_at", F.explode(places(value, [0])))
    b = right.withColumn("_at", F.explode(places(other, [-1, 0, 1])))
    met = a.join(b, [*keys, "_at"])
    in_zeros = (F.col("_at.sign") != 0) | (F.col(value) == 0) | (F.col(other) == 0)  # two small values meet in cells of their own
    return met.where(in_zeros & within(F.col(value), F.col(other), tolerance, zero)).drop("_at")


def overlap_join(df: DataFrame, keys: list[str], id_: str, start: str, end: str, days: int = DAYS) -> DataFrame:
    """left and right, the ids of each two rows with equal ``keys`` whose closed intervals of dates overlap, the lesser id on
    the left. The later start of two lies in both, so one side is spread over the cells it covers and the other is in the
    cell of its start only."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    cell = lambda c: F.floor(day(c) / days)
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.col(id_).alias("i"), F.col(start).alias("s"), F.col(end).alias("e"))
    rows = Scratch(df.sparkSession, "overlaps").again(rows)  # both sides come from it, so what made it runs once
    # Cells as wide as intervals are on average: a row goes to two of them on average, and few meet that don't overlap.
    wide = rows.agg(F.avg(F.abs(day("e") - day("s")))).first()[0]
    days = max(days, math.ceil(wide or 0))
    places = F.sequence(cell(F.least("s", "e")).cast("int"), cell(F.greatest("s", "e")).cast("int"))
    spread = rows.withColumn("cell", F.explode(places))
    starts = rows.select(*keys, cell(F.least("s", "e")).cast("int").alias("cell"), *[F.col(c).alias(f"{c}2") for c in ("i", "s", "e")])
    # Of equal starts the lesser id spreads; of others the earlier start does.
    lo, lo2, hi = F.least("s", "e"), F.least("s2", "e2"), F.greatest("s", "e")
    first = (lo < lo2) | ((lo == lo2) & (F.col("i") < F.col("i2")))
    met = spread.join(starts.hint("merge"), [*keys, "cell"]).where(first & (lo2 <= hi))
    met = met.where((F.col("e") >= F.col("s2")) & (F.col("e2") >= F.col("s")))
    return met.select(*keys, F.least("i", "i2").alias("left"), F.greatest("i", "i2").alias("right"))
