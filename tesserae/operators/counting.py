"""Order statistics by counting: how many rows have each value, and running sums of these counts. No task sorts a group's
rows, and no list of a group's values is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1024  # of a group, by value


def cumulated(counts: DataFrame, names: list[str]) -> DataFrame:
    """``counts`` (g, v and sums ``names``, a row for each value of a group) with, of each sum, base_ (over lesser values)
    and total_ (over the group)."""
    sums = [F.sum(n).alias(f"total_{n}") for n in names]
    spans = counts.groupBy(F.col("g").alias("g2")).agg(F.min("v").alias("low"), F.max("v").alias("high"), *sums)
    share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
    cell = F.when(F.col("high") > F.col("low"), F.least(F.floor(share * CELLS), F.lit(CELLS - 1))).otherwise(0)
    totals = [f"total_{n}" for n in names]
    counts = counts.join(spans, F.col("g").eqNullSafe(F.col("g2"))).select("g", "v", *names, *totals, cell.alias("cell"))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    tops = counts.groupBy("g", "cell").agg(*[F.sum(n).alias(f"m_{n}") for n in names])
    tops = tops.select(F.col("g").alias("g3"), F.col("cell").alias("cell3"), *[before(f"m_{n}", upto("g").orderBy("cell")).alias(f"above_{n}") for n in names])
    counts = counts.withColumns({f"inner_{n}": before(n, upto("g", "cell").orderBy("v")) for n in names})
    both = counts.join(tops, F.col("g").eqNullSafe(F.col("g3")) & (F.col("cell") == F.col("cell3")))
    return both.select("g", "v", *names, *totals, *[(F.col(f"inner_{n}") + F.col(f"above_{n}")).alias(f"base_{n}") for n in names])


def positions(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n (rows with it), base (rows of lesser values) and total (rows of the group). Nulls and NaN are left out."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    return cumulated(counts, ["n"]).select(F.col("g").alias(group), F.col("v").alias(value), "n", F.col("base_n").alias("base"), F.col("total_n").alias("total"))


def curves(df: DataFrame, group: str, score: str, label: str, recall: float = 0.8) -> DataFrame:
    """By group: positives, negatives, auc (the share of pairs in order, ties half), ap (average precision) and best_precision, the
    most at ``recall`` or more. They are null where one of the classes has no row. ``label`` is boolean; rows without score or
    label are left out."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    counts = rows.groupBy(F.col(group).alias("g"), F.col(score).alias("v")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    at = cumulated(counts, ["p", "n"])
    p, n, all_p, all_n = (F.col(c).cast("double") for c in ("p", "n", "total_p", "total_n"))
    higher_p, higher_n = all_p - F.col("base_p"), all_n - F.col("base_n")  # with this score or more
    precision = higher_p / (higher_p + higher_n)
    out = at.groupBy(F.col("g").alias(group)).agg(
        F.max("total_p").alias("positives"), F.max("total_n").alias("negatives"), (F.sum(p * (F.col("base_n") + n / 2)) / F.max(F.nullif(all_p * all_n, F.lit(0.0)))).alias("auc"),
        (F.sum(p * precision) / F.max(F.nullif(all_p, F.lit(0.0)))).alias("ap"), F.max(F.when(higher_p >= all_p * recall, precision)).alias("best_precision"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return out.withColumns({c: F.when(both, F.col(c)) for c in ("auc", "ap", "best_precision")})


def at_rank(value: str, rank: Column) -> Column:
    """An aggregate of ``positions``: the value of the row of that rank (from 0) of its group."""
    return F.max(F.when((F.col("base") <= rank) & (rank < F.col("base") + F.col("n")), F.col(value)))


def percentile(value: str, p: float) -> Column:
    """An aggregate of ``positions``: the percentile, interpolated between the two nearest ranks."""
    h = (F.col("total") - 1) * F.lit(p)
    low, high = at_rank(value, F.floor(h)), at_rank(value, F.ceil(h))
    part = F.max(h - F.floor(h))
    return low + (high - low) * part
