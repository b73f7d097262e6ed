"""Latest rows, top rows and pages. Every order has a unique last key, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list, others: bool = False) -> DataFrame:
    """The first row of each group in ``order``, or all but it."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn > 1" if others else "_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def page(df: DataFrame, sortable: dict[str, str], by: str, tie: str, limit: int, offset: int) -> DataFrame:
    """A page of a list, largest first, by one of the sortable columns; others fall back to the tie key."""
    return df.orderBy(F.desc_nulls_last(sortable.get(by, tie)), tie).offset(offset).limit(limit)


def dense_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))
