"""Write semantics of a keyed store, on immutable tables: the new version of the table is a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows win."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows win."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of every scope that ``new`` touches are deleted and replaced."""
    return upsert(old, new, scope)


class ReviewedWorkError(ValueError):
    """A replacement would delete rows that people have reviewed."""


def guard_reviewed(old: DataFrame, new: DataFrame, scope: list[str], force: bool = False) -> None:
    """Raises if a scope that ``new`` replaces holds reviewed rows (review_status neither pending nor null)."""
    touched = old.join(new.select(*scope).distinct(), scope, "left_semi")
    reviewed = touched.where(F.coalesce("review_status", F.lit("pending")) != "pending").limit(1).count()
    if reviewed and not force:
        raise ReviewedWorkError("the scope has reviewed rows")


MODES = ("force", "chart_only", "presence_only")


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, **modes: bool) -> None:
    """Overwrites only the partitions that ``df`` has. At most one of MODES may be set; chart_only keeps chart rows,
    presence_only the presence columns."""
    on = [m for m in MODES if modes.get(m)]
    if len(on) > 1 or set(modes) - set(MODES):
        raise ValueError(f"write modes exclude each other: {on}")
    if on == ["chart_only"]:
        df = df.where(F.col("source_type") == "chart")
    if on == ["presence_only"]:
        df = df.select("filing_id", "metric_id", "presence_score")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
