"""Incremental runs: decisions since the last succeeded run, as a batch filter or as a stream that stops when it has
caught up. A checkpoint takes the place of locks and of files that note progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def since_last_run(decisions: DataFrame, runs: DataFrame, at: str = "ts") -> DataFrame:
    """Rows newer than the newest succeeded run of ``runs`` (status, completed_at); all rows if none succeeded."""
    anchor = runs.where("status = 'succeeded'").agg(F.max("completed_at").alias("anchor"))
    return decisions.crossJoin(F.broadcast(anchor)).where(F.col("anchor").isNull() | (F.col(at) > F.col("anchor"))).drop("anchor")  # anchor is one row


def catch_up(spark: SparkSession, path: str, schema, checkpoint: str, target: str, transform) -> None:
    """Reads what has come to ``path`` since the last call, and appends ``transform`` of it to ``target``, exactly once."""
    stream = transform(spark.readStream.schema(schema).parquet(path))
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def counts_by_window(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by window and key of a stream or a batch; a stream drops rows later than ``late``."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
