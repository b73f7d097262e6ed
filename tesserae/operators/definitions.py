"""Definitions and methods that documents give near the mentions of a metric, and how far they agree with the canonical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Segments on either side of a mention, characters kept, phrases, and words of the canonical definitions.
WINDOW, KEPT = 5, 500
DEFINES = r"(?i)\b(we\s+define|defined\s+as|definition\s+of|refers\s+to)\b|\b(means|meaning|metric\s+definitions)\b"
METHOD = r"(?i)\b(calculated\s+as|calculated\s+by|calculation|computed\s+as)\b|\b(determined\s+by|formula|methodology)\b"
WORDS = {
    "cm_new_customers_acquired": ["first", "qualifying", "economic", "activity", "purchase", "transaction", "period"],
    "cm_customers_period_end_by_tenure": ["active", "period", "end", "tenure", "cohort", "time", "since"],
    "cm_revenue_by_cohort": ["revenue", "gaap", "cohort", "acquisition", "tenure", "period"],
    "cm_transactions_by_cohort": ["transactions", "purchase", "cohort", "completed"],
}
ALIGNED, PARTIAL = 0.7, 0.3


def segment_type(text: Column) -> Column:
    """definition, methodology or paragraph."""
    return F.when(text.rlike(DEFINES), "definition").when(text.rlike(METHOD), "methodology").otherwise("paragraph")


def shortened(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(clean) > KEPT, F.concat(F.substr(clean, F.lit(1), F.lit(KEPT)), F.lit("..."))).otherwise(clean)


def alignment(metric: Column, text: Column) -> Column:
    """By the share of the canonical definition's words; unknown without text, words or a canonical definition."""
    low, share = F.lower(text), F.lit(0.0)
    for name, words in WORDS.items():
        hits = sum([F.contains(low, F.lit(w)).cast("int") for w in words], F.lit(0))
        share = F.when(metric == name, hits / len(words)).otherwise(share)
    return F.when(share >= ALIGNED, "aligned").when(share >= PARTIAL, "partial").when(share > 0, "not_aligned").otherwise("unknown")


def definitions(segments: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """key, metric_id, definition and methodology (the first of each within WINDOW segments of a mention; empty: none) and
    alignment. ``segments`` has key, seq and text, ``mentions`` key, seq and metric_id. A mention is spread over the places of its window, so
    the join is on equal places and a document of many segments is no group."""
    typed = segments.withColumn("type", segment_type(F.col("text"))).where("type != 'paragraph'")
    places = mentions.select(key, "metric_id", F.explode(F.sequence(F.col("seq") - WINDOW, F.col("seq") + WINDOW)).alias("seq")).distinct()
    first = lambda kind: F.min(F.when(F.col("type") == kind, F.struct("seq", "text"))).alias(kind)
    near = places.join(typed, [key, "seq"]).groupBy(key, "metric_id").agg(first("definition"), first("methodology"))
    text = lambda kind: F.coalesce(shortened(F.col(f"{kind}.text")), F.lit(""))
    out = near.select(key, "metric_id", text("definition").alias("definition"), text("methodology").alias("methodology"))
    said = F.when(F.col("definition") != "", F.col("definition")).otherwise(F.col("methodology"))
    return out.withColumn("alignment", alignment(F.col("metric_id"), said))
