"""Queries of single functions: sentences, lists, similarity, JSON updates, clips, located rules, fact assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, sentences
from .base import facts, query, table
from .documents import hits
from .extraction import _values


@query("sentence_bounds")
def sentence_bounds(spark, d):  # H2, H3: the sentence around every "the" of each turn
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", F.explode(hits(F.col("text"), "the ")).alias("at")).withColumn("at", (F.col("at") - 1).cast("int"))
    return c.select("conv_id", "turn", "at", sentences.sentence_bounds("text", "at").alias("s")).select("conv_id", "turn", "at", "s.start", "s.end")


@query("text_similarity")
def text_similarity(spark, d):  # D25
    return table(spark, d, "part").select("p_partkey", F.round(sentences.similarity("p_name", "p_type"), 6).alias("ratio"))


@query("json_set", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"progress\":\"' || event_type || '\"}' AS props FROM events")
def json_set(spark, d):  # J3: a struct rebuilt with one path replaced
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(k, F.col("event_type").alias("progress"))).alias("props"))


@query("clipped_features", "SELECT fact_id, round(least(ln(1 + value) / 12, 1.0), 6) AS size, greatest(least(quantity / 40, 1.0), 0.1) AS share FROM facts", "facts")
def clipped_features(spark, d):  # I9
    f = facts(spark, d)
    return f.select("fact_id", F.round(F.least(F.log1p("value") / 12, F.lit(1.0)), 6).alias("size"), F.greatest(F.least(F.col("quantity") / 40, F.lit(1.0)), F.lit(0.1)).alias("share"))


@query("describe_values", "SELECT tier, count(*) AS n, round(avg(quantity), 6) AS mean, round(stddev_pop(quantity), 6) AS spread FROM facts GROUP BY tier", "facts")
def describe_values(spark, d):  # D20
    return facts(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("quantity"), 6).alias("mean"), F.round(F.stddev_pop("quantity"), 6).alias("spread"))


@query("fact_assembly", """SELECT fact_id, sha256(concat_ws('|', CAST(filing_id AS VARCHAR), metric_id, source_type)) AS fact_key, CASE WHEN tier LIKE 'S%' THEN 'cohort' ELSE 'company' END AS scope, CASE WHEN tier LIKE 'S%' THEN metric_id || '_by_cohort' ELSE metric_id END AS canonical_id FROM facts""", "facts")
def fact_assembly(spark, d):  # M13: reproducible ids instead of random ones
    f, cohort = facts(spark, d), F.col("tier").startswith("S")
    key = F.sha2(F.concat_ws("|", F.col("filing_id").cast("string"), "metric_id", "source_type"), 256)
    return f.select("fact_id", key.alias("fact_key"), F.when(cohort, "cohort").otherwise("company").alias("scope"), F.when(cohort, F.concat("metric_id", F.lit("_by_cohort"))).otherwise(F.col("metric_id")).alias("canonical_id"))
