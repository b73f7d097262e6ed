"""Definitions of metrics in documents: every order becomes one that mentions a metric and defines it, nearer or further off."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogue
from ..operators import definitions
from ..sources import html
from .base import query, table
from .dataflow import LEAD

METRICS = [*catalogue.METRICS, ("cm_revenue_by_cohort", [r"\brevenue\s+by\s+cohort\b"], []), ("cm_transactions_by_cohort", [r"\btransactions\s+by\s+cohort\b"], [])]
NAMES = ["new customers", "revenue by cohort", "transactions by cohort"]
TEXTS = [
    "We define this as the count of first qualifying economic activity, a purchase or transaction in the period.",
    "It is defined as the first purchase that anyone makes with us here and now today.",
    "This is calculated as GAAP revenue in the period over each cohort of users that we have.",
    "Meaning of words in this section is up to the reader of them all, as ever.",
    "Nothing is said here about how we count, nor about what it is that we count at all.",
]


@query("metric_definitions", """WITH o AS (SELECT o_orderkey AS filing_id, o_orderkey % 3 AS m, o_orderkey % 5 AS t, o_orderkey % 7 AS apart FROM orders)
SELECT filing_id, ['cm_new_customers_acquired', 'cm_revenue_by_cohort', 'cm_transactions_by_cohort'][m + 1] AS metric_id, t IN (0, 1, 3) AS defined, t = 2 AS calculated,
       CASE WHEN t = 3 OR t = 1 AND m = 1 THEN 'unknown' WHEN t = 0 AND m = 0 THEN 'aligned' WHEN t = 2 AND m = 1 THEN 'partial' ELSE 'not_aligned' END AS alignment FROM o WHERE apart < 5 AND t < 4""")
def metric_definitions(spark, d):  # M14, A4: typed segments near mentions, with their agreement
    o = F.col("o_orderkey")
    name, text = (F.get(F.array(*map(F.lit, x)), (o % len(x)).cast("int")) for x in (NAMES, TEXTS))
    page = F.concat(
        F.lit("<html><body><p>In this part of the report we speak of "), name, F.lit(" and of how they came to us.</p>"), F.repeat(F.lit(f"<p>{LEAD}</p>"), (o % 7).cast("int")), F.lit("<p>"), text, F.lit("</p></body></html>"),
    )
    found = html.segments(table(spark, d, "orders").select(o.alias("filing_id"), page.alias("html")), "filing_id").where("kind = 'paragraph'")
    said = catalogue.each(found.where(F.col("text").rlike(catalogue.any_pattern(METRICS))), "hit", catalogue.candidates(F.col("text"), METRICS)).select("filing_id", "seq", "hit")
    out = definitions.definitions(found.select("filing_id", "seq", "text"), said.select("filing_id", "seq", "hit.metric_id"), "filing_id")
    return out.select("filing_id", "metric_id", (F.col("definition") != "").alias("defined"), (F.col("methodology") != "").alias("calculated"), "alignment")
