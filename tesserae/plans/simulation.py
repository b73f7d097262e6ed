"""A change of the catalogue tried out on every filing before it is made."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogue
from ..operators import simulation
from .base import query, table
from .dataflow import SAID_SQL, filings, segments

# Accepted recommendations (exclusions), a pattern too wide and one taken away.
CHANGE = {
    "exclusions": {"cm_active_customers_total": [r"\bincreased\b"], "cm_customer_churn_rate": [r"\bkey\s+metric\b"]},
    "added": {"cm_revenue_per_customer": [r"\bhow\s+our\s+business\s+developed\b"], "cm_market_opportunity": [r"\bmarket\s+opportunity\b"]},
    "removed": {"cm_customers_period_end": [r"\btotal\s+customers?\b"]},
}
TIERS = {"tier1": ["cm_active_customers_total", "cm_customers_period_end", "cm_net_revenue_retention"], "tier2": ["cm_average_order_value", "cm_gmv", "cm_revenue_per_customer"]}


def gold(spark, d):
    """What somebody has stated of each filing: the values said outright, and revenue per customer of every seventh order."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    names = {0: "cm_active_customers_total", 1: "cm_net_revenue_retention", 2: "cm_average_order_value", 3: "cm_gmv", 5: "cm_customers_period_end", 6: "cm_net_revenue_retention", 7: "cm_market_opportunity"}
    said = mapped(((F.col("l_orderkey") + F.col("l_linenumber")) % 27), names)
    seventh = F.when(F.col("l_orderkey") % 7 == 0, "cm_revenue_per_customer")
    return lines.select(F.col("l_orderkey").alias("filing_id"), F.explode(F.array_compact(F.array(said, seventh))).alias("metric_id"))


def mapped(key, names: dict):
    return F.coalesce(*[F.when(key == k, v) for k, v in names.items()])


def by_metric(spark, d):
    found = simulation.presence(segments(filings(spark, d).select("filing_id", "html")), "filing_id", catalogue.METRICS, simulation.patched(catalogue.METRICS, **CHANGE))
    return simulation.scores(found, gold(spark, d), "filing_id")


SIMULATION_SQL = SAID_SQL + """, seen AS (
  SELECT filing_id, metric_id, true AS before, kind NOT IN (4, 7) AND metric_id <> 'cm_customers_period_end' AS after FROM meant
  UNION ALL SELECT filing_id, 'cm_market_opportunity', false, true FROM said WHERE kind = 5
  UNION ALL SELECT filing_id, 'cm_revenue_per_customer', false, true FROM said
), hits AS (SELECT filing_id, metric_id, bool_or(before) AS before, bool_or(after) AS after FROM seen GROUP BY ALL),
stated AS (
  SELECT filing_id, CASE kind WHEN 0 THEN 'cm_active_customers_total' WHEN 1 THEN 'cm_net_revenue_retention' WHEN 2 THEN 'cm_average_order_value' WHEN 3 THEN 'cm_gmv' WHEN 5 THEN 'cm_customers_period_end' WHEN 6 THEN 'cm_net_revenue_retention'
                              WHEN 7 THEN 'cm_market_opportunity' END AS metric_id FROM said WHERE kind IN (0, 1, 2, 3, 5, 6, 7)
  UNION ALL SELECT filing_id, 'cm_revenue_per_customer' FROM said WHERE filing_id % 7 = 0
), truth AS (SELECT filing_id, metric_id, count(*) AS facts FROM stated GROUP BY ALL),
j AS (SELECT metric_id, coalesce(before, false) AS before, coalesce(after, false) AS after, facts FROM hits FULL JOIN truth USING (filing_id, metric_id) WHERE metric_id IN (SELECT metric_id FROM truth)),
n AS (
  SELECT metric_id, count(*) FILTER (WHERE before AND facts IS NOT NULL) AS tp_before, count(*) FILTER (WHERE before AND facts IS NULL) AS fp_before, count(*) FILTER (WHERE NOT before AND facts IS NOT NULL) AS fn_before,
         count(*) FILTER (WHERE after AND facts IS NOT NULL) AS tp_after, count(*) FILTER (WHERE after AND facts IS NULL) AS fp_after, count(*) FILTER (WHERE NOT after AND facts IS NOT NULL) AS fn_after,
         count(facts) AS coverage_documents, CAST(coalesce(sum(facts), 0) AS BIGINT) AS coverage_facts
  FROM j GROUP BY metric_id
), s AS (
  SELECT *, round(tp_before::DOUBLE / nullif(tp_before + fp_before, 0), 6) AS precision_before, round(tp_before::DOUBLE / nullif(tp_before + fn_before, 0), 6) AS recall_before,
         round(2.0 * tp_before::DOUBLE / nullif(2 * tp_before + fp_before + fn_before, 0), 6) AS f1_before, round(tp_after::DOUBLE / nullif(tp_after + fp_after, 0), 6) AS precision_after,
         round(tp_after::DOUBLE / nullif(tp_after + fn_after, 0), 6) AS recall_after, round(2.0 * tp_after::DOUBLE / nullif(2 * tp_after + fp_after + fn_after, 0), 6) AS f1_after FROM n
)"""


@query("pattern_simulation", SIMULATION_SQL + " SELECT *, round(precision_after - precision_before, 6) AS precision_delta, round(recall_after - recall_before, 6) AS recall_delta, round(f1_after - f1_before, 6) AS f1_delta FROM s")
def pattern_simulation(spark, d):  # M29: P, R, F1 by metric with and without the change
    return by_metric(spark, d)


@query("simulation_tiers", SIMULATION_SQL + """, t AS (
  SELECT CASE WHEN metric_id IN ('cm_active_customers_total', 'cm_customers_period_end', 'cm_net_revenue_retention') THEN 'tier1' WHEN metric_id IN ('cm_average_order_value', 'cm_gmv', 'cm_revenue_per_customer') THEN 'tier2' END AS tier, * FROM s
), r AS (SELECT tier, round(sum(tp_before)::DOUBLE / nullif(sum(tp_before + fn_before), 0), 6) AS recall_before, round(sum(tp_after)::DOUBLE / nullif(sum(tp_after + fn_after), 0), 6) AS recall_after FROM t WHERE tier IS NOT NULL GROUP BY tier)
SELECT *, coalesce(recall_after - recall_before < -1e-4, false) AS regressed FROM r""")
def simulation_tiers(spark, d):  # M29: recall of each tier, and whether the change may ship
    return simulation.tier_recall(by_metric(spark, d), TIERS)
