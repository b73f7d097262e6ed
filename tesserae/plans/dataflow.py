"""The document dataflow: filings in HTML to segments, candidates, bindings, judged values, periods, facts and presence.

The tables hold no filings that disclose metrics, so each order becomes one: its line items are said in sentences of many
kinds under headings of four sections, and listed in a table. What the dataflow reads from the HTML is compared with the columns that the sentences were made of,
so the SQL side parses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogue, numbers, rules
from ..functions import text as X
from ..functions.catalogue import once
from ..shared import Scratch
from ..sources import html
from .base import query, table

NEAR = 100  # characters between a mention and its value at most
HEADINGS = ["Results of Operations", "Business", "Risk Factors", "Key Business Metrics"]
LEAD = "The figures below describe how our business developed over time. "
MONTH_BEFORE = rf"(?i)\b(?:{numbers.MONTHS})\s+$"


LINES = 250_000  # fixed value: rows of one task after ``spread``, on average and at most


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """``df`` by key, in partitions of LINES of its ``rows``, and no fewer than there are cores; their number is kept, since adaptive execution
    merges by compressed bytes, which lets the rows of a task grow with the input. Without ``rows`` it is left to that."""
    if rows is None:
        return df.repartition(key)
    return df.repartition(max(-(-rows // LINES), df.sparkSession.sparkContext.defaultParallelism), key)


def filings(spark, d) -> DataFrame:
    """filing_id, filed and html, of every order."""
    lines, orders = (table(spark, d, t) for t in ("lineitem", "orders"))
    # Only columns of lines are sorted for the groups and the join; texts are made of them behind it, a page at a time. Orders are merged: they grow
    # with the lines, and a few compressed megabytes of them are a gigabyte in every task when broadcast.
    own = ["l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice"]
    body = spread(lines, "l_orderkey", lines.count()).groupBy(F.col("l_orderkey").alias("filing_id")).agg(F.collect_list(F.struct(*own)).alias("lines"))
    filed = orders.select(F.col("o_orderkey").alias("filing_id"), F.col("o_orderdate").cast("date").alias("filed"))
    # Lines of one number stand in the order of their texts.
    said = once(body.join(filed.hint("merge"), "filing_id"), "parts", F.array_sort(F.transform("lines", lambda x: _line(F.col("filing_id"), x))))
    page = F.concat(
        F.lit("<html><body>"), F.array_join(F.transform("parts", lambda x: x["p"]), ""),
        F.lit("<table><tr><th>Item</th><th>Units</th></tr>"), F.array_join(F.transform("parts", lambda x: x["row"]), ""), F.lit("</table></body></html>"),
    )
    return said.select("filing_id", page.alias("html"), "filed")


def _line(filing, x):
    """l_linenumber, p and row: the heading and sentence of a line item, and its row of the table."""
    at = F.add_months(x["l_shipdate"].cast("date"), 240)  # quarters and fiscal years are read from 2000 on only
    day, number = F.date_format(at, "MMMM d, yyyy"), lambda c, n=0: F.format_number(c, n)
    quarter = F.concat(F.lit("Q"), F.quarter(at).cast("string"), F.lit(" "), F.year(at).cast("string"))
    quantity, year = x["l_quantity"].cast("long"), F.year(at).cast("string")
    q = quantity.cast("string")
    says = [
        F.concat(F.lit("As of "), day, F.lit(", we had "), number(quantity * 1000), F.lit(" active customers.")),
        F.concat(F.lit("Net revenue retention was "), (quantity + 60).cast("string"), F.lit("% in "), quarter, F.lit(".")),
        F.concat(F.lit("Average order value reached $"), number(x["l_extendedprice"], 2), F.lit(" for the year ended December 31, "), year, F.lit(".")),
        F.concat(F.lit("Our gross merchandise volume was $"), quantity.cast("string"), F.lit(" million in FY"), year, F.lit(".")),
        F.concat(F.lit("Active customers increased by "), number(quantity * 100), F.lit(" during "), quarter, F.lit(".")),
        F.concat(F.lit("Total customers of "), number(quantity * 2000), F.lit(" reflect our market opportunity.")),
        F.concat(F.lit("Net revenue retention of "), quantity.cast("string"), F.lit("% was below our plan in "), quarter, F.lit(".")),
        F.lit("Customer churn rate is a key metric that we will report."),
        F.concat(F.lit("Customer churn rate of "), (quantity + 600).cast("string"), F.lit("% was stated.")),
        F.concat(F.lit("Gross merchandise volume of $"), q, F.lit(" billion was the aim.")),
        F.concat(F.lit("Total customers of -"), q, F.lit(" were restated.")),
        F.concat(F.lit("ARPU of "), q, F.lit("% was lower.")),
        F.concat(F.lit("Monthly active users grew "), q, F.lit("% to 12 million.")),
        F.concat(F.lit("Customer acquisition cost was $"), number(quantity * 2000), F.lit(".")),
        F.concat(F.lit("Average order value per share of $"), q, F.lit(".5 fell.")),
        F.concat(F.lit("Average order value and ARPU of $"), q, F.lit(".5 were alike.")),
        F.concat(F.lit("Daily active users of "), number(quantity * 10), F.lit(" developers rose.")),
        F.concat(F.lit("Total customers of "), q, F.lit(" of the Fortune 500 are ours.")),
        F.concat(F.lit("Total customers on the Enterprise plan were "), number(quantity * 10), F.lit(".")),
        F.concat(F.lit("Active customers made "), number(quantity * 10), F.lit(" page views.")),
        F.concat(F.lit("Monthly active users had "), q, F.lit(" transactions per account.")),
        F.concat(F.lit("In "), quarter, F.lit(" demand rose. Customer churn rate was "), q, F.lit("%.")),
        F.concat(F.lit("Net revenue retention (in thousands) of "), (quantity + 60).cast("string"), F.lit("% was noted.")),
        F.concat(F.lit("Active customers with stock-based compensation of "), number(quantity * 10), F.lit(".")),
        F.concat(F.lit("Total customers and net income of "), number(quantity * 10), F.lit(".")),
        F.concat(F.lit("Average order value is defined as more than $"), q, F.lit(".5 a year.")),
        F.concat(F.lit("Total customers of 0"), q, F.lit(" were listed.")),
    ]
    kind = (filing + x["l_linenumber"]) % len(says)
    said = F.when(kind == 0, says[0])  # a case by itself, so that a line makes only its own sentence
    for k, sentence in enumerate(says[1:], 1):
        said = said.when(kind == k, sentence)
    row = F.concat(F.lit("<tr><td>Line "), x["l_linenumber"].cast("string"), F.lit("</td><td>"), number(quantity * 10), F.lit("</td></tr>"))
    heading = F.concat(F.lit("<h2>"), F.get(F.array(*map(F.lit, HEADINGS)), (x["l_linenumber"] % len(HEADINGS)).cast("int")), F.lit("</h2>"))
    return F.struct(x["l_linenumber"].alias("l_linenumber"), F.concat(heading, F.lit("<p>" + LEAD), said, F.lit("</p>")).alias("p"), row.alias("row"))


def segments(pages: DataFrame) -> DataFrame:
    """filing_id, seq, text and section of the text segments; a section holds from its heading to the next."""
    # All that follows works within a filing, so this is the only shuffle up to the facts.
    found = spread(html.segments(pages, "filing_id").where("kind in ('paragraph', 'heading')"), "filing_id")
    so_far = Window.partitionBy("filing_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("kind") == "heading", X.section_of(F.col("text")))
    return found.withColumn("section", F.last(opened, ignorenulls=True).over(so_far)).where("kind = 'paragraph'").select("filing_id", "seq", "text", "section")


def candidates(found: DataFrame) -> DataFrame:
    """Mentions of metrics in segments, with the confidence of their kind and section."""
    hits = catalogue.each(found, "hit", catalogue.candidates(F.col("text")))
    sure = F.lit(0.5) + F.when(F.col("hit.specific"), 0.1).otherwise(0.0) + F.when(F.col("section").isin("mda", "business"), 0.1).otherwise(0.0)
    return hits.select("filing_id", "seq", "text", "section", "hit.*", F.round(sure, 2).alias("mention"))


def bindings(mentions: DataFrame) -> DataFrame:
    """Numbers within NEAR characters of a mention, those of its sentence or else the nearest one, in units that the metric
    allows. A percent-only metric takes no bare number, nor does a currency."""
    # A mention's numbers stay in its row until they are chosen: nothing is sorted or sent to compare them.
    units = F.lit(None).cast("array<string>")  # null: any
    for metric, own in rules.allowed_units().items():
        own = [F.lit(u) for u in own if not (metric in rules.CURRENCY_ONLY and u == "other")]
        units = F.when(F.col("metric_id") == metric, F.array(*own).cast("array<string>")).otherwise(units)
    start, end, text = F.col("start"), F.col("end"), F.col("text")

    def number(x):
        n = x["n"]
        between = F.substr(text, F.least(start, n["start"]) + 1, F.greatest(start, n["start"]) - F.least(start, n["start"]))
        distance = F.abs(n["start"] + n["end"] - start - end) / 2
        return F.struct(distance.alias("distance"), n["start"].alias("start"), n["match"].alias("match"), numbers.number_of(x["parts"]).alias("read"), (~between.rlike(r"[.!?]\s")).alias("same"))

    near = F.filter(catalogue.spans(text, numbers.IN_TEXT), lambda n: (n["start"] >= start - NEAR) & (n["end"] <= end + NEAR))
    near = F.transform(near, lambda n: F.struct(n.alias("n"), numbers.parts(F.trim(n["match"]), numbers.NUMBER, *range(6)).alias("parts")))
    fit = lambda n: n["read"].isNotNull() & (F.col("units").isNull() | F.array_contains("units", n["read"]["unit"]))
    values = once(mentions.withColumn("units", units), "near", F.filter(F.transform(near, number), fit))
    values = once(values, "own", F.filter("near", lambda n: n["same"]))
    chosen = F.when(F.size("own") > 0, F.col("own")).when(F.size("near") > 0, F.array(F.array_min("near")))
    ambiguous = F.size(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("near"))) > 1
    values = values.withColumn("ambiguous", ambiguous).withColumn("number", F.explode(chosen)).withColumn("read", F.col("number.read"))
    sure = F.lit(0.4) + F.when(F.col("read.unit").isin("currency", "percent"), 0.1).otherwise(0.0) + F.when(F.col("number.same"), 0.1).otherwise(0.0) - F.when(F.col("ambiguous"), 0.1).otherwise(0.0)
    keep = ["filing_id", "seq", "text", "section", "metric_id", "mention", "start"]
    # The value's place is that of the number itself, behind white space that the pattern took along.
    at = F.col("number.start") + 1 + F.length("number.match") - F.length(F.ltrim("number.match"))
    return values.select(*keep, "read.value", "read.unit", "read.raw", at.alias("at"), F.lit("text").alias("binding"), F.round(sure, 2).alias("confidence"))


def judged(bound: DataFrame) -> DataFrame:
    """``bound`` with tag, the reason that a value is none, or null. A day of a date comes before all rules."""
    in_date = F.substr(F.col("text"), F.lit(1), F.col("at") - 1).rlike(MONTH_BEFORE)
    return once(bound, "tag", F.when(in_date, F.lit("part_of_date")).otherwise(rules.reason()))


def dated(kept: DataFrame, pages: DataFrame) -> DataFrame:
    """Periods from the value's sentence, the text around it or the filing's date; and the fact's confidence of binding, section and period."""
    text, at = F.col("text"), F.col("at")
    period = numbers.infer_period(None, numbers.sentence_at(text, at), F.col("filed"), numbers.around(text, at))
    facts = once(kept.join(pages.select("filing_id", "filed"), "filing_id"), "p", period)
    section = F.when(F.col("section") == "mda", 0.1).when(F.col("section") == "business", 0.05).otherwise(0.0)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("confidence") + section) * 0.8 + F.col("p.confidence") * 0.2))
    return facts.select("filing_id", "seq", "metric_id", "value", "unit", "section", "p.period_type", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), F.round(sure, 4).alias("confidence"))


def primary(facts: DataFrame) -> DataFrame:
    """One fact for each metric and period of a filing: the surest, then the largest; and how many values there were."""
    key = ["filing_id", "metric_id", "period_type", "period_start", "period_end"]
    best = F.max(F.struct("confidence", "value", "unit", "section")).alias("best")
    out = facts.groupBy(*key).agg(best, F.count_distinct("value").alias("n_values"))
    return out.select(*key, "best.value", "best.unit", "best.section", "best.confidence", "n_values")


def routed(facts: DataFrame) -> DataFrame:
    """auto_accepted from 0.90 on without a competing value, reject_candidate under 0.15, or pending."""
    route = F.when((F.col("confidence") >= 0.9) & (F.col("n_values") == 1), "auto_accepted").when(F.col("confidence") < 0.15, "reject_candidate").otherwise("pending")
    return facts.withColumn("route", route)


def run(spark, d) -> dict[str, DataFrame]:
    """Every stage's result by name."""
    out = {"pages": filings(spark, d)}
    out["segments"] = segments(out["pages"].select("filing_id", "html"))
    out["candidates"] = candidates(out["segments"])
    out["judged"] = judged(bindings(out["candidates"]))
    filed = table(spark, d, "orders").select(F.col("o_orderkey").alias("filing_id"), F.col("o_orderdate").cast("date").alias("filed"))
    out["facts"] = dated(out["judged"].where("tag is null"), filed)
    out["routed"] = routed(primary(out["facts"]))
    return out


# What the sentences say, from the columns they were made of.
SAID_SQL = """WITH said AS (
  SELECT l_orderkey AS filing_id, (l_orderkey + l_linenumber) % 27 AS kind, CAST(l_quantity AS BIGINT) AS q, CAST(l_extendedprice AS DOUBLE) AS price, CAST(o_orderdate AS DATE) AS filed,
         day, year(day) AS y, CAST(date_trunc('quarter', day) AS DATE) AS quarter, ['mda', 'business', 'risk_factors', 'key_metrics'][l_linenumber % 4 + 1] AS section
  FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) + INTERVAL 20 YEAR AS DATE) AS day FROM lineitem) JOIN orders ON l_orderkey = o_orderkey
), meant AS (
  SELECT *, CASE WHEN kind IN (0, 4, 19, 23) THEN 'cm_active_customers_total' WHEN kind IN (1, 6, 22) THEN 'cm_net_revenue_retention' WHEN kind IN (2, 14, 15, 25) THEN 'cm_average_order_value' WHEN kind IN (3, 9) THEN 'cm_gmv'
                 WHEN kind IN (5, 10, 17, 18, 24, 26) THEN 'cm_customers_period_end' WHEN kind IN (7, 8, 21) THEN 'cm_customer_churn_rate' WHEN kind = 11 THEN 'cm_revenue_per_customer' WHEN kind IN (12, 20) THEN 'cm_monthly_active_users'
                 WHEN kind = 13 THEN 'cm_customer_acquisition_cost' WHEN kind = 16 THEN 'cm_daily_active_users' END AS metric_id,
         0.5 + CASE WHEN kind <> 11 THEN 0.1 ELSE 0 END + CASE WHEN section IN ('mda', 'business') THEN 0.1 ELSE 0 END AS mention
  FROM said
  UNION ALL SELECT *, 'cm_revenue_per_customer', 0.5 + CASE WHEN section IN ('mda', 'business') THEN 0.1 ELSE 0 END FROM said WHERE kind = 15
), valued AS (
  SELECT *, CASE WHEN kind = 0 THEN q * 1000.0 WHEN kind IN (1, 22) THEN q + 60.0 WHEN kind = 2 THEN price WHEN kind = 3 THEN q * 1e6 WHEN kind = 4 THEN q * 100.0 WHEN kind IN (5, 13) THEN q * 2000.0 WHEN kind = 8 THEN q + 600.0
                 WHEN kind = 9 THEN q * 1e9 WHEN kind = 10 THEN -q WHEN kind IN (14, 15, 25) THEN q + 0.5 WHEN kind IN (16, 18, 19, 23, 24) THEN q * 10.0 ELSE q END AS value,
         CASE WHEN kind IN (2, 3, 9, 13, 14, 15, 25) THEN 'currency' WHEN kind IN (1, 6, 8, 11, 12, 21, 22) THEN 'percent' ELSE 'count' END AS unit, kind IN (0, 4, 12, 17) AS rivals FROM meant WHERE kind <> 7
  UNION ALL SELECT *, 12e6, 'count', true FROM meant WHERE kind = 12
  UNION ALL SELECT *, 500, 'other', true FROM meant WHERE kind = 17
), judged AS (
  SELECT *, CASE WHEN kind IN (0, 4, 5) AND value BETWEEN 1990 AND 2100 THEN 'year_value' WHEN kind = 8 THEN 'percent_range' WHEN kind = 9 AND q > 10 THEN 'garbage_value' WHEN kind = 10 THEN 'negative_value' WHEN kind = 26 THEN 'year_fragment'
                 WHEN kind = 22 THEN 'financial_annotation' WHEN kind = 23 THEN 'financial_sbc' WHEN kind = 17 AND value = 500 THEN 'ranking_name' WHEN kind = 14 THEN 'per_share' WHEN kind = 16 THEN 'developer_count' WHEN kind = 17 THEN 'fortune_subset'
                 WHEN kind = 18 THEN 'tier_qualifier' WHEN kind = 19 THEN 'content_engagement' WHEN kind = 20 THEN 'transactions_per_account' WHEN kind = 4 THEN 'delta_count_value' WHEN kind = 12 AND unit = 'percent' THEN 'growth_rate_percent'
                 WHEN kind = 11 THEN 'arpu_percent' WHEN kind = 15 AND metric_id = 'cm_average_order_value' THEN 'arpu_as_aov' WHEN kind = 6 AND value < 31 OR kind = 13 AND value > 5e4 THEN 'magnitude_sanity'
                 WHEN kind = 24 THEN 'financial_context_customer_metric' WHEN kind = 25 THEN 'metric_definition_value' WHEN kind = 5 THEN 'tam_market_size' END AS tag
  FROM valued
), placed AS (
  SELECT *, 0.4 + 0.1 + CASE WHEN unit IN ('currency', 'percent') THEN 0.1 ELSE 0 END - CASE WHEN rivals THEN 0.1 ELSE 0 END + CASE section WHEN 'mda' THEN 0.1 WHEN 'business' THEN 0.05 ELSE 0 END AS bound,
         CASE WHEN kind = 21 THEN 0.5 WHEN kind < 8 THEN 0.7 ELSE 0.3 END AS pc,
         CASE WHEN kind IN (2, 3) THEN 'annual' WHEN kind IN (1, 4, 6, 21) THEN 'quarterly' ELSE 'point_in_time' END AS period_type
  FROM judged WHERE tag IS NULL
), found AS (
  SELECT filing_id, metric_id, section, CAST(value AS DOUBLE) AS value, unit, period_type,
         CASE period_type WHEN 'annual' THEN make_date(y, 1, 1) WHEN 'quarterly' THEN quarter ELSE CASE WHEN kind = 0 THEN day ELSE filed END END AS period_start,
         CASE period_type WHEN 'annual' THEN make_date(y, 12, 31) WHEN 'quarterly' THEN CAST(quarter + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) ELSE CASE WHEN kind = 0 THEN day ELSE filed END END AS period_end,
         round(CAST(bound AS DOUBLE) * 0.8 + CAST(pc AS DOUBLE) * 0.2, 4) AS confidence, CAST(pc AS DOUBLE) AS pc
  FROM placed
)"""
ROUTED_SQL = """r AS (
  SELECT filing_id, metric_id, period_type, period_start, period_end, first(struct_pack(v := value, u := unit, s := section, c := confidence) ORDER BY confidence DESC, value DESC, unit DESC, section DESC) AS b, count(DISTINCT value) AS n_values
  FROM {source} GROUP BY filing_id, metric_id, period_type, period_start, period_end
) SELECT filing_id, metric_id, period_type, period_start, period_end, b.v AS value, b.u AS unit, b.s AS section, b.c AS confidence, n_values,
         CASE WHEN b.c >= 0.9 AND n_values = 1 THEN 'auto_accepted' WHEN b.c < 0.15 THEN 'reject_candidate' ELSE 'pending' END AS route FROM r"""


@query("filing_mentions", SAID_SQL + " SELECT filing_id, metric_id, section, count(*) AS mentions, CAST(max(mention) AS DOUBLE) AS mention FROM meant GROUP BY filing_id, metric_id, section")
def filing_mentions(spark, d):  # M1, M2, M8, H6: spans of every mention, in the section that the last heading opened
    return run(spark, d)["candidates"].groupBy("filing_id", "metric_id", "section").agg(F.count("*").alias("mentions"), F.max("mention").alias("mention"))


@query("filing_false_positives", SAID_SQL + """, years AS (SELECT filing_id, metric_id, section, kind FROM meant WHERE kind IN (0, 4))
SELECT filing_id, metric_id, section, tag, count(*) AS n FROM (
  SELECT filing_id, metric_id, section, tag FROM judged WHERE tag IS NOT NULL
  UNION ALL SELECT filing_id, metric_id, section, 'year_value' FROM years
  UNION ALL SELECT filing_id, metric_id, section, 'part_of_date' FROM years WHERE kind = 0) GROUP BY ALL""")
def filing_false_positives(spark, d):  # M10, M11, I8: what was bound and judged to be no value
    return run(spark, d)["judged"].where("tag is not null").groupBy("filing_id", "metric_id", "section", "tag").agg(F.count("*").alias("n"))


@query("document_facts", SAID_SQL + ", " + ROUTED_SQL.format(source="found"))
def document_facts(spark, d):  # M1 to M20 chained, over every order
    return run(spark, d)["routed"]


@query("document_presence", SAID_SQL + """, f AS (SELECT filing_id, metric_id, count(*) AS facts, max(confidence) AS score FROM found GROUP BY ALL)
SELECT m.filing_id, m.metric_id, m.mentions, coalesce(f.facts, 0) AS facts, greatest(m.score, coalesce(f.score, 0)) AS score, f.facts IS NOT NULL AS disclosed
FROM (SELECT filing_id, metric_id, count(*) AS mentions, CAST(max(mention) AS DOUBLE) AS score FROM meant GROUP BY ALL) m LEFT JOIN f USING (filing_id, metric_id)""")
def document_presence(spark, d):  # M21: evidence of mentions and of facts by filing and metric
    pages = filings(spark, d)
    found = Scratch(spark, "presence").again(candidates(segments(pages.select("filing_id", "html"))))  # both kinds of evidence come from them
    filed = table(spark, d, "orders").select(F.col("o_orderkey").alias("filing_id"), F.col("o_orderdate").cast("date").alias("filed"))
    dated_ = dated(judged(bindings(found)).where("tag is null"), filed)
    said = found.select("filing_id", "metric_id", F.col("mention").alias("score"), F.lit(0).alias("fact"))
    facts = dated_.select("filing_id", "metric_id", F.col("confidence").alias("score"), F.lit(1).alias("fact"))
    out = said.unionByName(facts).groupBy("filing_id", "metric_id")
    return out.agg(F.count_if(F.col("fact") == 0).alias("mentions"), F.sum("fact").alias("facts"), F.max("score").alias("score"), (F.max("fact") == 1).alias("disclosed"))


@query("filing_tables", "SELECT l_orderkey AS filing_id, 'Units' AS header, 'Line ' || CAST(l_linenumber AS VARCHAR) AS stub, CAST(CAST(l_quantity AS BIGINT) * 10 AS VARCHAR) AS value FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def filing_tables(spark, d):  # M3: cells with their header and stub, of every filing's table
    columns = ["text", "is_header", "is_stub", "header_path", "stub_path"]
    cells = html.table_grid(filings(spark, d).select("filing_id", "html"), "filing_id", columns=columns).where("not is_header and not is_stub")
    return cells.select("filing_id", F.array_join("header_path", "|").alias("header"), F.array_join("stub_path", "|").alias("stub"), F.col("text").alias("value"))


TALK_SECTIONS = ["prepared_remarks", "qa", "operator", "presentation_slide", "appendix"]


@query("talk_false_positives", """WITH t AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, (l_orderkey + l_linenumber) % 5 AS kind, ['prepared_remarks', 'qa', 'operator', 'presentation_slide', 'appendix'][l_orderkey % 5 + 1] AS section FROM lineitem
), j AS (
  SELECT section, kind, CASE WHEN section = 'operator' THEN 'suppressed_section' WHEN section = 'appendix' THEN 'presentation_suppressed_section' WHEN section = 'presentation_slide' AND kind = 0 AND q < 10 THEN 'presentation_page_number'
    WHEN kind = 0 AND q IN (20, 21) THEN 'year_value' WHEN kind = 0 AND (section = 'prepared_remarks' AND q < 4 OR section = 'qa' AND q < 5) THEN 'bare_small_count'
    WHEN kind = 1 AND section = 'qa' THEN 'qa_hedging_percent' WHEN kind = 3 AND section = 'qa' THEN 'qa_currency_on_count' WHEN kind IN (2, 4) THEN 'forward_guidance' ELSE 'none' END AS tag FROM t
) SELECT section, kind, tag, count(*) AS n FROM j GROUP BY ALL""")
def talk_false_positives(spark, d):  # M11: sections without disclosures, page numbers, small counts, hedging, guidance, around the registry
    q, kind = F.col("l_quantity").cast("long"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5).cast("int")
    pick = lambda *x: F.get(F.array(*[F.lit(c) if isinstance(c, str) else c for c in x]), kind)
    raw = pick(F.format_number(q * 100, 0), F.concat(q.cast("string"), F.lit("%")), F.concat(q.cast("string"), F.lit(" million")), F.concat(F.lit("$"), q.cast("string"), F.lit(" million")), F.concat(q.cast("string"), F.lit("%")))
    said = pick("Active customers reached # at last.", "Was it a customer churn rate of #?", "We expect active customers of # by then.", "How does # relate to active customers?", "The customer churn rate is on track to be # soon.")
    value = F.get(F.array(q * 100.0, q * 1.0, q * 1e6, q * 1e6, q * 1.0), kind)
    unit = F.when(kind == 0, F.when(q >= 10, "count").otherwise("other")).otherwise(pick("count", "percent", "count", "currency", "percent"))
    metric = pick("cm_active_customers_total", "cm_customer_churn_rate", "cm_active_customers_total", "cm_active_customers_total", "cm_customer_churn_rate")
    section = F.get(F.array(*map(F.lit, TALK_SECTIONS)), (F.col("l_orderkey") % len(TALK_SECTIONS)).cast("int"))
    bound = table(spark, d, "lineitem").select(section.alias("section"), kind.alias("kind"), metric.alias("metric_id"), value.alias("value"), raw.alias("raw"), unit.alias("unit"), F.replace(said, F.lit("#"), raw).alias("text"))
    bound = bound.withColumns({"binding": F.lit("text"), "confidence": F.lit(0.5), "at": F.instr("text", F.col("raw"))})
    return once(bound, "tag", rules.full_reason(F.lit(True))).groupBy("section", "kind", F.coalesce("tag", F.lit("none")).alias("tag")).agg(F.count("*").alias("n"))


@query("false_positive_rules", SAID_SQL + """ SELECT tag, count(*) AS n FROM (
  SELECT coalesce(tag, 'kept') AS tag FROM judged UNION ALL SELECT 'year_value' FROM meant WHERE kind IN (0, 4) UNION ALL SELECT 'part_of_date' FROM meant WHERE kind = 0) GROUP BY tag""")
def false_positive_rules(spark, d):  # M11: how often each registered rule is the first that holds
    return run(spark, d)["judged"].groupBy(F.coalesce("tag", F.lit("kept")).alias("tag")).agg(F.count("*").alias("n"))
