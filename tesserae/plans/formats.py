"""Readers of numbers, periods, labels, lists, tables and indexes over strings made of the tables' columns.

Each row of a table says its value in one of several forms; the SQL has the value from the columns and reads nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue, lists, markers, rules
from ..functions import numbers as N
from ..functions import text as X
from ..sources import html, readers
from .base import query, table
from .dataflow import bindings, filings, once, spread
from .tables import TABLES_SQL, table_filings, table_run

ID = ["l_orderkey", "l_linenumber"]


def quantity():
    return F.col("l_quantity").cast("long")


def price():
    return F.col("l_extendedprice")


def shipped():
    return F.col("l_shipdate").cast("date")


def forms(spark, d, n: int, *texts, name: str = "text", keep=()) -> DataFrame:
    """Every line item with its form (from 0 to n - 1) and the text of that form."""
    form = ((F.col("l_orderkey") + F.col("l_linenumber")) % n).cast("int")
    said = F.get(F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts]), form)
    return table(spark, d, "lineitem").select(*ID, *keep, form.alias("form"), said.alias(name), quantity().alias("q"), price().alias("price"), shipped().alias("at"))


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def lines_sql(n: int) -> str:
    return f"""WITH l AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % {n} AS form, CAST(l_quantity AS BIGINT) AS q, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_shipdate AS DATE) AS shipped FROM lineitem) """


@query("parse_number", lines_sql(7) + """SELECT l_orderkey, l_linenumber, CASE form WHEN 0 THEN q * 1e6 + 5e5 WHEN 1 THEN q WHEN 2 THEN q + 0.25 WHEN 3 THEN q * 1000 WHEN 4 THEN -q WHEN 5 THEN q * 1e9 END::DOUBLE AS value,
CASE form WHEN 0 THEN 'currency' WHEN 1 THEN 'percent' WHEN 2 THEN 'ratio' WHEN 3 THEN 'count' WHEN 4 THEN 'other' WHEN 5 THEN 'count' END AS unit FROM l""")
def parse_number(spark, d):  # I1
    said = forms(spark, d, 7, text("$", quantity(), ".5 million"), text(quantity(), " percent of all"), text(quantity(), ".25x"), F.format_number(quantity() * 1000, 0), text("-", quantity()), text("about ", quantity(), "bn users"), "none")
    n = N.parse_number(F.col("text"))
    return said.select(*ID, n["value"].alias("value"), n["unit"].alias("unit"))


@query("review_numbers", lines_sql(3) + "SELECT l_orderkey, l_linenumber, CASE form WHEN 0 THEN q::DOUBLE / 100 WHEN 1 THEN q * 1e3 ELSE price END AS value FROM l")
def review_numbers(spark, d):  # I2: percentages are fractions
    said = forms(spark, d, 3, text(quantity(), "%"), text(quantity(), "k"), text("$", F.format_number(price(), 2)))
    return said.select(*ID, N.review_number(F.col("text")).alias("value"))


@query("normalise_gold", lines_sql(6) + "SELECT l_orderkey, l_linenumber, CASE form WHEN 0 THEN price WHEN 1 THEN (q + 0.5) * 1e6 WHEN 2 THEN q * 1e3 WHEN 3 THEN (q + 0.25) * 1e12 WHEN 5 THEN q END::DOUBLE AS value FROM l")
def normalise_gold(spark, d):  # I4: a text's own scale comes before the column's
    said = forms(spark, d, 6, text("$", F.format_number(price(), 2)), text(quantity(), ".5M"), text(quantity()), text(quantity(), ".25T"), "n/a", text(quantity(), "%"))
    scale = F.when(F.col("form") == 1, "millions").when(F.col("form") == 2, "thousands").otherwise("")
    return said.select(*ID, N.normalise_gold(F.col("text"), scale).alias("value"))


SMALL = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]


@query("spelled_numbers", lines_sql(5) + "SELECT l_orderkey, l_linenumber, CASE form WHEN 0 THEN q % 13 * 1e2 WHEN 1 THEN q % 13 * 1e3 WHEN 2 THEN q % 13 * 1e6 WHEN 3 THEN q % 13 * 1e9 END::DOUBLE AS value FROM l")
def spelled_numbers(spark, d):  # I3
    word = F.get(F.array(*map(F.lit, SMALL)), (quantity() % 13).cast("int"))
    said = forms(spark, d, 5, text("some ", word, " hundred"), text(F.initcap(word), " thousand users"), text("about ", word, " million"), text("nearly ", word, " billion people"), text(word, " stores"))
    return said.select(*ID, N.spelled_number(F.col("text")).alias("value"))


@query("table_scale", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 WHEN 3 THEN 1e2 ELSE 1 END::DOUBLE AS factor FROM orders")
def table_scale(spark, d):  # I5
    notes = ["Revenue (in thousands)", "(Amounts in millions, unaudited)", "( in billions, except as noted)", "Units (in hundreds)", "in thousands of cases"]
    note = F.get(F.array(*map(F.lit, notes)), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", N.table_scale(note).alias("factor"))


PERIODS_SQL = lines_sql(12) + """, p AS (SELECT *, CAST(date_trunc('quarter', day) AS DATE) AS quarter, year(day) AS y, last_day(day) AS finish FROM (SELECT *, CAST(shipped + INTERVAL 20 YEAR AS DATE) AS day FROM l)), r AS (
SELECT l_orderkey, l_linenumber, CASE WHEN form IN (0, 1, 2, 9) THEN 'quarterly' WHEN form IN (3, 5, 11) THEN 'annual' WHEN form IN (4, 7) THEN 'ytd' WHEN form = 8 THEN 'trailing' ELSE 'point_in_time' END AS period_type,
 CASE WHEN form IN (0, 1, 2) THEN quarter WHEN form IN (3, 11) THEN make_date(y, 1, 1) WHEN form = 4 THEN last_day(CAST(finish - INTERVAL 9 MONTH AS DATE)) + 1 WHEN form = 5 THEN last_day(CAST(finish - INTERVAL 12 MONTH AS DATE)) + 1
      WHEN form = 7 THEN make_date(y, 1, 1) WHEN form = 8 THEN CAST(day - INTERVAL 12 MONTH AS DATE) + 1 WHEN form = 9 THEN CAST(quarter - INTERVAL 3 MONTH AS DATE) ELSE day END AS start,
 CASE WHEN form IN (0, 1, 2) THEN last_day(CAST(quarter + INTERVAL 2 MONTH AS DATE)) WHEN form IN (3, 11) THEN make_date(y, 12, 31) WHEN form IN (4, 5) THEN finish WHEN form = 9 THEN quarter - 1 ELSE day END AS finish,
 CASE form WHEN 11 THEN 0.9 WHEN 10 THEN 0.3 ELSE 0.7 END::DOUBLE AS confidence FROM p) """


@query("period_parse", PERIODS_SQL + "SELECT * FROM r")
def period_parse(spark, d):  # I11, I12, I13, M12: quarters and fiscal years of two digits too, durations, relative periods, headers
    day = F.add_months(shipped(), 240)
    q, year, short = F.quarter(day), F.year(day), F.lpad((F.year(day) % 100).cast("string"), 2, "0")
    finish = F.date_format(F.last_day(day), "MMMM d, yyyy")
    said = forms(
        spark, d, 12, text("sales of Q", q, " ", year), text("revenue in ", q, "Q", short, " rose"), text("Q", q, "'", short), text("FY", short, " results"), text("nine months ended ", finish), text("the year ended ", finish),
        text("as of ", F.date_format(day, "MMMM d, yyyy")), "year-to-date growth", "TTM revenue", "growth since last quarter", "nothing said", "as in the year before",
    )
    header = F.when(F.col("form") == 11, F.year(F.add_months("at", 240)).cast("string")).otherwise("Metric")
    p = N.infer_period(header, F.col("text"), F.add_months("at", 240))
    return said.select(*ID, p["period_type"].alias("period_type"), p["start"].alias("start"), p["end"].alias("finish"), p["confidence"].alias("confidence"))


@query("cohort_label", lines_sql(8) + """SELECT l_orderkey, l_linenumber, CASE WHEN form < 2 THEN 'acquisition' WHEN form < 6 THEN 'tenure' WHEN form = 6 THEN 'other' END AS kind,
CASE form WHEN 0 THEN year(shipped)::VARCHAR WHEN 1 THEN year(shipped)::VARCHAR WHEN 2 THEN q || '-' || (q + 2) || 'y' WHEN 3 THEN q || 'y+' WHEN 4 THEN q || '-' || (q + 2) || 'y' WHEN 5 THEN '<' || q || 'y' WHEN 6 THEN 'Tier ' || q END AS bucket FROM l""")
def cohort_label(spark, d):  # I14
    year = F.year(shipped())
    said = forms(spark, d, 8, text(year, " Cohort"), text("cohort of ", year), text(quantity() * 12, "-", quantity() * 12 + 24, " mos"), text(quantity(), "+ years"), text(quantity(), " - ", quantity() + 2, " years"), text("less than ", quantity() * 12, " months"), text("Tier ", quantity()), "")
    c = N.parse_cohort_label(F.col("text"))
    return said.select(*ID, c["kind"].alias("kind"), c["bucket"].alias("bucket"))


@query("percent_promotion", lines_sql(4) + """SELECT l_orderkey, l_linenumber, CASE WHEN form = 0 THEN 'percent' WHEN form = 1 OR form = 2 AND q >= 10 THEN 'count' WHEN form = 2 THEN 'other' ELSE 'currency' END AS unit FROM l""")
def percent_promotion(spark, d):  # I7: a bare number of a retention metric is a percentage where the context speaks of it
    said = forms(spark, d, 4, text("net dollar retention of ", quantity()), text("customers of ", quantity(), ".5"), text("renewals of ", F.format_number(quantity() * 100, 0)), text("retention of $", quantity()))
    metric = F.when(F.col("form") == 2, "cm_active_customers_total").otherwise("cm_net_revenue_retention")
    read = once(once(said, "said", F.col("text")), "read", N.parse_number(F.col("said")))
    return read.select(*ID, N.promoted_unit(metric, F.col("read.unit"), F.col("said")).alias("unit"))


UNITS = ["count", "currency", "percent", "ratio", "other"]
METRICS = sorted({*rules.allowed_units(), "cm_monthly_active_users", "cm_revenue_by_cohort"})  # two of them take any unit
_ALLOWED = ", ".join(f"('{m}', '{u}')" for m, units in rules.allowed_units().items() for u in units)
_METRICS = ", ".join(f"'{m}'" for m in METRICS)


@query("allowed_units", f"""WITH f AS (SELECT [{_METRICS}][l_partkey % {len(METRICS)} + 1] AS metric_id, ['count', 'currency', 'percent', 'ratio', 'other'][l_suppkey % 5 + 1] AS unit FROM lineitem),
a AS (SELECT * FROM (VALUES {_ALLOWED}) v(m, u))
SELECT metric_id, unit, count(*) AS n FROM f WHERE metric_id NOT IN (SELECT m FROM a) OR EXISTS (SELECT 1 FROM a WHERE m = metric_id AND u = unit) GROUP BY metric_id, unit""")
def allowed_units(spark, d):  # I8: what the table of units lets through
    from ..operators.binding import allowed

    pick = lambda names, c: F.get(F.array(*map(F.lit, names)), (F.col(c) % len(names)).cast("int"))
    f = table(spark, d, "lineitem").select(pick(METRICS, "l_partkey").alias("metric_id"), pick(UNITS, "l_suppkey").alias("unit"))
    return f.where(allowed(F.col("metric_id"), F.col("unit"))).groupBy("metric_id", "unit").agg(F.count("*").alias("n"))


@query("nearest_value", lines_sql(3) + """, v AS (
  SELECT l_orderkey, l_linenumber, q * 100.0 AS value, CASE form WHEN 0 THEN 0.4 WHEN 1 THEN 0.5 ELSE 0.4 END AS confidence FROM l
  UNION ALL SELECT l_orderkey, l_linenumber, q * 100.0 + 700, 0.4 FROM l WHERE form = 0) SELECT l_orderkey, l_linenumber, CAST(value AS DOUBLE) AS value, CAST(confidence AS DOUBLE) AS confidence FROM v""")
def nearest_value(spark, d):  # C21, M10: rivals in the sentence are ambiguous, others count only where the sentence has none
    n = lambda x: F.format_number(x, 0)
    said = forms(
        spark, d, 3, text("There were ", n(quantity() * 3 + 5000), " stores. Active customers reached ", n(quantity() * 100), " after ", n(quantity() * 100 + 700), " before."), text("Active customers were ", n(quantity() * 100), ". Stores were ", n(quantity() * 3 + 5000), "."),
        text("In all ", n(quantity() * 100), ". That is how many active customers we have."),
    )
    found = catalogue.each(said, "hit", catalogue.candidates(F.col("text")))
    found = found.select(F.struct(*ID).alias("filing_id"), F.lit(1).alias("seq"), "text", F.lit("mda").alias("section"), "hit.*", F.lit(0.7).alias("mention"))
    return bindings(found).select(*[F.col(f"filing_id.{c}").alias(c) for c in ID], "value", "confidence")


@query("respectively_pairs", """WITH l AS (
  SELECT l_orderkey AS o, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
) SELECT o, CASE WHEN o % 4 = 0 THEN '$' || q || ' million' ELSE q || '%' END AS value, CASE WHEN o % 4 = 1 THEN 'Q' || (1 + (k - 1) % 4) WHEN o % 8 < 4 THEN CAST(2000 + k AS VARCHAR) ELSE CAST(2000 + 2 * k AS VARCHAR) END AS period,
  CAST(CASE WHEN o % 4 <> 1 AND o % 8 < 4 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence FROM l WHERE n > 1 AND n < 15 AND o % 4 < 2""")
def respectively_pairs(spark, d):  # I15: lists of equal length, near each other, with a confidence
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", quantity().cast("string").alias("q")))).alias("x"))
    o = F.col("o")
    values = F.transform("x", lambda x: F.when(o % 4 == 0, F.concat(F.lit("$"), x["q"], F.lit(" million"))).otherwise(F.concat(x["q"], F.lit("%"))))
    year = lambda i: F.when(o % 8 < 4, F.lit(2001) + i).otherwise(F.lit(2002) + 2 * i)
    periods = F.transform("x", lambda x, i: F.when(o % 4 == 1, F.concat(F.lit("Q"), (i % 4 + 1).cast("string"))).otherwise(year(i).cast("string")))
    values = F.when(o % 4 == 2, F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(1)))).otherwise(values)
    joined = lambda a: F.when(F.size(a) > 1, F.concat(F.array_join(F.slice(a, 1, F.size(a) - 1), ", "), F.lit(" and "), F.element_at(a, -1))).otherwise(F.element_at(a, 1))
    filler = F.when(o % 4 == 3, F.repeat(F.lit("as described elsewhere in this report "), 8)).otherwise("")
    said = F.concat(F.lit("We grew. Gross margin for "), joined(periods), F.lit(" was "), filler, joined(values), F.lit(", respectively. Nothing else is said."))
    found = catalogue.each(once(lines.where(F.size("x") < 15), "said", said), "r", lists.respectively(F.col("said")))
    return found.select("o", "r.value", "r.period", "r.confidence")


@query("marker_rows", """SELECT l_orderkey AS filing_id, 'Line ' || l_linenumber AS heading, CAST(CAST(l_quantity AS BIGINT) * 10 AS VARCHAR) AS value, 2 AS cell, true AS same_row, count(*) AS n
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL""")
def marker_rows(spark, d):  # M24: the row, cell and heading of every number of a linearised table, and whether its heading is in its row
    tables = html.segments(filings(spark, d).select("filing_id", "html"), "filing_id").where("kind = 'table'")
    t = F.col("text")
    hits = catalogue.each(tables, "hit", catalogue.spans(t, r"(?<=\[CELL\] )\d[\d,.]*"))
    at = F.col("hit.start") + 1
    heading = markers.heading(t, at)
    whole = F.concat(F.lit("[CELL] "), heading, F.lit(" [CELL]"))
    hits = hits.select("filing_id", "text", at.alias("at"), F.col("hit.match").alias("value"), markers.place(t, at)["cell"].alias("cell"), heading.alias("heading"), F.instr(t, whole).alias("first"))
    found = hits.select("filing_id", "heading", "value", "cell", F.when(F.col("first") > 0, markers.same_row(F.col("text"), F.col("at"), F.lit(0) + F.col("at") - 1)).alias("same_row"))
    # A line has one number in its table, so there are as many rows as lines.
    return spread(found, "filing_id", table(spark, d, "lineitem").count()).groupBy("filing_id", "heading", "value", "cell", "same_row").agg(F.count("*").alias("n"))


@query("filing_index", """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'Company ' || o_custkey AS company_name, CASE WHEN o_orderkey % 4 = 0 THEN 'S-1' ELSE 'F-1' END AS form_type, CAST(o_orderdate AS DATE) AS filing_date, 'edgar/data/' || o_orderkey || '.txt' AS file_name
FROM orders WHERE o_orderkey % 4 < 2 AND o_orderkey % 7 <> 3 AND o_orderkey % 11 <> 5""")
def filing_index(spark, d):  # A8: lines of an index with other forms, bad dates and lines that are no rows
    o = F.col("o_orderkey")
    form = F.get(F.array(F.lit("S-1"), F.lit("F-1"), F.lit("10-K"), F.lit("8-K")), (o % 4).cast("int"))
    date = F.when(o % 7 == 3, "2024-13-99").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    line = F.concat_ws("|", F.concat(F.lit(" "), F.col("o_custkey").cast("string")), text("Company ", F.col("o_custkey")), form, date, text("edgar/data/", o, ".txt"))
    lines = table(spark, d, "orders").select(F.when(o % 11 == 5, F.concat(F.lit("Description: "), line, F.lit("|more"))).otherwise(line).alias("value"))
    return readers.filing_index(lines, ["S-1", "F-1"])


@query("pattern_dimension", """SELECT p_brand AS metric_id, lower(p_type) AS pattern, CASE WHEN contains(p_type, ' ') THEN 'specific' ELSE 'primary' END AS kind, count(*) AS parts FROM part GROUP BY ALL""")
def pattern_dimension(spark, d):  # A7: a YAML mapping of the parts' brands and types, read as a dimension and joined
    import yaml

    part = table(spark, d, "part")
    kinds = part.select("p_brand", "p_type").distinct().collect()  # a dimension: brands times types
    text_: dict = {}
    for r in kinds:
        text_.setdefault(r.p_brand, {}).setdefault("specific" if " " in r.p_type else "primary", []).append(r.p_type.lower())
    known = readers.yaml_dimension(spark, yaml.safe_dump(text_))
    own = part.groupBy(F.col("p_brand").alias("metric_id"), F.lower("p_type").alias("pattern")).agg(F.count("*").alias("parts"))
    return known.join(own, ["metric_id", "pattern"])


CHART = "struct<title:string,y_axis:string,series:array<struct<name:string,points:array<struct<x:string,y:double>>>>>"


@query("chart_presence", """WITH n AS (SELECT l_orderkey AS o, count(*) AS points FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey)
SELECT o, CASE WHEN o % 3 = 0 THEN 'cm_net_revenue_retention' ELSE 'cm_customer_churn_rate' END AS metric_id, CAST(CASE o % 3 WHEN 0 THEN 5.0 ELSE 2.0 END + CASE WHEN o % 2 = 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS score,
 points FROM n WHERE o % 5 < 3 AND o % 3 < 2""")
def chart_presence(spark, d):  # M5, M6, M7, H16: stored readings of charts, fenced or cut off, with gates and weighted words
    o = F.col("o")
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    points = F.array_sort(F.collect_list(F.struct(F.concat(F.lit("Q"), F.col("l_linenumber").cast("string")).alias("x"), F.col("l_quantity").cast("double").alias("y"))))
    made = lines.groupBy(F.col("l_orderkey").alias("o")).agg(points.alias("points"))
    title = F.when(o % 3 == 0, "Net revenue retention").when(o % 3 == 1, "Churn").otherwise("Headcount")
    chart = F.struct(F.when(o % 5 < 3, F.concat(title, F.lit(" by cohort"))).otherwise(title).alias("title"), F.when(o % 2 == 0, "Percent").otherwise("Units").alias("y_axis"), F.array(F.struct(F.lit("all").alias("name"), "points")).alias("series"))
    raw = F.to_json(chart)
    raw = F.when(o % 4 == 0, F.concat(F.lit("Here it is:\n```json\n"), raw, F.lit("\n```\nDone."))).when(o % 4 == 1, F.substr(raw, F.lit(1), F.length(raw) - 4)).otherwise(raw)
    read = once(once(made, "raw", raw).select("o", "raw"), "c", F.from_json(X.repair_json(F.col("raw")), CHART))
    gates = [("cm_net_revenue_retention", r"(?i)\bnet revenue retention\b", r"(?i)\bretention\b"), ("cm_customer_churn_rate", r"(?i)\bcustomer churn\b", r"(?i)\bchurn\b")]
    unit = F.when(F.col("c.y_axis").rlike("(?i)percent|%"), 1.5).otherwise(0.0)
    scored = [F.struct(F.lit(m).alias("metric_id"), (F.when(F.col("c.title").rlike(specific), 3.0).otherwise(0.0) + F.when(F.col("c.title").rlike(main), 2.0).otherwise(0.0)).alias("words")) for m, specific, main in gates]
    found = read.where(F.col("c.title").rlike("(?i)cohort")).withColumn("g", F.explode(F.array(*scored))).where("g.words > 0")
    n = F.aggregate("c.series", F.lit(0).cast("long"), lambda a, s: a + F.size(s["points"]))
    return found.select("o", "g.metric_id", (F.col("g.words") + unit).alias("score"), n.alias("points"))


@query("table_cells", """WITH n AS (SELECT l_orderkey AS filing_id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey)
SELECT filing_id, CASE filing_id % 3 WHEN 0 THEN 3 * n WHEN 1 THEN 10 * n ELSE n END AS cells, CASE filing_id % 3 WHEN 0 THEN 2 ELSE 1 END AS header_rows, CASE filing_id % 3 WHEN 0 THEN n WHEN 1 THEN 5 ELSE n END AS stubs FROM n""")
def table_cells(spark, d):  # M3: data cells, header rows and stubs of the three forms of tables, spans resolved
    cells = html.table_grid(table_filings(spark, d), "filing_id", columns=["row", "is_header", "is_stub"]).groupBy("filing_id")
    return cells.agg(F.count_if(~F.col("is_header") & ~F.col("is_stub")).alias("cells"), F.count_distinct(F.when(F.col("is_header"), F.col("row"))).cast("int").alias("header_rows"), F.count_if("is_stub").alias("stubs"))


@query("located_rules", TABLES_SQL + " SELECT binding, metric_id, coalesce(tag, 'none') AS tag, count(*) AS n FROM j GROUP BY ALL")
def located_rules(spark, d):  # M11: all registered rules in order over the values of tables
    judged = table_run(spark, d)["judged"]
    return judged.groupBy("binding", "metric_id", F.coalesce("tag", F.lit("none")).alias("tag")).agg(F.count("*").alias("n"))
