"""Readers of numbers, periods, labels, lists and tables on hand-worked cases; the queries hold them against SQL over the tables."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import lists, markers, rules
from tesserae.functions import numbers as N
from tesserae.functions import text as X
from tesserae.sources import html, readers

INDEX = "Description: daily index\ncik|company|form|date|file\n320193|Example Inc|S-1|2024-03-01|edgar/data/1.txt\n1234|Other Ltd|10-K|2024-03-02|edgar/data/2.txt\n77|Third|S-1|2024-13-99|bad.txt"
GRID = "<table><tr><th rowspan=2>Metric</th><th colspan=2>Year</th></tr><tr><th>2023</th><th>2024</th></tr><tr><td>Customers</td><td>10</td><td>12</td></tr></table>"
NUMBERS = [
    ("$1,234.5 million", 1234.5e6, "currency"), ("112%", 112.0, "percent"), ("1.42x", 1.42, "ratio"), ("50,000", 50000.0, "count"),
    ("-3", -3.0, "other"), ("about 2.5bn users", 2.5e9, "count"), ("€7k", 7000.0, "currency"), ("12 percent", 12.0, "percent"), ("none", None, None), ("2021", 2021.0, "other"),
]
GOLD = [("$1,250", None, 1250.0), ("3.5M", "millions", 3.5e6), ("12", "thousands", 12000.0), ("1.2T", None, 1.2e12), ("n/a", None, None), ("45%", None, 45.0)]
SPELLED = [("one billion people", 1e9), ("Twelve thousand", 12000.0), ("five hundred", 500.0), ("some words", None)]
SCALES = [("Revenue (in thousands)", 1000.0), ("(Amounts in millions, unaudited)", 1e6), ("(in thousands, except as noted)", 1000.0), ("plain", 1.0)]
PERIODS = [
    ("Q1 2024", "quarterly", "2024-01-01", "2024-03-31"), ("revenue in 3Q23 rose", "quarterly", "2023-07-01", "2023-09-30"), ("Q4'22", "quarterly", "2022-10-01", "2022-12-31"),
    ("FY24", "annual", "2024-01-01", "2024-12-31"), ("full year 2025", "annual", "2025-01-01", "2025-12-31"), ("nine months ended June 30, 2024", "ytd", "2023-10-01", "2024-06-30"),
    ("three months ended March 31, 2023", "quarterly", "2023-01-01", "2023-03-31"), ("year ended December 31, 2022", "annual", "2022-01-01", "2022-12-31"), ("as of May 5, 2021", "point_in_time", "2021-05-05", "2021-05-05"),
    ("year-to-date", "ytd", "2024-01-01", "2024-08-15"), ("TTM revenue", "trailing", "2023-08-16", "2024-08-15"), ("last quarter", "quarterly", "2024-04-01", "2024-06-30"), ("nothing", "point_in_time", "2024-08-15", "2024-08-15"),
]
COHORTS = [("2021 Cohort", "acquisition", "2021"), ("0-12 months", "tenure", "0-1y"), ("2+ years", "tenure", "2y+"), ("1-3 years", "tenure", "1-3y"), ("less than 24 months", "tenure", "<2y"), ("Enterprise", "other", "Enterprise"), ("", None, None)]
CHART = '{"title": "Net revenue retention by cohort", "y_axis": "Percent", "series": [{"name": "2021 cohort", "points": [{"x": "Q1", "y": 101.0}, {"x": "Q2", "y": 104.5}]}]}'
CANDIDATES = [
    (1, "cm_customers_period_end", 2021.0, "2021", "other", "text", 0.5, "in 2021 we had customers", "year_value"),
    (2, "cm_net_revenue_retention", 900.0, "900%", "percent", "text", 0.9, "900% retention", "percent_range"),
    (3, "cm_customers_period_end", 500.0, "500", "count", "text", 0.5, "we serve 80% of the Fortune 500", "ranking_name"),
    (4, "cm_customers_period_end", 12.0, "12", "count", "table_header", 0.9, "[ROW] [CELL] 12", None),
    (5, "cm_customers_period_end", 12.0, "12", "count", "table_header", 0.5, "[ROW] [CELL] 12", "linearized_table"),
    (6, "cm_customers_period_end", 5000.0, "5,000", "count", "text", 0.5, "we had 5,000 customers", None),
    (7, "cm_customers_period_end", 5e9, "5 billion", "count", "text", 0.5, "a market opportunity of 5 billion dollars", "tam_market_size"),
    (8, "cm_customer_retention_rate", 130.0, "130%", "percent", "text", 0.9, "retention of 130%", "retention_rate_over_100"),
]
RULES = [(r[0], r[-1]) for r in CANDIDATES]


def column(spark, rows, kind="string"):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, text {kind}").repartition(1).sortWithinPartitions("i")


def read(spark, texts, *values):
    return [tuple(r) for r in column(spark, texts).select(*values).collect()]


def test_numbers(spark):
    n = N.parse_number(F.col("text"))
    assert read(spark, [r[0] for r in NUMBERS], n["value"], n["unit"]) == [r[1:] for r in NUMBERS]
    assert [r.v for r in spark.createDataFrame([r[:2] for r in GOLD], "text string, scale string").select(N.normalise_gold(F.col("text"), F.coalesce("scale", F.lit(""))).alias("v")).collect()] == [r[2] for r in GOLD]
    assert read(spark, [r[0] for r in SPELLED], N.spelled_number(F.col("text"))) == [r[1:] for r in SPELLED]
    assert read(spark, [r[0] for r in SCALES], N.table_scale(F.col("text"))) == [r[1:] for r in SCALES]
    cell = N.cell_number(F.col("text"))
    assert read(spark, ["12", "about two million", "nearly $5 million", "one thousand", "text", None], cell["value"], cell["unit"]) == [(12.0, "other"), (2e6, "count"), (5e6, "currency"), (1000.0, "count"), (None, None), (None, None)]


def test_periods_and_labels(spark):
    p = N.infer_period(F.lit(""), F.col("text"), F.lit("2024-08-15").cast("date"))
    assert read(spark, [r[0] for r in PERIODS], p["period_type"], p["start"].cast("string"), p["end"].cast("string")) == [r[1:] for r in PERIODS]
    c = N.parse_cohort_label(F.col("text"))
    assert read(spark, [r[0] for r in COHORTS] + ["12-36 mos", "< 24 mos"], c["kind"], c["bucket"]) == [r[1:] for r in COHORTS] + [("tenure", "1-3y"), ("tenure", "<2y")]


def test_promotion(spark):
    unit = lambda m: N.promoted_unit(F.lit(m), F.lit("other"), F.col("text"))
    texts = ["NRR", "customers", "Renewals rose"]
    assert read(spark, texts, unit("cm_net_revenue_retention")) == [("percent",), ("other",), ("percent",)] and read(spark, texts, unit("cm_gmv")) == [("other",)] * 3


def test_rules(spark):
    names = "id int, metric_id string, value double, raw string, unit string, binding string, confidence double, text string"
    df = spark.createDataFrame([r[:-1] for r in CANDIDATES], names).withColumn("at", F.instr("text", F.col("raw"))).select("id", rules.reason().alias("tag"))
    assert sorted(map(tuple, df.collect())) == RULES
    units = rules.allowed_units()
    assert len(units) == 27 and sum(map(len, units.values())) == 60


@pytest.mark.parametrize("said, want, sure", [
    ("Revenue for 2021, 2022 and 2023 was $10 million, $12 million and $15 million, respectively.", [("$10 million", "2021"), ("$12 million", "2022"), ("$15 million", "2023")], 1.0),
    ("The ratio for the years ended December 31, 2015, 2016 and 2017 cohorts was 1.42, 1.53 and 1.77, respectively.", [("1.42", "2015"), ("1.53", "2016"), ("1.77", "2017")], 0.9),
    ("Sales for Q1 and Q2 were 5% and $6, respectively.", [("5%", "Q1"), ("$6", "Q2")], 0.8),
    ("Values of 5% and 6% in 2020 and 2019, respectively.", [("5%", "2020"), ("6%", "2019")], 0.9),
    ("For 2015 and 2016 it was 33%, respectively.", [], None), ("In 2015 and 2016 it was 33% and 35%.", [], None), (None, [], None), ("", [], None),
    ("For 2015 and 2016. It was 33% and 35%, respectively.", [], None), ("For 2015 and 2016 " + "x" * 250 + " was 33% and 35%, respectively.", [], None),
])
def test_respectively(spark, said, want, sure):
    got = spark.createDataFrame([(said,)], "t string").select(F.explode(lists.respectively(F.col("t"))).alias("r")).select("r.*").collect()
    assert [(r.value, r.period) for r in got] == want and {r.confidence for r in got} == ({sure} if want else set())


def test_markers(spark):
    t = "[ROW] [CELL] Metric [CELL] 2024 [ROW] [CELL] Customers [CELL] 1,200 [ROW] [CELL] 7 [CELL] 4%"
    at = lambda x: F.instr(F.col("text"), F.lit(x))
    place = lambda x: [markers.place(F.col("text"), at(x))[c] for c in ("row", "cell")]
    assert read(spark, [t], *place("2024"), *place("1,200"), *place("4%")) == [(1, 2, 2, 2, 3, 2)]
    assert read(spark, [t], markers.heading(F.col("text"), at("1,200")), markers.heading(F.col("text"), at("4%")), markers.heading(F.col("text"), at("Customers"))) == [("Customers", None, None)]
    assert read(spark, [t], markers.same_row(F.col("text"), at("Customers"), at("1,200")), markers.same_row(F.col("text"), at("4%"), at("1,200"))) == [(True, False)]


def test_index_dimension_and_grid(spark):
    lines = spark.createDataFrame([(x,) for x in INDEX.split("\n")], "value string")
    assert [(r.cik, r.company_name, r.form_type, str(r.filing_date)) for r in readers.filing_index(lines, ["S-1", "F-1"]).collect()] == [("0000320193", "Example Inc", "S-1", "2024-03-01")]
    yaml = "cm_churn:\n  primary: [churn]\n  specific: [net churn]\ncm_arpu:\n  primary: [arpu]\n"
    assert sorted(map(tuple, readers.yaml_dimension(spark, yaml).collect())) == [("cm_arpu", "primary", "arpu"), ("cm_churn", "primary", "churn"), ("cm_churn", "specific", "net churn")]
    cells = html.table_grid(spark.createDataFrame([(1, GRID)], "page_id int, html string"), "page_id").where("not is_header and not is_stub").collect()
    assert [(r.header_path, r.stub_path, r.text) for r in cells] == [(["Year", "2023"], ["Customers"], "10"), (["Year", "2024"], ["Customers"], "12")]


def test_json_repair(spark):
    cut = "```json\n" + CHART[:-3] + "\n```"
    kind = "struct<title:string,series:array<struct<name:string>>>"
    got = column(spark, [CHART, cut, "text before " + CHART]).select(F.from_json(X.repair_json(F.col("text")), kind).alias("c")).collect()
    assert all(r.c.title == "Net revenue retention by cohort" and r.c.series[0].name == "2021 cohort" for r in got)
