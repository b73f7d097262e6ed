"""Functions, sources, sinks, matching and streams on hand-worked cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import numbers, rules, sentences, text
from tesserae.operators import filters, matching, sinks
from tesserae.sources import html, readers
from tesserae.streaming import anchors


def test_sentences():
    spans = lambda t: [t[a:b] for a, b in sentences.sentence_spans(t)]
    assert spans("Acme Inc. grew. It has 1.5 million users! Who knew?") == ["Acme Inc. grew.", "It has 1.5 million users!", "Who knew?"]
    assert spans("One\n\nTwo\n- item a\n- item b") == ["One", "Two", "- item a", "- item b"]
    assert sentences.bounds_at("First. Second one.", 9) == (7, 18)
    assert spans("") == []


def test_respectively():
    t = "Revenue was $10 million, $12 million and $15 million in 2021, 2022 and 2023, respectively."
    assert sentences.respectively_pairs(t) == [("$10 million", "2021"), ("$12 million", "2022"), ("$15 million", "2023")]
    assert sentences.respectively_pairs("It was 5% and 6% in 2021, 2022 and 2023, respectively.") == []
    assert sentences.respectively_pairs("It was 5% and 6% in 2021 and 2022.") == []


def test_pandas_functions(spark):
    df = spark.createDataFrame([("First. Second one.", 9, "kitten", "sitting"), (None, None, None, "x")], "t string, at int, a string, b string")
    rows = df.select(sentences.sentence_bounds("t", "at").alias("s"), sentences.respectively("t").alias("r"), sentences.similarity("a", "b").alias("x")).collect()
    assert (rows[0].s.start, rows[0].s.end, rows[0].r) == (7, 18, []) and round(rows[0].x, 4) == 0.6154 and rows[1].x == 0


def test_review_number_is_a_fraction(spark):
    assert spark.sql("SELECT '45%' AS t").select(numbers.review_number(F.col("t"))).first()[0] == 0.45


@pytest.mark.parametrize(("t", "want"), [('```json\n{"a": 1, "b": [1, 2,]}\n``` thanks', {"a": 1, "b": [1, 2]}), ('{"a": 1, "b": [1, 2', {"a": 1, "b": [1, 2]}), ('{"a": 1, "s": "cut', {"a": 1, "s": "cut"})])
def test_json_repair(spark, t, want):
    import json

    assert json.loads(spark.createDataFrame([(t,)], "t string").select(text.repair_json(F.col("t"))).first()[0]) == want


def test_rule_language(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5.0)], "id int, s string, v double")
    got = lambda p: [r.id for r in df.where(filters.rule(p)).collect()]
    c = lambda f, o, v: {"field": f, "op": o, "value": v}
    assert got({"conditions": []}) == [] and got({"conditions": [c("s", "like", "a")]}) == [] and got({"conditions": [c("s", "eq", None)]}) == []
    assert got({"logic": "or", "conditions": [c("v", "gt", 1), c("s", "eq", "a")]}) == [1, 2]
    assert got({"conditions": [c("v", "gt", 1), c("s", "ne", "a")]}) == [2] and got({"conditions": [c("s", "contains", "b")]}) == [2]


# metric, value, raw, unit, binding, confidence, text, tag; each rule fires once and holds back once where that is telling
RULE_CASES = [
    ("cm_customers_period_end", 2021.0, "2021", "other", "text", 0.5, "in 2021 we had customers", "year_value"),
    ("cm_customers_period_end", 2021.0, "2,021", "count", "text", 0.5, "we had 2,021 customers", "year_value"),
    ("cm_customers_period_end", 2150.0, "2150", "other", "text", 0.5, "we had 2150 customers", None),
    ("cm_net_revenue_retention", 900.0, "900%", "percent", "text", 0.9, "900% retention", "percent_range"),
    ("cm_gmv", 2e10, "20 billion", "currency", "text", 0.5, "volume of 20 billion", "garbage_value"),
    ("cm_net_revenue_retention", -3.0, "-3%", "other", "text", 0.5, "retention moved -3%", "percent_range"),
    ("cm_monthly_active_users", -3.0, "-3", "count", "text", 0.5, "users moved -3", "negative_value"),
    ("cm_customers_period_end", 18.0, "018", "count", "text", 0.5, "in 2018 customers", "year_fragment"),
    ("cm_customers_period_end", 12.0, "12", "count", "text", 0.5, "since 2012 our customers", "truncated_year"),
    ("cm_customers_period_end", 21.0, "21", "count", "table_header", 0.9, "[CELL] 20 [CELL] 21 [CELL] 22", "truncated_year"),
    ("cm_customers_period_end", 12.0, "12", "count", "table_header", 0.9, "[ROW] [CELL] 12", None),
    ("cm_customers_period_end", 12.0, "12", "count", "table_header", 0.5, "[ROW] [CELL] 12", "linearized_table"),
    ("cm_gmv", 5.0, "5", "currency", "text", 0.5, "volume ($ in thousands) of 5", "financial_annotation"),
    ("cm_gmv", 5.0, "5", "currency", "text", 0.5, "stock-based compensation of 5", "financial_sbc"),
    ("cm_customers_period_end", 500.0, "500", "count", "text", 0.5, "we serve 80% of the Fortune 500", "ranking_name"),
    ("cm_average_order_value", 7.0, "$7", "currency", "text", 0.5, "earned $7 per share", "per_share"),
    ("cm_revenue_concentration", 20.0, "20%", "percent", "text", 0.5, "20% of revenue is international", "revenue_concentration_context"),
    ("cm_revenue_concentration", 20.0, "20%", "percent", "text", 0.5, "our largest customer was 20%", None),
    ("cm_revenue_concentration", 20.0, "20%", "percent", "text", 0.5, "value elsewhere", "revenue_concentration_context"),
    ("cm_daily_active_users", 900.0, "900", "other", "text", 0.5, "900 registered developers use it daily", "developer_count"),
    ("cm_customers_period_end", 300.0, "300", "other", "text", 0.5, "300 of the Fortune 500", "fortune_subset"),
    ("cm_customers_period_end", 30000.0, "30,000", "count", "text", 0.5, "30,000 with many of the Fortune 500", None),
    ("cm_customers_period_end", 70.0, "70", "other", "text", 0.5, "70 Enterprise customers", "tier_qualifier"),
    ("cm_customers_period_end", 70.0, "70", "other", "text", 0.5, "number of Enterprise customers: 70", None),
    ("cm_active_customers_total", 70.0, "70", "other", "text", 0.5, "Paid Customers >$100,000 were 70", "dollar_threshold_customer"),
    ("cm_net_revenue_retention", 110.0, "110%", "percent", "text", 0.5, "Customers >$100,000 retain 110%", None),
    ("cm_active_customers_total", 70.0, "70", "other", "text", 0.5, "70 video views", "content_engagement"),
    ("cm_active_customers_total", 57.6, "57.6", "count", "text", 0.5, "transactions per active account rose to 57.6", "transactions_per_account"),
    ("cm_active_customers_total", 300.0, "300", "other", "text", 0.5, "customers increased by 300", "delta_count_value"),
    ("cm_new_customers_acquired", 300.0, "300", "other", "text", 0.5, "customers increased by 300", None),
    ("cm_monthly_active_users", 30.0, "30%", "percent", "text", 0.5, "monthly actives grew 30%", "growth_rate_percent"),
    ("cm_revenue_per_customer", 3.0, "3%", "percent", "text", 0.5, "ARPA grew 3%", "arpu_percent"),
    ("cm_average_order_value", 9.0, "$9", "currency", "text", 0.5, "ARPU of $9", "arpu_as_aov"),
    ("cm_customers_period_end", 30.0, "30%", "percent", "text", 0.5, "30% of customers", "percent_on_count"),
    ("cm_monthly_active_users", 23.0, "23%", "percent", "text", 0.5, "users rising 23% year-over-year", None),
    ("cm_customer_retention_rate", 130.0, "130%", "percent", "text", 0.9, "retention of 130%", "retention_rate_over_100"),
    ("cm_customer_retention_rate", 95.0, "95%", "percent", "text", 0.9, "NRR of 95%", "retention_rate_over_100"),
    ("cm_net_revenue_retention", 30.0, "30%", "percent", "text", 0.9, "retention of 30%", "magnitude_sanity"),
    ("cm_ltv_to_cac_ratio", 26.0, "26x", "ratio", "text", 0.9, "a ratio of 26x", "magnitude_sanity"),
    ("cm_revenue_per_customer", 6789.0, "6,789", "count", "table_stub", 0.9, "revenue per customer (in thousands) 6,789", "revenue_per_customer_fin_annotation"),
    ("cm_revenue_concentration", 33.9, "33.9x", "ratio", "text", 0.9, "concentration 33.9x", "revenue_concentration_ratio_suffix"),
    ("cm_customers_period_end", 3.0, "3x", "ratio", "text", 0.5, "grew 3x", "ratio_suffix_on_count_metric"),
    ("cm_large_customers_period_end", 13000.0, "13,000", "count", "text", 0.9, "13,000 with $5,000 in ARR", "large_customers_small_arr_threshold"),
    ("cm_active_customers_total", 88.0, "88", "other", "table_stub", 0.5, "ARPU 88", "arpu_context_on_customer_count"),
    ("cm_active_customers_total", 88.0, "88", "other", "text", 0.5, "net loss of 88", "financial_context_customer_metric"),
    ("cm_gmv", 100000.0, "$100,000", "currency", "text", 0.5, "customers with over $100,000", "metric_definition_value"),
    ("cm_gmv", 12.0, "$12", "currency", "chart_label", 0.5, "$12 per seat", "chart_pricing_label"),
    ("cm_customers_period_end", 9000.0, "9,000", "count", "text", 0.5, "a market opportunity of 9,000", "tam_market_size"),
    ("cm_net_revenue_retention", 70.0, "70", "other", "table_header", 0.9, "Net revenue retention Number of customers 70", "stub_metric_contradiction"),
    ("cm_gmv", 70.0, "70", "other", "table_header", 0.9, "Volume Accounts payable 70", "stub_financial_line_item"),
    ("cm_customers_period_end", 5000.0, "5,000", "count", "text", 0.5, "we had 5,000 customers", None),
]


def test_false_positive_rules(spark):
    from pyspark.sql import functions as F

    names = "metric_id string, value double, raw string, unit string, binding string, confidence double, text string, tag string"
    df = spark.createDataFrame(RULE_CASES, names).withColumn("at", F.instr("text", F.col("raw")))
    got = df.select("raw", "text", "tag", rules.reason().alias("got"), rules.reason(F.lit(True)).alias("talk")).collect()
    assert [(r.text, r.got) for r in got] == [(r.text, r.tag) for r in got]
    assert {r.tag for r in got if r.talk != r.got} == set(rules.SKIPPED_IN_TALKS)
    assert {t for t, _, _ in rules.registry()} == {r.tag for r in got} - {None}  # every rule has a case
    assert len(rules.registry()) == 36 and rules.allowed_units()["cm_tcv"] == ["currency", "other"]


def test_value_place_is_that_of_extraction(spark):
    df = spark.createDataFrame([("cm_customers_period_end", 12.0, "12", "count", "text", 0.5, "since 2012 we had 12", 19)], "metric_id string, value double, raw string, unit string, binding string, confidence double, text string, at int")
    assert df.select(rules.reason()).first()[0] is None


def test_candidates_and_spans(spark):
    from tesserae.functions import catalogue

    df = spark.createDataFrame([("MAU of 3 and MAUs of 4; employee churn rate; churn rate",), ("",), (None,)], "text string")
    hits = df.selectExpr("*").select(catalogue.candidates(df["text"]).alias("h")).collect()
    got = [(h.metric_id, h.match, h.start, h.end, h.specific) for h in hits[0].h]
    assert got == [("cm_monthly_active_users", "MAU", 0, 3, False), ("cm_monthly_active_users", "MAUs", 13, 17, False)]  # employees are near both others
    assert hits[1].h == [] and not hits[2].h


def test_cross_metric_dedup(spark):
    rows = [(1, "12", "cm_a", 0.5), (1, "12", "cm_b", 0.9), (1, "12", "cm_b_by_cohort", 0.4), (2, "12", "cm_a", 0.1)]
    df = spark.createDataFrame(rows, "segment_id int, raw string, metric_id string, confidence double")
    assert sorted(r.metric_id for r in rules.cross_metric_dedup(df).collect()) == ["cm_a", "cm_b", "cm_b_by_cohort"]


def test_html_segments_and_grids():
    page = "<html><body><h2>Key  metrics</h2><p>" + "word " * 20 + "</p><p>short</p><script>x()</script><table><tr><th>A</th></tr><tr><td>1</td></tr></table><img src='a.png' alt='chart'>"
    assert html.segments_of(page) == [("heading", "Key metrics"), ("paragraph", ("word " * 20).strip()), ("table", "[ROW] [CELL] A [ROW] [CELL] 1"), ("image", "a.png|chart")]
    assert [len(t) for _, t in html.segments_of("<p>" + "x" * 25_000 + "</p>")] == [10_000, 10_000, 5_000]
    assert html.segments_of("") == [] and html.segments_of(None) == []
    (cells,) = html.tables_of("<table><tr><th rowspan=2>Metric</th><th colspan=2>Year</th></tr><tr><th>2023</th><th>2024</th></tr><tr><td>Users</td><td>10</td><td>12</td></tr></table>")
    body = {(c["row"], c["col"]): c for c in cells}
    assert body[2, 2]["text"] == "12" and body[2, 2]["header_path"] == ["Year", "2024"] and body[2, 2]["stub_path"] == ["Users"] and body[1, 0]["text"] == "Metric"
    (cells,) = html.tables_of("<table><tr><td>Item</td><td>2024</td></tr><tr><td>Users</td><td>5</td></tr></table>")
    assert not any(c["is_header"] for c in cells) and [c["text"] for c in cells if c["is_stub"]] == ["Item", "Users"]
    assert html.decode(b"\xef\xbb\xbfhi") == "hi" and html.decode("é".encode("cp1252")) == "é"


def test_readers(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes('﻿company,raw\n"Acme, Inc","said ""hi"""\n'.encode())
    assert tuple(readers.gold_csv(spark, str(tmp_path / "g.csv"), "company string, raw string").first()) == ("Acme, Inc", 'said "hi"')
    (tmp_path / "s.json").write_text('{"version": 1,\n "splits": {"train": [{"url": "u"}]}}')
    assert readers.json_files(spark, str(tmp_path / "s.json"), "version int, splits struct<train: array<struct<url:string>>>").first().splits.train[0].url == "u"
    (tmp_path / "d.html").write_bytes("<p>é</p>".encode("cp1252"))
    assert readers.html_files(spark, str(tmp_path / "d.html")).first().html == "<p>é</p>"
    assert readers.slide_title("Q4 Highlights and Outlook") and not readers.slide_title("this is a plain sentence.")

    class Source:
        def list_available(self):
            return ["a", "b", "c"]

        def fetch(self, key):
            return key * 2

    spark.dataSource.register(readers.connector("doubles", Source(), 2))
    assert sorted(map(tuple, spark.read.format("doubles").load().collect())) == [("a", "aa"), ("b", "bb"), ("c", "cc")]
    cache = spark.sql("SELECT sha2('v1|x', 256) AS cache_key, 'hit' AS response, timestamp'2024-01-10' AS created_at")
    asked = spark.createDataFrame([("x",), ("y",)], "q string")
    assert {r.q: r.response for r in readers.cached_responses(asked, cache, ["q"], "v1", "2024-01-20").collect()} == {"x": "hit", "y": None}
    assert {r.response for r in readers.cached_responses(asked, cache, ["q"], "v1", "2024-03-20").collect()} == {None}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "accepted"), (2, "b", None)], "filing_id int, v string, review_status string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", None)], "filing_id int, v string, review_status string")
    as_map = lambda df: {r.filing_id: r.v for r in df.collect()}
    assert as_map(sinks.upsert(old, new, ["filing_id"])) == {1: "a", 2: "c", 3: "d"}
    assert as_map(sinks.insert_missing(old, new, ["filing_id"])) == {1: "a", 2: "b", 3: "d"}
    sinks.guard_reviewed(old, new, ["filing_id"])
    with pytest.raises(sinks.ReviewedWorkError):
        sinks.guard_reviewed(old, old, ["filing_id"])
    sinks.guard_reviewed(old, old, ["filing_id"], force=True)
    with pytest.raises(ValueError, match="exclude"):
        sinks.write(old, str(tmp_path / "t"), force=True, chart_only=True)
    sinks.write(old, str(tmp_path / "t"), ["filing_id"])
    sinks.write(new, str(tmp_path / "t"), ["filing_id"])
    assert as_map(spark.read.parquet(str(tmp_path / "t"))) == {1: "a", 2: "c", 3: "d"}
    sinks.export(old, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_streams(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = lambda a, b: spark.range(a, b).select(F.col("id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("ts"), F.lit("x").alias("k"))
    rows(0, 5).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for total, more in ((5, (5, 8)), (8, None)):
        anchors.catch_up(spark, src, schema, check, out, lambda df: df.where("id >= 0"))
        assert spark.read.parquet(out).count() == total
        if more:
            rows(*more).write.mode("append").parquet(src)
    runs = spark.sql("SELECT 'succeeded' AS status, timestamp'2024-01-01 03:00:00' AS completed_at UNION ALL SELECT 'failed', timestamp'2024-01-01 06:00:00'")
    assert anchors.since_last_run(rows(0, 8), runs).count() == 4
    assert anchors.since_last_run(rows(0, 8), runs.where("status = 'none'")).count() == 8
    assert anchors.counts_by_window(rows(0, 8), "ts", "k", "4 hours").count() == 2


def test_outermost_spans(spark):
    from tesserae.plans.extraction import outermost

    rng = random.Random(5)
    # Facts of one a for each id, some ids with several spans.
    rows = [(i, rng.randrange(2), f"m{rng.randrange(2)}", i % 9, i % 9 + rng.randrange(1, 12)) for i in [rng.randrange(60) for _ in range(90)]]
    inside = lambda x, o: o[0] != x[0] and o[1:3] == x[1:3] and x[3] >= o[3] and x[4] <= o[4] and x[4] - x[3] < o[4] - o[3]
    want = sorted(x[0] for x in rows if not any(inside(x, o) for o in rows))
    df = spark.createDataFrame(rows, "fact_id long, company_id long, metric_id string, a long, b long")
    assert 0 < len(want) < len(rows) and sorted(r.fact_id for r in outermost(df).collect()) == want


def test_every_hit_is_judged(spark, tmp_path):
    from tesserae.plans.registry import QUERIES

    text = "the x with y. " + "pad " * 40 + "the end of it. " + "pad " * 40 + "over the hill, station nation"
    spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "the ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name, *cols: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("doc_id", *cols).collect())
    at = lambda word: [i + 1 for i in range(len(text)) if text.startswith(word, i)]
    assert got("exclusion_windows", "pos") == [(1, p) for p in at("the ")[1:]] + [(4, 1)]
    assert got("context_windows", "pos", "context") == [(1, p, hashlib.md5(text[max(0, p - 101) : p + 99].encode()).hexdigest()) for p in at("tion")]
    w = text.split()
    around = [(1, i + 1, hashlib.md5(" ".join(w[max(0, i - 6) : i + 7]).encode()).hexdigest()) for i, x in enumerate(w) if x == "the"]
    assert got("word_windows", "word", "around") == [*around, (4, 1, hashlib.md5(b"the").hexdigest())]
    spark.createDataFrame([(1, 1, "On the hill. Under the old tree the cat sat. No.", "user"), (1, 2, None, "user")], "conv_id long, turn int, text string, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    bounds = QUERIES["sentence_bounds"](spark, str(tmp_path)).select("turn", "at", "start", "end").collect()
    assert sorted(map(tuple, bounds)) == [(1, 3, 0, 12), (1, 19, 13, 44), (1, 32, 13, 44)]


ISSUERS = [  # name, code, text; the classes and what tells
    ("Acme Robotics", "7371", None, {"saas": "code"}),
    ("Acme Cloud Tools", "7990", None, {"saas": "name"}),
    ("Acme Cloud Tools", "3570", None, {}),  # the name counts beside a code of services only
    ("Acme", None, "We sell software as a service by subscription.", {"saas": "text"}),
    ("Acme", None, "x" * 10_000 + " saas subscription", {}),  # beyond the head
    ("Corner Shop AG", None, None, {"ecommerce": "name"}),
    ("Acme", "5961", "Our take rate rose.", {"ecommerce": "code"}),
    ("Acme", None, "A marketplace that earns a commission.", {"ecommerce": "text"}),
    ("Acme Payment", "6211", None, {"fintech": "name"}),
    ("Acme Payment Trust", "6211", None, {}),
    ("Crowdfunding Wallet", "6199", None, {"fintech": "code"}),  # funding is no fund
    ("Acme Mining", "3570", "blockchain digital wallet", {}),
    ("Acme Mining", None, "blockchain digital wallet", {"fintech": "text"}),
    ("Acme", "6199", "We make mining equipment.", {}),
    ("Patient Data Co", None, None, {"health": "name"}),
    ("Patient Care Co", None, None, {}),
    ("Acme", None, "Telehealth visits doubled.", {"health": "text"}),
    ("Acme", "4899", None, {"media": "code", "telecom": "code"}),
    ("Acme", None, "streaming for subscribers", {"media": "text"}),
    ("Acme Network", None, None, {"telecom": "name", "platform": "name"}),
    ("Acme", "7380", None, {"media": "code", "platform": "code"}),
    ("Acme", None, "Network effects help us.", {"platform": "text"}),
    (None, None, None, {}),
]


def test_issuer_classes(spark):
    from tesserae.functions import issuers

    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(ISSUERS)], "i int, name string, code string, text string")
    rows = df.select("i", *[c.alias(k) for k, c in issuers.industry(F.col("name"), F.col("code"), F.col("text")).items()]).orderBy("i").collect()
    assert [{k: v for k, v in r.asDict().items() if k != "i" and v} for r in rows] == [r[3] for r in ISSUERS]


def test_post_combination(spark):
    from tesserae.functions import issuers

    told = "After the business combination, see our Consolidated Balance Sheets."
    busy = "The merger agreement. Cost of sales. " + "Revenue grew. " * 6
    cases = [(False, False, told, False), (None, None, told, False), (False, True, None, True), (True, True, None, False), (True, True, told, True), (True, True, busy, True), (True, True, busy.replace("Revenue grew. ", "", 1), False)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, now boolean, earlier boolean, text string")
    rows = df.select("i", issuers.is_post_combination(F.col("now"), F.col("earlier"), F.col("text")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [c[3] for c in cases]


def test_validators(spark):
    from tesserae.functions import validation as v

    def check(f, cases):
        df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
        assert [r.y for r in df.select("i", f(F.col("x")).cast("string").alias("y")).orderBy("i").collect()] == [y for _, y in cases]

    check(v.cik, [("320193", "0000320193"), (" 7 ", "0000000007"), ("12345678901", None), ("../1", None), ("", None), (None, None)])
    check(v.accession, [("0000320193-24-000001", "0000320193-24-000001"), ("0000320193-24-00001", None), ("x0000320193-24-000001", None), ("0000320193-24-000001\n.", None), (None, None)])
    check(v.accession_within, [("transcript:0000320193-24-000001/a", "0000320193-24-000001"), ("none", None), (None, None)])
    check(v.sic, [("7372", "7372"), ("100", "0100"), ("99", None), ("12345", None), ("73a", None), ("", None)])
    check(v.date, [("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("2024-2-9", None), ("2024-13-01", None), (None, None)])
    check(lambda x: v.score(x.cast("double")), [("0", "true"), ("1", "true"), ("1.01", "false"), ("-0.1", "false"), ("NaN", "false"), (None, "true")])


def test_cell_scale(spark):
    noted = "(in thousands, except as noted)"
    cases = [("(in thousands)", "Revenue", "$5", 1e3), (noted, "Revenue", "5", 1e3), (noted, "Revenue", "$5", 1.0), ("(in millions)", "Users (Actual)", "5", 1.0), (None, None, None, 1.0), ("(in billions)", None, None, 1e9)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, note string, stub string, raw string")
    rows = df.select("i", numbers.cell_scale(F.col("note"), F.col("stub"), F.col("raw")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [c[3] for c in cases]
