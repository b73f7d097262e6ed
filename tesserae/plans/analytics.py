"""The analytical views: wide facts, coverage, presence, disclosure, review progress, decision statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranking import latest
from .base import decisions, facts, parted, pct, pct_sql, query, table

CENTS = "decimal(18,2)"


@query("fact_wide", """SELECT fact_id, filing_id, company_id, c_name AS company_name, n_name AS industry, metric_id, tier, value, confidence, source_type, review_status, CAST(filing_date AS VARCHAR) AS filing_date
FROM facts JOIN customer ON c_custkey = company_id JOIN nation ON n_nationkey = c_nationkey""", "facts")
def fact_wide(spark, d):  # C1, B1
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    wide = facts(spark, d).join(c, F.col("c_custkey") == F.col("company_id")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return wide.select("fact_id", "filing_id", "company_id", F.col("c_name").alias("company_name"), F.col("n_name").alias("industry"), "metric_id", "tier", "value", "confidence", "source_type", "review_status", F.col("filing_date").cast("string").alias("filing_date"))


@query("coverage_matrix", """+ a AS (SELECT company_id, metric_id, count(*) AS n, max(confidence) AS best, bool_or(review_status = 'accepted') AS acc FROM facts WHERE source_type = 'text' GROUP BY ALL)
SELECT c_custkey AS company_id, m.p_brand AS metric_id, n IS NOT NULL AS has_fact, acc AS has_accepted_fact, coalesce(n, 0) AS n_facts, best FROM customer CROSS JOIN (SELECT DISTINCT p_brand FROM part) m LEFT JOIN a ON a.company_id = c_custkey AND a.metric_id = m.p_brand""", "facts")
def coverage_matrix(spark, d):  # C5, C2, D1: every company by every metric; the metrics are a fixed catalogue
    metrics = table(spark, d, "part").select(F.col("p_brand").alias("metric_id")).distinct()
    a = facts(spark, d).where("source_type = 'text'").groupBy("company_id", "metric_id").agg(F.count("*").alias("n"), F.max("confidence").alias("best"), F.bool_or(F.col("review_status") == "accepted").alias("acc"))
    grid = table(spark, d, "customer").select(F.col("c_custkey").alias("company_id")).crossJoin(metrics)  # the matrix is the product
    return grid.join(a, ["company_id", "metric_id"], "left").select("company_id", "metric_id", F.col("n").isNotNull().alias("has_fact"), F.col("acc").alias("has_accepted_fact"), F.coalesce("n", F.lit(0)).alias("n_facts"), "best")


@query("company_disclosure", """+ p AS (SELECT company_id, metric_id, bool_or(source_type = 'text') AS t, bool_or(source_type = 'chart') AS i, count(DISTINCT filing_id) AS filings FROM facts WHERE confidence >= 0.95 GROUP BY ALL)
SELECT company_id, count(DISTINCT metric_id) AS metrics, CAST(sum(CASE WHEN t AND i THEN 1 ELSE 0 END) AS BIGINT) AS in_both, CAST(max(filings) AS BIGINT) AS most_filings, array_to_string(list_sort(list(DISTINCT metric_id)), '|') AS metric_list FROM p GROUP BY company_id""", "facts")
def company_disclosure(spark, d):  # D7, D8, D4
    f = facts(spark, d).where("confidence >= 0.95").select("company_id", "metric_id", "filing_id", "source_type")
    f = parted(f, table(spark, d, "lineitem").count(), "company_id")  # all that follows is within a company
    p = f.groupBy("company_id", "metric_id").agg(F.bool_or(F.col("source_type") == "text").alias("t"), F.bool_or(F.col("source_type") == "chart").alias("i"), F.count_distinct("filing_id").alias("filings"))
    return p.groupBy("company_id").agg(F.count("*").alias("metrics"), F.count_if(F.col("t") & F.col("i")).alias("in_both"), F.max("filings").alias("most_filings"), F.array_join(F.array_sort(F.collect_set("metric_id")), "|").alias("metric_list"))


@query("tier1_summary", """+ t AS (SELECT DISTINCT company_id, metric_id FROM facts WHERE tier = (SELECT min(p_type) FROM part))
SELECT bucket, count(*) AS companies FROM (SELECT c_custkey, CASE WHEN count(metric_id) >= 5 THEN '5+' ELSE CAST(count(metric_id) AS VARCHAR) END AS bucket FROM customer LEFT JOIN t ON company_id = c_custkey GROUP BY c_custkey) GROUP BY bucket""", "facts")
def tier1_summary(spark, d):  # B2, C2
    first = table(spark, d, "part").agg(F.min("p_type").alias("tier"))
    t = facts(spark, d).join(F.broadcast(first), "tier").select(F.col("company_id").alias("c_custkey"), "metric_id").distinct()
    n = table(spark, d, "customer").join(t, "c_custkey", "left").groupBy("c_custkey").agg(F.count("metric_id").alias("n"))
    return n.groupBy(F.when(F.col("n") >= 5, "5+").otherwise(F.col("n").cast("string")).alias("bucket")).agg(F.count("*").alias("companies"))


@query("confidence_bands", "SELECT CASE WHEN confidence >= 0.97 THEN 'high' WHEN confidence >= 0.93 THEN 'mid' ELSE 'low' END AS band, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM facts GROUP BY 1", "facts")
def confidence_bands(spark, d):  # D2, D3
    band = F.when(F.col("confidence") >= 0.97, "high").when(F.col("confidence") >= 0.93, "mid").otherwise("low")
    return facts(spark, d).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast(CENTS)).cast("double").alias("total"))


@query("company_review_stats", f"SELECT company_id, count(DISTINCT filing_id) AS filings, count(*) AS n_facts, {pct_sql('count(*) FILTER (WHERE review_status = \'accepted\')', 'count(*)')} AS reviewed_pct FROM facts GROUP BY company_id", "facts")
def company_review_stats(spark, d):  # D4, D13
    return facts(spark, d).groupBy("company_id").agg(F.count_distinct("filing_id").alias("filings"), F.count("*").alias("n_facts"), pct(F.count_if(F.col("review_status") == "accepted"), F.count("*")).alias("reviewed_pct"))


@query("precision_by_tier", f"""+ t AS (SELECT CASE WHEN k >= 70 THEN 'high' WHEN k >= 30 THEN 'mid' ELSE 'low' END AS tier, decision FROM decisions WHERE decision <> 'skip') SELECT tier, count(*) AS n, {pct_sql('count(*) FILTER (WHERE decision IN (\'accept\', \'add\'))', 'count(*)')} AS precision_pct FROM t GROUP BY tier""", "decisions")
def precision_by_tier(spark, d):  # B3, D2, D13
    tier = F.when(F.col("k") >= 70, "high").when(F.col("k") >= 30, "mid").otherwise("low")
    return decisions(spark, d).where("decision <> 'skip'").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), pct(F.count_if(F.col("decision").isin("accept", "add")), F.count("*")).alias("precision_pct"))


@query("decisions_by_metric", "SELECT metric_id, count(*) FILTER (WHERE decision = 'accept') AS accepts, count(*) FILTER (WHERE decision = 'reject') AS rejects, count(*) FILTER (WHERE decision = 'correct') AS corrects, count(*) FILTER (WHERE decision = 'add') AS adds FROM decisions GROUP BY metric_id", "decisions")
def decisions_by_metric(spark, d):  # D2
    return decisions(spark, d).groupBy("metric_id").agg(*[F.count_if(F.col("decision") == x).alias(x + "s") for x in ("accept", "reject", "correct", "add")])


@query("image_review_state", """+ r AS (SELECT img_id, count(DISTINCT metric_id) FILTER (WHERE decision IN ('accept', 'add', 'correct')) AS positive, count(*) FILTER (WHERE decision <> 'skip') AS n FROM decisions GROUP BY img_id)
SELECT CASE WHEN positive > 0 THEN 'relevant' WHEN n > 0 THEN 'no_relevant' ELSE 'pending' END AS state, count(*) AS images FROM (SELECT i.img_id, coalesce(positive, 0) AS positive, coalesce(n, 0) AS n FROM (SELECT range AS img_id FROM range(450)) i LEFT JOIN r ON r.img_id = i.img_id) GROUP BY 1""", "decisions")
def image_review_state(spark, d):  # M27, D5, D7
    positive = F.count_distinct(F.when(F.col("decision").isin("accept", "add", "correct"), F.col("metric_id")))
    r = decisions(spark, d).groupBy("img_id").agg(positive.alias("positive"), F.count_if(F.col("decision") != "skip").alias("n"))
    state = F.when(F.col("positive") > 0, "relevant").when(F.col("n") > 0, "no_relevant").otherwise("pending")
    return spark.range(450).toDF("img_id").join(r, "img_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("images"))


@query("review_progress", f"""+ r AS (SELECT img_id % 20 AS filing, img_id, bool_or(decision <> 'skip') AS done FROM decisions GROUP BY ALL) SELECT filing, count(*) AS images, count(*) FILTER (WHERE done) AS reviewed, {pct_sql('count(*) FILTER (WHERE done)', 'count(*)')} AS reviewed_pct FROM r GROUP BY filing""", "decisions")
def review_progress(spark, d):  # M30: progress of a filing's images
    r = decisions(spark, d).groupBy((F.col("img_id") % 20).alias("filing"), "img_id").agg(F.bool_or(F.col("decision") != "skip").alias("done"))
    return r.groupBy("filing").agg(F.count("*").alias("images"), F.count_if("done").alias("reviewed"), pct(F.count_if("done"), F.count("*")).alias("reviewed_pct"))


@query("decision_breakdown", """+ s AS (SELECT DISTINCT img_id FROM decisions WHERE decision = 'accept' UNION SELECT DISTINCT img_id FROM decisions WHERE decision = 'add') SELECT (SELECT count(*) FROM s) AS relevant, count(DISTINCT img_id) FILTER (WHERE decision = 'reject') AS rejected, count(DISTINCT img_id) FILTER (WHERE img_id NOT IN (SELECT img_id FROM s)) AS other FROM decisions""", "decisions")
def decision_breakdown(spark, d):  # C6, G2, D5
    per = decisions(spark, d).groupBy("img_id").agg(F.bool_or(F.col("decision").isin("accept", "add")).alias("rel"), F.bool_or(F.col("decision") == "reject").alias("rej"))
    return per.agg(F.count_if("rel").alias("relevant"), F.count_if("rej").alias("rejected"), F.count_if(~F.col("rel")).alias("other"))


@query("rejection_rollup", f"SELECT metric_id, count(*) AS n, {pct_sql('count(*)', 'sum(count(*)) OVER ()')} AS share FROM decisions WHERE decision = 'reject' AND ts > TIMESTAMP '2024-01-05' GROUP BY metric_id", "decisions")
def rejection_rollup(spark, d):  # E2, B9
    from pyspark.sql import Window

    n = decisions(spark, d).where("decision = 'reject' and ts > timestamp_ntz '2024-01-05'").groupBy("metric_id").agg(F.count("*").alias("n"))
    return n.select("metric_id", "n", pct(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


@query("facts_pending_review", "SELECT fact_id, metric_id, confidence FROM facts WHERE review_status = 'pending' AND confidence < 0.93 AND source_type = 'chart'", "facts")
def facts_pending_review(spark, d):  # M30
    return facts(spark, d).where("review_status = 'pending' and confidence < 0.93 and source_type = 'chart'").select("fact_id", "metric_id", "confidence")


@query("extraction_summary", "SELECT source_type, review_status, count(*) AS n, count(DISTINCT filing_id) AS filings, count(DISTINCT company_id) AS companies, min(confidence) AS least, max(confidence) AS most FROM facts GROUP BY ALL", "facts")
def extraction_summary(spark, d):  # M30
    # A filing's facts meet, then a company's filings, so distinct ones are counted without rows for each of the two counts.
    by, span = ["source_type", "review_status"], [F.min("least").alias("least"), F.max("most").alias("most")]
    f = facts(spark, d).select(*by, "filing_id", "company_id", F.col("confidence").alias("least"), F.col("confidence").alias("most")).repartition("filing_id")
    f = f.groupBy(*by, "filing_id").agg(F.count("*").alias("n"), F.collect_set("company_id").alias("companies"), *span)
    f = f.select(*by, "n", "least", "most", F.posexplode_outer("companies").alias("at", "company_id"))
    first = lambda c: F.when(F.coalesce("at", F.lit(0)) == 0, c).otherwise(0)
    f = f.groupBy(*by, "company_id").agg(F.sum(first(F.col("n"))).alias("n"), F.sum(first(F.lit(1))).alias("filings"), *span)
    return f.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("filings").alias("filings"), F.count("company_id").alias("companies"), *span)


@query("latest_classification", "SELECT img_id, decision, metric_id FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY ts DESC, decision_id DESC) AS rn FROM decisions) WHERE rn = 1", "decisions")
def latest_classification(spark, d):  # D9
    return latest(decisions(spark, d), ["img_id"], [F.desc("ts"), F.desc("decision_id")]).select("img_id", "decision", "metric_id")


TIER_1 = ["Brand#11", "Brand#12", "Brand#23", "Brand#34", "Brand#45"]


@query("metric_tiers", f"SELECT DISTINCT p_brand AS metric_id, replace(p_brand, '#', ' ') AS metric_name, CASE WHEN p_brand IN ({str(TIER_1)[1:-1]}) THEN 1 ELSE 2 END AS tier FROM part")
def metric_tiers(spark, d):  # M30: 1 is what must not be missed
    brand = F.col("p_brand")
    tier = F.when(brand.isin(TIER_1), 1).otherwise(2)
    return table(spark, d, "part").select(brand.alias("metric_id"), F.replace(brand, F.lit("#"), F.lit(" ")).alias("metric_name"), tier.alias("tier")).distinct()


@query("metric_presence", """+ t AS (SELECT filing_id, metric_id, array_to_string(list_sort(list(DISTINCT fact_id)), '|') AS segments FROM facts WHERE source_type = 'text' GROUP BY ALL),
c AS (SELECT *, CASE WHEN quantity < 10 THEN fact_id - 1 END AS supersedes FROM facts WHERE source_type = 'chart'),
i AS (SELECT filing_id, metric_id, array_to_string(list_sort(list(DISTINCT fact_id)), '|') AS images FROM c WHERE review_status = 'accepted' AND NOT EXISTS (SELECT 1 FROM c AS later WHERE later.supersedes = c.fact_id) GROUP BY ALL)
SELECT coalesce(t.filing_id, i.filing_id) AS filing_id, coalesce(t.metric_id, i.metric_id) AS metric_id, t.filing_id IS NOT NULL AS text_disclosed, i.filing_id IS NOT NULL AS image_disclosed, coalesce(segments, '') AS segments, coalesce(images, '') AS images
FROM t FULL OUTER JOIN i ON t.filing_id = i.filing_id AND t.metric_id = i.metric_id""", "facts")
def metric_presence(spark, d):  # M30: text and confirmed images by filing and metric, with their evidence; superseded decisions don't count
    f = facts(spark, d).select("filing_id", "metric_id", "fact_id", "source_type", "review_status", "quantity")
    key = ["filing_id", "metric_id"]
    ids = F.array_join(F.array_sort(F.collect_set("fact_id")), "|")
    charts = f.where("source_type = 'chart'")
    superseded = charts.where("quantity < 10").select((F.col("fact_id") - 1).alias("fact_id"))
    images = charts.where("review_status = 'accepted'").join(superseded, "fact_id", "left_anti").groupBy(*key).agg(ids.alias("images"))
    both = f.where("source_type = 'text'").groupBy(*key).agg(ids.alias("segments")).join(images, key, "full_outer")
    shown = lambda c: F.col(c).isNotNull()
    return both.select(*key, shown("segments").alias("text_disclosed"), shown("images").alias("image_disclosed"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("segments", "images")])


def create_views(spark, sf_dir) -> list[str]:
    """The views under the names that dashboards query."""
    views = {
        "v_fact_wide": fact_wide, "v_coverage_matrix": coverage_matrix, "v_company_metric_disclosure": company_disclosure,
        "v_company_tier1_summary": tier1_summary, "v_image_review_progress": review_progress, "v_facts_pending_review": facts_pending_review,
        "v_extraction_summary": extraction_summary, "v_metric_tiers": metric_tiers, "v_metric_presence": metric_presence,
    }
    for name, build in views.items():
        build(spark, sf_dir).createOrReplaceTempView(name)
    return list(views)
