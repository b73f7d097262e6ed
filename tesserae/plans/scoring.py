"""Scores against gold: precision and recall, thresholds, percentiles, calibration, baselines, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aliases import canonical, closed
from ..operators.counting import at_rank, percentile, positions
from ..operators.matching import greedy_one_to_one, tolerance_groups
from ..operators.ranges import near_join, overlap_join
from .base import FACTS_SQL, decisions, facts, query, table
from .dedup import BEST_SQL, first_come_sql
from .extraction import SOURCE_RANK

GOLD_SQL = """g AS (SELECT metric_id, company_id, fact_id, confidence, fact_id % 3 <> 0 AS in_gold, confidence >= 0.94 AS predicted FROM facts)"""


def gold(spark, d):
    return facts(spark, d).select("metric_id", "company_id", "fact_id", "confidence", (F.col("fact_id") % 3 != 0).alias("in_gold"), (F.col("confidence") >= 0.94).alias("predicted"))


def counts(positive, truth):
    return (F.count_if(positive & truth).alias("tp"), F.count_if(positive & ~truth).alias("fp"), F.count_if(~positive & truth).alias("fn"))


def rates(df, empty_precision: float = 0.0):
    """precision, recall and F1, rounded to 6 places. Without predictions the precision is ``empty_precision``: the
    validator says 0, calibration says 1."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(empty_precision)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return df.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f, 6)})


RATES_SQL = """round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE {e} END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


@query("prf_by_metric", f"+ {GOLD_SQL}, n AS (SELECT metric_id, count(*) FILTER (WHERE predicted AND in_gold) AS tp, count(*) FILTER (WHERE predicted AND NOT in_gold) AS fp, count(*) FILTER (WHERE NOT predicted AND in_gold) AS fn FROM g GROUP BY metric_id) SELECT metric_id, tp, fp, fn, {RATES_SQL.format(e=0.0)} FROM n", "facts")
def prf_by_metric(spark, d):  # D18
    return rates(gold(spark, d).groupBy("metric_id").agg(*counts(F.col("predicted"), F.col("in_gold"))))


@query("prf_micro", f"+ {GOLD_SQL}, n AS (SELECT count(*) FILTER (WHERE predicted AND in_gold) AS tp, count(*) FILTER (WHERE predicted AND NOT in_gold) AS fp, count(*) FILTER (WHERE NOT predicted AND in_gold) AS fn FROM g) SELECT tp, fp, fn, {RATES_SQL.format(e=0.0)} FROM n", "facts")
def prf_micro(spark, d):  # D18
    return rates(gold(spark, d).agg(*counts(F.col("predicted"), F.col("in_gold"))))


THRESHOLDS = [k / 10 for k in range(1, 10)]


@query("threshold_sweep", f"""+ {GOLD_SQL}, s AS (SELECT in_gold, (confidence - 0.9) * 10 AS score FROM g), t AS (SELECT range / 10.0::DOUBLE AS threshold FROM range(1, 10)),
n AS (SELECT threshold, count(*) FILTER (WHERE score > threshold AND in_gold) AS tp, count(*) FILTER (WHERE score > threshold AND NOT in_gold) AS fp, count(*) FILTER (WHERE NOT score > threshold AND in_gold) AS fn FROM s, t GROUP BY threshold) SELECT threshold, tp, fp, fn, {RATES_SQL.format(e=1.0)} FROM n""", "facts")
def threshold_sweep(spark, d):  # D19: strict comparison; nine thresholds a row, so no join
    g = gold(spark, d).select("in_gold", ((F.col("confidence") - 0.9) * 10).alias("score"))
    n = g.select("in_gold", "score", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold")).groupBy("threshold").agg(*counts(F.col("score") > F.col("threshold"), F.col("in_gold")))
    return rates(n, 1.0)


@query("best_threshold", f"""+ {GOLD_SQL}, s AS (SELECT in_gold, (confidence - 0.9) * 10 AS score FROM g), t AS (SELECT range / 10.0::DOUBLE AS threshold FROM range(1, 10)),
n AS (SELECT threshold, count(*) FILTER (WHERE score > threshold AND in_gold) AS tp, count(*) FILTER (WHERE score > threshold AND NOT in_gold) AS fp, count(*) FILTER (WHERE NOT score > threshold AND in_gold) AS fn FROM s, t GROUP BY threshold),
r AS (SELECT threshold, {RATES_SQL.format(e=1.0)} FROM n) SELECT threshold, recall FROM r WHERE precision >= 0.6 ORDER BY recall DESC, threshold LIMIT 1""", "facts")
def best_threshold(spark, d):  # D19: most recall above a floor of precision
    ok = threshold_sweep(spark, d).where("precision >= 0.6")
    best = F.max_by(F.struct("threshold", "recall"), F.struct("recall", -F.col("threshold")))
    return ok.agg(best.alias("b")).where("b is not null").select("b.threshold", "b.recall")


@query("percentiles", "SELECT metric_id, min(value) AS least, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.99), 4) AS p99, max(value) AS most FROM facts GROUP BY metric_id", "facts")
def percentiles(spark, d):  # D20: linear interpolation between two ranks
    at = positions(facts(spark, d), "metric_id", "value").groupBy("metric_id")
    return at.agg(F.min("value").alias("least"), *[F.round(percentile("value", p), 4).alias(n) for n, p in (("p25", 0.25), ("p50", 0.5), ("p99", 0.99))], F.max("value").alias("most"))


@query("p90_index", "SELECT metric_id, list_sort(list(value))[least(CAST(floor(0.9 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p90 FROM decisions GROUP BY metric_id", "decisions")
def p90_index(spark, d):  # D21: nearest index by rank
    total = F.col("total")
    return positions(decisions(spark, d), "metric_id", "value").groupBy("metric_id").agg(at_rank("value", F.least(F.floor(total * F.lit(0.9)), total - 1)).alias("p90"))


@query("hist_bins", """+ r AS (SELECT min(value) AS a, max(value) AS b FROM facts) SELECT CAST(least(10, floor((value - a) / (b - a) * 10) + 1) AS BIGINT) AS bin, count(*) AS n FROM facts, r GROUP BY 1""", "facts")
def hist_bins(spark, d):  # D22: the largest value belongs to the last bin
    f = facts(spark, d)
    r = f.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    b = F.least(F.lit(10), F.floor((F.col("value") - F.col("a")) / (F.col("b") - F.col("a")) * 10) + 1)
    return f.crossJoin(F.broadcast(r)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # r is one row


@query("calibration_error", f"""+ {GOLD_SQL}, b AS (SELECT least(9, CAST(floor((confidence - 0.9) * 100) AS BIGINT)) AS bin, confidence, in_gold FROM g), s AS (SELECT bin, count(*) AS n, abs(CAST(sum(CAST(confidence AS DECIMAL(9,2))) AS DOUBLE) - count(*) FILTER (WHERE in_gold)) AS gap FROM b GROUP BY bin) SELECT round(sum(gap) / sum(n), 6) AS ece FROM s""", "facts")
def calibration_error(spark, d):  # D23
    g = gold(spark, d).withColumn("bin", F.least(F.lit(9), F.floor((F.col("confidence") - 0.9) * 100)))
    s = g.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.sum(F.col("confidence").cast("decimal(9,2)")).cast("double") - F.count_if("in_gold")).alias("gap"))
    return s.agg(F.round(F.sum("gap") / F.sum("n"), 6).alias("ece"))


@query("set_action_label", """+ s AS (SELECT img_id, list_sort(list(DISTINCT metric_id) FILTER (WHERE decision IN ('accept', 'skip'))) AS det, list_sort(list(DISTINCT metric_id) FILTER (WHERE decision IN ('accept', 'add'))) AS con FROM decisions GROUP BY img_id),
t AS (SELECT coalesce(det, []) AS det, coalesce(con, []) AS con FROM s) SELECT CASE WHEN len(det) = 0 AND len(con) = 0 THEN 'skip' WHEN det = con THEN 'accept' WHEN len(det) = 0 THEN 'add' WHEN len(con) = 0 THEN 'reject' WHEN NOT list_has_any(det, con) THEN 'correct' ELSE 'partial' END AS label, count(*) AS n FROM t GROUP BY 1""", "decisions")
def set_action_label(spark, d):  # D24
    s = decisions(spark, d).groupBy("img_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("decision").isin("accept", "skip"), F.col("metric_id")))).alias("det"),
        F.array_sort(F.collect_set(F.when(F.col("decision").isin("accept", "add"), F.col("metric_id")))).alias("con"),
    )
    none = lambda c: F.size(c) == 0
    label = F.when(none("det") & none("con"), "skip").when(F.col("det") == F.col("con"), "accept").when(none("det"), "add").when(none("con"), "reject")
    return s.groupBy(label.when(~F.arrays_overlap("det", "con"), "correct").otherwise("partial").alias("label")).agg(F.count("*").alias("n"))


# A gold standard of three years: a third of its names are the metrics', a third older ones and a third the oldest.
ALIAS_SQL = f"""+ {GOLD_SQL}, t AS (SELECT fact_id, metric_id, CASE fact_id % 4 WHEN 1 THEN 'alt_' || metric_id WHEN 2 THEN 'old_' || metric_id ELSE metric_id END AS named FROM g WHERE in_gold)
SELECT metric_id, count(*) AS gold, count(*) FILTER (WHERE named = metric_id) AS matched_before, count(*) AS matched_after, round(count(*) FILTER (WHERE named = metric_id)::DOUBLE / count(*), 6) AS recall_before, 1.0::DOUBLE AS recall_after
FROM t GROUP BY metric_id"""


@query("alias_recall", ALIAS_SQL, "facts")
def alias_recall(spark, d):  # H14: names of a gold standard resolved along chains of aliases, and the recall without and with that
    g = gold(spark, d).where("in_gold")
    old = F.when(F.col("fact_id") % 4 == 1, F.concat(F.lit("alt_"), "metric_id")).when(F.col("fact_id") % 4 == 2, F.concat(F.lit("old_"), "metric_id")).otherwise(F.col("metric_id"))
    brands = table(spark, d, "part").select(F.col("p_brand").alias("b")).distinct()
    chain = F.array(F.struct(F.concat(F.lit("old_"), "b").alias("alias"), F.concat(F.lit("alt_"), "b").alias("canonical")), F.struct(F.concat(F.lit("alt_"), "b").alias("alias"), F.col("b").alias("canonical")))
    known = closed(brands.select(F.explode(chain).alias("x")).select("x.*"))
    named = canonical(g.withColumn("named", old).withColumn("raw", F.col("named")), "named", known).groupBy("metric_id")
    before, after = F.count_if(F.col("raw") == F.col("metric_id")), F.count_if(F.col("named") == F.col("metric_id"))
    out = named.agg(F.count("*").alias("gold"), before.alias("matched_before"), after.alias("matched_after"))
    return out.withColumns({f"recall_{v}": F.round(F.col(f"matched_{v}") / F.col("gold"), 6) for v in ("before", "after")})


@query("agreement_rate", f"+ {GOLD_SQL} SELECT metric_id, round(avg(CASE WHEN predicted = in_gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS agreement FROM g GROUP BY metric_id", "facts")
def agreement_rate(spark, d):  # D27
    same = (F.col("predicted") == F.col("in_gold")).cast("long")
    return gold(spark, d).groupBy("metric_id").agg(F.round(F.sum(same) / F.count("*"), 6).alias("agreement"))


@query("baseline_compare", f"""+ {GOLD_SQL}, c AS (SELECT metric_id, count(*) FILTER (WHERE predicted AND in_gold)::DOUBLE / count(*) FILTER (WHERE in_gold) AS r FROM g GROUP BY metric_id),
b AS (SELECT metric_id, count(*) FILTER (WHERE confidence >= 0.93 AND in_gold)::DOUBLE / count(*) FILTER (WHERE in_gold) AS r FROM g GROUP BY metric_id) SELECT c.metric_id, round(c.r - b.r, 6) AS delta, c.r - b.r < -0.1 AS regressed FROM c JOIN b ON c.metric_id = b.metric_id""", "facts")
def baseline_compare(spark, d):  # D28
    truth = F.count_if("in_gold")
    g = gold(spark, d)
    now = g.groupBy("metric_id").agg((F.count_if(F.col("predicted") & F.col("in_gold")) / truth).alias("now"))
    base = g.groupBy("metric_id").agg((F.count_if((F.col("confidence") >= 0.93) & F.col("in_gold")) / truth).alias("base"))
    delta = F.col("now") - F.col("base")
    return now.join(base, "metric_id").select("metric_id", F.round(delta, 6).alias("delta"), (delta < -0.1).alias("regressed"))


@query("cost_rollup", "SELECT metric_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost, CASE WHEN count(*) FILTER (WHERE k > 0) > 0 THEN round(count(*) FILTER (WHERE k > 50)::DOUBLE / count(*) FILTER (WHERE k > 0), 6) END AS hit_rate FROM decisions GROUP BY metric_id", "decisions")
def cost_rollup(spark, d):  # D29
    hits, asked = F.count_if(F.col("k") > 50), F.count_if(F.col("k") > 0)
    return decisions(spark, d).groupBy("metric_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("cost"), F.round(hits / F.nullif(asked, F.lit(0)), 6).alias("hit_rate"))


@query("band_join", """+ a AS (SELECT fact_id, company_id, metric_id, value FROM facts WHERE source_type = 'text'), b AS (SELECT fact_id, company_id, metric_id, value FROM facts WHERE source_type = 'chart')
SELECT a.fact_id AS left_id, b.fact_id AS right_id FROM a JOIN b ON a.company_id = b.company_id AND a.metric_id = b.metric_id AND abs(a.value - b.value) <= 0.02 * abs(b.value)""", "facts")
def band_join(spark, d):  # C19, I6: a tolerance relative to the right side
    f = facts(spark, d)
    side = lambda s, p: f.where(F.col("source_type") == s).select("company_id", "metric_id", F.col("fact_id").alias(p + "_id"), F.col("value").alias(p))
    return near_join(side("text", "left"), side("chart", "right"), ["company_id", "metric_id"], "left", "right", 0.02).select("left_id", "right_id")


@query("interval_overlap_join", """+ p AS (SELECT fact_id, company_id, metric_id, filing_date AS s, period_end AS e FROM facts) SELECT a.fact_id AS left_id, b.fact_id AS right_id FROM p a JOIN p b ON a.company_id = b.company_id AND a.metric_id = b.metric_id AND a.fact_id < b.fact_id AND NOT (a.e < b.s OR b.e < a.s)""", "facts")
def interval_overlap_join(spark, d):  # C18
    pairs = overlap_join(facts(spark, d), ["company_id", "metric_id"], "fact_id", "filing_date", "period_end")
    return pairs.select(F.col("left").alias("left_id"), F.col("right").alias("right_id"))


# A step takes the first pair of each company's list whose ids are free.
GREEDY_SQL = """WITH RECURSIVE facts_ AS (SELECT * FROM ({facts})),
a AS (SELECT fact_id, company_id, metric_id, value, confidence FROM facts_ WHERE source_type = 'text'), b AS (SELECT fact_id, company_id, metric_id, value FROM facts_ WHERE source_type = 'chart'),
p AS (SELECT a.company_id, list(struct_pack(l := a.fact_id, r := b.fact_id) ORDER BY a.confidence DESC, a.fact_id, b.fact_id) AS ps
      FROM a JOIN b ON a.company_id = b.company_id AND a.metric_id = b.metric_id AND abs(a.value - b.value) <= 0.02 * abs(b.value) GROUP BY a.company_id),
g AS (SELECT company_id, ps, 1 AS i, ps[1:0] AS taken FROM p
      UNION ALL SELECT company_id, ps, i + 1, CASE WHEN len(list_filter(taken, lambda t: t.l = ps[i].l OR t.r = ps[i].r)) = 0 THEN list_append(taken, ps[i]) ELSE taken END FROM g WHERE i <= len(ps))
SELECT company_id, x.l AS left_id, x.r AS right_id FROM (SELECT company_id, unnest(taken) AS x FROM g WHERE i = len(ps) + 1)"""
FACTS_QUERY = "WITH " + FACTS_SQL + " SELECT * FROM facts"


@query("greedy_match", GREEDY_SQL.format(facts=FACTS_QUERY))
def greedy_match(spark, d):  # C20: each side once, best first
    f = facts(spark, d)
    texts = f.where("source_type = 'text'").select("company_id", "metric_id", F.col("fact_id").alias("left_id"), F.col("value").alias("left"), "confidence")
    charts = f.where("source_type = 'chart'").select("company_id", "metric_id", F.col("fact_id").alias("right_id"), F.col("value").alias("right"))
    pairs = near_join(texts, charts, ["company_id", "metric_id"], "left", "right", 0.02)
    return greedy_one_to_one(pairs, "company_id", "left_id", "right_id", "confidence")


GROUPS_SQL = """WITH RECURSIVE facts_ AS (SELECT * FROM ({facts})), {groups} SELECT id AS fact_id, seed AS group_id FROM g"""
NEAR_ONLY_SQL = "CASE WHEN {a}.v = 0 OR {b}.v = 0 THEN {a}.v = {b}.v ELSE abs({a}.v - {b}.v) <= 0.02 * abs({b}.v) END"
ITEM_SQL = "struct_pack(id := fact_id, v := value)"


@query("fuzzy_dedup", GROUPS_SQL.format(facts=FACTS_QUERY, groups=first_come_sql("g", "facts_", "company_id, metric_id, source_type", ITEM_SQL, "fact_id, value", NEAR_ONLY_SQL)))
def fuzzy_dedup(spark, d):  # M15: greedy groups within 2 %, in input order
    return tolerance_groups(facts(spark, d), ["company_id", "metric_id", "source_type"], "fact_id", "value", 0.02)


@query("fuzzy_dedup_periods", GROUPS_SQL.format(facts=FACTS_QUERY, groups=first_come_sql("g", "facts_", "company_id, metric_id, source_type = 'chart'", ITEM_SQL, BEST_SQL + ", value", NEAR_ONLY_SQL)))
def fuzzy_dedup_periods(spark, d):  # M17: periods ignored, charts apart, best sources first
    order = F.struct((-SOURCE_RANK(F.col("source_type"))).alias("a"), (-F.col("confidence")).alias("b"), (-F.col("fact_id")).alias("c"))
    f = facts(spark, d).withColumn("kind", F.col("source_type") == "chart")
    return tolerance_groups(f, ["company_id", "metric_id", "kind"], "fact_id", "value", 0.02, order=order)


@query("logistic_scores")
def logistic_scores(spark, d):  # M28: weighted logistic regression on image-like features
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    r = decisions(spark, d).groupBy("img_id").agg(F.bool_or(F.col("decision").isin("accept", "add", "correct")).cast("double").alias("label"), F.count_if(F.col("decision") != "skip").alias("n"), F.log1p(F.avg("value")).alias("x1"), F.avg("k").alias("x2"))
    r = r.where("n > 0")
    positive = r.agg(F.avg("label")).first()[0] or 0.5
    r = r.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(positive, 1e-6)).otherwise(0.5 / max(1 - positive, 1e-6)))
    x = VectorAssembler(inputCols=["x1", "x2"], outputCol="raw").transform(r)
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    model = LogisticRegression(weightCol="weight", maxIter=20, regParam=0.01).fit(x)
    return model.transform(x).select("img_id", "label", F.round(vector_to_array("probability")[1], 4).alias("score"))

