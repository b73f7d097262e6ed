"""Predicates, joins, aggregates, windows, ordering and set operations over the role tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import validation as V
from ..operators.filters import any_of, is_not_true, none_of_or_null, optional, rule
from ..operators.ranking import dense_total, latest, page, top_per_group
from .base import also, decisions, facts, pct, pct_sql, query, table

AS_OF = "2024-01-20"


@query("scan_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000")
def scan_parameters(spark, d):  # A1, A2
    table(spark, d, "orders").createOrReplaceTempView("orders_scan")
    return spark.sql(
        "SELECT o_orderkey, o_totalprice FROM orders_scan WHERE array_contains(:forms, o_orderpriority) AND o_totalprice > :least",
        args={"forms": F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), "least": 100000},
    )


@query("named_fragments", """SELECT 'ipo' AS tab, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'earnings', count(*) FROM orders WHERE o_orderpriority = '3-MEDIUM'
UNION ALL SELECT 'investor_day', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def named_fragments(spark, d):  # A3
    p = F.col("o_orderpriority")
    tabs = {"ipo": p.isin("1-URGENT", "2-HIGH"), "earnings": p == "3-MEDIUM", "investor_day": ~p.isin("1-URGENT", "2-HIGH", "3-MEDIUM")}
    counts = table(spark, d, "orders").agg(*[F.count_if(c).alias(k) for k, c in tabs.items()])
    return counts.select(F.expr("stack(3, " + ", ".join(f"'{k}', {k}" for k in tabs) + ") AS (tab, n)"))


@query("buckets", """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN n >= 5 THEN '5+' ELSE CAST(n AS VARCHAR) END AS bucket
FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey)) GROUP BY bucket""")
def buckets(spark, d):  # B2, C2, C3
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderpriority") == "1-URGENT")
    n = c.join(o, on, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return n.groupBy(F.when(F.col("n") >= 5, "5+").otherwise(F.col("n").cast("string")).alias("bucket")).agg(F.count("*").alias("n"))


@query("detection_tiers", """SELECT tier_name, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN p_type IN (SELECT min(p_type) FROM part) AND p_size >= 25 THEN 'chart'
 WHEN p_retailprice >= 1500 THEN 'high' WHEN p_size <= 5 THEN 'presence_seed' ELSE 'low' END AS tier_name FROM part) GROUP BY tier_name""")
def detection_tiers(spark, d):  # B3, B4
    p = table(spark, d, "part")
    first = p.agg(F.min("p_type").alias("first_type"))
    tier = F.when((F.col("p_type") == F.col("first_type")) & (F.col("p_size") >= 25), "chart").when(F.col("p_retailprice") >= 1500, "high").when(F.col("p_size") <= 5, "presence_seed").otherwise("low")
    return p.crossJoin(F.broadcast(first)).groupBy(tier.alias("tier_name")).agg(F.count("*").alias("n"))  # one row


@query("three_valued_filters", """SELECT CAST(sum(CASE WHEN f IS NOT TRUE THEN 1 ELSE 0 END) AS BIGINT) AS not_true, CAST(sum(CASE WHEN coalesce(f, TRUE) THEN 1 ELSE 0 END) AS BIGINT) AS true_by_default,
 CAST(sum(CASE WHEN s <> ALL(['BUILDING', 'MACHINERY']) OR s IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS other FROM (SELECT CASE WHEN c_acctbal > 5000 THEN TRUE WHEN c_acctbal < 0 THEN NULL ELSE FALSE END AS f, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer)""")
def three_valued_filters(spark, d):  # B5, B6, B7
    c = table(spark, d, "customer").select(
        F.when(F.col("c_acctbal") > 5000, True).when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(False).alias("f"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("s"),
    )
    return c.agg(F.count_if(is_not_true("f")).alias("not_true"), F.count_if(F.coalesce("f", F.lit(True))).alias("true_by_default"), F.count_if(none_of_or_null("s", ["BUILDING", "MACHINERY"])).alias("other"))


@query("optional_filters", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderpriority IN ('1-URGENT') AND o_orderdate >= DATE '1997-01-01' AND o_orderstatus <> 'P'")
def optional_filters(spark, d):  # B8, B9: gates that hold only if asked for
    def listing(forms=None, since=None, until=None, status=None):
        gate = F.col("o_orderstatus") != "P" if forms and "1-URGENT" in forms else None
        return optional(forms and F.col("o_orderpriority").isin(forms), since and F.col("o_orderdate") >= F.lit(since).cast("date"), until and F.col("o_orderdate") < F.lit(until), status and F.col("o_orderstatus") == status, gate)

    return table(spark, d, "orders").where(listing(forms=["1-URGENT"], since="1997-01-01")).select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("rolling_window", f"+ t AS (SELECT * FROM decisions WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{AS_OF}') SELECT metric_id, count(*) AS n, CAST(max(decision_id) AS BIGINT) AS newest FROM t WHERE decision = 'correct' GROUP BY metric_id ORDER BY n DESC, newest DESC LIMIT 5", "decisions")
def rolling_window(spark, d):  # B10, D14: as of a day that is a parameter
    at = F.lit(AS_OF).cast("timestamp_ntz")
    recent = decisions(spark, d).where((F.col("ts") >= at - F.expr("interval 7 days")) & (F.col("ts") < at) & (F.col("decision") == "correct"))
    return recent.groupBy("metric_id").agg(F.count("*").alias("n"), F.max("decision_id").alias("newest")).orderBy(F.desc("n"), F.desc("newest")).limit(5)


@query("substring_filters", "SELECT p_partkey FROM part WHERE p_name ILIKE '%a%' AND p_brand LIKE 'Brand#1%'")
def substring_filters(spark, d):  # B11
    return table(spark, d, "part").where(F.col("p_name").ilike("%a%") & F.col("p_brand").startswith("Brand#1")).select("p_partkey")


@query("json_paths", """SELECT event_type, CAST(sum(CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS with_k, CAST(sum(CASE WHEN json_extract_string(props, '$.zz') IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS with_zz,
 CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY event_type""")
def json_paths(spark, d):  # B12, J4, J5
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(k.isNotNull()).alias("with_k"), F.count_if(F.get_json_object("props", "$.zz").isNotNull()).alias("with_zz"), F.sum(k.cast("long")).alias("sum_k"))


@query("reviewer_overlap", "+ r AS (SELECT metric_id, list_sort(list(DISTINCT reviewer)) AS who FROM decisions GROUP BY metric_id) SELECT metric_id, CAST(len(who) AS BIGINT) AS n, list_has_any(who, [1, 2, 3]) AS overlaps FROM r", "decisions")
def reviewer_overlap(spark, d):  # B13, D8, J1, J2
    who = decisions(spark, d).groupBy("metric_id").agg(F.array_sort(F.collect_set("reviewer")).alias("who"))
    return who.select("metric_id", F.coalesce(F.size("who"), F.lit(0)).cast("long").alias("n"), F.arrays_overlap("who", F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]).cast(who.schema["who"].dataType)).alias("overlaps"))


@query("distinct_from", "SELECT a.o_orderkey FROM orders a LEFT JOIN orders b ON a.o_orderkey = b.o_orderkey + 1 WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
def distinct_from(spark, d):  # B14
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    before = o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("o_orderstatus").alias("old"))
    return o.join(before, "o_orderkey", "left").where(~F.col("o_orderstatus").eqNullSafe(F.col("old"))).select("o_orderkey")


@query("suppression_tags", """+ t AS (SELECT fact_id, list_filter([CASE WHEN confidence < 0.92 THEN 'low_confidence' END, CASE WHEN value > 90000 THEN 'outlier' END, CASE WHEN source_type = 'chart' AND quantity < 5 THEN 'thin_chart' END], lambda x: x IS NOT NULL) AS tags FROM facts)
SELECT fact_id, array_to_string(tags, '|') AS tags FROM t WHERE len(tags) > 0""", "facts")
def suppression_tags(spark, d):  # B15
    tags = any_of({"low_confidence": F.col("confidence") < 0.92, "outlier": F.col("value") > 90000, "thin_chart": (F.col("source_type") == "chart") & (F.col("quantity") < 5)})
    return facts(spark, d).withColumn("tags", tags).where(F.size("tags") > 0).select("fact_id", F.array_join("tags", "|").alias("tags"))


@query("reviewer_listing", """+ o AS (SELECT DISTINCT img_id FROM decisions WHERE decision = 'correct' AND k >= 90) SELECT decision_id, metric_id, img_id FROM decisions t
WHERE decision = 'reject' AND metric_id IN ('m1', 'm2') AND EXISTS (SELECT 1 FROM decisions a WHERE a.img_id = t.img_id AND a.decision = 'accept') AND NOT EXISTS (SELECT 1 FROM o WHERE o.img_id = t.img_id)""", "decisions")
def reviewer_listing(spark, d):  # B16, C7, C9
    all_ = decisions(spark, d)
    kept = all_.where((F.col("decision") == "reject") & F.col("metric_id").isin("m1", "m2"))
    kept = kept.join(all_.where("decision = 'accept'").select("img_id").distinct(), "img_id", "left_semi")
    return kept.join(all_.where("decision = 'correct' and k >= 90").select("img_id").distinct(), "img_id", "left_anti").select("decision_id", "metric_id", "img_id")


PATTERN = {"logic": "and", "conditions": [{"field": "confidence", "op": "gte", "value": 0.95}, {"field": "source_type", "op": "in", "value": ["text", "chart"]}, {"field": "metric_id", "op": "contains", "value": "#2"}]}


@query("rule_dsl", "SELECT fact_id FROM facts WHERE confidence >= 0.95 AND source_type IN ('text', 'chart') AND contains(metric_id, '#2')", "facts")
def rule_dsl(spark, d):  # B17
    return facts(spark, d).where(rule(PATTERN)).select("fact_id")


@query("validators", """SELECT CAST(sum(CASE WHEN regexp_matches(lpad(CAST(c_custkey AS VARCHAR), 10, '0'), '^[0-9]{10}$') THEN 1 ELSE 0 END) AS BIGINT) AS good_cik,
 CAST(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 1 ELSE 0 END) AS BIGINT) AS known, CAST(sum(CASE WHEN c_acctbal BETWEEN 0 AND 1000 THEN 1 ELSE 0 END) AS BIGINT) AS in_range FROM customer""")
def validators(spark, d):  # B18, B19
    c = table(spark, d, "customer")
    return c.agg(
        F.count_if(F.lpad(F.col("c_custkey").cast("string"), 10, "0").rlike("^[0-9]{10}$")).alias("good_cik"),
        F.count_if(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")).alias("known"),
        F.count_if(F.col("c_acctbal").between(0, 1000)).alias("in_range"),
    )


@query("input_validators", """WITH r AS (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_orderkey WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '00000000000' WHEN 2 THEN '../' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS cik,
         'transcript:' || lpad(CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE 10 END, '0') || '-24-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '/a' AS acc,
         CAST(o_orderkey % 12000 AS VARCHAR) AS sic, '2023-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS day, o_orderstatus, o_totalprice / 200000 AS score FROM orders
) SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS cik, CASE WHEN o_orderkey % 3 <> 0 THEN substr(acc, 12, 20) END AS accession,
  CASE WHEN o_orderkey % 12000 BETWEEN 100 AND 9999 THEN lpad(sic, 4, '0') END AS sic, CAST(TRY_CAST(day AS DATE) AS VARCHAR) AS day, coalesce(TRY_CAST(day AS DATE) <= DATE '2023-06-30', FALSE) AS in_order,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS status, score IS NULL OR score BETWEEN 0 AND 1 AS good_score FROM r""")
def input_validators(spark, d):  # B18: every validator, on keys that are made right and wrong in turn
    key, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    turn = key % 4
    raw = F.when(turn == 0, F.concat(F.lit(" "), text("o_orderkey"))).when(turn == 1, F.concat(text("o_orderkey"), F.lit("0" * 11))).when(turn == 2, F.concat(F.lit("../"), text("o_orderkey"))).otherwise(text("o_orderkey"))
    padded = F.when(key % 3 == 0, F.lpad(text("o_custkey"), 9, "0")).otherwise(F.lpad(text("o_custkey"), 10, "0"))
    acc = F.concat(F.lit("transcript:"), padded, F.lit("-24-"), F.lpad((key % 1_000_000).cast("string"), 6, "0"), F.lit("/a"))
    day = V.date(F.concat(F.lit("2023-"), F.lpad((key % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((key % 33).cast("string"), 2, "0")))
    return table(spark, d, "orders").select(
        "o_orderkey", V.cik(raw).alias("cik"), V.accession_within(acc).alias("accession"), V.sic((key % 12_000).cast("string")).alias("sic"), day.cast("string").alias("day"),
        V.ordered(day, F.lit("2023-06-30").cast("date")).alias("in_order"), V.one_of(F.col("o_orderstatus"), ["F", "O"]).alias("status"), V.score(F.col("o_totalprice") / 200_000).alias("good_score"),
    )


@query("full_outer_presence", """SELECT coalesce(t.c, i.c) AS company_id, coalesce(t.m, i.m) AS metric_id, t.c IS NOT NULL AS in_text, i.c IS NOT NULL AS in_image, coalesce(t.n, 0) AS n_text, coalesce(i.n, 0) AS n_image FROM
 (SELECT company_id AS c, metric_id AS m, count(*) AS n FROM facts WHERE source_type = 'text' GROUP BY ALL) t FULL JOIN (SELECT company_id AS c, metric_id AS m, count(*) AS n FROM facts WHERE source_type = 'chart' GROUP BY ALL) i ON t.c = i.c AND t.m = i.m""", "facts")
def full_outer_presence(spark, d):  # C4
    f = facts(spark, d)
    side = lambda s, n: f.where(F.col("source_type") == s).groupBy("company_id", "metric_id").agg(F.count("*").alias(n))
    both = side("text", "n_text").join(side("chart", "n_image"), ["company_id", "metric_id"], "full")
    return both.select("company_id", "metric_id", F.col("n_text").isNotNull().alias("in_text"), F.col("n_image").isNotNull().alias("in_image"), F.coalesce("n_text", F.lit(0)).alias("n_text"), F.coalesce("n_image", F.lit(0)).alias("n_image"))


@query("cross_single_rows", """+ a AS (SELECT count(*) AS n_all FROM decisions), b AS (SELECT count(DISTINCT img_id) AS n_images FROM decisions WHERE decision <> 'skip') SELECT n_all, n_images FROM a, b""", "decisions")
def cross_single_rows(spark, d):  # C6, D3, D4, D5
    return decisions(spark, d).agg(F.count("*").alias("n_all"), F.count_distinct(F.when(F.col("decision") != "skip", F.col("img_id"))).alias("n_images"))


@query("exists_in_case", """SELECT n_nationkey, count(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) THEN 1 END) AS n_big FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def exists_in_case(spark, d):  # C8: a flag from distinct keys, joined once
    big = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("big")).distinct()
    c = table(spark, d, "customer").join(big, "c_custkey", "left")
    return table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.count("big").alias("n_big"))


@query("anti_orphans", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1998-06-01')")
def anti_orphans(spark, d):  # C9
    late = table(spark, d, "orders").where("o_orderdate >= date '1998-06-01'")
    return table(spark, d, "customer").join(late, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("superseded", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE rn > 1
UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, y ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS y FROM orders WHERE o_orderpriority = '5-LOW') WHERE y IS NOT NULL) WHERE rn > 1""")
def superseded(spark, d):  # C10, D9, M25: by company for some forms; by company and period for others, null periods stay
    o = table(spark, d, "orders")
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    first = latest(o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), ["o_custkey"], newest, others=True)
    yearly = o.where("o_orderpriority = '5-LOW'").withColumn("y", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))).where("y is not null")
    return first.select("o_orderkey").unionAll(latest(yearly, ["o_custkey", "y"], newest, others=True).select("o_orderkey"))


@query("lateral_rollup", "+ r AS (SELECT img_id, count(*) AS n, count(DISTINCT metric_id) FILTER (WHERE decision IN ('accept', 'add')) AS positive, bool_or(decision = 'reject') AS rejected FROM decisions GROUP BY img_id) SELECT i.img_id, coalesce(n, 0) AS n, coalesce(positive, 0) AS positive, rejected FROM (SELECT range AS img_id FROM range(450)) i LEFT JOIN r ON i.img_id = r.img_id", "decisions")
def lateral_rollup(spark, d):  # C11, D5, D7: aggregated before the join
    roll = decisions(spark, d).groupBy("img_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("decision").isin("accept", "add"), F.col("metric_id"))).alias("positive"), F.bool_or(F.col("decision") == "reject").alias("rejected"))
    return spark.range(450).withColumnRenamed("id", "img_id").join(roll, "img_id", "left").select("img_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positive", F.lit(0)).alias("positive"), "rejected")


@query("earliest_reason", "SELECT img_id, arg_min(metric_id, decision_id) AS first_reason FROM decisions WHERE decision = 'reject' GROUP BY img_id", "decisions")
def earliest_reason(spark, d):  # C12
    return decisions(spark, d).where("decision = 'reject'").groupBy("img_id").agg(F.min_by("metric_id", "decision_id").alias("first_reason"))


@query("neighbour_range", "SELECT a.conv_id, a.turn, count(*) AS n_around FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 GROUP BY ALL")
def neighbour_range(spark, d):  # C13, E6: a range frame instead of a self-join
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-2, 2)
    return table(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("n_around")).distinct()


@query("unnest_rows", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, unnest([1, 2]) AS side FROM documents")
def unnest_rows(spark, d):  # C14, J1
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.explode(F.array(F.lit(1), F.lit(2))).alias("side"))


@query("inline_relation", "SELECT v.label, count(c_custkey) AS n FROM (VALUES ('BUILDING', 'Construction'), ('MACHINERY', 'Industry'), ('ABSENT', 'None')) v(seg, label) LEFT JOIN customer ON c_mktsegment = seg GROUP BY v.label")
def inline_relation(spark, d):  # C15
    v = spark.createDataFrame([("BUILDING", "Construction"), ("MACHINERY", "Industry"), ("ABSENT", "None")], "seg string, label string")
    return v.join(table(spark, d, "customer"), F.col("c_mktsegment") == F.col("seg"), "left").groupBy("label").agg(F.count("c_custkey").alias("n"))


@query("status_pivot", """SELECT form_type, count(*) AS n, count(*) FILTER (WHERE review_status = 'accepted') AS accepted, count(*) FILTER (WHERE review_status = 'pending') AS pending, max(filing_date)::VARCHAR AS newest FROM facts GROUP BY form_type""", "facts")
def status_pivot(spark, d):  # D1, D2
    return facts(spark, d).groupBy("form_type").agg(F.count("*").alias("n"), F.count_if(F.col("review_status") == "accepted").alias("accepted"), F.count_if(F.col("review_status") == "pending").alias("pending"), F.max("filing_date").cast("string").alias("newest"))


@query("distinct_tuples", "SELECT count(DISTINCT (company_id, metric_id)) AS pairs, count(DISTINCT filing_id) AS filings FROM facts", "facts")
def distinct_tuples(spark, d):  # D4, D6, D10
    return facts(spark, d).agg(F.count_distinct(F.struct("company_id", "metric_id")).alias("pairs"), F.count_distinct("filing_id").alias("filings"))


@query("having_groups", "SELECT img_id FROM decisions GROUP BY img_id HAVING bool_or(decision = 'accept') AND count(DISTINCT decision) = 4", "decisions")
def having_groups(spark, d):  # D11
    g = decisions(spark, d).groupBy("img_id").agg(F.bool_or(F.col("decision") == "accept").alias("a"), F.count_distinct("decision").alias("n"))
    return g.where("a and n = 4").select("img_id")


@query("mode_by_group", """SELECT metric_id, decision AS mode FROM (SELECT metric_id, decision, row_number() OVER (PARTITION BY metric_id ORDER BY count(*) DESC, decision) AS rn FROM decisions GROUP BY metric_id, decision) WHERE rn = 1""", "decisions")
def mode_by_group(spark, d):  # D12: ties by name
    n = decisions(spark, d).groupBy("metric_id", "decision").agg(F.count("*").alias("n"))
    return latest(n, ["metric_id"], [F.desc("n"), "decision"]).select("metric_id", F.col("decision").alias("mode"))


@query("guarded_percent", f"SELECT reviewer, count(*) AS n, {pct_sql('count(*) FILTER (WHERE decision IN (\'accept\', \'add\'))', 'count(*) FILTER (WHERE decision <> \'skip\')')} AS precision_pct FROM decisions GROUP BY reviewer", "decisions")
def guarded_percent(spark, d):  # D13
    good, all_ = F.count_if(F.col("decision").isin("accept", "add")), F.count_if(F.col("decision") != "skip")
    return decisions(spark, d).groupBy("reviewer").agg(F.count("*").alias("n"), pct(good, all_).alias("precision_pct"))


@query("next_after", """SELECT nxt FROM (SELECT o_orderkey, lead(o_orderkey) OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS nxt FROM orders WHERE o_orderstatus = 'P') WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')""")
def next_after(spark, d):  # E1, F3: the row after the current one, by comparison instead of a global window
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    now = o.orderBy("o_orderkey").limit(1).select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    later = o.crossJoin(F.broadcast(now)).where("o_totalprice < p or (o_totalprice = p and o_orderkey > k)")  # now is one row
    return later.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(1).select(F.col("o_orderkey").alias("nxt"))


@query("next_image", """+ a AS (SELECT filing_id, fact_id AS img_id, metric_id AS filename, CAST(round(confidence * 100) AS INT) AS relevance, value, review_status, period_end FROM facts WHERE source_type = 'chart' AND quantity >= 5
      QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY value DESC, metric_id, confidence DESC, review_status, period_end) = 1),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filing_id, filename ORDER BY review_status = 'accepted' DESC, period_end DESC NULLS LAST, img_id) AS rn FROM a) WHERE rn = 1),
p AS (SELECT c.filing_id, c.img_id, n.img_id AS next_id, row_number() OVER (PARTITION BY c.img_id ORDER BY n.relevance DESC, n.value DESC, n.img_id) AS rn
      FROM v c JOIN v n ON n.filing_id = c.filing_id AND n.review_status = 'pending' AND (n.relevance < c.relevance OR n.relevance = c.relevance AND n.img_id > c.img_id))
SELECT filing_id, img_id, next_id FROM p WHERE rn = 1""", "facts")
def next_image(spark, d):  # within a filing, the pending image after each one; without pairs
    a = facts(spark, d).where("source_type = 'chart' and quantity >= 5")
    a = a.select("filing_id", F.col("fact_id").alias("img_id"), F.col("metric_id").alias("filename"), F.round(F.col("confidence") * 100).cast("int").alias("relevance"), "value", "review_status", "period_end")
    a = latest(a, ["img_id"], [F.desc("value"), "filename", F.desc("relevance"), "review_status", "period_end"])  # order and line number repeat in the tables
    v = latest(a, ["filing_id", "filename"], [F.desc(F.col("review_status") == "accepted"), F.desc_nulls_last("period_end"), "img_id"])  # an image shown twice counts once
    shown = F.when(F.col("review_status") == "pending", F.struct("relevance", "value", (-F.col("img_id")).alias("turn")))
    equal = Window.partitionBy("filing_id", "relevance").orderBy("img_id").rowsBetween(1, Window.unboundedFollowing)
    below = Window.partitionBy("filing_id").orderBy(F.desc("relevance")).rangeBetween(1, Window.unboundedFollowing)
    after = F.coalesce(F.max(shown).over(equal), F.max(shown).over(below))
    return v.select("filing_id", "img_id", (-after["turn"]).alias("next_id")).where("next_id is not null")


@query("share_of_total", f"SELECT decision, count(*) AS n, {pct_sql('count(*)', 'sum(count(*)) OVER ()')} AS share FROM decisions GROUP BY decision", "decisions")
def share_of_total(spark, d):  # E2
    n = decisions(spark, d).groupBy("decision").agg(F.count("*").alias("n"))
    return n.select("decision", "n", pct(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


@query("share_in_group", f"SELECT metric_id, decision, count(*) AS n, {pct_sql('count(*)', 'sum(count(*)) OVER (PARTITION BY metric_id)')} AS share FROM decisions GROUP BY metric_id, decision", "decisions")
def share_in_group(spark, d):  # E3
    n = decisions(spark, d).groupBy("metric_id", "decision").agg(F.count("*").alias("n"))
    return n.select("metric_id", "decision", "n", pct(F.col("n"), F.sum("n").over(Window.partitionBy("metric_id"))).alias("share"))


@query("top_per_bucket", """SELECT metric_id, reviewer, n FROM (SELECT metric_id, reviewer, count(*) AS n, row_number() OVER (PARTITION BY metric_id ORDER BY count(*) DESC, reviewer) AS rn FROM decisions GROUP BY metric_id, reviewer HAVING count(*) >= 2) WHERE rn <= 3""", "decisions")
def top_per_bucket(spark, d):  # E4
    n = decisions(spark, d).groupBy("metric_id", "reviewer").agg(F.count("*").alias("n")).where("n >= 2")
    return top_per_group(n, ["metric_id"], [F.desc("n"), "reviewer"], 3).select("metric_id", "reviewer", "n")


@query("paged_list", """SELECT c_custkey, c_name, n_orders FROM (SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) ORDER BY n_orders DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 40""")
def paged_list(spark, d):  # F1, F2; the page is the feature
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    rows = table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))
    return page(rows, {"orders": "n_orders", "name": "c_name"}, "orders", "c_custkey", 20, 40)


@query("list_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000")
def list_total(spark, d):  # F4
    return dense_total(table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 50000"))


@query("ordinal_sort", """SELECT event_type, CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 99 END AS BIGINT) AS rank, count(*) AS n FROM events GROUP BY event_type ORDER BY rank, event_type""")
def ordinal_sort(spark, d):  # F5, F6
    order = F.array(*map(F.lit, ["purchase", "signup", "click"]))
    place = F.array_position(order, F.col("event_type"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("rank", F.when(place > 0, place).otherwise(99).cast("long")).orderBy("rank", "event_type")


@query("union_streams", "SELECT metric_id, count(*) AS n FROM (SELECT metric_id FROM decisions WHERE decision = 'accept' UNION ALL SELECT metric_id FROM decisions WHERE decision = 'add') GROUP BY metric_id", "decisions")
def union_streams(spark, d):  # G1
    t = decisions(spark, d)
    return t.where("decision = 'accept'").unionByName(t.where("decision = 'add'")).groupBy("metric_id").agg(F.count("*").alias("n"))


@query("distinct_union", "SELECT reviewer FROM decisions WHERE decision = 'accept' UNION SELECT reviewer FROM decisions WHERE decision = 'reject'", "decisions")
def distinct_union(spark, d):  # G2
    t = decisions(spark, d).select("reviewer", "decision")
    return t.where("decision = 'accept'").select("reviewer").union(t.where("decision = 'reject'").select("reviewer")).distinct()


@query("universe_gaps_all", """SELECT y AS year, p AS form FROM range(1992, 2003) r(y), (SELECT DISTINCT o_orderpriority AS p FROM orders) EXCEPT SELECT year(o_orderdate), o_orderpriority FROM orders""")
def universe_gaps_all(spark, d):  # G3, G4: less those of all orders
    present = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("form")).distinct()
    grid = present.select("form").distinct().select(F.explode(F.sequence(F.lit(1992).cast("long"), F.lit(2002).cast("long"))).alias("year"), "form")
    return grid.join(present, ["year", "form"], "left_anti")


also("universe_gaps", "universe_gaps_all")


@query("facet_industry", """SELECT n_name AS industry, count(o_orderkey) AS filings FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY n_name""")
def facet_industry(spark, d):  # C3: predicates in the join keep empty groups
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    c = table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("industry")).agg(F.count("o_orderkey").alias("filings"))


@query("facet_year", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS filings FROM orders GROUP BY 1")
def facet_year(spark, d):  # I10
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("filings"))


@query("facet_other", "SELECT count(*) AS filings FROM orders WHERE CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END NOT IN ('1-URGENT', '2-HIGH') OR o_orderkey % 9 = 0")
def facet_other(spark, d):  # B7
    o = table(spark, d, "orders").withColumn("form", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")))
    return o.where(none_of_or_null("form", ["1-URGENT", "2-HIGH"])).agg(F.count("*").alias("filings"))


@query("relational_division", "SELECT reviewer FROM decisions WHERE metric_id IN ('m1', 'm2', 'm3') GROUP BY reviewer HAVING count(DISTINCT metric_id) = 3", "decisions")
def relational_division(spark, d):  # D11
    n = decisions(spark, d).where(F.col("metric_id").isin("m1", "m2", "m3")).groupBy("reviewer").agg(F.count_distinct("metric_id").alias("n"))
    return n.where("n = 3").select("reviewer")


@query("sample_by_hash", "SELECT o_orderkey FROM orders ORDER BY md5('audit' || CAST(o_orderkey AS VARCHAR)) LIMIT 25")
def sample_by_hash(spark, d):  # A18; sampling is the feature
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.md5(F.concat(F.lit("audit"), F.col("o_orderkey").cast("string")))).limit(25)


def _merge(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = o.where("o_orderkey % 3 <> 0")
    new = o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N"))
    return old, new


@query("upsert_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def upsert_merge(spark, d):  # A13
    from ..operators.sinks import upsert

    old, new = _merge(spark, d)
    return upsert(old, new, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("insert_ignore", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def insert_ignore(spark, d):  # A14
    from ..operators.sinks import insert_missing

    old, new = _merge(spark, d)
    return insert_missing(old, new, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("scoped_replace", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE (o_orderkey % 3 <> 0 AND o_orderstatus <> 'O') OR (o_orderstatus = 'O' AND o_orderkey % 2 = 0)")
def scoped_replace(spark, d):  # A15: rows of a scope are replaced as a whole
    from ..operators.sinks import replace_scope

    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderstatus = 'O' and o_orderkey % 2 = 0")
    return replace_scope(o.where("o_orderkey % 3 <> 0"), new, ["o_orderstatus"]).select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "N").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))

