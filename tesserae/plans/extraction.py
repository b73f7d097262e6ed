"""From numbers to routed facts: parsing, units, false-positive rules, confidences, dedup, presence, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..functions.issuers import industry
from ..operators.filters import any_of
from ..operators.ranking import latest
from .base import also, facts, mapped, query, table

def _values(rows, names):
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names})"


@query("scaled_cells", """SELECT l_orderkey, l_linenumber, l_quantity * CASE WHEN l_linenumber = 3 THEN 1.0 WHEN l_orderkey % 5 = 1 THEN 1e3 WHEN l_orderkey % 5 = 2 AND l_returnflag <> 'R' THEN 1e6 WHEN l_orderkey % 5 = 3 THEN 1e9 ELSE 1.0 END AS value FROM lineitem""")
def scaled_cells(spark, d):  # I5: every line as a cell below its order's note
    note = F.get(F.array(*map(F.lit, ["Results", "Results (in thousands)", "(Amounts in millions, except as otherwise noted)", "(In billions, unaudited)", "(actual)"])), (F.col("l_orderkey") % 5).cast("int"))
    stub = F.when(F.col("l_linenumber") == 3, "Orders (Actual)").otherwise("Orders")
    raw = F.concat(F.when(F.col("l_returnflag") == "R", "$").otherwise(""), F.col("l_quantity").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * N.cell_scale(note, stub, raw)).alias("value"))


ALLOWED = [("Brand#11", "html_table"), ("Brand#11", "text"), ("Brand#12", "chart"), ("Brand#13", "text")]


@query("unit_filter", """+ a AS (SELECT * FROM (VALUES ('Brand#11', 'html_table'), ('Brand#11', 'text'), ('Brand#12', 'chart'), ('Brand#13', 'text')) v(m, u)) SELECT metric_id, count(*) AS kept FROM facts f WHERE NOT EXISTS (SELECT 1 FROM a WHERE m = metric_id) OR EXISTS (SELECT 1 FROM a WHERE m = metric_id AND u = source_type) GROUP BY metric_id""", "facts")
def unit_filter(spark, d):  # I8: metrics without an entry accept all units; the table of units is fixed
    a = spark.createDataFrame(ALLOWED, "metric_id string, source_type string")
    allowed = F.broadcast(a.groupBy("metric_id").agg(F.collect_set("source_type").alias("units")))
    f = facts(spark, d).join(allowed, "metric_id", "left").where(F.col("units").isNull() | F.expr("array_contains(units, source_type)"))
    return f.groupBy("metric_id").agg(F.count("*").alias("kept"))


def clamp(c):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def SOURCE_RANK(c):
    """Tables before text before charts."""
    return F.when(c == "html_table", 4).when(c == "text", 3).when(c == "ocr_table", 2).when(c == "chart", 1).otherwise(0)


@query("binding_confidence", """SELECT fact_id, round(least(1.0, greatest(0.0, CASE WHEN source_type = 'html_table' THEN 0.6 + CASE WHEN quantity >= 40 THEN 0.2 ELSE 0 END + CASE WHEN confidence >= 0.95 THEN 0.1 ELSE 0 END
 ELSE 0.4 + CASE WHEN confidence >= 0.95 THEN 0.1 ELSE 0 END + CASE WHEN quantity < 10 THEN 0.1 ELSE 0 END - CASE WHEN source_type = 'chart' THEN 0.1 ELSE 0 END END)), 4)::DOUBLE AS binding FROM facts""", "facts")
def binding_confidence(spark, d):  # I16, I17
    f = facts(spark, d)
    unit = F.when(F.col("confidence") >= 0.95, 0.1).otherwise(0.0)
    in_table = F.lit(0.6) + F.when(F.col("quantity") >= 40, 0.2).otherwise(0.0) + unit
    in_text = F.lit(0.4) + unit + F.when(F.col("quantity") < 10, 0.1).otherwise(0.0) - F.when(F.col("source_type") == "chart", 0.1).otherwise(0.0)
    return f.select("fact_id", F.round(clamp(F.when(F.col("source_type") == "html_table", in_table).otherwise(in_text)), 4).alias("binding"))


@query("fact_confidence", """SELECT fact_id, round(least(1.0, greatest(0.0, (confidence + CASE WHEN tier LIKE 'E%' THEN 0.1 WHEN tier LIKE 'L%' THEN 0.05 ELSE 0 END - CASE WHEN source_type = 'chart' THEN 0.05 ELSE 0 END) * 0.8 + 0.7 * 0.2 - CASE WHEN quantity > 45 THEN 0.1 ELSE 0 END)), 4)::DOUBLE AS final FROM facts""", "facts")
def fact_confidence(spark, d):  # I18: the ambiguity penalty is the constant 0.10
    section = F.when(F.col("tier").startswith("E"), 0.1).when(F.col("tier").startswith("L"), 0.05).otherwise(0.0)
    source = F.when(F.col("source_type") == "ocr_table", 0.1).when(F.col("source_type") == "chart", 0.05).otherwise(0.0)
    blended = (F.col("confidence") + section - source) * 0.8 + F.lit(0.7) * 0.2 - F.when(F.col("quantity") > 45, 0.1).otherwise(0.0)
    return facts(spark, d).select("fact_id", F.round(clamp(blended), 4).alias("final"))


IMAGE_WORDS = ["retention", "churn", "revenue", "growth", "that", "with"]


@query("image_relevance", """+ n AS (SELECT doc_id, (CASE WHEN contains(lower(text), 'retention') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'churn') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'revenue') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'growth') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'that') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'with') THEN 1 ELSE 0 END) AS hits, source FROM documents)
SELECT doc_id, round(least(1.0, 0.3 + CASE WHEN source = 'src1' THEN 0.2 ELSE 0 END + least(hits, 4) * 0.08), 4)::DOUBLE AS relevance FROM n""".replace("+ n AS", "WITH n AS"))
def image_relevance(spark, d):  # I19, M4: the cap is tested after adding, so four words give 0.32
    low = F.lower("text")
    hits = sum([F.contains(low, F.lit(w)).cast("int") for w in IMAGE_WORDS], F.lit(0))
    score = F.lit(0.3) + F.when(F.col("source") == "src1", 0.2).otherwise(0.0) + F.least(hits, F.lit(4)) * 0.08
    return table(spark, d, "documents").select("doc_id", F.round(F.least(F.lit(1.0), score), 4).alias("relevance"))


@query("routing", """+ r AS (SELECT fact_id, confidence, source_type, list_filter([CASE WHEN source_type = 'chart' THEN 'chart requires verification' END, CASE WHEN quantity > 48 THEN 'quantity out of range' END], lambda x: x IS NOT NULL) AS why FROM facts)
SELECT fact_id, CASE WHEN confidence >= 0.95 AND len(why) = 0 THEN 'auto_accepted' WHEN confidence < 0.91 THEN 'reject_candidate' ELSE 'pending' END AS route, array_to_string(why, '; ') AS reasons FROM r""", "facts")
def routing(spark, d):  # B20, B19, M20
    why = any_of({"chart requires verification": F.col("source_type") == "chart", "quantity out of range": F.col("quantity") > 48})
    f = facts(spark, d).withColumn("why", why)
    route = F.when((F.col("confidence") >= 0.95) & (F.size("why") == 0), "auto_accepted").when(F.col("confidence") < 0.91, "reject_candidate").otherwise("pending")
    return f.select("fact_id", route.alias("route"), F.array_join("why", "; ").alias("reasons"))


RANK_SQL = "CASE source_type WHEN 'html_table' THEN 4 WHEN 'text' THEN 3 ELSE 1 END"


@query("dedup_primary", f"SELECT company_id, metric_id, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id, metric_id ORDER BY {RANK_SQL} DESC, confidence DESC, value DESC, fact_id DESC) AS rn FROM facts) WHERE rn = 1", "facts")
def dedup_primary(spark, d):  # M16: the largest of source, confidence, then content
    order = [F.desc(SOURCE_RANK(F.col("source_type"))), F.desc("confidence"), F.desc("value"), F.desc("fact_id")]
    return latest(facts(spark, d), ["company_id", "metric_id"], order).select("company_id", "metric_id", "fact_id")


@query("collision_collapse", f"+ r AS (SELECT *, row_number() OVER (PARTITION BY company_id, metric_id, source_type ORDER BY confidence DESC, fact_id) AS rn FROM facts) SELECT company_id, metric_id, source_type, min(fact_id) FILTER (WHERE rn = 1) AS primary_id, coalesce(string_agg(CAST(fact_id AS VARCHAR), '|' ORDER BY fact_id) FILTER (WHERE rn > 1), '') AS alternates FROM r GROUP BY ALL", "facts")
def collision_collapse(spark, d):  # M18, J6, J7
    keys = ["company_id", "metric_id", "source_type"]
    r = facts(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "fact_id")))
    rest = F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.col("fact_id"))))
    return r.groupBy(*keys).agg(F.min(F.when(F.col("rn") == 1, F.col("fact_id"))).alias("primary_id"), F.array_join(F.transform(rest, lambda x: x.cast("string")), "|").alias("alternates"))


@query("cross_source_confirm", "+ s AS (SELECT company_id, metric_id, count(DISTINCT source_type) AS n FROM facts GROUP BY ALL) SELECT fact_id FROM facts JOIN s USING (company_id, metric_id) WHERE n >= 2", "facts")
def cross_source_confirm(spark, d):  # M19
    w = Window.partitionBy("company_id", "metric_id")
    return facts(spark, d).withColumn("n", F.size(F.collect_set("source_type").over(w))).where("n >= 2").select("fact_id")


@query("cohort_siblings_all", """+ m AS (SELECT fact_id, company_id, quantity, metric_id || CASE WHEN tier LIKE 'S%' THEN '_by_cohort' ELSE '' END AS metric FROM facts),
s AS (SELECT DISTINCT a.company_id, a.quantity FROM m a JOIN m b ON a.company_id = b.company_id AND a.quantity = b.quantity AND b.metric = a.metric || '_by_cohort')
SELECT fact_id FROM m JOIN s USING (company_id, quantity)""", "facts")
def cohort_siblings_all(spark, d):  # C22: facts of one value that stay, as a metric and its sibling by cohort are among them
    f = facts(spark, d).select("fact_id", "company_id", "quantity", "metric_id", F.coalesce(F.col("tier").startswith("S"), F.lit(False)).alias("by_cohort"))
    both = f.groupBy("company_id", "quantity", "metric_id").agg((F.bool_or("by_cohort") & ~F.bool_and("by_cohort")).alias("both"))
    return f.join(both.where("both").select("company_id", "quantity").distinct(), ["company_id", "quantity"], "left_semi").select("fact_id")


also("cohort_siblings", "cohort_siblings_all")


@query("span_containment_all", """+ s AS (SELECT fact_id, company_id, metric_id, fact_id % 50 AS a, fact_id % 50 + CAST(quantity AS BIGINT) AS b FROM facts) SELECT fact_id FROM s i WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.company_id = i.company_id AND o.metric_id = i.metric_id AND o.fact_id <> i.fact_id AND i.a >= o.a AND i.b <= o.b AND i.b - i.a < o.b - o.a)""", "facts")
def span_containment_all(spark, d):  # C17: of all facts
    return outermost(facts(spark, d).select("fact_id", "company_id", "metric_id", (F.col("fact_id") % 50).alias("a"), (F.col("fact_id") % 50 + F.col("quantity").cast("long")).alias("b")))


also("span_containment", "span_containment_all")


def outermost(spans):
    """fact_id of the spans [a, b] that are inside no longer one of another fact of the same company and metric.

    Inside means that a span of smaller a ends at b or later, or one of equal a later: running and group maxima, no pairs.
    As a follows from fact_id, only among spans of equal a a fact can meet itself."""
    group, same = Window.partitionBy("company_id", "metric_id"), Window.partitionBy("company_id", "metric_id", "a")
    s = spans.withColumn("top", F.max(F.struct("b", "fact_id")).over(same))
    s = s.withColumn("next", F.max(F.when(F.col("fact_id") != F.col("top.fact_id"), F.col("b"))).over(same))
    other = F.when(F.col("fact_id") == F.col("top.fact_id"), F.col("next")).otherwise(F.col("top.b"))
    s = s.withColumn("other", other).withColumn("earlier", F.max("b").over(group.orderBy("a").rangeBetween(Window.unboundedPreceding, -1)))
    return s.where("(earlier is null or earlier < b) and (other is null or other <= b)").select("fact_id")


@query("review_dedup", "SELECT fact_id FROM (SELECT fact_id, row_number() OVER (PARTITION BY metric_id, period_end, source_type ORDER BY CASE WHEN quantity < 25 THEN 0 ELSE 1 END, confidence DESC, fact_id) AS rn FROM facts) WHERE rn = 1", "facts")
def review_dedup(spark, d):  # M23: same sentence first, then confidence, then order
    order = [F.when(F.col("quantity") < 25, 0).otherwise(1), F.desc("confidence"), "fact_id"]
    return latest(facts(spark, d), ["metric_id", "period_end", "source_type"], order).select("fact_id")


@query("presence_aggregate", """+ e AS (SELECT filing_id, metric_id, CASE source_type WHEN 'text' THEN 1 WHEN 'html_table' THEN 2 ELSE 3 END AS stage, confidence, fact_id FROM facts) SELECT filing_id, metric_id, max(confidence) AS score, count(*) AS n, min(stage) AS first_stage, string_agg(DISTINCT CAST(stage AS VARCHAR), '|' ORDER BY CAST(stage AS VARCHAR)) AS stages FROM e GROUP BY ALL""", "facts")
def presence_aggregate(spark, d):  # D26, M21
    e = facts(spark, d).withColumn("stage", mapped("source_type", {"text": 1, "html_table": 2}, 3))
    return e.groupBy("filing_id", "metric_id").agg(F.max("confidence").alias("score"), F.count("*").alias("n"), F.min("stage").alias("first_stage"), F.array_join(F.array_sort(F.transform(F.collect_set("stage"), lambda x: x.cast("string"))), "|").alias("stages"))


@query("issuer_classify", """SELECT c_custkey, c_custkey % 11 = 0 OR c_mktsegment = 'MACHINERY' AND c_custkey % 5 = 0 AS blank_check, c_mktsegment = 'HOUSEHOLD' AND c_custkey % 2 = 0 AS fund FROM customer""")
def issuer_classify(spark, d):  # M22
    c = table(spark, d, "customer")
    sic = F.when(F.col("c_custkey") % 11 == 0, "6770").when(F.col("c_custkey") % 2 == 0, "6722").otherwise("7372")
    name = F.when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_custkey") % 5 == 0), "Alpha Acquisition Corp").when(F.col("c_mktsegment") == "HOUSEHOLD", "Household Trust").otherwise(F.col("c_name"))
    c = c.select("c_custkey", sic.alias("sic"), F.when((F.col("c_mktsegment") == "HOUSEHOLD"), F.lit("Household Trust")).otherwise(name).alias("name"), F.lit("").alias("text"))
    fund_sic = F.when(F.col("c_custkey") % 2 == 0, "6722").otherwise(F.col("sic"))
    return c.select("c_custkey", X.is_blank_check(F.col("name"), F.col("sic"), F.col("text")).alias("blank_check"), X.is_fund(F.col("name"), fund_sic).alias("fund"))


# Issuers made of the customers: names, codes and closing sentences go round, behind the whole text of a document.
NAMES = ["Cloud Bakery Inc", "Harbor Software Ltd", "Blockchain Payment Corp", "Crypto Exchange Trust", "Crowdfunding Wallet Co", "Digital Health Labs", "Clinical Partners", "Wireless Network Group", "Mining Rigs Inc", "Streaming Video Co", "Retail Trading AG"]
CODES = ["7372", "7990", "6199", "6211", "5961", "8090", "4899", "7380", "3570"]
ENDS = ["Our SaaS plans bring recurring revenue.", "GMV grew, and our take rate with it.", "A digital wallet on blockchain rails.", "We sell mining equipment.", "Telehealth visits doubled.", "Streaming subscribers and viewers rose.", "Network effects help us."]


def _tells(*groups: list[str]) -> str:
    return " AND ".join("(" + " OR ".join(f"contains(head, '{x}')" for x in group) + ")" for group in groups)


def _named(words: str) -> str:
    return "(" + " OR ".join(f"contains(low, '{x}')" for x in words.split("|")) + ")"


@query("industry_classes", f"""WITH i AS (
  SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN ({NAMES})[c_custkey % {len(NAMES)} + 1] END AS name, CASE WHEN c_custkey % 5 <> 0 THEN ({CODES})[c_custkey % {len(CODES)} + 1] END AS code,
         CASE WHEN c_custkey % 3 <> 0 THEN coalesce(text, '') || ' ' || ({ENDS})[c_custkey % {len(ENDS)} + 1] END AS text FROM customer LEFT JOIN documents ON doc_id = c_custkey
), h AS (SELECT c_custkey, coalesce(code, '') AS code, lower(coalesce(name, '')) AS low, lower(left(coalesce(text, ''), 10000)) AS head FROM i)
SELECT c_custkey,
  CASE WHEN code IN ('7370', '7371', '7372', '7373', '7374') THEN 'code' WHEN code LIKE '7%' AND {_named("saas|software|cloud")} THEN 'name' WHEN {_tells(["software as a service", "saas"], ["subscription", "recurring revenue"])} THEN 'text' END AS saas,
  CASE WHEN code IN ('5900', '5940', '5961') THEN 'code' WHEN {_named("marketplace|commerce|retail|shop|store|merchant|seller|buyer|trading")} THEN 'name' WHEN {_tells(["gross merchandise value", "gmv", "take rate"])} OR ({_tells(["marketplace"], ["commission"])}) THEN 'text' END AS ecommerce,
  CASE WHEN {_named("etf|fund|trust")} AND NOT contains(low, 'funding') OR contains(low, 'canaan') OR contains(low, 'mining') AND code <> '' AND code NOT LIKE '6%' OR {_tells(["mining equipment", "asic manufacturer", "hardware manufacturer"])} THEN NULL
       WHEN code = '6199' THEN 'code' WHEN code LIKE '6%' AND {_named("fintech|financial technology|payment|wallet|exchange|blockchain|crypto")} THEN 'name' WHEN {_tells(["cryptocurrency", "blockchain"], ["payment processing", "digital wallet"])} THEN 'text' END AS fintech,
  CASE WHEN code IN ('8000', '8071', '8090') THEN 'code' WHEN {_named("health|medical|telemedicine|patient|clinical|therapeutics")} AND {_named("tech|digital|platform|software|data")} THEN 'name' WHEN {_tells(["digital health", "health technology", "telemedicine", "telehealth", "patient platform"])} THEN 'text' END AS health,
  CASE WHEN code IN ('4899', '7380') THEN 'code' WHEN {_named("media|streaming|content|entertainment|publishing|video|music|podcast")} THEN 'name' WHEN ({_tells(["streaming"], ["subscribers"])}) OR {_tells(["content platform"])} OR ({_tells(["subscription revenue"], ["viewers"])}) THEN 'text' END AS media,
  CASE WHEN code IN ('4813', '4833', '4899') THEN 'code' WHEN {_named("telecom|wireless|communications|network|broadband|cellular|mobile")} THEN 'name' END AS telecom,
  CASE WHEN code IN ('7380', '7389') THEN 'code' WHEN {_named("platform|network|connect|marketplace")} THEN 'name' WHEN {_tells(["network effects", "two-sided market", "multi-sided platform", "platform business"])} THEN 'text' END AS platform
FROM h""")
def industry_classes(spark, d):  # M22: the classes by industry
    key = F.col("c_custkey")
    turn = lambda values, skip: F.when(key % skip != 0, F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int")))
    c = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "documents").select("doc_id", "text"), key == F.col("doc_id"), "left")
    c = c.select("c_custkey", turn(NAMES, 13).alias("name"), turn(CODES, 5).alias("code"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), turn(ENDS, 3)).alias("text"))
    return c.select("c_custkey", *[found.alias(k) for k, found in industry(F.col("name"), F.col("code"), F.col("text")).items()])


@query("scope_gate", """+ f AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'S-1' WHEN '2-HIGH' THEN 'F-1/A' ELSE '10-K' END AS form, o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_time, o_custkey % 7 = 0 AS spac, CASE o_orderstatus WHEN 'P' THEN 'secondary' WHEN 'F' THEN 'primary' END AS offering FROM orders)
SELECT o_orderkey FROM f WHERE form IN ('S-1', 'F-1/A') AND first_time AND NOT spac AND coalesce(offering, '') <> 'secondary'""".replace("+ f AS", "WITH f AS"))
def scope_gate(spark, d):  # B21
    o = table(spark, d, "orders")
    f = o.select("o_orderkey", mapped("o_orderpriority", {"1-URGENT": "S-1", "2-HIGH": "F-1/A"}, "10-K").alias("form"), (F.col("o_orderdate") == F.min("o_orderdate").over(Window.partitionBy("o_custkey"))).alias("first_time"), (F.col("o_custkey") % 7 == 0).alias("spac"), F.when(F.col("o_orderstatus") == "P", "secondary").when(F.col("o_orderstatus") == "F", "primary").alias("offering"))
    no = F.lit(False)
    return f.where(X.in_scope(F.col("form"), F.col("first_time"), F.col("spac"), no, no, no, F.col("offering"))).select("o_orderkey")


