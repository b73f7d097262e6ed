"""Deduplication of facts, pass by pass: identical slots, values with other or missing periods, collisions, confirmation.

A supplier's line items are one document's facts here: the value is the quantity, the period the quarter shipped (missing
without tax), the customer type comes from the order's priority and is missing for most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.matching import SMALL, split_by_size, tolerance_groups, walked
from ..shared import Scratch
from .base import mapped, query, table
from .extraction import RANK_SQL, SOURCE_RANK

TOLERANCE = 0.02


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def stated(spark, d) -> DataFrame:
    lines, orders, part = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    # Orders come last, so that the numbering below finds the rows by their order already.
    rows = lines.select(*LINE).join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.trunc(F.col("l_shipdate").cast("date"), "quarter")
    known = lambda c: F.when(F.col("l_tax") > 0, c)
    # Lines repeat their order and number, so a fact's id counts them.
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE[2:]))
    return rows.select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + nth).alias("fact_id"), F.col("l_suppkey").alias("doc_id"), F.col("p_brand").alias("metric_id"), F.col("l_linestatus").alias("unit"),
        F.col("l_quantity").cast("double").alias("value"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), mapped("l_returnflag", {"A": "html_table", "N": "text"}, "chart").alias("source_type"),
        known(at).alias("period_start"), known(F.last_day(F.add_months(at, 2))).alias("period_end"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "paid").when(F.col("o_orderpriority") == "2-HIGH", "enterprise").alias("customer_type"),
    )


SLOT = ["doc_id", "metric_id", "unit", "period_start", "period_end", "customer_type", "source_type"]
QUALITY = ["quality", "confidence", "fact_id"]


def quality(df: DataFrame) -> DataFrame:
    return df.withColumn("quality", SOURCE_RANK(F.col("source_type")))


def best_of(facts: DataFrame, by: list[str]) -> DataFrame:
    """The fact of the best source, then confidence, of each group, with the alternates of all and how many it beat."""
    rest = [c for c in facts.columns if c not in (*by, "alternates")]
    best = F.max_by(F.struct(*rest), F.struct(*QUALITY)).alias("b")
    out = facts.groupBy(*by).agg(best, (F.sum("alternates") + F.count("*") - 1).alias("alternates"))
    return out.select(*by, *[f"b.{c}" for c in rest], "alternates")


def compatible(a: Column, b: Column) -> Column:
    """Periods that overlap, or of which one is missing."""
    known = lambda p: p["period_start"].isNotNull() & p["period_end"].isNotNull()
    apart = (a["period_end"] < b["period_start"]) | (b["period_end"] < a["period_start"])
    return ~(known(a) & known(b) & F.coalesce(apart, F.lit(False)))


def seeded(facts: DataFrame, keys: list[str], small: bool, **how) -> DataFrame:
    """``facts`` with the id of the fact that each belongs to as group_id."""
    if small:
        return walked(facts, keys, "fact_id", "value", TOLERANCE, zero=TOLERANCE, **how)
    return facts.join(tolerance_groups(facts, keys, "fact_id", "value", TOLERANCE, zero=TOLERANCE, **how), "fact_id")


def same_slot(facts: DataFrame, small: bool = False) -> DataFrame:
    """Pass 1: of facts equal in all but the value, with values within the tolerance of the first, the best one."""
    facts = quality(facts).withColumn("alternates", F.lit(0).cast("long"))
    return best_of(seeded(facts, SLOT, small), [*SLOT, "group_id"]).drop("group_id")


def other_periods(facts: DataFrame, small: bool = False) -> DataFrame:
    """Pass 2: of values within the tolerance of a better fact, whose periods don't contradict it, that one stays. A missing
    period or customer type comes from the best of those that it beats."""
    columns = facts.columns
    keys = ["doc_id", "metric_id", "unit", "chart"]
    facts = facts.withColumn("chart", F.col("source_type") == "chart")
    order = F.struct(*[(-F.col(c)).alias(c) for c in QUALITY])
    joined = seeded(facts, keys, small, order=order, also=["period_start", "period_end"], compatible=compatible).withColumn("order", order)
    dated = F.when(F.col("period_start").isNotNull() & F.col("period_end").isNotNull(), F.struct("period_start", "period_end"))
    own = [c for c in columns if c not in (*keys, "alternates")]
    kept = joined.groupBy(*keys, "group_id").agg(
        F.min_by(F.struct(*own), "order").alias("own"),  # the fact of that id, as it comes before those it beats
        F.min_by(dated, F.when(dated.isNotNull(), F.col("order"))).alias("period"),
        F.min_by("customer_type", F.when(F.col("customer_type").isNotNull(), F.col("order"))).alias("type"),
        (F.sum("alternates") + F.count("*") - 1).alias("alternates"),
    )
    kept = kept.select(*keys, *[f"own.{c}" for c in own], "period", "type", "alternates")
    lacks = F.col("period_start").isNull() | F.col("period_end").isNull()
    from_ = lambda c: F.when(lacks, F.coalesce(F.col(f"period.{c}"), F.col(c))).otherwise(F.col(c))
    return kept.withColumns({"period_start": from_("period_start"), "period_end": from_("period_end"), "customer_type": F.coalesce("customer_type", "type")}).select(*columns)


def confirmed(facts: DataFrame) -> DataFrame:
    """confirming: the other sources, in order, that state a fact's value in its slot. ``facts`` has one of each source in a slot,
    so those that state one value are few."""
    columns = facts.columns
    by = ["doc_id", "metric_id", "unit", "period_start", "period_end", "customer_type"]
    rest = [c for c in columns if c not in by]
    stated_ = facts.groupBy(*by, F.round("value", 2).alias("v")).agg(F.array_sort(F.collect_set("source_type")).alias("sources"), F.collect_list(F.struct(*rest)).alias("of"))
    each = stated_.withColumn("of", F.explode("of")).select(*by, *[f"of.{c}" for c in rest], "sources").select(*columns, "sources")
    return each.withColumn("confirming", F.array_join(F.array_except("sources", F.array("source_type")), "|")).drop("sources")


def deduplicated(facts: DataFrame, small: int = SMALL) -> DataFrame:
    """All passes in turn. Each works within a document, metric and unit: those of ``small`` facts at most are brought together
    once, and no pass shuffles them again; larger ones go by joins and rounds."""
    place = ["doc_id", "metric_id", "unit"]
    few, many = split_by_size(facts, place, small, Scratch(facts.sparkSession, "dedup"))
    run = lambda df, small: confirmed(best_of(other_periods(same_slot(df, small), small), SLOT))
    out = run(few.repartition(*place), True)
    return out if many is None else out.unionByName(run(many, False))


def first_come_sql(name: str, source: str, keys: str, item: str, order: str, covers: str) -> str:
    """Recursive CTEs that go down each bucket's list: ``name`` (id, seed). ``covers`` compares a (before) and b."""
    return f"""{name}_b AS (SELECT row_number() OVER () AS bucket, list({item} ORDER BY {order}) AS ps FROM {source} GROUP BY {keys}),
{name}_r AS (
  SELECT bucket, ps, 1 AS i, CAST([] AS BIGINT[]) AS own FROM {name}_b
  UNION ALL SELECT bucket, ps, i + 1, list_append(own, coalesce(list_filter(range(1, i), lambda j: own[j] = j AND {covers.format(a="ps[j]", b="ps[i]")})[1], i)) FROM {name}_r WHERE i <= len(ps)
), {name} AS (SELECT x.p.id AS id, x.s.id AS seed FROM (SELECT unnest(list_transform(own, lambda o, k: struct_pack(p := ps[k], s := ps[o]))) AS x FROM {name}_r WHERE i = len(ps) + 1))"""


NEAR_SQL = "CASE WHEN {a}.v = 0 OR {b}.v = 0 THEN abs({a}.v - {b}.v) <= 0.02 ELSE abs({a}.v - {b}.v) <= 0.02 * abs({b}.v) END"
APART_SQL = "coalesce({a}.e < {b}.s OR {b}.e < {a}.s, false)"
BEST_SQL = f"{RANK_SQL} DESC, confidence DESC, fact_id DESC"

STATED_SQL = f"""WITH RECURSIVE f AS (
  SELECT l_orderkey * 1000 + l_linenumber * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(LINE[2:])}) AS fact_id, l_suppkey AS doc_id, p_brand AS metric_id, l_linestatus AS unit, CAST(l_quantity AS DOUBLE) AS value, round(1 - l_discount, 2) AS confidence,
         CASE l_returnflag WHEN 'A' THEN 'html_table' WHEN 'N' THEN 'text' ELSE 'chart' END AS source_type,
         CASE WHEN l_tax > 0 THEN CAST(date_trunc('quarter', l_shipdate) AS DATE) END AS period_start,
         CASE WHEN l_tax > 0 THEN CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) END AS period_end,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'paid' WHEN '2-HIGH' THEN 'enterprise' END AS customer_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""
DEDUP_SQL = STATED_SQL + ", " + first_come_sql("g1", "f", "doc_id, metric_id, unit, period_start, period_end, customer_type, source_type", "struct_pack(id := fact_id, v := value)", "fact_id", NEAR_SQL) + f""",
p1 AS (SELECT * FROM (SELECT f.*, count(*) OVER (PARTITION BY seed) - 1 AS alternates, row_number() OVER (PARTITION BY seed ORDER BY {BEST_SQL}) AS rn FROM f JOIN g1 ON f.fact_id = g1.id) WHERE rn = 1), """ + first_come_sql(
    "g2", "p1", "doc_id, metric_id, unit, source_type = 'chart'", "struct_pack(id := fact_id, v := value, s := period_start, e := period_end)", BEST_SQL, f"({NEAR_SQL}) AND NOT {APART_SQL}"
) + f""",
given AS (
  SELECT seed, sum(alternates) + count(*) - 1 AS more, first(struct_pack(s := period_start, e := period_end) ORDER BY {BEST_SQL}) FILTER (WHERE period_start IS NOT NULL AND period_end IS NOT NULL) AS p,
         first(customer_type ORDER BY {BEST_SQL}) FILTER (WHERE customer_type IS NOT NULL) AS t FROM p1 JOIN g2 ON fact_id = id GROUP BY seed
), p2 AS (
  SELECT p1.* EXCLUDE (period_start, period_end, customer_type, alternates, rn), coalesce(period_start, p.s) AS period_start, coalesce(period_end, p.e) AS period_end, coalesce(customer_type, t) AS customer_type, more AS alternates
  FROM p1 JOIN given ON fact_id = seed
), p3 AS (
  SELECT * FROM (SELECT *, sum(alternates) OVER w + count(*) OVER w - 1 AS beaten, row_number() OVER (w ORDER BY {BEST_SQL}) AS rn
                 FROM p2 WINDOW w AS (PARTITION BY doc_id, metric_id, unit, period_start, period_end, customer_type, source_type)) WHERE rn = 1
), c AS (SELECT *, list_sort(list(source_type) OVER (PARTITION BY doc_id, metric_id, unit, period_start, period_end, customer_type, round(value, 2))) AS sources FROM p3)
"""


@query("deduplicated_facts", DEDUP_SQL + """SELECT fact_id, doc_id, metric_id, unit, value, confidence, source_type, period_start, period_end, customer_type, CAST(beaten AS BIGINT) AS alternates,
 array_to_string(list_filter(list_distinct(sources), lambda s: s <> source_type).list_sort(), '|') AS confirming FROM c""")
def deduplicated_facts(spark, d):  # M15 to M19 chained: same slots, other periods with transfer, collisions, confirmation
    out = deduplicated(stated(spark, d))
    return out.select("fact_id", "doc_id", "metric_id", "unit", "value", "confidence", "source_type", "period_start", "period_end", "customer_type", "alternates", "confirming")
