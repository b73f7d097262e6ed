"""Registration of queries, and the roles that the test tables play.

company = customer, filing = orders (form = priority, status = status), fact = lineitem (metric = brand of the part,
tier = type, source type = return flag, confidence = 1 - discount), reviewer decision = events (user = reviewer; click =
accept, purchase = add, signup = correct, error = reject, view = skip), segment = a line of documents, transcript =
conversations, industry = nation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SOURCE_TYPES = {"A": "html_table", "N": "text", "R": "chart"}
DECISIONS = {"click": "accept", "purchase": "add", "signup": "correct", "error": "reject", "view": "skip"}

FACTS_SQL = """facts AS (
  SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_orderkey AS filing_id, o_custkey AS company_id, p_brand AS metric_id, p_type AS tier,
         l_extendedprice AS value, l_quantity AS quantity, round(1 - l_discount, 2) AS confidence,
         CASE l_returnflag WHEN 'A' THEN 'html_table' WHEN 'N' THEN 'text' ELSE 'chart' END AS source_type,
         CASE l_linestatus WHEN 'F' THEN 'accepted' ELSE 'pending' END AS review_status,
         o_orderpriority AS form_type, CAST(o_orderdate AS DATE) AS filing_date, CAST(l_shipdate AS DATE) AS period_end
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

DECISIONS_SQL = """decisions AS (
  SELECT event_id AS decision_id, user_id AS reviewer, event_type, value, ts,
         CASE event_type WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'add' WHEN 'signup' THEN 'correct' WHEN 'error' THEN 'reject' ELSE 'skip' END AS decision,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'm' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS VARCHAR) AS metric_id,
         event_id % 400 AS img_id
  FROM events)"""


def query(name: str, sql: str | None = None, with_: str = ""):
    """Registers a query with the SQL of the same result; ``with_`` names role tables to put before it."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            heads = {"facts": FACTS_SQL, "decisions": DECISIONS_SQL}
            before = ", ".join(heads[w] for w in with_.split())
            ORACLES[name] = (f"WITH {before}" + (", " if sql.lstrip().startswith("+") else " ") if before else "") + sql.lstrip().lstrip("+")
        return f

    return keep


def also(name: str, same: str) -> None:
    """Registers a query of whole tables under a second name, which once had a narrower query."""
    QUERIES[name] = QUERIES[same]
    if same in ORACLES:
        ORACLES[name] = ORACLES[same]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS = 500_000  # fixed value: of one task after a shuffle, on average and at most


def parted(df: DataFrame, rows: int, key: str) -> DataFrame:
    """``df`` by key, in partitions of ROWS rows on average; as it is where the session's own number of partitions keeps to that."""
    n = -(-rows // ROWS)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def mapped(column, names: dict[str, str], other: str):
    out = None
    for k, v in names.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out.otherwise(other)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = lines.count()  # from the files' footers
    joined = parted(lines, rows, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = parted(joined, rows, "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"),
        F.col("l_orderkey").alias("filing_id"),
        F.col("o_custkey").alias("company_id"),
        F.col("p_brand").alias("metric_id"),
        F.col("p_type").alias("tier"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_quantity").alias("quantity"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        mapped("l_returnflag", {"A": "html_table", "N": "text"}, "chart").alias("source_type"),
        F.when(F.col("l_linestatus") == "F", "accepted").otherwise("pending").alias("review_status"),
        F.col("o_orderpriority").alias("form_type"),
        F.col("o_orderdate").cast("date").alias("filing_date"),
        F.col("l_shipdate").cast("date").alias("period_end"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("decision_id"),
        F.col("user_id").alias("reviewer"),
        "event_type",
        "value",
        "ts",
        mapped("event_type", {k: v for k, v in DECISIONS.items() if v != "skip"}, "skip").alias("decision"),
        k.alias("k"),
        F.concat(F.lit("m"), (k % 12).cast("string")).alias("metric_id"),
        (F.col("event_id") % 400).alias("img_id"),
    )


def pct(part, whole, places: int = 1):
    """A percentage with a guard against nothing, rounded half up as decimals."""
    return F.round(F.lit(100) * part.cast("decimal(18,0)") / F.nullif(whole, F.lit(0)).cast("decimal(18,0)"), places).cast("double")


def pct_sql(part: str, whole: str, places: int = 1) -> str:
    p, w = f"CAST({part} AS HUGEINT)", f"CAST({whole} AS HUGEINT)"
    scale = 10**places
    return f"CASE WHEN {w} <> 0 THEN CAST((2 * 100 * {scale} * {p} + {w}) // (2 * {w}) AS DOUBLE) / {scale}.0 END"
