"""Mining of review decisions: tokens, phrases, histograms, severities, recommendations, training labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ranking import top_per_group
from .base import decisions, pct, pct_sql, query, table

STOP = ["the", "and", "that", "with", "for", "was", "are"]
TOKENS_SQL = "t AS (SELECT doc_id, source, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'that', 'with', 'for', 'was', 'are')) AS w FROM documents)"


def _tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", X.tokens(F.col("text"), STOP).alias("w"))


@query("tokens", f"WITH {TOKENS_SQL} SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS words FROM t")
def tokens(spark, d):  # H7
    return _tokens(spark, d).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("words"))


@query("ngrams", f"WITH {TOKENS_SQL} SELECT doc_id, CAST(greatest(len(w) - 1, 0) AS BIGINT) AS pairs, CAST(greatest(len(w) - 2, 0) AS BIGINT) AS triples, CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END AS first_pair FROM t")
def ngrams(spark, d):  # H8
    two, three = X.ngrams(F.col("w"), 2), X.ngrams(F.col("w"), 3)
    return _tokens(spark, d).select("doc_id", F.size(two).cast("long").alias("pairs"), F.size(three).cast("long").alias("triples"), F.get(two, F.lit(0)).alias("first_pair"))


PHRASES_SQL = TOKENS_SQL + ", g AS (SELECT source, doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS phrase FROM t), p AS (SELECT source, phrase, count(DISTINCT doc_id) AS n FROM g GROUP BY ALL)"


def _said(docs, *keep):
    # A document, of which doc_id is the key, counts once: its repeats go before the shuffle, and counts combine there.
    return docs.select(*keep, F.explode(F.array_distinct(X.ngrams(F.col("w"), 2))).alias("phrase"))


def _phrases(spark, d):
    return _said(_tokens(spark, d), "source").groupBy("source", "phrase").agg(F.count("*").alias("n"))


BITS = 64  # fixed value: of a long


@query("top_phrases", f"WITH {PHRASES_SQL} SELECT source, phrase, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, phrase) AS rn FROM p WHERE n >= 2) WHERE rn <= 15")
def top_phrases(spark, d):  # E4: the floor applies before the cap
    return top_per_group(_phrases(spark, d).where("n >= 2"), ["source"], [F.desc("n"), "phrase"], 15).select("source", "phrase", "n")


@query("cross_metric_phrases", f"WITH {PHRASES_SQL} SELECT phrase, count(*) AS sources, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_sort(list(source))[1:5], '|') AS examples FROM p GROUP BY phrase HAVING count(*) >= 3")
def cross_metric_phrases(spark, d):  # D17: five examples are what is shown
    docs = _tokens(spark, d)
    names = sorted(r.source for r in docs.select("source").where("source is not null").distinct().limit(BITS).collect())
    if len(names) < BITS:
        # A bit for each source, and one for none: phrases are grouped once, in buffers of two numbers.
        bits = F.array(*[F.lit(1 << k if k < BITS - 1 else -(1 << k)).cast("long") for k in range(len(names) + 1)])
        known = F.array(*map(F.lit, names)).cast("array<string>")
        bit = F.get(bits, F.coalesce(F.nullif(F.array_position(known, F.col("source")), F.lit(0)) - 1, F.lit(len(names))).cast("int"))
        g = _said(docs.select("w", bit.alias("bit")), "bit").groupBy("phrase").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
        g = g.select("phrase", F.bit_count("bits").cast("long").alias("sources"), "n", F.filter(known, lambda s, k: F.getbit("bits", k) == 1).alias("examples"))
    else:
        g = _phrases(spark, d).groupBy("phrase").agg(F.count("*").alias("sources"), F.sum("n").alias("n"), F.array_sort(F.collect_set("source")).alias("examples"))
    return g.where("sources >= 3").withColumn("examples", F.array_join(F.slice("examples", 1, 5), "|"))


@query("histogram_map", """+ n AS (SELECT reviewer, metric_id, count(*) AS n FROM decisions WHERE decision = 'reject' GROUP BY ALL) SELECT reviewer, string_agg(metric_id || '=' || CAST(n AS VARCHAR), ',' ORDER BY metric_id) AS histogram, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY reviewer""", "decisions")
def histogram_map(spark, d):  # D15
    n = decisions(spark, d).where("decision = 'reject'").groupBy("reviewer", "metric_id").agg(F.count("*").alias("n"))
    m = n.groupBy("reviewer").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_id", "n")))).alias("m"), F.sum("n").alias("total"))
    return m.select("reviewer", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("histogram"), "total")


@query("category_rollup", f"""SELECT metric_id, count(*) AS n, {pct_sql('count(*)', 'sum(count(*)) OVER ()')} AS share, CASE WHEN count(*) >= 40 THEN 'high' WHEN count(*) >= 20 THEN 'medium' ELSE 'low' END AS severity FROM decisions WHERE decision = 'reject' GROUP BY metric_id""", "decisions")
def category_rollup(spark, d):  # D16: maps of reviewers merged, with share and severity
    n = decisions(spark, d).where("decision = 'reject'").groupBy("reviewer", "metric_id").agg(F.count("*").alias("n"))
    maps = n.groupBy("reviewer").agg(F.map_from_entries(F.collect_list(F.struct("metric_id", "n"))).alias("m"))
    merged = maps.select(F.explode("m").alias("metric_id", "n")).groupBy("metric_id").agg(F.sum("n").alias("n"))
    severity = F.when(F.col("n") >= 40, "high").when(F.col("n") >= 20, "medium").otherwise("low")
    return merged.select("metric_id", "n", pct(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"), severity.alias("severity"))


@query("label_having", "+ l AS (SELECT img_id, bool_or(decision IN ('accept', 'correct', 'add')) AS pos, bool_or(decision = 'reject') AS neg FROM decisions GROUP BY img_id) SELECT img_id, CAST(CASE WHEN pos THEN 1 ELSE 0 END AS INTEGER) AS label FROM l WHERE pos OR neg", "decisions")
def label_having(spark, d):  # M28, D11: images that were only skipped teach nothing
    g = decisions(spark, d).groupBy("img_id").agg(F.bool_or(F.col("decision").isin("accept", "correct", "add")).alias("pos"), F.bool_or(F.col("decision") == "reject").alias("neg"))
    return g.where("pos or neg").select("img_id", F.col("pos").cast("int").alias("label"))


@query("recommendations", """+ c AS (SELECT metric_id, count(*) FILTER (WHERE decision = 'reject') AS rejects, count(*) FILTER (WHERE decision = 'correct') AS corrects, count(*) FILTER (WHERE decision = 'reject' AND k >= 40) AS wrong FROM decisions GROUP BY metric_id),
r AS (SELECT metric_id, 'keyword_overlap' AS rule, CASE WHEN corrects >= 10 THEN 'high' ELSE 'medium' END AS severity FROM c WHERE corrects >= 5 UNION ALL SELECT metric_id, 'fp_filter_gap', CASE WHEN wrong * 10 >= rejects * 7 THEN 'high' ELSE 'medium' END FROM c WHERE rejects >= 5 AND wrong * 2 >= rejects) SELECT * FROM r""", "decisions")
def recommendations(spark, d):  # M26
    c = decisions(spark, d).groupBy("metric_id").agg(F.count_if(F.col("decision") == "reject").alias("rejects"), F.count_if(F.col("decision") == "correct").alias("corrects"), F.count_if((F.col("decision") == "reject") & (F.col("k") >= 40)).alias("wrong"))
    overlap = F.when(F.col("corrects") >= 5, F.struct(F.lit("keyword_overlap").alias("rule"), F.when(F.col("corrects") >= 10, "high").otherwise("medium").alias("severity")))
    gap = F.when((F.col("rejects") >= 5) & (F.col("wrong") * 2 >= F.col("rejects")), F.struct(F.lit("fp_filter_gap").alias("rule"), F.when(F.col("wrong") * 10 >= F.col("rejects") * 7, "high").otherwise("medium").alias("severity")))
    return c.select("metric_id", F.explode(F.array_compact(F.array(overlap, gap))).alias("r")).select("metric_id", "r.rule", "r.severity")


@query("simulation_delta", """WITH b AS (SELECT source, count(*) FILTER (WHERE contains(lower(text), 'tion')) AS n FROM documents GROUP BY source), a AS (SELECT source, count(*) FILTER (WHERE contains(lower(text), 'tion') AND NOT contains(lower(text), 'que')) AS n FROM documents GROUP BY source) SELECT b.source, b.n AS before, a.n AS after, a.n - b.n AS delta FROM a JOIN b ON a.source = b.source""")
def simulation_delta(spark, d):  # M29: both pattern sets in one pass
    low = F.lower("text")
    now = F.contains(low, F.lit("tion"))
    g = table(spark, d, "documents").groupBy("source").agg(F.count_if(now).alias("before"), F.count_if(now & ~F.contains(low, F.lit("que"))).alias("after"))
    return g.withColumn("delta", F.col("after") - F.col("before"))


@query("paraphrase_tasks", """WITH k AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'tion')), w AS (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')) SELECT doc_id, 'keyword' AS path FROM k UNION ALL SELECT doc_id, 'paraphrase' FROM w WHERE doc_id NOT IN (SELECT doc_id FROM k)""")
def paraphrase_tasks(spark, d):  # M9: keyword hits, and whitelisted sections without one
    docs = table(spark, d, "documents")
    k = docs.where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id")
    w = docs.where(F.col("source").isin("src1", "src2")).select("doc_id").join(k, "doc_id", "left_anti")
    return k.withColumn("path", F.lit("keyword")).unionByName(w.withColumn("path", F.lit("paraphrase")))
