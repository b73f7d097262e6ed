"""Line dedup: lines that many sites share are boilerplate and go. Built of DataFrame functions only.

A line is normalised (runs of white space become one space, ends trimmed, lower case) and known by two 64-bit hashes. It is
boilerplate if ``sites`` distinct sites have it, in as many distinct texts: a page that many sites copy is a matter for
near dedup, and its lines are nobody's boilerplate. HyperLogLog sketches of each line's sites and texts merge by
aggregation; where an estimate lies within the sketch's error of the threshold, both are counted exactly. So the decision
equals that of exact counts, and only lines near the threshold pay for it.

Every document loses its boilerplate lines, however many they are, and keeps its others in order. Only a text of which no
word would be left stays as it is: it isn't a page that carries boilerplate, it is what the others carry, and without it
the corpus would lose it altogether.

Edge cases: null and empty texts have no lines and stay as they are. A null site counts as a site of its own. Lines of
fewer than ``min_words`` words are never boilerplate. Extra columns are kept, whatever their names;
only n_lines and n_removed are replaced where counts are asked for.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import bounded
from .scratch import Scratch

SITES, MIN_WORDS, LOG_K = 5, 5, 12
TEXT = ["r1", "r2"]


def normalised(line: Column) -> Column:
    odd = reduce(or_, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")])  # else there is nothing to replace
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)))


def text_hashes() -> list[Column]:
    return [F.xxhash64("text").alias("r1"), F.xxhash64(F.lit(1), "text").alias("r2")]


def exploded(docs: DataFrame, min_words: int) -> DataFrame:
    """r1 and r2 (the hashes of a text), site, pos and hashes of each line long enough to be judged."""
    lines = docs.select(*text_hashes(), F.coalesce("source", F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", normalised(F.col("line")))
    lines = lines.where(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) >= min_words - 1).where("line != ''")
    lines = lines.select(*TEXT, "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    return lines.distinct()  # the copies of a text on a site meet here, each line of it on its own


def boilerplate(lines: DataFrame, sites: int = SITES, log_k: int = LOG_K) -> DataFrame:
    """h1, h2 of the lines that may have ``sites`` distinct sites and texts; ``near`` where only exact counts tell."""
    margin = 1 + int(sites * 4 * 1.04 / 2 ** (log_k / 2))  # four standard errors, and one
    ends = [f(c).alias(f"{n}_{c}") for c in ("site", "r1") for n, f in (("low", F.min), ("high", F.max))]
    shared = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), *ends)  # most lines are one text's and need no sketch
    shared = shared.where((F.col("n") >= sites) & (F.col("low_site") != F.col("high_site")) & (F.col("low_r1") != F.col("high_r1"))).select("h1", "h2")
    sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(log_k))) for c in ("site", "r1")]
    spread = lines.join(bounded(shared), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.least(*sketches).alias("least"))
    return spread.where(F.col("least") >= sites - margin).select("h1", "h2", (F.col("least") <= sites + margin).alias("near"))


def exact(lines: DataFrame, near: DataFrame, sites: int) -> DataFrame:
    """Of the lines in ``near`` those whose exact counts of sites and of texts reach the threshold."""
    own = lines.join(near, ["h1", "h2"], "left_semi")
    reached = lambda by: own.select("h1", "h2", *by).distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h1", "h2")
    return reached(["site"]).join(reached(TEXT), ["h1", "h2"])


def remove_boilerplate(docs: DataFrame, sites: int = SITES, min_words: int = MIN_WORDS, log_k: int = LOG_K, counts: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``; with ``counts`` also n_lines and n_removed, which take the
    place of columns of that name."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(exploded(docs, min_words), "lines")  # 16 bytes of hashes a line; the texts are cut up once
    found = scratch.save(boilerplate(lines, sites, log_k), "spread")
    sure = found.where("not near").select("h1", "h2")
    near = found.where("near").select("h1", "h2")
    bad = scratch.save(sure.unionByName(exact(lines, bounded(near), sites)), "boilerplate")
    hits = lines.join(bounded(bad), ["h1", "h2"], "left_semi").groupBy(*TEXT).agg(F.collect_set("pos").alias("hits"))
    hits = scratch.save(hits, "hits").hint("merge")  # a row for each text hit: never broadcast for its small files
    # The caller's columns travel in a struct, so none of their names meets one of ours.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *text_hashes())
    out = packed.join(hits, TEXT, "left").select("doc", "hits", F.split("doc.text", "\n").alias("parts"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "hits")
    rest = F.array_join(F.transform(stay, lambda i: F.get(F.col("parts"), i)), "\n")
    out = out.withColumn("n", F.size("parts")).withColumn("rest", F.when(F.col("hits").isNotNull(), rest))
    cut = F.coalesce(F.regexp_replace("rest", r"[\x20\x09-\x0D]+", "") != "", F.lit(False))
    out = out.withColumn("cut", cut)
    own = {"n_lines", "n_removed"} if counts else set()
    kept = [F.when(F.col("cut"), F.col("rest")).otherwise(F.col("doc.text")).alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in own]
    if not counts:
        return out.select(*kept)
    n_lines = F.coalesce(F.when(F.col("doc.text") == "", 0).otherwise(F.nullif("n", F.lit(-1))), F.lit(0)).cast("long")
    return out.select(*kept, n_lines.alias("n_lines"), F.when(F.col("cut"), F.size("hits")).otherwise(0).cast("long").alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the MD5 of the cleaned text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


OP3_SQL = """
WITH parts AS (
  SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS arr FROM documents
), texts AS (SELECT DISTINCT text, arr, site FROM parts),
lines AS (
  SELECT text, site, unnest(range(len(arr))) AS pos,
         lower(trim(regexp_replace(unnest(arr), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS line FROM texts
), judged AS (
  SELECT * FROM lines WHERE line <> '' AND length(line) - length(replace(line, ' ', '')) >= 4
), bad AS (
  SELECT line FROM judged GROUP BY line HAVING count(DISTINCT site) >= 5 AND count(DISTINCT text) >= 5
), hits AS (
  SELECT text, list(DISTINCT pos) AS hits FROM judged WHERE line IN (SELECT line FROM bad) GROUP BY text
), cut AS (
  SELECT p.doc_id, p.text, arr, coalesce(len(hits), 0) AS n,
         CASE WHEN hits IS NULL THEN p.text
              ELSE array_to_string([arr[i + 1] FOR i IN range(len(arr)) IF NOT list_contains(hits, i)], chr(10)) END AS kept
  FROM parts p LEFT JOIN hits h ON p.text = h.text
), judged_docs AS (
  SELECT *, n = 0 OR regexp_replace(kept, '[\\x20\\x09-\\x0D]+', '', 'g') = '' AS whole FROM cut
)
SELECT doc_id,
       CAST(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(arr) END AS BIGINT) AS n_lines,
       CAST(CASE WHEN whole THEN 0 ELSE n END AS BIGINT) AS n_removed,
       md5(coalesce(CASE WHEN whole THEN text ELSE kept END, '')) AS text_md5
FROM judged_docs
"""
