"""Documents: segments, keyword presence and its roll-up, contexts, sections, neighbourhoods, hashes, HTML."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import catalogue
from ..functions import text as X
from ..sources import html, readers
from .base import also, query, table
from .dataflow import filings, once

#: metric, pattern; one alternation tests all before each is tried.
KEYWORDS = [("retention", "(of the|with and)"), ("churn", "(was by|are with)"), ("revenue", "(que de|ein der)"), ("growth", "(la de|el los)")]
ANY = "(of the|with and|was by|are with|que de|ein der|la de|el los)"
LINES_SQL = "l AS (SELECT doc_id, source, lang, unnest(range(len(string_split(text, chr(10))))) AS seq, unnest(string_split(text, chr(10))) AS line FROM documents)"


def segments(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("seq", "line"))


def mentions(spark, d):
    """Segments by metric whose pattern they match; most segments stop at the one alternation of all patterns."""
    hits = segments(spark, d).where(F.lower("line").rlike(ANY))
    metrics = F.array_compact(F.array(*[F.when(F.lower("line").rlike(p), F.lit(m)) for m, p in KEYWORDS]))
    return hits.select("doc_id", "source", "lang", "seq", "line", F.explode(metrics).alias("metric_id"))


MENTIONS_SQL = LINES_SQL + ", k AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{p}')" for m, p in KEYWORDS) + ") v(metric_id, pattern)), m AS (SELECT doc_id, source, lang, seq, line, metric_id FROM l JOIN k ON regexp_matches(lower(line), pattern))"


@query("keyword_disclosure", f"WITH {MENTIONS_SQL}, p AS (SELECT source, metric_id, count(DISTINCT doc_id) AS docs FROM m GROUP BY ALL) SELECT source, CASE WHEN count(*) >= 4 THEN '4+' ELSE CAST(count(*) AS VARCHAR) END AS bucket, CAST(sum(docs) AS BIGINT) AS docs, string_agg(metric_id, '|' ORDER BY metric_id) AS metrics FROM p GROUP BY source")
def keyword_disclosure(spark, d):  # the minimum slice: scan, explode, match, aggregate, bucket
    p = mentions(spark, d).groupBy("source", "metric_id").agg(F.count_distinct("doc_id").alias("docs"))
    n = p.groupBy("source").agg(F.count("*").alias("n"), F.sum("docs").alias("docs"), F.array_join(F.array_sort(F.collect_list("metric_id")), "|").alias("metrics"))
    return n.select("source", F.when(F.col("n") >= 4, "4+").otherwise(F.col("n").cast("string")).alias("bucket"), "docs", "metrics")


@query("keyword_presence", f"WITH {MENTIONS_SQL} SELECT doc_id, metric_id, count(*) AS segments, min(seq) AS first_seq FROM m GROUP BY ALL")
def keyword_presence(spark, d):  # C16, M8, H6
    return mentions(spark, d).groupBy("doc_id", "metric_id").agg(F.count("*").alias("segments"), F.min("seq").cast("long").alias("first_seq"))


@query("keyword_counts", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '(the|and)')) AS BIGINT) AS n_common, CAST(len(regexp_extract_all(lower(text), 'tion')) AS BIGINT) AS n_tion FROM documents")
def keyword_counts(spark, d):  # H10
    low = F.lower("text")
    return table(spark, d, "documents").select("doc_id", F.regexp_count(low, F.lit("(the|and)")).cast("long").alias("n_common"), F.regexp_count(low, F.lit("tion")).cast("long").alias("n_tion"))


def hits(text, word: str):
    """1-based positions of every occurrence of ``word``, which doesn't overlap itself."""
    ends = F.transform(F.split(text, word), lambda x: F.length(x).cast("long"))
    upto = lambda i: F.aggregate(F.slice(ends, 1, i + 1), F.lit(0).cast("long"), lambda a, n: a + n)
    return F.when(F.size(ends) > 1, F.transform(F.sequence(F.lit(0), F.size(ends) - 2), lambda i: upto(i) + i * len(word) + 1))


#: All occurrences of a word, from the lengths of the parts between them.
HITS_SQL = "q AS (SELECT doc_id, text, string_split({of}, '{word}') AS parts FROM documents), n AS (SELECT doc_id, text, unnest(range(1, len(parts))) AS i, unnest(parts) AS part FROM q), p AS (SELECT doc_id, text, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * length('{word}') + 1 AS BIGINT) AS pos FROM n WHERE i IS NOT NULL)"
EVERY = lambda of, word: HITS_SQL.format(of=of, word=word)


@query("exclusion_windows", f"WITH {EVERY('lower(text)', 'the ')} SELECT doc_id, pos FROM p WHERE NOT contains(lower(substr(text, greatest(1, pos - 50), pos + 50 - greatest(1, pos - 50))), 'with')")
def exclusion_windows(spark, d):  # H4, M8: every hit
    p = table(spark, d, "documents").select("doc_id", "text", F.explode(hits(F.lower("text"), "the ")).alias("pos"))
    return p.where(~F.contains(F.lower(X.window(F.col("text"), F.col("pos").cast("int"), 50, 50)), F.lit("with"))).select("doc_id", "pos")


also("exclusion_window", "exclusion_windows")


@query("context_windows", f"WITH {EVERY('text', 'tion')} SELECT doc_id, pos, md5(substr(text, greatest(1, pos - 100), pos + 100 - greatest(1, pos - 100))) AS context FROM p")
def context_windows(spark, d):  # H4: every hit
    p = table(spark, d, "documents").select("doc_id", "text", F.explode(hits(F.col("text"), "tion")).alias("pos"))
    return p.select("doc_id", "pos", F.md5(X.window(F.col("text"), F.col("pos").cast("int"), 100, 100)).alias("context"))


also("context_window", "context_windows")


@query("word_windows", "WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), ' ') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) SELECT doc_id, i AS word, md5(array_to_string(w[greatest(1, i - 6):i + 6], ' ')) AS around FROM p WHERE lower(w[i]) = 'the'")
def word_windows(spark, d):  # H5: six words on either side of every hit
    # A text is cut into words once, not for each hit again, and hits leave without the text.
    p = once(table(spark, d, "documents").select("doc_id", "text"), "words", F.split(X.collapse(F.col("text")), " "))
    found = F.transform("words", lambda w, i: F.when(F.lower(w) == "the", F.struct((i + 1).cast("long").alias("word"), X.words_around(F.col("words"), i + 1, 6).alias("around"))))
    p = catalogue.each(p, "hit", F.filter(found, lambda x: x.isNotNull()))
    return p.select("doc_id", "hit.word", F.md5("hit.around").alias("around"))


also("word_context", "word_windows")


@query("normalize_ws", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) AS clean FROM documents")
def normalize_ws(spark, d):  # H1
    return table(spark, d, "documents").select("doc_id", F.md5(X.collapse(F.col("text"))).alias("clean"))


@query("metric_id_norm", "SELECT DISTINCT p_type, 'cm_' || regexp_replace(regexp_replace(lower(trim(p_type)), '[ -]+', '_', 'g'), '_+', '_', 'g') AS metric_id FROM part")
def metric_id_norm(spark, d):  # H13, H14, H18
    return table(spark, d, "part").select("p_type", X.metric_id(F.col("p_type")).alias("metric_id")).distinct()


@query("url_builder", "SELECT page_id, 'https://example.org/archives/' || CAST(page_id AS VARCHAR) || '/' || replace(lpad(CAST(page_id AS VARCHAR), 4, '0') || '-24-' || '000001', '-', '') || '/' AS link, split_part(url, '/', 3) AS host FROM pages")
def url_builder(spark, d):  # H11
    accession = F.concat(F.lpad(F.col("page_id").cast("string"), 4, "0"), F.lit("-24-000001"))
    return table(spark, d, "pages").select("page_id", X.archive_url(F.lpad(F.col("page_id").cast("string"), 10, "0"), accession).alias("link"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))


@query("content_hash", "SELECT doc_id, sha256(concat_ws('|', source, lang, text)) AS hash FROM documents")
def content_hash(spark, d):  # H15, A19
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("hash"))


@query("keyword_set", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '(the|and|with|of)'))), '|') AS words FROM documents")
def keyword_set(spark, d):  # H9
    return table(spark, d, "documents").select("doc_id", F.array_join(X.keyword_set(F.col("text"), "(the|and|with|of)"), "|").alias("words"))


@query("upper_share", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 THEN round(length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 6) END AS share FROM documents")
def upper_share(spark, d):  # H17
    return table(spark, d, "documents").select("doc_id", F.round(X.upper_share(F.col("text")), 6).alias("share"))


@query("strip_tags", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) AS plain FROM pages")
def strip_tags(spark, d):  # H12
    return table(spark, d, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("plain"))


@query("content_filter", "SELECT coalesce(CASE WHEN coalesce(length(html), 0) < 500 THEN 'too_small' WHEN regexp_matches(lower(html), 'access denied|404 not found|request rate threshold exceeded') THEN 'error_page' END, 'good') AS reason, count(*) AS n FROM pages GROUP BY 1")
def content_filter(spark, d):  # A12
    return readers.valid_content(table(spark, d, "pages"), "html").groupBy(F.coalesce("reject_reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


@query("transcript_roles", "SELECT role, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(role, '^operator') THEN 'operator' WHEN regexp_matches(role, 'analyst|research') THEN 'analyst' WHEN role = 'assistant' THEN 'executive' ELSE 'other' END AS role FROM conversations) GROUP BY role")
def transcript_roles(spark, d):  # A9
    c = table(spark, d, "conversations").withColumn("speaker", F.when(F.col("role") == "assistant", "Chief Executive Officer").otherwise(F.col("role")))
    return readers.transcript_turns(c.drop("role"), "speaker", "text").groupBy("role").agg(F.count("*").alias("n"))


@query("section_carry_forward", """SELECT conv_id, turn, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'cover') AS section FROM (SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN 'mda' WHEN length(text) % 7 = 0 THEN 'business' END AS label FROM conversations)""")
def section_carry_forward(spark, d):  # E5, M2
    n = F.length("text")
    label = F.when(n % 5 == 0, X.section_of(F.lit("MD&A"))).when(n % 7 == 0, X.section_of(F.lit("Business")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").withColumn("label", label).select("conv_id", "turn", F.coalesce(F.last("label", ignorenulls=True).over(w), F.lit("cover")).alias("section"))


@query("segment_neighbourhood", "SELECT conv_id, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS prev, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS next FROM conversations")
def segment_neighbourhood(spark, d):  # E6
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.lag("turn").over(w), F.lit(-1)).alias("prev"), F.coalesce(F.lead("turn").over(w), F.lit(-1)).alias("next"))


@query("definition_alignment", """WITH n AS (SELECT conv_id, turn, string_agg(lower(text), ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS around FROM conversations),
s AS (SELECT conv_id, turn, (CASE WHEN contains(around, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(around, 'with') THEN 1 ELSE 0 END + CASE WHEN contains(around, 'que') THEN 1 ELSE 0 END) AS k FROM n) SELECT conv_id, turn, CASE WHEN k >= 3 THEN 'aligned' WHEN k >= 1 THEN 'partial' ELSE 'unknown' END AS flag FROM s""")
def definition_alignment(spark, d):  # M14: keyword overlap in five segments on either side
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, 5)
    has = [F.max(F.contains(F.lower("text"), F.lit(k)).cast("int")).over(w) for k in ("the", "with", "que")]
    share = (has[0] + has[1] + has[2]) / 3
    flag = F.when(share >= 0.7, "aligned").when(share >= 0.3, "partial").when(share > 0, "not_aligned").otherwise("unknown")
    return table(spark, d, "conversations").select("conv_id", "turn", flag.alias("flag"))


@query("repeat_count_filter", f"WITH {LINES_SQL} SELECT source, line_hash, n FROM (SELECT source, md5(line) AS line_hash, count(*) AS n FROM l WHERE length(line) > 20 GROUP BY ALL) WHERE n > 5")
def repeat_count_filter(spark, d):  # E7
    n = segments(spark, d).where("length(line) > 20").groupBy("source", F.md5("line").alias("line_hash")).agg(F.count("*").alias("n"))
    return n.where("n > 5")


@query("html_segments")
def html_segments(spark, d):  # A4, M1
    return html.segments(table(spark, d, "pages"), "page_id")


@query("table_grid")
def table_grid(spark, d):  # M3: of the tables in filings, as pages have none; filing_tables is its counterpart with SQL
    return html.table_grid(filings(spark, d).select("filing_id", "html"), "filing_id", columns=["row", "col", "text", "is_header", "is_stub"])


