"""Images in filings: every line item of an order becomes an image with a caption, in one of nine forms, under a heading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import triage
from ..sources import html
from .base import query, table
from .dataflow import HEADINGS, spread

APART = "plain words go on and on here " * 20  # more than the text that counts as nearby
FORMS = [  # file name, width, height, caption
    ("logo_{n}.png", 200, 120, "Our mark."),
    ("sign-{n}.png", 400, 90, "The president."),
    ("photo{n}.png", 900, 300, "Schedule of customers."),
    ("chart_{n}.png", 900, 700, "A stacked bar of users."),
    ("banner-{n}.png", 1000, 100, "Welcome."),
    ("photo{n}.jpg", 600, 500, "Our hall and its subscribers."),
    ("img{n}.gif", 0, 0, "Cohort retention, churn and growth of revenue."),
    ("dot{n}.gif", 20, 20, "Item."),
    ("page{n}.jpg", 1000, 1300, "Scanned."),
]


def illustrated(spark, d) -> DataFrame:
    """filing_id and html of every order: of every fifth all images are page scans, of every fifth they share one file. Other
    files are numbered by their place in the filing, since a line's number may occur in an order any number of times."""
    # Only numbers of lines are sorted for the groups; texts are made of them behind it, a page at a time.
    lines = table(spark, d, "lineitem")
    body = spread(lines, "l_orderkey", lines.count()).groupBy(F.col("l_orderkey").alias("filing_id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    body = body.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("filing_id")).hint("merge"), "filing_id")
    o = F.col("filing_id")

    def block(n, i):
        form = F.when(o % 5 == 0, 8).otherwise((o + n) % len(FORMS)).cast("int")
        pick = lambda k: F.get(F.array(*[F.lit(f[k]) for f in FORMS]), form)
        name = F.when(o % 5 == 1, "spacer.gif").otherwise(F.replace(pick(0), F.lit("{n}"), i.cast("string")))
        heading = F.get(F.array(*map(F.lit, HEADINGS)), (n % len(HEADINGS)).cast("int"))
        return F.concat(
            F.lit("<h2>"), heading, F.lit(f"</h2><p>{APART}</p><p>"), pick(3), F.lit('</p><img src="/a/'), name, F.lit('?v=1" width="'), pick(1).cast("string"), F.lit('px" height="'), pick(2).cast("string"), F.lit(f'"><p>{APART}</p>'),
        )

    return body.select("filing_id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("lines", block), ""), F.lit("</body></html>")).alias("html"))


# A filing has some 1,210 characters a line besides captions, so images outnumber its pages of text by 1.6.
TRIAGE_SQL = """WITH l AS (
  SELECT l_orderkey AS filing_id, l_linenumber AS n, l_orderkey % 5 AS o5, CASE WHEN l_orderkey % 5 = 0 THEN 8 ELSE (l_orderkey + l_linenumber) % 9 END AS form, count(*) OVER (PARTITION BY l_orderkey) AS lines,
         ['mda', 'business', 'risk_factors', 'key_metrics'][l_linenumber % 4 + 1] AS section FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
), c AS (
  SELECT *, o5 = 1 AND lines > 5 AS often, form IN (6, 8) AND lines >= 5 AND count(*) FILTER (WHERE form IN (6, 8)) OVER (PARTITION BY filing_id) >= 0.7 * lines AS deck,
         CASE WHEN form = 0 THEN 'logo' WHEN form = 1 AND o5 <> 1 THEN 'signature' WHEN form = 2 THEN 'table_image' WHEN form IN (3, 6) THEN 'chart'
              WHEN o5 = 1 OR form IN (4, 7) THEN 'decorative' ELSE 'unknown' END AS class,
         CASE form WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 4 ELSE 0 END AS words,
         CASE section WHEN 'mda' THEN 0.2 WHEN 'business' THEN 0.15 WHEN 'risk_factors' THEN 0.1 ELSE 0 END AS bonus FROM l
), s AS (
  SELECT *, CASE class WHEN 'chart' THEN 0.5 WHEN 'table_image' THEN 0.4 WHEN 'unknown' THEN 0.2 ELSE 0 END + bonus + 0.08 * words AS score FROM c
)
SELECT filing_id, section, CASE WHEN deck THEN 'full_page_scan' WHEN often THEN 'decorative' ELSE class END AS class, CASE WHEN class = 'chart' AND form = 3 AND NOT often THEN 'stacked_bar' ELSE 'unknown' END AS chart_type,
       round(CAST(CASE WHEN deck THEN greatest(CASE WHEN often THEN 0 ELSE least(1, score) END, 0.6) WHEN often THEN 0 ELSE least(1, score) END AS DOUBLE), 4) AS relevance, deck OR NOT often AND score >= 0.3 AS queued,
       NOT deck AND NOT often AND class = 'unknown' AND score >= 0.3 AND score < 0.5 AS manual, count(*) AS n FROM s GROUP BY ALL"""


@query("image_triage", TRIAGE_SQL)
def image_triage(spark, d):  # M4, I19: class by priority, relevance, repeated files, decks of page scans
    found = triage.triage(html.images(illustrated(spark, d), "filing_id"), "filing_id")
    return found.groupBy("filing_id", "section", "class", "chart_type", "relevance", "queued", "manual").agg(F.count("*").alias("n"))
