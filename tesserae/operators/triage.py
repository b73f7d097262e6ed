"""Images of documents: class, relevance, what is to be read, and documents that are decks of scanned pages.

What is read from the text near an image is read once and before any shuffle, so texts are neither sent nor sorted. A document's
verdict needs all of its images: sections are carried forward from headings, and file names and page shapes counted, by
windows over one shuffle of what was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogue
from ..functions import text as X
from ..functions.catalogue import once

# Thresholds, sizes in pixels, shares.
PROCESS, AMBIGUOUS, REPEATED = 0.3, 0.5, 5
LOGO_WIDTH, LOGO_HEIGHT, LARGE_WIDTH, LARGE_HEIGHT, TINY, BANNER = 300, 150, 800, 600, 50, 4.0
PAGE_CHARS, PAGE_IMAGES, PAGE_RATIO, PAGE_SHARE = 2000, 5, 1.5, 0.70
PAGE_ASPECT, PAGE_WIDTH = (0.7, 0.85), (900, 1300)
# Words of file names and of the text nearby.
LOGO = r"(?i)\blogo\b|\bicon\b|\bbrand\b|\bemblem\b"
SIGNATURE = r"(?i)\bsignature\b|\bsign[_-]?\d*\b|\bautograph\b"
CHART = r"(?i)\bchart\b|\bgraph\b|\bfigures?\b|\bexhibit\b|\bdiagram\b|\bplot\b"
DECORATIVE = r"(?i)\bbullet\b|\bbanner\b|\bheader\b|\bfooter\b|\bspacer\b|\bdivider\b|\bbackground\b|\bwatermark\b"
CHART_TYPES = [
    ("stacked_bar", ["stacked bar", "stacked chart", "stacked column"]),
    ("bar", ["bar chart", "bar graph", "histogram", "column chart"]),
    ("line", ["line chart", "line graph", "trend line", "time series"]),
    ("pie", ["pie chart", "pie graph", "donut chart", "distribution"]),
    ("area", ["area chart", "area graph", "filled line"]),
]
METRIC_WORDS = ["retention", "cohort", "revenue", "growth", "customers", "arr", "mrr"]
TABLE_WORDS = ["table", "schedule", "summary of", "breakdown"]
FINANCIAL_WORDS = ["revenue", "income", "expense", "total", "period", "year"]
VALUE_WORDS = ["cohort", "retention", "churn", "ltv", "cac", "arr", "mrr", "nrr", "revenue", "customers", "subscribers", "users", "dau", "mau", "engagement", "conversion", "growth", "arpu", "gmv"]
BASE = {"chart": 0.5, "table_image": 0.4, "unknown": 0.2, "decorative": 0.0, "logo": 0.0, "signature": 0.0, "full_page_scan": 0.6}
SECTION = {"mda": 0.2, "business": 0.15, "risk_factors": 0.1, "financials": 0.05}
WORD, MOST_WORDS = 0.08, 0.3


def says(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def named(text: Column, lower: Column, pattern: str) -> Column:
    """Whether a text has an alternation of words. Most texts hold none of its letters, and are not searched for its bounds then."""
    return catalogue.may_match(text, lower, pattern.removeprefix("(?i)").split("|")) & text.rlike(pattern)


def classified() -> Column:
    """The class of an image of filename, nearby, low (nearby in lower case), both (plain file name and nearby, with both_low), type (of a
    chart), width and height (0: unknown), the first that fits, or null; sections have a say where none does."""
    name, near, low, w, h = F.col("filename"), F.col("nearby"), F.col("low"), F.col("width"), F.col("height")
    known, tiny = (w > 0) & (h > 0), (w < TINY) | (h < TINY)
    aspect = F.when(known, F.try_divide(w, h))
    small = known & (w <= LOGO_WIDTH) & (h <= LOGO_HEIGHT)
    logo = ~(known & tiny) & (name.rlike(LOGO) | (small & (named(near, low, LOGO) | aspect.between(0.5, 2.0))))
    signature = F.col("plain").rlike(SIGNATURE) | F.contains(F.lower(name), F.lit("sign")) | named(near, low, SIGNATURE)
    table = says(F.col("both_low"), TABLE_WORDS) | (F.coalesce(aspect >= 2.0, F.lit(False)) & says(low, FINANCIAL_WORDS))
    large = (w >= LARGE_WIDTH) | (h >= LARGE_HEIGHT) | ~((w > 0) | (h > 0))
    chart = named(F.col("both"), F.col("both_low"), CHART) | (F.col("type") != "unknown") | (large & says(low, METRIC_WORDS))
    decorative = name.rlike(DECORATIVE) | (known & (tiny | (aspect >= BANNER) | (aspect <= 0.1)))
    out = F.when(logo, "logo").when(signature, "signature").when(table, "table_image").when(chart, "chart")
    return out.when(F.coalesce(decorative, F.lit(False)), "decorative")


def chart_type(text: Column) -> Column:
    return F.coalesce(*[F.when(says(text, words), F.lit(name)) for name, words in CHART_TYPES], F.lit("unknown"))


def relevance(kind: Column, section: Column, hits: Column) -> Column:
    """Base of the class, bonus of the section, and WORD for each word nearby (``hits``) until their sum reaches MOST_WORDS."""
    base, bonus = F.lit(0.1), F.lit(0.0)
    for name, x in BASE.items():
        base = F.when(kind == name, x).otherwise(base)
    for name, x in SECTION.items():
        bonus = F.when(section == name, x).otherwise(bonus)
    most = -int(-MOST_WORDS / WORD // 1)  # the sum is tested after adding
    return F.round(F.least(F.lit(1.0), base + bonus + F.least(hits, F.lit(most)) * WORD), 4)


def page_shaped() -> Column:
    w, h = F.col("width"), F.col("height")
    return (w <= 0) | (h <= 0) | (F.try_divide(w, h).between(*PAGE_ASPECT) & w.between(*PAGE_WIDTH))


def looked_at(found: DataFrame, key: str) -> DataFrame:
    """_key and what a document's verdict needs of its images and headings, without the texts: early (class before its section is known), type, hits
    (words of values nearby) and page (shaped like one) of images, opened (section) of headings."""
    image = F.col("kind") == "image"
    texts = found.withColumnsRenamed({key: "_key", "text": "filename"}).withColumn("plain", F.regexp_replace(F.lower("filename"), "[_-]", " "))
    texts = once(texts, "t", F.when(image, F.struct(F.lower("nearby").alias("low"), F.concat_ws(" ", "plain", "nearby").alias("both"))))
    texts = texts.select("*", F.col("t.low").alias("low"), F.col("t.both").alias("both"))
    texts = once(texts, "both_low", F.lower("both"))
    # Charts' names are looked for in the file name as it is written, and so in lower case all the same.
    texts = once(texts, "type", F.when(image, chart_type(F.col("both_low"))))
    hits = F.size(F.filter(F.array(*map(F.lit, VALUE_WORDS)), lambda w: F.contains(F.col("low"), w)))
    early, opened = F.when(image, classified()), F.when(~image, X.section_of(F.col("filename")))
    seen = once(texts, "s", F.struct(early.alias("early"), F.when(image, hits).alias("hits"), F.when(image, page_shaped()).alias("page"), opened.alias("opened")))
    return seen.select("_key", "seq", "kind", F.when(image, F.col("filename")).alias("filename"), "chars", "type", "s.*")


def triage(found: DataFrame, key: str) -> DataFrame:
    """key, seq, filename, section, class, chart_type, relevance, queued and manual of the images among ``found`` (what
    ``html.images`` gives)."""
    document = Window.partitionBy("_key")
    so_far = document.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce(F.last("opened", ignorenulls=True).over(so_far), F.lit("unknown"))
    images = looked_at(found, key).withColumn("section", section).where("kind = 'image'")
    n = F.count("*").over(document)
    deck = (n >= PAGE_IMAGES) & (n / F.greatest(F.lit(1.0), F.max("chars").over(document) / PAGE_CHARS) >= PAGE_RATIO) & (F.count_if("page").over(document) / n >= PAGE_SHARE)
    images = images.withColumn("scan", F.coalesce(deck, F.lit(False)) & F.col("page"))
    copies = F.count("*").over(Window.partitionBy("_key", "filename"))
    often = F.col("often")
    images = images.withColumn("often", F.coalesce((F.col("filename") != "") & (copies > REPEATED), F.lit(False)))
    early = F.coalesce("early", F.when(F.col("section").isin("exhibits", "signatures"), "decorative"), F.lit("unknown"))
    images = images.withColumn("class", F.when(often, "decorative").otherwise(early))
    images = images.withColumn("relevance", F.when(often, 0.0).otherwise(relevance(F.col("class"), F.col("section"), F.col("hits"))))
    scan = F.col("scan")
    manual = ~scan & ~often & (F.col("class") == "unknown") & (F.col("relevance") >= PROCESS) & (F.col("relevance") < AMBIGUOUS)
    kind = F.when(F.col("class") == "chart", F.col("type")).otherwise("unknown")
    images = images.withColumns({"manual": manual, "chart_type": F.when(scan, "unknown").otherwise(kind), "queued": scan | (~often & (F.col("relevance") >= PROCESS))})
    images = images.withColumns({"class": F.when(scan, "full_page_scan").otherwise(F.col("class")), "relevance": F.when(scan, F.greatest("relevance", F.lit(BASE["full_page_scan"]))).otherwise(F.col("relevance"))})
    return images.select(F.col("_key").alias(key), "seq", "filename", "section", "class", "chart_type", "relevance", "queued", "manual")
