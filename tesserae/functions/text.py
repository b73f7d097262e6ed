"""Text functions as Columns: white space, tokens, n-grams, windows, ids, links, issuer and section rules."""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def definition_text(text: Column, most: int = 500) -> Column:
    t = collapse(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def tokens(text: Column, stop: list[str], least: int = 3) -> Column:
    """Lower-case words of a letter and letters, digits or underscores; short ones and stop words out, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_]+"), 0)
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(stop))


def ngrams(words: Column, n: int) -> Column:
    """Phrases of ``n`` words, in order."""
    last = F.size(words) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " ")))


def window(text: Column, at: Column, before: int, after: int) -> Column:
    """Characters around the 1-based position ``at``."""
    first = F.greatest(F.lit(1), at - before)
    return F.substr(text, first, at + after - first)


def word_window(text: Column, index: Column, n: int) -> Column:
    return words_around(F.split(collapse(text), " "), index, n)


def words_around(words: Column, index: Column, n: int) -> Column:
    """The word at the 1-based ``index`` and ``n`` on either side."""
    first = F.greatest(F.lit(1), index - n)
    return F.array_join(F.slice(words, first, index + n - first + 1), " ")


def metric_id(label: Column) -> Column:
    """lower case, blanks and dashes to one underscore, with the cm_ prefix."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[\s\-]+", "_"), "_+", "_")
    return F.when(x.startswith("cm_"), x).otherwise(F.concat(F.lit("cm_"), x))


def title(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def archive_url(cik: Column, accession: Column) -> Column:
    plain = F.coalesce(F.nullif(F.ltrim(cik, F.lit("0")), F.lit("")), F.lit("0"))
    return F.concat(F.lit("https://example.org/archives/"), plain, F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def keyword_set(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0), F.lower)))


def upper_share(text: Column) -> Column:
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    return F.length(F.regexp_replace(text, "[^A-Z]", "")) / F.nullif(F.length(letters), F.lit(0))


def strip_tags(html: Column) -> Column:
    return collapse(F.regexp_replace(html, "<[^>]*>", " "))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# Headings of the sections, first match wins; tested on upper-case text.
SECTIONS = [
    ("risk_factors", r"^ITEM\s*1A[.:]?\s*RISK\s*FACTORS"),
    ("risk_factors", r"^RISK\s*FACTORS$"),
    ("risk_factors", r"^PART\s*II?\s*[-:]\s*RISK\s*FACTORS"),
    ("mda", r"^ITEM\s*7[.:]?\s*MANAGEMENT.{0,5}S?\s*DISCUSSION"),
    ("mda", r"^MANAGEMENT.{0,5}S?\s*DISCUSSION\s*(AND|&)\s*ANALYSIS"),
    ("mda", r"^MD\s*&?\s*A$"),
    ("mda", r"^RESULTS\s*OF\s*OPERATIONS$"),
    ("mda", r"^[A-Z][A-Z\s&.,'-]{0,40}(?:S|'S)?\s*MANAGEMENT.{0,15}S?\s*DISCUSSION"),
    ("business", r"^ITEM\s*1[.:]?\s*BUSINESS$"),
    ("business", r"^BUSINESS$"),
    ("business", r"^DESCRIPTION\s*OF\s*BUSINESS"),
    ("financials", r"^ITEM\s*8[.:]?\s*FINANCIAL\s*STATEMENTS"),
    ("financials", r"^FINANCIAL\s*STATEMENTS\s*(AND|&)\s*SUPPLEMENTARY"),
    ("financials", r"^CONSOLIDATED\s*(BALANCE\s*SHEETS?|STATEMENTS?)"),
    ("notes", r"^NOTES?\s*TO\s*(THE\s*)?(CONSOLIDATED\s*)?FINANCIAL"),
    ("notes", r"^NOTE\s*\d+"),
    ("exhibits", r"^ITEM\s*15[.:]?\s*EXHIBITS"),
    ("exhibits", r"^EXHIBITS?\s*(AND|&)\s*FINANCIAL"),
    ("exhibits", r"^EXHIBIT\s*INDEX"),
    ("signatures", r"^SIGNATURES?$"),
    ("signatures", r"^POWER\s*OF\s*ATTORNEY"),
    ("key_metrics", r"^KEY\s*BUSINESS\s*METRICS?$"),
    ("key_metrics", r"^KEY\s*OPERATING\s*METRICS?$"),
    ("key_metrics", r"^BUSINESS\s*HIGHLIGHTS?$"),
    ("key_metrics", r"^OPERATING\s*HIGHLIGHTS?$"),
    ("key_metrics", r"^Q[1-4]\s*\d{4}\s*HIGHLIGHTS?$"),
    ("financial_overview", r"^FINANCIAL\s*HIGHLIGHTS?$"),
    ("guidance", r"^FY\s*\d{4}\s*OUTLOOK$"),
    ("guidance", r"^Q[1-4]\s*\d{4}\s*(OUTLOOK|GUIDANCE)$"),
]


def section_of(heading: Column) -> Column:
    """The section that a line opens, or null. Headings have 200 characters at most."""
    runs = [(s, "|".join(p for _, p in of)) for s, of in groupby(SECTIONS, lambda x: x[0])]  # neighbours of one section are one look
    opened = lambda line: F.coalesce(*[F.when(line.rlike(p), F.lit(s)) for s, p in runs])
    return let(F.translate(F.upper(collapse(heading)), "\u2019", "'"), lambda line: F.when(F.length(line) <= 200, opened(line)))


# Industry codes and phrases of the issuer classes.
FUNDS, EXTRACTION = ["6722", "6726"], ["1311", "1381", "1040", "1220"]
IN_SCOPE_FORMS = ["S-1", "S-1/A", "F-1", "F-1/A"]


def is_blank_check(name: Column, sic: Column, text: Column) -> Column:
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 10_000))
    strong = F.contains(head, F.lit("blank check company")) | F.contains(head, F.lit("special purpose acquisition")) | F.contains(head, F.lit("blank checks [6770]"))
    has = lambda *words: reduce(and_, [F.contains(head, F.lit(w)) for w in words]).cast("int")
    weak = has("initial business combination") + has("target business", "acquisition") + has("sponsor", "founder shares")
    return F.coalesce(sic == "6770", F.lit(False)) | F.coalesce(name.rlike(r"(?i)\bacquisition\s+(corp|company|co|inc|holdings)\b|\bSPAC\b|\bblank\s+check\b"), F.lit(False)) | strong | (weak >= 2)


def is_fund(name: Column, sic: Column) -> Column:
    return F.coalesce(sic.isin(FUNDS) & name.rlike(r"(?i)\b(fund|trust|ETF|REIT)\b"), F.lit(False))


def is_extraction(name: Column, sic: Column) -> Column:
    return F.coalesce(sic.isin(EXTRACTION) & name.rlike(r"(?i)\b(oil|gas|mining|petroleum|resources|energy)\b"), F.lit(False))


def offering_type(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 5_000))
    primary, secondary = head.rlike("we are offering|initial public offering|shares offered by us"), head.rlike("selling (stock|share)holders|secondary offering")
    return F.when(primary & secondary, "mixed").when(primary, "primary").when(secondary, "secondary")


def in_scope(form: Column, first_time: Column, blank_check: Column, post_combination: Column, fund: Column, extraction: Column, offering: Column) -> Column:
    return form.isin(IN_SCOPE_FORMS) & (first_time | post_combination) & (~blank_check | post_combination) & ~fund & ~extraction & (F.coalesce(offering, F.lit("")) != "secondary")


# Speaker roles of transcripts, first match wins.
ROLES = [("operator", r"(?i)^operator"), ("analyst", r"(?i)analyst|research"), ("executive", r"(?i)chief|CEO|CFO|president|officer"), ("investor_relations", r"(?i)investor relations|\bIR\b")]


def speaker_role(speaker: Column) -> Column:
    return F.coalesce(*[F.when(speaker.rlike(p), F.lit(r)) for r, p in ROLES], F.lit("other"))


WHOLE_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def repair_json(text: Column) -> Column:
    """Fences and text around the outermost braces off, trailing commas out; an open string and open
    brackets are closed, the innermost first."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)^.*?(?=[{\[])", ""), r"(?s)```.*$", "")
    body = F.regexp_replace(F.trim(body), r",\s*([}\]])", "$1")
    body = F.regexp_replace(body, r",\s*$", "")

    def read(close: Column, c: Column) -> Column:
        """What must still be closed behind a bracket, innermost first."""
        opened = F.when(c == "{", F.concat(F.lit("}"), close)).when(c == "[", F.concat(F.lit("]"), close))
        return opened.otherwise(F.substr(close, F.lit(2)))

    def closed(body: Column, plain: Column) -> Column:
        said = F.contains(plain, F.lit('"'))  # whole strings are off, so what is left begins the open one
        brackets = F.regexp_extract_all(F.substring_index(plain, '"', 1), F.lit(r"[{}\[\]]"), F.lit(0))
        return F.concat(body, F.when(said, '"').otherwise(""), F.aggregate(brackets, F.lit(""), read))

    return let(body, lambda b: let(F.regexp_replace(b, WHOLE_STRING, ""), lambda plain: closed(b, plain)))
