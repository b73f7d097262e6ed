"""Metric phrases as data: what candidate generation looks for, and what keeps a match from counting."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import let_list

# Metric, patterns (longer ones first), exclusions within 50 characters. A pattern of several words is
# specific. Other catalogues of this form can be given to the functions below, for example from a YAML file.
METRICS = [
    ("cm_active_customers_total", [r"\bactive\s+customers?\b", r"\bactive\s+accounts?\b", r"\bactive\s+buyers?\b"], []),
    ("cm_customers_period_end", [r"\btotal\s+customers?\b", r"\bpaid\s+customers?\b", r"\btotal\s+subscribers?\b"], []),
    ("cm_new_customers_acquired", [r"\bnet\s+new\s+customers?\b", r"\bnew\s+customers?\b", r"\bcustomers?\s+acquired\b"], []),
    ("cm_monthly_active_users", [r"\bmonthly\s+active\s+users?\b", r"\bMAUs?\b"], []),
    ("cm_daily_active_users", [r"\bdaily\s+active\s+users?\b", r"\bDAUs?\b"], []),
    ("cm_net_revenue_retention", [r"\bnet\s+(?:revenue|dollar)\s+retention\b", r"\bNRR\b"], []),
    ("cm_gross_revenue_retention", [r"\bgross\s+(?:revenue|dollar)\s+retention\b"], []),
    ("cm_customer_churn_rate", [r"\bcustomer\s+churn(?:\s+rate)?\b", r"\bchurn\s+rate\b"], [r"\bemployee\b"]),
    ("cm_average_order_value", [r"\baverage\s+order\s+value\b", r"\bAOV\b"], []),
    ("cm_gmv", [r"\bgross\s+merchandise\s+(?:volume|value)\b", r"\bGMV\b"], []),
    ("cm_customer_acquisition_cost", [r"\bcustomer\s+acquisition\s+costs?\b", r"\bCAC\b"], [r"\bpayback\b"]),
    ("cm_revenue_per_customer", [r"\b(?:average\s+)?revenue\s+per\s+(?:user|customer|account)\b", r"\bARPU\b"], []),
]

HIT = "struct<metric_id:string,match:string,start:int,end:int,specific:boolean>"


def one_of(patterns: list[str]) -> str:
    """One alternation, in this order. Where all begin with a word's bound, it is asked for once a place and not once a pattern."""
    bare = [re.sub(r"\([^()]*\)", "", p) for p in patterns]
    if all(p.startswith(r"\b") and "|" not in b for p, b in zip(patterns, bare, strict=True)):
        return r"(?i)\b(?:" + "|".join(p[2:] for p in patterns) + ")"
    return "(?i)" + "|".join(patterns)


def any_pattern(metrics=METRICS) -> str:
    """One alternation of all patterns: most segments stop at it."""
    return one_of([p for _, patterns, _ in metrics for p in patterns])


def words_in(pattern: str) -> list[str]:
    """Letters and digits, in lower case, that every match of a pattern holds. None where that isn't plain to see: unknown escapes,
    flags that change letters or comments, alternatives outside groups."""
    if re.search(r"\\[^bBsSwWdD\W]|\(\?[a-zA-Z^-]*[xuU]|\[\^?\]|[^\x00-\x7f]", pattern):
        return []
    bare = re.sub(r"\\.", "\0", pattern)
    if re.search(r"\[[^\]]*\[", bare):
        return []
    bare = re.sub(r"\[[^\]]*\]", "\0", bare)
    while (less := re.sub(r"\([^()]*\)", "\0", bare)) != bare:
        bare = less
    if re.search(r"[()|]", bare):
        return []
    bare = re.sub(r".(?:[?*]|\{[^}]*\})[?+]?", "\0", bare)  # what may be absent
    return sorted({w.lower() for w in re.findall(r"[A-Za-z0-9]{2,}", bare)}, key=lambda w: (-len(w), w))


def may_match(text: Column, lower: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns can match, by the words that its matches hold; looking for words costs a fraction of a pattern. A
    pattern without such words is tried itself."""
    held = [reduce(and_, [F.contains(lower, F.lit(w)) for w in words]) if (words := words_in(p)) else text.rlike("(?i)" + p) for p in patterns]
    return reduce(or_, held)


def spans(text: Column, pattern: str) -> Column:
    """match and its place (0-based start, end) of every match, from the lengths of the matches and of what lies between."""
    upto = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))

    def places(found: Column, gaps: Column) -> Column:
        return F.transform(found, lambda m, i: F.struct(m.alias("match"), (upto(gaps, i + 1) + upto(found, i)).alias("start"), (upto(gaps, i + 1) + upto(found, i + 1)).alias("end")))

    # The text is read twice in all, not for each match again; without a match it is read once.
    none = F.array().cast("array<struct<match:string,start:int,end:int>>")
    # Split would compile a pattern for every text; a noncharacter in the matches' place needs none.
    gaps = F.split(F.regexp_replace(F.replace(text, F.lit("\uffff"), F.lit("\ufffe")), pattern, "\uffff"), "\uffff")
    read = lambda found: F.when(F.size(found) > 0, let_list(gaps, lambda gaps: places(found, gaps))).when(found.isNotNull(), none)
    return let_list(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), read)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, although several others are taken from it: a generator is a
    boundary that the optimiser doesn't copy expressions across. The value itself is computed in a projection before it, which is
    compiled in methods of a fit size; a generator with a lambda would evaluate all of it node by node."""
    return df.withColumn("_once", value).withColumn(name, F.explode(F.array("_once"))).drop("_once")


def each(df: DataFrame, name: str, values: Column) -> DataFrame:
    """A row for each of these values. The optimiser asks before an explode whether its array has any and computes the array
    for that once or twice more; behind a generator of one row it is a column, computed once."""
    return once(df, "_all", values).withColumn(name, F.explode("_all")).drop("_all")


def candidates(text: Column, metrics=METRICS) -> Column:
    """Array of HIT: every mention of every metric that no exclusion within 50 characters rules out."""
    def of(lower: Column, metric: str, patterns: list[str], exclusions: list[str]) -> Column:
        return F.when(may_match(text, lower, patterns), _hits(text, metric, patterns, exclusions))

    return F.when(text.isNotNull(), let_list(F.lower(text), lambda lower: F.flatten(F.array_compact(F.array(*[of(lower, *entry) for entry in metrics])))))


def named(text: Column, versions: list[tuple[str, list[str], list[str], Column]]) -> Column:
    """Array of the last members of these entries (metric, patterns, exclusions, what to give) that are mentioned. Places are only
    looked for where exclusions need them."""

    def given(lower: Column, metric: str, patterns: list[str], exclusions: list[str], give: Column) -> Column:
        said = F.size(_hits(text, metric, patterns, exclusions)) > 0 if exclusions else text.rlike(one_of(patterns))
        return F.when(may_match(text, lower, patterns) & said, give)

    return let_list(F.lower(text), lambda lower: F.array_compact(F.array(*[given(lower, *v) for v in versions])))


def _hits(text: Column, metric: str, patterns: list[str], exclusions: list[str]) -> Column:
    found = spans(text, one_of(patterns))
    for x in exclusions:
        found = _without(text, found, "(?i)" + x)
    return F.transform(found, lambda h: F.struct(F.lit(metric).alias("metric_id"), h["match"].alias("match"), h["start"].alias("start"), h["end"].alias("end"), h["match"].rlike(r"\s").alias("specific")))


def _without(text: Column, found: Column, exclusion: str) -> Column:
    first = lambda h: F.greatest(F.lit(0), h["start"] - 50)
    return F.filter(found, lambda h: ~F.substr(text, first(h) + 1, h["end"] + 50 - first(h)).rlike(exclusion))
