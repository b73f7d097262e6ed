"""Issuer classes by industry code, name and the head of a filing's text.

A class is a row of data: codes that decide by themselves, words of names (with what else the name or the code must have),
and phrases of the text's first HEAD characters. One function turns any such row into a Column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD, COMBINATION_HEAD = 10_000, 20_000


@dataclass(frozen=True)
class Issuers:
    """``phrases`` are alternatives; each is a list of groups that must all occur, by any phrase of the group."""

    name: str
    codes: list[str]
    words: list[str]
    phrases: list[list[list[str]]]
    code_starts: str = ""  # what the code must start with for a word of the name to count
    beside: tuple[str, ...] = ()  # words of which the name must have one as well


# Fixed values.
CLASSES = [
    Issuers("saas", ["7372", "7371", "7370", "7373", "7374"], ["saas", "software", "cloud"], [[["software as a service", "saas"], ["subscription", "recurring revenue"]]], code_starts="7"),
    Issuers("ecommerce", ["5961", "5940", "5900"], ["marketplace", "commerce", "retail", "shop", "store", "merchant", "seller", "buyer", "trading"], [[["gross merchandise value", "gmv"]], [["marketplace"], ["commission"]], [["take rate"]]]),
    Issuers("fintech", ["6199"], ["fintech", "financial technology", "payment", "wallet", "exchange", "blockchain", "crypto"], [[["cryptocurrency", "blockchain"], ["payment processing", "digital wallet"]]], code_starts="6"),
    Issuers("health", ["8071", "8090", "8000"], ["health", "medical", "telehealth", "telemedicine", "healthcare", "patient", "clinical", "therapeutics"], [[["digital health", "health technology", "telemedicine", "telehealth", "patient platform"]]], beside=("tech", "digital", "platform", "software", "data")),
    Issuers("media", ["7380", "4899"], ["media", "streaming", "content", "entertainment", "publishing", "video", "music", "podcast"], [[["streaming"], ["subscribers"]], [["content platform"]], [["subscription revenue"], ["viewers"]]]),
    Issuers("telecom", ["4813", "4899", "4833"], ["telecom", "wireless", "communications", "network", "broadband", "cellular", "mobile"], []),
    Issuers("platform", ["7389", "7380"], ["platform", "network", "connect", "marketplace"], [[["network effects"]], [["two-sided market", "multi-sided platform"]], [["platform business"]]]),
]
# Never fintech: vehicles by name (but "funding" is no fund), makers of mining hardware by name or text.
VEHICLES, HARDWARE = ["etf", "fund", "trust"], ["mining equipment", "asic manufacturer", "hardware manufacturer"]
# A former blank check that has combined: its agreement, and statements or an operating business.
COMBINATION = ["business combination", "de-spac", "merger agreement"]
STATEMENTS, COSTS = ["consolidated statements of operations", "consolidated balance sheets"], ["cost of revenue", "cost of sales"]


def _low(x: Column, most: int | None = None) -> Column:
    x = F.coalesce(x, F.lit(""))
    return F.lower(F.substring(x, 1, most) if most else x)


def _has(x: Column, phrases) -> Column:
    return x.rlike("|".join(phrases))


def classified(c: Issuers, name: Column, code: Column, text: Column) -> Column:
    """'code', 'name' or 'text', whichever tells first that an issuer is of the class; null if none does."""
    low, head, code = _low(name), _low(text, HEAD), F.coalesce(code, F.lit(""))
    by_name = _has(low, c.words) & code.startswith(c.code_starts)
    if c.beside:
        by_name = by_name & _has(low, c.beside)
    by_text = reduce(or_, [reduce(and_, [_has(head, group) for group in groups]) for groups in c.phrases], F.lit(False))
    return F.when(code.isin(c.codes), "code").when(by_name, "name").when(by_text, "text")


def no_fintech(name: Column, code: Column, text: Column) -> Column:
    low, code = _low(name), F.coalesce(code, F.lit(""))
    vehicle = _has(low, VEHICLES) & ~F.contains(low, F.lit("funding"))
    maker = F.contains(low, F.lit("canaan")) | (F.contains(low, F.lit("mining")) & (code != "") & ~code.startswith("6"))
    return vehicle | maker | _has(_low(text, HEAD), HARDWARE)


def industry(name: Column, code: Column, text: Column) -> dict[str, Column]:
    """For each class a Column that says how it was found, or null."""
    found = {c.name: classified(c, name, code, text) for c in CLASSES}
    return found | {"fintech": F.when(~no_fintech(name, code, text), found["fintech"])}


def is_post_combination(blank_check: Column, earlier_blank_check: Column, text: Column) -> Column:
    """Of issuers that were a blank check before: those that are none now, or whose text tells of a combination and has
    statements, or more than five mentions of revenue and its costs."""
    head = _low(text, COMBINATION_HEAD)
    operating = (F.regexp_count(head, F.lit("revenue")) > 5) & _has(head, COSTS)
    done = _has(head, COMBINATION) & (_has(head, STATEMENTS) | operating)
    return F.coalesce(earlier_blank_check, F.lit(False)) & (~F.coalesce(blank_check, F.lit(False)) | done)
