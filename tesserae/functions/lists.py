"""Parallel lists: values and periods that a sentence pairs by the word respectively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let

# How far the lists may lie apart, what a period and a value look like, and the parts of the confidence.
MOST = 200
PERIOD = r"(?:20[0-2]\d|19[89]\d|Q[1-4]|(?:first|second|third|fourth)\s+quarter)"
VALUE = (
    r"(?:\$\s*[\d,]*\d(?:\.\d+)?(?:\s*(?:million|billion|thousand|mn|bn|k|m|b)\b)?|\d[\d,]*(?:\.\d+)?%|\d[\d,]*(?:\.\d+)?\s+percent"
    r"|\d[\d,]*(?:\.\d+)?\s*(?:million|billion|thousand|mn|bn|k|m|b)\b|\d[\d,]*\.\d+)"
)
BASE, EACH, SURE = 0.5, 0.1, 0.6

_NEXT = r"(?:\s*,\s*(?:and\s+)?|\s+and\s+)"
_SENTENCE = r"(?<=[.!?])\s+(?=[A-Z])"


def _list(item: str) -> str:
    return rf"(?i)(?<![\w$.]){item}(?:{_NEXT}{item})+"


def respectively(text: Column, least: float = SURE) -> Column:
    """Array of value, period and confidence: of every sentence that says respectively, the lists of equal length before
    that word, no more than MOST characters apart. Null and other texts have none."""
    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), _SENTENCE), lambda s: s.rlike(r"(?i)\brespectively\b"))
    heads = F.transform(sentences, lambda s: F.regexp_extract(s, r"(?is)^(.*?)\brespectively\b", 1))
    # What the parts below take several times is computed once: each step's array holds what the next one takes.
    found = F.transform(heads, lambda h: F.struct(h.alias("h"), F.regexp_extract(h, _list(PERIOD), 0).alias("p"), F.regexp_extract(h, _list(VALUE), 0).alias("v")))
    items = lambda c, item: F.regexp_extract_all(c, F.lit("(?i)" + item), F.lit(0))
    found = F.transform(found, lambda x: F.struct(x["h"].alias("h"), x["p"].alias("p"), x["v"].alias("v"), items(x["v"], VALUE).alias("values"), items(x["p"], PERIOD).alias("periods")))
    found = F.filter(found, lambda x: (F.size(x["values"]) == F.size(x["periods"])) & (F.size(x["values"]) > 1))

    def paired(x: Column) -> Column:
        values, periods = x["values"], x["periods"]
        apart = F.instr(x["h"], x["v"]) - F.instr(x["h"], x["p"])
        good = F.abs(apart) - F.length(x["p"]) <= MOST
        sure = F.lit(BASE)
        years = F.transform(periods, lambda p: p.try_cast("int"))
        steps = F.forall(F.sequence(F.lit(1), F.size(years) - 1), lambda k: F.coalesce(F.get(years, k) == F.get(years, k - 1) + 1, F.lit(False)))
        alike = F.forall(values, lambda v: v.rlike("%|percent")) | F.forall(values, lambda v: F.contains(v, F.lit("$")))
        last = r"(?i)\band\s+{}\s*$"
        for test in (x["v"].rlike(last.format(VALUE)), x["p"].rlike(last.format(PERIOD)), steps, alike, F.abs(apart) < MOST):
            sure = sure + F.when(test, EACH).otherwise(0.0)
        pairs = lambda sure: F.transform(F.arrays_zip(values.alias("v"), periods.alias("p")), lambda z: F.struct(z["v"].alias("value"), z["p"].alias("period"), sure.alias("confidence")))
        none = F.array().cast("array<struct<value:string,period:string,confidence:double>>")
        return F.when(good, let(F.round(sure, 2), lambda sure: F.when(sure >= least, pairs(sure)).otherwise(none))).otherwise(none)

    return F.flatten(F.transform(found, paired))
