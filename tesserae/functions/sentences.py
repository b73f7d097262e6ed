"""Sentence bounds and lists joined by "respectively", as Arrow-batched functions of text.

Boundaries are sequential: whether a full stop ends a sentence depends on what stood before. So these are pandas
functions; everything else in this package is Columns.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = {"inc", "corp", "co", "ltd", "mr", "mrs", "ms", "dr", "no", "vs", "approx", "u.s", "e.g", "i.e", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec"}


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence. A full stop ends none inside a number, after an abbreviation or a single initial,
    or before a lower-case letter; a blank line or a list mark always begins one."""
    out, begin = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s|$)|\n\s*\n|\n(?=\s*(?:[-*•]|\d+[.)])\s)", text):
        end = m.end()
        if m[0][0] == ".":
            word = re.search(r"([A-Za-z.]+)$", text[begin : m.start()])
            last = word[1].lower() if word else ""
            after = text[end:].lstrip()
            if last in ABBREVIATIONS or (len(last) == 1 and last.isalpha()) or after[:1].islower():
                continue
        if text[begin:end].strip():
            out.append((begin, end))
        begin = end
    if text[begin:].strip():
        out.append((begin, len(text)))
    return [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in out]


def bounds_at(text: str, at: int) -> tuple[int, int]:
    """The sentence around an offset."""
    for a, b in sentence_spans(text):
        if at < b:
            return a, b
    return 0, len(text)


def sentence_bounds(text, at):
    """Column of structs (start, end) for the 0-based offset in ``at``."""

    ship(SparkSession.active())

    @F.pandas_udf("start int, end int")
    def run(texts: pd.Series, offsets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bounds_at(t or "", int(o)) for t, o in zip(texts, offsets.fillna(0), strict=True)], columns=["start", "end"])

    return run(text, at)


_VALUE = r"[$€£]?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|million|billion|thousand)?"
_PERIOD = r"(?:Q[1-4]\s+)?(?:fiscal\s+)?(?:19|20)\d{2}|Q[1-4](?:\s*'\d{2})?"


def respectively_pairs(text: str) -> list[tuple[str, str]]:
    """(value, period) of lists of equal length in a sentence that says respectively."""
    out = []
    for a, b in sentence_spans(text):
        s = text[a:b]
        if not re.search(r"\brespectively\b", s, re.I):
            continue
        join = r"(?:\s*,\s*(?:and\s+)?|\s+and\s+)"
        periods = next((re.findall(_PERIOD, m[0]) for m in re.finditer(rf"(?:{_PERIOD})(?:{join}(?:{_PERIOD}))+", s)), [])
        rest = re.sub(_PERIOD, lambda m: " " * len(m[0]), s)
        values = next((re.findall(_VALUE, m[0]) for m in re.finditer(rf"(?:{_VALUE})(?:{join}(?:{_VALUE}))+", rest)), [])
        if len(values) == len(periods) > 1:
            out += list(zip([v.strip() for v in values], periods, strict=True))
    return out


def respectively(text):
    """Column of arrays of (value, period)."""

    ship(SparkSession.active())

    @F.pandas_udf("array<struct<value:string,period:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"value": v, "period": p} for v, p in respectively_pairs(t or "")])

    return run(text)


def similarity(a, b):
    """The ratio of matching characters in longest matching blocks."""

    ship(SparkSession.active())

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return run(a, b)
