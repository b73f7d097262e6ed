"""All queries of the engine, each with the SQL of the same result where SQL can express it."""

from __future__ import annotations

from . import analytics, dataflow, dedup, definitions, documents, extraction, formats, images, mining, models, relational, scoring, simulation, tables, values  # noqa: F401  they register themselves
from .base import ORACLES, QUERIES  # noqa: F401


def FLAGSHIP(spark, sf_dir):
    return QUERIES["keyword_disclosure"](spark, sf_dir)
