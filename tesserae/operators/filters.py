"""Predicates that SQL spells in several clauses, as Column builders."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_not_true(name: str) -> Column:
    """``x IS NOT TRUE``: false and null both pass."""
    return ~F.coalesce(F.col(name), F.lit(False))


def none_of_or_null(name: str, values: list) -> Column:
    """The bucket of all others; null belongs to it."""
    return F.col(name).isNull() | ~F.col(name).isin(values)


def optional(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that were asked for."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def any_of(clauses: dict[str, Column]) -> Column:
    """The names of the clauses that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in clauses.items()]))


def first_of(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*[F.when(c, F.lit(tag)) for tag, c in rules])


_OPS = {
    "eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "ne": lambda c, v: c.isNotNull() & (c != v),
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(v),
    "contains": lambda c, v: F.contains(c, F.lit(v)),
}


def rule(pattern: dict) -> Column:
    """Compiles {logic, conditions: [{field, op, value}]}. An unknown operator, a null operand and an empty list of
    conditions are false."""
    made = [
        F.coalesce(_OPS[c["op"]](F.col(c["field"]), c["value"]), F.lit(False)) if c.get("op") in _OPS and c.get("value") is not None else F.lit(False)
        for c in pattern.get("conditions", [])
    ]
    return reduce(or_ if pattern.get("logic") == "or" else and_, made) if made else F.lit(False)
