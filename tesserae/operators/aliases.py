"""Names that mean the same metric: an alias map closed to canonical names, and joined before anything is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch

SMALL = 100_000  # names, up to which the closed map is broadcast


def closed(aliases: DataFrame) -> DataFrame:
    """alias and canonical of a map (alias, canonical) in which a canonical name may itself be an alias: each alias with the end
    of its chain. Each round follows every chain twice as far, so there are as many as the logarithm of the longest.
    An alias of several names keeps the least; a circle has no end, so its names stay as they are."""
    scratch = Scratch(aliases.sparkSession, "aliases")
    now = aliases.where("alias is not null and canonical is not null and alias != canonical").groupBy("alias").agg(F.min("canonical").alias("canonical"))
    now = scratch.again(now)
    most, steps = now.count(), 1
    while steps <= 2 * most:  # a chain has no more links than there are aliases
        up = now.select(F.col("alias").alias("canonical"), F.col("canonical").alias("next"))
        further = scratch.again(now.join(up, "canonical", "left").select("alias", F.coalesce("next", "canonical").alias("canonical")))
        moved = further.join(now, ["alias", "canonical"], "left_anti").limit(1).count()
        now, steps = further, steps * 2
        if not moved:
            break
    # What still has a next name after so many steps is in a circle or leads into one.
    return now.join(now.select(F.col("alias").alias("canonical")), "canonical", "left_anti").where("alias != canonical").select("alias", "canonical")


def canonical(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``df`` with the canonical names in ``column``; names that are no alias stay. ``known`` is a closed map."""
    known = known.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    known = F.broadcast(known) if known.count() <= SMALL else known
    out = df.join(known, F.col(column) == F.col("_alias"), "left")
    return out.withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")
