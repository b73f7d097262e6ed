"""What a change of the catalogue would do to the scores: two catalogues over the segments in one pass.

Metrics that the change leaves alone are looked for once; of a changed metric both versions are. So a pass costs the old
catalogue and what is new, and one shuffle of the hits by document and metric serves both scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue

REGRESSION = 1e-4  # of recall, from which on a drop counts


def patched(metrics: list, added: dict[str, list[str]] = {}, removed: dict[str, list[str]] = {}, exclusions: dict[str, list[str]] = {}) -> list:  # noqa: B006  never written to
    """The catalogue with patterns added and removed and exclusions appended, by metric."""
    known = {m for m, _, _ in metrics}
    new = [(m, list(p), list(exclusions.get(m, []))) for m, p in added.items() if m not in known]
    changed = [(m, [p for p in patterns if p not in removed.get(m, [])] + list(added.get(m, [])), [*out, *exclusions.get(m, [])]) for m, patterns, out in metrics]
    return [(m, p, x) for m, p, x in changed + new if p]


def presence(segments: DataFrame, key: str, before: list, after: list) -> DataFrame:
    """key, metric_id, before and after: whether each catalogue finds the metric in the document. Rows that neither finds
    don't exist."""
    old, new = {m: (p, x) for m, p, x in before}, {m: (p, x) for m, p, x in after}
    same = [(m, *old[m]) for m in old if new.get(m) == old[m]]
    gone, come = [(m, *old[m]) for m in old if new.get(m) != old[m]], [(m, *new[m]) for m in new if old.get(m) != new[m]]

    def entries(metrics: list, was: bool, is_: bool) -> list:
        return [(*entry, F.struct(F.lit(entry[0]).alias("metric_id"), F.lit(was).alias("before"), F.lit(is_).alias("after"))) for entry in metrics]

    versions = entries(same, True, True) + entries(gone, True, False) + entries(come, False, True)
    hits = catalogue.each(segments, "h", catalogue.named(F.col("text"), versions)).select(key, "h")
    return hits.groupBy(key, F.col("h.metric_id").alias("metric_id")).agg(F.bool_or("h.before").alias("before"), F.bool_or("h.after").alias("after"))


def scores(found: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """By metric: precision, recall and F1 before and after (null without a ground for them), coverage and deltas. ``gold``
    has key and metric_id, a row for each fact that somebody has stated; metrics without any can't be judged."""
    truth = gold.groupBy(key, "metric_id").agg(F.count("*").alias("facts"))
    judged = gold.select("metric_id").distinct()
    both = found.join(judged, "metric_id", "left_semi").join(truth, [key, "metric_id"], "full_outer")
    true = F.col("facts").isNotNull()
    sums = []
    for v in ("before", "after"):
        hit = F.coalesce(F.col(v), F.lit(False))
        sums += [F.count_if(hit & true).alias(f"tp_{v}"), F.count_if(hit & ~true).alias(f"fp_{v}"), F.count_if(~hit & true).alias(f"fn_{v}")]
    out = both.groupBy("metric_id").agg(*sums, F.count_if(true).alias("coverage_documents"), F.coalesce(F.sum("facts"), F.lit(0)).alias("coverage_facts"))
    for v in ("before", "after"):
        tp, fp, fn = (F.col(f"{c}_{v}") for c in ("tp", "fp", "fn"))
        ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
        out = out.withColumns({f"precision_{v}": ratio(tp, tp + fp), f"recall_{v}": ratio(tp, tp + fn), f"f1_{v}": ratio(2 * tp, 2 * tp + fp + fn)})
    return out.withColumns({f"{c}_delta": F.round(F.col(f"{c}_after") - F.col(f"{c}_before"), 6) for c in ("precision", "recall", "f1")})


def tier_recall(by_metric: DataFrame, tiers: dict[str, list[str]]) -> DataFrame:
    """tier, recall before and after over all its metrics' documents, and whether it regressed."""
    rows = [F.when(F.col("metric_id").isin(list(metrics)), F.lit(name)) for name, metrics in tiers.items()]
    tiered = by_metric.withColumn("tier", F.explode(F.array_compact(F.array(*rows))))
    recall = lambda v: F.round(F.sum(f"tp_{v}") / F.nullif(F.sum(F.col(f"tp_{v}") + F.col(f"fn_{v}")), F.lit(0)), 6)
    out = tiered.groupBy("tier").agg(recall("before").alias("recall_before"), recall("after").alias("recall_after"))
    return out.withColumn("regressed", F.coalesce(F.col("recall_after") - F.col("recall_before") < -REGRESSION, F.lit(False)))
