"""Validation of ranking models: folds by hash within the class, a fit a fold, curves from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.counting import curves
from ..shared import Scratch
from .base import decisions, query
from .scoring import GOLD_SQL, gold

FOLDS = 5


@query("ranking_curves", f"""+ {GOLD_SQL}, c AS (SELECT metric_id, confidence AS s, count(*) FILTER (WHERE in_gold) AS p, count(*) FILTER (WHERE NOT in_gold) AS n FROM g GROUP BY ALL),
w AS (SELECT *, sum(p) OVER d AS hp, sum(n) OVER d AS hn, sum(p) OVER (PARTITION BY metric_id) AS ap_, sum(n) OVER (PARTITION BY metric_id) AS an FROM c WINDOW d AS (PARTITION BY metric_id ORDER BY s DESC))
SELECT metric_id, CAST(max(ap_) AS BIGINT) AS positives, CAST(max(an) AS BIGINT) AS negatives, CASE WHEN max(ap_) > 0 AND max(an) > 0 THEN round(sum(p * (an - hn + n / 2.0::DOUBLE)) / max(ap_ * an), 6) END AS auc,
       CASE WHEN max(ap_) > 0 AND max(an) > 0 THEN round(sum(p * (hp / (hp + hn)::DOUBLE)) / max(ap_), 6) END AS ap,
       CASE WHEN max(ap_) > 0 AND max(an) > 0 THEN round(max(CASE WHEN hp >= 0.8::DOUBLE * ap_ THEN hp / (hp + hn)::DOUBLE END), 6) END AS best_precision FROM w GROUP BY metric_id""", "facts")
def ranking_curves(spark, d):  # M28, D19: area, average precision and precision at 80 % recall of the confidences against gold
    out = curves(gold(spark, d), "metric_id", "confidence", "in_gold")
    return out.withColumns({c: F.round(c, 6) for c in ("auc", "ap", "best_precision")})


def image_features(spark, d) -> DataFrame:
    """img_id, label (1: some reviewer took a metric from it; 0: only rejects) and 21 features that don't tell the decision: of
    the values, of the progress k, of who looked at it and when. Images that were only skipped are left out."""
    e = decisions(spark, d)
    took, rejected = F.col("decision").isin("accept", "add", "correct"), F.col("decision") == "reject"
    hour, day = F.hour("ts"), F.dayofweek("ts")
    spread = lambda c, n: [f(c).cast("double").alias(f"{n}_{k}") for k, f in (("mean", F.avg), ("least", F.min), ("most", F.max), ("spread", F.stddev_pop))]
    share = lambda cond, n: F.avg(cond.cast("double")).alias(n)
    out = e.groupBy("img_id").agg(
        F.bool_or(took).cast("double").alias("label"), F.count_if(took | rejected).alias("decided"),
        *spread("value", "value"), F.avg(F.log1p("value")).alias("log_value"), *spread("k", "k"), F.log1p(F.count_distinct("reviewer").cast("double")).alias("reviewers"),
        F.log1p(F.count_if(F.col("decision") == "skip").cast("double")).alias("skipped"), *spread(hour, "hour"), share(day.isin(1, 7), "weekend"), share(hour.between(9, 17), "office"), share(F.col("k") >= 50, "late"), share(F.col("value") >= 100, "large"),
        F.count_distinct("metric_id").cast("double").alias("metrics"), (F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))).cast("double").alias("days"),
    )
    return out.where("decided > 0").drop("decided")


def fold(id_="img_id"):
    """The fold of a row: a hash of its id and class, so each class is dealt evenly and reruns agree."""
    return F.pmod(F.xxhash64(F.lit(11), id_, "label"), F.lit(FOLDS)).cast("int")


def out_of_fold(rows: DataFrame, features: list[str]) -> DataFrame:
    """img_id, label, fold and score, each row's by a model of the other folds. Classes weigh the same in a fit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = Scratch(rows.sparkSession, "folds").again(rows.withColumn("fold", fold()).na.fill(0.0, features))  # read once a fold
    classes = rows.groupBy("fold").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()  # a row a fold
    raw = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    out = None
    for k in range(FOLDS):
        train, test = raw.where(F.col("fold") != k), raw.where(F.col("fold") == k)
        p, n = sum(c.p for c in classes if c.fold != k), sum(c.n for c in classes if c.fold != k)
        if not 0 < p < n:  # one class only: nothing to learn
            scored = test.select("img_id", "label", "fold", F.lit(0.5).alias("score"))
        else:
            train = train.withColumn("weight", F.when(F.col("label") == 1, n / (2 * p)).otherwise(n / (2 * (n - p))))
            scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
            model = LogisticRegression(weightCol="weight", maxIter=50, regParam=0.01).fit(scale.transform(train))
            scored = model.transform(scale.transform(test)).select("img_id", "label", "fold", vector_to_array("probability")[1].alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


@query("image_model_validation")
def image_model_validation(spark, d):  # M28: 5 folds, AUC and average precision of each and of all out-of-fold scores
    rows = image_features(spark, d)
    scores = out_of_fold(rows, [c for c in rows.columns if c not in ("img_id", "label")])
    scores = Scratch(spark, "scores").again(scores)
    each = scores.unionByName(scores.withColumn("fold", F.lit(-1)))  # -1: all of them
    return curves(each.withColumn("positive", F.col("label") == 1), "fold", "score", "positive")
