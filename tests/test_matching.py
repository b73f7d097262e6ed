"""Range joins, ranks by counting and greedy choices against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import counting, matching, ranges


def near(v, w, tolerance, zero):
    if v is None or w is None:
        return v is None and w is None
    if v == 0 or w == 0:
        return abs(v - w) <= zero
    return abs(v - w) <= tolerance * abs(w)


@pytest.mark.parametrize("zero", [0.0, 0.02])
def test_near_join(spark, zero):
    rng = random.Random(4)
    pool = [0.0, -0.0, 0.01, -0.015, 0.02, 1e-9, 98.0, 100.0, 102.0, -100.0, -98.0, 1e12, None, 49.0, 50.0, 51.0] + [rng.uniform(-3, 3) for _ in range(60)] + [10 ** rng.uniform(-3, 6) for _ in range(100)]
    a = [(k, g, v) for k, (g, v) in enumerate((g, v) for g in ("x", "y") for v in pool)]
    left, right = spark.createDataFrame(a, "i long, g string, v double"), spark.createDataFrame(a, "j long, g string, w double")
    got = sorted((r.i, r.j) for r in ranges.near_join(left, right, ["g"], "v", "w", 0.02, zero).collect())
    assert got == sorted((i, j) for i, g, v in a for j, h, w in a if g == h and near(v, w, 0.02, zero))


def test_overlap_join(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        s = rng.randrange(3000)
        e = s + rng.choice([0, 0, 5, 63, 64, 400, -7])  # some end before they start
        rows.append((i, i % 2, s, e))
    rows += [(900, 0, 10, None), (901, 0, None, 10)]
    day = lambda c: F.date_add(F.lit("1965-03-01").cast("date"), F.col(c).cast("int"))
    df = spark.createDataFrame(rows, "id long, g long, s int, e int").select("id", "g", day("s").alias("s"), day("e").alias("e"))
    got = sorted((r.left, r.right) for r in ranges.overlap_join(df, ["g"], "id", "s", "e").collect())
    full = [r for r in rows if None not in r]
    assert got == sorted((a[0], b[0]) for a in full for b in full if a[0] < b[0] and a[1] == b[1] and not (a[3] < b[2] or b[3] < a[2]))


def test_long_intervals_are_not_copied_to_many_cells(spark):
    """Copies of a row, as the plan's generator makes them, don't grow with the length of intervals."""
    rows = spark.range(50).selectExpr("id", "1 AS g", "date'1990-01-01' AS s", "date_add(date'2020-01-01', cast(id AS int)) AS e")
    out = ranges.overlap_join(rows, ["g"], "id", "s", "e")
    assert out.count() == 50 * 49 // 2
    width = max(int(n) for n in re.findall(r"/ (\d+)\.0", out._jdf.queryExecution().optimizedPlan().toString()))
    assert 30 * 365 < width < 31 * 366


def test_positions_and_percentiles(spark):
    rng = random.Random(6)
    rows = [("many", rng.gauss(0, 100)) for _ in range(3000)] + [("same", 7.0)] * 500 + [("two", 1.0), ("two", 2.0), ("one", 3.5), ("none", None), (None, 5.0), ("far", -1e300), ("far", 1e300), ("far", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = counting.positions(df, "g", "v")
    got = {r.g: r for r in at.groupBy("g").agg(*[counting.percentile("v", p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.99)], counting.at_rank("v", F.least(F.floor(F.col("total") * 0.9), F.col("total") - 1)).alias("p90")).collect()}
    for g in {g for g, v in rows if v is not None}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        assert np.allclose([got[g].p25, got[g].p50, got[g].p99], np.percentile(own, [25, 50, 99]), rtol=1e-12)
        assert got[g].p90 == own[min(int(len(own) * 0.9), len(own) - 1)]
    assert "none" not in got and len(got) == 6


@pytest.mark.parametrize("local", [0, 10, 100_000])
def test_greedy_pairs(spark, local):
    rng = random.Random(7)
    pairs = {(g, rng.randrange(40), rng.randrange(40)): rng.choice([0.1, 0.5, 0.5, rng.random()]) for g in "ab" for _ in range(300)}
    rows = [(g, i, j, s) for (g, i, j), s in pairs.items()]
    want = []
    for g in "ab":
        left, right = set(), set()
        for _, i, j, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2])):
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                want.append((g, i, j))
    df = spark.createDataFrame(rows + rows[:5] + [("a", 1, 2, None)], "who string, x long, y long, score double")
    assert sorted(map(tuple, matching.greedy_one_to_one(df, "who", "x", "y", "score", local).collect())) == sorted(want)


@pytest.mark.parametrize("local", [0, 20, 100_000])
def test_first_come(spark, local):
    rng = random.Random(8)
    n = 120
    covers = {(i, j) for i in range(n) for j in rng.sample(range(n), 4) if i < j}
    seed = {}
    for j in range(n):
        by = [i for i in range(j) if (i, j) in covers and seed[i] == i]
        seed[j] = min(by) if by else j
    edges = spark.createDataFrame([(f"n{i}", f"n{j}", i, j) for i, j in covers], "by string, to string, by_rank long, to_rank long")
    rows = spark.createDataFrame([(f"n{i}",) for i in range(n)], "node string")
    assert {r.node: r.seed for r in matching.first_come(rows, edges, local).collect()} == {f"n{j}": f"n{i}" for j, i in seed.items()}


@pytest.mark.parametrize("local", [0, 100_000])
def test_tolerance_groups(spark, local):
    """Against going down each bucket's list: repeated ids and rows, nulls, zeros, and a condition on more columns."""
    rng = random.Random(9)
    rows = [(rng.choice(["x", "y", None]), i % 170, rng.choice([None, 0.0, 0.01, *[round(100 * (1 + rng.uniform(-0.03, 0.03)), 3) for _ in range(9)]]), rng.choice([None, 1, 2])) for i in range(200)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "k string, id long, v double, w long")
    for conditional in (False, True):
        want = []
        for k in ("x", "y", None):
            seeds = []
            for _, i, v, w in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2] is not None, r[2] or 0.0, r[3] is not None, r[3] or 0)):
                own = [s for s, x, y in seeds if near(x, v, 0.02, 0.02) and (not conditional or None in (y, w) or y == w)]
                if not own:
                    seeds.append((i, v, w))
                want.append((i, own[0] if own else i))
        more = {"also": ["w"], "compatible": lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(True))} if conditional else {}
        got = matching.tolerance_groups(df, ["k"], "id", "v", 0.02, zero=0.02, local=local, **more).collect()
        assert sorted((r.id, r.group_id) for r in got) == sorted(want)


@pytest.mark.parametrize("small", [0, 3, 1000])
def test_groups_of_small_and_large_buckets(spark, small):
    """In place, by rounds, or some of each: the same groups."""
    rng = random.Random(11)
    rows = [(k, 10 * i + n, v) for k, n in ((1, 1), (2, 3), (3, 40), (None, 2)) for i, v in enumerate(rng.choice([None, float("nan"), 0.0, -0.0, 100 * (1 + rng.uniform(-0.05, 0.05))]) for _ in range(n))]
    df = spark.createDataFrame(rows, "k long, id long, v double")
    got = matching.tolerance_groups(df, ["k"], "id", "v", 0.02, local=5, small=small)
    want = []
    for k in (1, 2, 3, None):
        seeds = []
        for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            own = [s for s, x in seeds if (x != x and v != v) or near(x, v, 0.02, 0.0)]
            if not own:
                seeds.append((i, v))
            want.append((i, own[0] if own else i))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_deduplication_shuffles_facts_once(spark, sf_dir):
    """Small documents are brought together once for all passes; large ones, by rounds, have the same facts."""
    from tesserae.plans import dedup

    facts = dedup.stated(spark, sf_dir)
    out = dedup.deduplicated(facts)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    by_rounds = dedup.deduplicated(facts.where("doc_id < 4"), small=8)
    columns = [F.col(c) for c in out.columns]
    want = {str(tuple(r)) for r in out.where("doc_id < 4").select(*columns).collect()}
    assert {str(tuple(r)) for r in by_rounds.select(*columns).collect()} == want and want


def test_aliases(spark):
    """Chains of any length, several names, circles and what leads into them."""
    from tesserae.operators import aliases

    rows = [(f"a{k}", f"a{k + 1}") for k in range(20)] + [("x", "a3"), ("y", "z"), ("y", "a20"), ("p", "q"), ("q", "p"), ("r", "p"), ("s", "s"), (None, "t")]
    known = aliases.closed(spark.createDataFrame(rows, "alias string, canonical string"))
    want = {f"a{k}": "a20" for k in range(20)} | {"x": "a20", "y": "a20"}
    assert dict(map(tuple, known.collect())) == want
    df = spark.createDataFrame([("a0",), ("p",), ("none",), (None,)], "m string")
    assert sorted(str(r.m) for r in aliases.canonical(df, "m", known).collect()) == ["None", "a20", "none", "p"]
    assert aliases.closed(spark.createDataFrame([], "alias string, canonical string")).count() == 0


def test_curves(spark):
    rng = random.Random(10)
    rows = [(g, rng.choice([0.1, 0.2, 0.5, rng.random()]), rng.random() < share) for g, share in (("a", 0.3), ("b", 0.7), ("only", 2), ("no", -1)) for _ in range(200)] + [("a", None, True), ("a", 0.5, None)]
    got = {r.g: r for r in counting.curves(spark.createDataFrame(rows, "g string, s double, y boolean"), "g", "s", "y").collect()}
    for g in "ab":
        own = [(s, y) for h, s, y in rows if h == g and None not in (s, y)]
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
        at = sorted({s for s, _ in own}, reverse=True)
        hits = [(sum(p >= t for p in pos), sum(n >= t for n in neg)) for t in at]
        ap = sum((tp - before) * tp / (tp + fp) for (tp, fp), (before, _) in zip(hits, [(0, 0), *hits])) / len(pos)
        best = max(tp / (tp + fp) for tp, fp in hits if tp >= 0.8 * len(pos))
        assert np.allclose([got[g].auc, got[g].ap, got[g].best_precision], [auc, ap, best], rtol=1e-12) and got[g].positives == len(pos)
    assert got["only"].auc is None and got["no"].ap is None


def test_image_model(spark, sf_dir):
    from tesserae.plans import models

    rows = models.image_features(spark, sf_dir)
    features = [c for c in rows.columns if c not in ("img_id", "label")]
    assert len(features) == 21
    made = rows.withColumn("value_mean", F.when(F.col("label") == 1, F.col("value_mean") + 1000).otherwise(F.col("value_mean")))  # a feature that tells
    scores = models.out_of_fold(made, features).toPandas()
    assert len(scores) == rows.count() and sorted(scores.fold.unique()) == [0, 1, 2, 3, 4] and scores.score.between(0, 1).all()
    pos, neg = scores[scores.label == 1].score.to_numpy(), scores[scores.label == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.95
