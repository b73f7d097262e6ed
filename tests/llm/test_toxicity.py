"""FTRL toxicity: held-out accuracy, leakage, awkward rows."""

import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import toxicity


def test_grams_are_within_documents():
    at, doc = toxicity.grams([b"a b c", b"", b"A B  c", b"c"], 20)
    own = [set(at[doc == k]) for k in range(4)]
    assert len(own[0]) == 6 and own[0] == own[2] and own[1] == set() and own[3] < own[0]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert (held.predicted == held.toxic).mean() > 0.95
    assert ((held.predicted == 1) & (held.toxic == 0)).mean() < 0.01
    hits = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hits / (held.predicted == 1).sum() > 0.95 and hits / (held.toxic == 1).sum() > 0.8  # precision and recall of label 1
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_weights_are_sparse_and_ignore_held_out_labels(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        w = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = "vile"
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t, "label") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None)], "doc_id long, label int")
    weights = toxicity.train(docs, labels)
    assert weights.count() < 2000
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.98
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("label")).otherwise(F.col("label")))
    same = toxicity.fit_on_labels(spark, docs, labels.withColumn("toxic", F.col("label")))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, toxicity.fit_on_labels(spark, docs, flipped).collect()))


def plain_ftrl(rows, bits, epochs, min_docs):
    """The update rule put down for one coordinate at a time, in Python floats. ``rows``: text and label in order."""
    features = [sorted(set(toxicity.grams([t.encode()], bits)[0].tolist())) for t, _ in rows]
    often = collections.Counter(i for f in features for i in f)
    features = [[i for i in f if often[i] >= min_docs] for f in features]
    z, n, alpha, beta, l1 = collections.defaultdict(float), collections.defaultdict(float), toxicity.ALPHA, toxicity.BETA, toxicity.L1
    w = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha)
    ones = sum(y for _, y in rows)
    share, rare, bias_n = (ones + 0.5) / (len(rows) + 1), max(1.0, math.sqrt(len(rows) / (2 * ones))), 0.0
    bias = math.log(share / (1 - share))
    for _ in range(epochs):
        for (_, y), own in zip(rows, features, strict=True):
            now = {i: w(i) for i in own}
            g = (rare if y else 1.0) * (1 / (1 + math.exp(-(bias + sum(now.values())))) - y)
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * now[i]
                n[i] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    return {i: w(i) for i in n if w(i)} | {-1: bias}


def test_weights_and_scores_equal_a_plain_loop(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["index"]: r.weight for r in toxicity.fit_on_labels(spark, docs, labels).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic", F.xxhash64(F.lit(7), "doc_id").alias("turn")).collect()
    rows = [(r.text or "", r.toxic) for r in sorted(rows, key=lambda r: (r.turn, r.doc_id)) if r.toxic is not None and not held(r.doc_id)]
    want = plain_ftrl(rows, toxicity.BITS, toxicity.EPOCHS, toxicity.MIN_DOCS)
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-12) for i in got)
    scores = {r.doc_id: r.score for r in toxicity.op7_toxicity(spark, sf_dir).collect()}
    for r in docs.collect():
        own = set(toxicity.grams([(r.text or "").encode()], toxicity.BITS)[0].tolist())
        x = want[-1] + sum(want.get(i, 0.0) for i in own)
        assert math.isclose(scores[r.doc_id], 1 / (1 + math.exp(-max(-35, min(35, x)))), rel_tol=1e-4)


def test_bounds_hold(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3}") for i in range(60)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1000 + i, 1) for i in range(500)], "doc_id long, label int")
    assert toxicity.train(docs, labels, max_rows=30).where("index = -1").first().weight == toxicity.train(docs, labels.where("doc_id < 1000"), max_rows=30).where("index = -1").first().weight
    none = toxicity.score(docs, toxicity.train(docs, labels, max_features=0))  # no row fits
    assert {r.score for r in none.collect()} == {0.5}
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 61
    assert docs.where("doc_id is null").select(toxicity.held_out()).first()[0] is True


def test_a_repeated_id_takes_no_more_than_its_place(spark):
    rows = [(i, f"vile words {i % 5}" if i % 2 else f"kind words {i % 5}") for i in range(100)]
    first = min(range(100), key=lambda i: spark.range(1).select(F.xxhash64(F.lit(7), F.lit(i).cast("long"))).first()[0])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, label int")
    schema = "doc_id long, text string"
    plain = toxicity.train(spark.createDataFrame(rows, schema), labels, max_rows=100).collect()
    copied = toxicity.train(spark.createDataFrame(rows + [rows[first]] * 150, schema).repartition(5), labels, max_rows=100).collect()
    assert len(plain) > 1 and sorted(map(tuple, plain)) == sorted(map(tuple, copied))
    varied = rows + [(first, f"other text {k}") for k in range(150)] + [(first, "long " * 10 + " ".join(f"w{k}" for k in range(4000)))]
    assert toxicity.train(spark.createDataFrame(varied, schema), labels, max_rows=100, max_features=100_000).count() > 1


def test_without_both_classes_no_row_is_rejected(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "other text")], "doc_id long, text string")
    for labels in ([], [(1, 1), (3, 1)]):
        weights = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, label int"))
        assert toxicity.reject(docs, weights).count() == 3


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (4, "y " * 200000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (9, 0)], "doc_id long, label int")
    assert {round(r.score, 3) for r in toxicity.score(docs, toxicity.train(docs, one)).collect()} == {round(2.5 / 3, 3)}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0
