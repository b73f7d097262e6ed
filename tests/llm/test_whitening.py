"""Whitening against whole-matrix numpy and exact arithmetic."""

from fractions import Fraction

import numpy as np

from tesserae.llm import whitening


def brute(vectors):
    """Deviation and components by whole matrices, from exact means."""
    x = [[int(np.floor(1024.0 * float(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    away = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for r in x])
    cov = away.T @ away / n
    values, axes = np.linalg.eigh(cov)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    return deviation, values[::-1] / np.trace(cov), (away @ axes[:, ::-1]) / np.sqrt(np.maximum(values[::-1], 1e-300))


def check(got, rows, components):
    """``got`` against brute force of the rows (vec_id, vector), either sign of a component."""
    deviation, explained, white = brute([v for _, v in rows])
    place = {i: k for k, (i, _) in enumerate(rows)}
    assert len(got) == len(rows) * components
    signs = {}
    for r in got:
        k, c = place[r.vec_id], r.component - 1
        assert r.n == len(rows) and r.deviation == deviation[k] and r.identity_error < 1e-9
        assert abs(r.explained - explained[c]) < 1e-9
        if abs(white[k, c]) > 1e-3:
            signs.setdefault(c, set()).add(bool(np.sign(r.whitened) == np.sign(white[k, c])))
        assert abs(abs(r.whitened) - abs(white[k, c])) < 1e-7
    assert all(len(s) == 1 for s in signs.values())


def test_query_equals_whole_matrices(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(whitening.op12_whitening(spark, sf_dir).collect(), rows, 8)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(5, 5))
    rows = [(i, (rng.normal(size=5) @ mix + 3).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]
    bad = [(2000, None), (2001, []), (2002, [None] * 5), (2003, [float("nan")] + [1.0] * 4), (2004, [float("-inf")] * 5)]
    other = [(3000 + i, [float(i % 5), 2.0 * (i % 5), 7.0]) for i in range(10)]  # one component varies
    df = spark.createDataFrame([(*r, "x") for r in rows + bad + other], "vec_id long, embedding array<float>, component string").repartition(5)
    got = whitening.whiten(df).collect()
    check([r for r in got if r.vec_id < 3000], rows, 5)
    check([r for r in got if r.vec_id >= 3000], other, 1)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id in (1, 2000)")).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [(i - 3) * 1e12, float(i % 3)]) for i in range(7)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and {r.identity_error < 1e-9 for r in got} == {True}
    at_bound = [max(-whitening.BOUND, min(whitening.BOUND, int(v[0] * 1024))) for _, v in rows]
    wide = [(7 * x - sum(at_bound)) ** 2 for x in at_bound]
    assert all((r.deviation is None) == (wide[r.vec_id] + 0 >= 2**63) for r in got if wide[r.vec_id] != 0)


def test_merge_equals_whole():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(5000, 6)) * 1000).astype(np.int64) + 100_000
    whole = whitening.Moments.of(x)
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 10, 2500, 2501, 4999])]
    while len(parts) > 1:
        parts = [parts[0].merged(parts[1]), *parts[2:]]
    assert parts[0].n == 5000 and parts[0].sums == whole.sums
    assert np.allclose(parts[0].scatter, whole.scatter, rtol=1e-12, atol=0)
