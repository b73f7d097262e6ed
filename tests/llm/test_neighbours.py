"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from tesserae.llm import graphs, neighbours


def usable(rows):
    ok = lambda v: v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    return [(i, np.asarray(v, float)) for i, v in rows if i is not None and ok(v)]


def brute(rows, nearest=5, every=50):
    """query_id, rank, vec_id and score by comparing each query with all rows."""
    good, out = usable(rows), []
    for k, (i, v) in enumerate(good):
        if i % every == 0:
            near = sorted((-(w @ v) / (np.sqrt(w @ w) * np.sqrt(v @ v)), j) for m, (j, w) in enumerate(good) if m != k and len(w) == len(v))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near[:nearest], 1)]
    return sorted(out)


def recall(got, want):
    """The share of what was found that is as near as the last of the true ones, of as many as there are true ones."""
    last = {}
    for q, _, _, s in want:
        last[q] = min(s, last.get(q, 2.0))
    return sum(s >= last[q] - 1e-12 for q, _, _, s in got) / len(want)


def test_query_recall(spark, sf_dir):
    for d in (sf_dir, sf_dir.replace("0.001", "0.01")):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
        got = [tuple(r) for r in neighbours.op13_nearest_neighbours(spark, d).collect()]
        want, vectors = brute(rows), dict(rows)
        assert len(got) == len(want) and recall(got, want) >= 0.98
        for q, _, i, s in got:
            a, b = np.asarray(vectors[q], float), np.asarray(vectors[i], float)
            assert q != i and abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(2500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest_neighbours(df, shard=400).collect()]
    assert recall(got, brute(rows)) >= 0.98


def test_awkward_vectors(spark):
    """Exact where a beam holds a shard: copies, scaled and opposite vectors, two lengths, rows that take no part."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(400, rows[3][1])] * 3 + [(500, (-np.asarray(rows[0][1])).tolist())]
    rows += [(600, [1.0, 2.0]), (601, [2.0, 4.5]), (650, [0.0, -1.0]), (700, [3.0] * 9)]
    bad = [(None, rows[0][1]), (800, None), (850, []), (900, [0.0] * 6), (950, [None] + [1.0] * 5), (1000, [float("nan")] + [1.0] * 5), (1050, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<float>, h1 string, rank int").repartition(6)
    got = sorted((q, r, i, s) for q, r, i, s in neighbours.nearest_neighbours(df).collect())
    want = brute(rows)
    assert [(q, r) for q, r, _, _ in got] == [(q, r) for q, r, _, _ in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12, rtol=0)
    copies = lambda out, q: sorted(i for x, _, i, _ in out if x == q)
    assert all(copies(got, q) == copies(want, q) for q in (0, 100, 400, 500, 600, 650))
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 40, 1500])
def test_graph(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    edges, entry = graphs.build(x)
    assert edges.shape == (n, graphs.DEGREE) and all(len(set(e[e >= 0])) == (e >= 0).sum() and k not in e for k, e in enumerate(edges))
    found, far, _ = graphs.search(x, np.vstack([edges, np.full((1, graphs.DEGREE), -1, np.int32)]), entry, x, 64)
    assert (found[:, 0] == np.arange(n)).mean() > 0.99 and (np.diff(np.nan_to_num(far, posinf=9.0)) >= 0).all()


def test_pruning_keeps_what_is_diverse():
    """Of candidates in a line the nearest stands for those behind it, one to the other side stays."""
    angle = np.array([0.0, 0.1, 0.2, 0.3, -0.5])
    x = np.stack([np.cos(angle), np.sin(angle)], 1).astype(np.float32)
    kept = graphs.prune(x, np.array([0]), np.array([[1, 2, 3, 4, -1, 0, 2]]), 1.2, 4)[0]
    assert set(kept[kept >= 0].tolist()) == {1, 4}
