"""Embedding near-dedup against brute force."""

import numpy as np

from tesserae.llm import embeddings


def brute(rows, cosine):
    ok = []
    for k, (i, v, label) in enumerate(rows):
        good = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append((k, i, np.asarray(v, np.float32).astype(float), label) if good else None)
    ok = [x for x in ok if x]
    links = []
    for p in range(len(ok)):
        for q in range(p):
            (_, _, a, x), (_, _, b, y) = ok[p], ok[q]
            if x == y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links.append((ok[p][0], ok[q][0]))
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for p, q in links:
        x, y = sorted((top(rows[p][0]), top(rows[q][0])))
        up[y] = x
    n = np.bincount([k for link in links for k in link], minlength=len(rows))
    return sorted([(i, int(n[k]), None if i is None else top(i)) for k, (i, _, _) in enumerate(rows)], key=str)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(12):
        base = rng.normal(size=24)
        for _ in range(20):
            rows.append((len(rows), (base + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.35])).tolist(), g % 3))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)] + [(2000, (np.array(rows[5][1]) * 7).tolist(), rows[5][2])]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 24, 1), (3003, [None] + [1.0] * 23, 1), (3004, [float("nan")] + [1.0] * 23, 1)]
    rows += [(3005, rows[5][1], None), (3006, [float("inf")] * 24, 2), (3007, [1.0, 2.0], 0), (3008, [1.0, 2.1], 0), (None, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = embeddings.near_duplicates(df).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == brute(rows, 0.93)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = embeddings.op9_embedding_neardup(spark, sf_dir).collect()
    want = brute(rows, 0.93)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == want


def isotropic(rng, n, dims):
    x = rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_probes_are_sufficient():
    """In few dimensions with certainty; in many, next to all of the pairs at the threshold, from few lists."""
    rng = np.random.default_rng(3)
    for dims, n in ((3, 2000), (64, 20_000)):
        x = isotropic(rng, n, dims)
        index = embeddings.Index(x, ["a"] * n, 1.0)
        own, codes, error = index.encode(x, "a")
        u = isotropic(rng, n, dims)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * u
        there = embeddings.nearest(y, index.of("a"))
        found = index.probes(x, own, "a", 0.93)[np.arange(n), there] | index.probes(y, there, "a", 0.93)[np.arange(n), own]
        assert found.all() if dims == 3 else found.mean() > 0.9995
        assert index.probes(x, own, "a", 0.93).mean() < 0.35
        for which in range(3):
            part = np.flatnonzero(own == which)
            d = index.distances(x[:50], "a", which, codes[part])
            true = np.sqrt(embeddings.squared(x[:50], x[part]))
            assert (np.abs(d - true) <= error[part][None, :] + 1e-3).all()


def test_recall_at_the_threshold(spark):
    """Pairs of cosine 0.93 to 0.95 among vectors without structure, held against brute force."""
    rng = np.random.default_rng(8)
    x = isotropic(rng, 1500, 64)
    u = isotropic(rng, 1500, 64)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = rng.uniform(0.93, 0.95, size=(1500, 1))
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * u])
    df = spark.createDataFrame([(i, v.tolist(), f"label {i % 1500 % 2}") for i, v in enumerate(both)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    want = sum((both[g::2] @ both[g::2].T >= 0.93).sum() - len(both[g::2]) for g in (0, 1))
    assert want >= 2990 and want * 0.99 <= sum(got.values()) <= want


def test_double_precision_and_labels_of_any_type(spark):
    # As floats the first pair would reach 0.93; its cosine in double precision is just below. Large values must not overflow.
    t = np.arccos(0.93) + 1e-9
    rows = [(1, [1.0, 0.0], "x"), (2, [float(np.cos(t)), float(np.sin(t))], "x"), (3, [1e300, 1e300], "y"), (4, [2e300, 2e300], "y"), (5, [1e-310, 1e-310], "y")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (2, 3), 4: (2, 3), 5: (2, 3)}
    numbers = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, [1.0, 0.0], -0.0), (3, [1.0, 0.0], 0.5)], "vec_id int, embedding array<double>, label double")
    assert {r.vec_id: r.component_id for r in embeddings.near_duplicates(numbers).collect()} == {1: 1, 2: 1, 3: 3}


def test_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.01, 1.0], 0), (3, [1.0, 0.01], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
