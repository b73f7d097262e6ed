"""Near dedup and components against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae.llm import neardup
from tesserae.llm.components import connected
from tesserae.llm.scratch import Scratch
from tesserae.llm.words import shingle_sets, word_hashes


def sets(text, width):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def roots(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def brute(rows, width, percent):
    s = [(i, sets(t, width)) for i, t in rows]
    links = [
        (s[a][0], s[b][0]) for a in range(len(s)) for b in range(a)
        if s[a][1] and s[b][1] and 5 * min(len(s[a][1]), len(s[b][1])) >= 4 * max(len(s[a][1]), len(s[b][1]))
        and 100 * len(s[a][1] & s[b][1]) >= percent * len(s[a][1] | s[b][1])
    ]
    found = roots([i for i, _ in s], links)
    return sorted((i, len(x), found[i], found[i] == i) for i, x in s)


def test_words_and_shingles_agree_with_plain_python():
    texts = ["", "One  two\tone\x0btwo ONE", "é È É", "a\x1cb a\x85b\xa0c", "x", " lead and trail \n", "of the of the of the"]
    raw = [t.encode() for t in texts]
    h, at = word_hashes(raw)
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert at[k + 1] - at[k] == len(words)
    for width in (1, 2, 3, 5):
        assert [len(x) for x in shingle_sets(raw, width)] == [len(sets(t, width)) for t in texts]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = roots(nodes, [e for e in edges if e[0] != e[1]])
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected(df, Scratch(spark, "t"), "c").collect()}
    assert got == want
    assert {r.node: r.component for r in connected(df, Scratch(spark, "t"), "c", local=10).collect()} == want
    assert connected(df.limit(0), Scratch(spark, "t"), "c").count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_of_awkward_rows(spark, width):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(150)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\ttwo"), (8, "Éa éa"), (9, "éa éa")]
    for i in range(60):  # near copies of one text, around the threshold and on both sides of it
        w = base[:]
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((100 + i, " ".join(w)))
    chain = base[:]
    for i in range(30):  # each near the one before, the ends far apart
        chain = chain[3:] + [rng.choice(vocab) for _ in range(3)]
        rows.append((300 + i, " ".join(chain)))
    rows += [(400 + i, " ".join(rng.choice(vocab) for _ in range(40)) + " " + " ".join(base[:60])) for i in range(30)]
    rows += [(500 + i, rows[12][1]) for i in range(25)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, component int")
    got = sorted(tuple(r) for r in neardup.near_duplicates(df, width).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows, width, 80)


def test_repeated_ids_keep_all_their_texts(spark):
    rng = random.Random(9)
    a, b = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " extra"), (3, a + " more"), (4, "of its own entirely"), (4, None), (None, a)]
    want = {1: 1, 2: 1, 3: 1, 4: 4, None: None}
    for order in (rows, rows[::-1], rows * 40):
        df = spark.createDataFrame(order, "doc_id long, text string")
        got = neardup.near_duplicates(df, 2).collect()
        assert len(got) == len(order) and all(r.component_id == want[r.doc_id] for r in got)


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    """Template pages near the threshold, in small components, share buckets by hundreds."""
    rng = random.Random(11)
    base = [f"t{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):
        w = base[:]
        for k in rng.sample(range(120), rng.choice([3, 6, 8, 9, 10])):
            w[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2, 80)
    for hot, big, cell in ((2, 1000, 20), (64, 1000, 256), (2, 4, 20)):
        monkeypatch.setattr(neardup, "HOT", hot)
        monkeypatch.setattr(neardup, "BIG", big)
        monkeypatch.setattr(neardup, "CELL", cell)
        got = sorted(tuple(r) for r in neardup.near_duplicates(df, 2).select("doc_id", "n_shingles", "component_id", "kept").collect())
        assert got == want


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in neardup.op4_minhash_neardup(spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows, 2, 80)


def test_members_of_large_components_are_not_brought_to_every_bucket(spark, monkeypatch):
    """What is kept of open buckets has a component once, however many of its members are there."""
    rng = random.Random(12)
    base, rows = [f"t{k}" for k in range(60)], []
    for i in range(60):
        w = base[:]
        for k in rng.sample(range(60), 1 if i < 40 else rng.choice([3, 4])):
            w[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    kept, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: kept.setdefault(name, save(self, df, name)) if name == "open" else save(self, df, name))
    monkeypatch.setattr(neardup, "BIG", 4)
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == brute(rows, 2, 80)
    n = kept["open"].count()
    assert n > 0 and n == kept["open"].select("key", "part").distinct().count()
