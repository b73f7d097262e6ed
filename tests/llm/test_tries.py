"""The prefix trie against a plain trie of tuples."""

import hashlib
import zlib

import duckdb
import pytest

from tesserae.llm import tries
from tesserae.llm.scratch import Scratch


def brute(rows, share_heads=True):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in said.items()}
    made = {}
    for c, ts in said.items():
        h = zlib.crc32(str(c).encode()) % 6 if share_heads else 0
        made[c] = tuple(said.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + ts[h:])
    nodes = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    out = {}
    for k in sorted(nodes, key=len, reverse=True):
        kids = [out[x] for x in out if len(x) == len(k) + 1 and x[:-1] == k]
        own = (len(nodes[k]) - 1) * len(k[-1][1]) if k else 0
        ends = ",".join(str(c) for c in sorted(c for c in nodes[k] if len(made[c]) == len(k)))
        out[k] = (min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(kids), sum(x[5] for x in kids) or 1, own + sum(x[6] for x in kids), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def made_up():
    """A long conversation that others start like, copies, null fields, short ones, negative and clashing numbers."""
    rows = [(c, t, "user", f"first {c % 7} turn {t}" * (t % 3)) for c in range(0, 400, 3) for t in range(c % 9)]
    rows += [(200, t, "user", f"long {t}") for t in range(20, 90)]
    rows += [(c, t, "user", "same é𝄞") for c in range(1000, 1040) for t in range(4)]
    rows += [(c, t, None, None) for c in (2000, 2001, 2002) for t in range(7)] + [(2003, None, "user", "x"), (2003, 5, "user", "y")]
    rows += [(-150, t, "user", f"n{t}") for t in range(8)] + [(-100, t, "user", f"m{t}") for t in range(8)] + [(None, 0, "user", "lost")]
    return rows + [(3000, 0, "user", "again")] * 9 + [(3001, t, "user", "z" * 50_000) for t in range(7)]


@pytest.mark.parametrize("block", [4096, 5])
def test_trie_equals_plain_trie(spark, monkeypatch, block):
    monkeypatch.setattr(tries, "BLOCK", block)
    df = spark.createDataFrame([(*r, 1, "x") for r in made_up()], "conv_id long, turn long, role string, text string, depth int, path string").repartition(7)
    assert rows_of(tries.prefix_trie(df)) == brute(made_up())
    assert rows_of(tries.prefix_trie(df, share_heads=False)) == brute(made_up(), False)


def test_order_of_ties_is_fixed(spark):
    rows = [(1, 0, "user", x) for x in "abcdef"] * 2
    got = [rows_of(tries.prefix_trie(spark.createDataFrame(r, "conv_id long, turn long, role string, text string"), False)) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 13


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tries.prefix_trie(df).count() == 0


def test_rounds_are_logarithmic(spark, monkeypatch):
    """Conversations that share all their turns but the last make one path with many light ones: two rounds and the empty one."""
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: (saved.append(name), save(self, df, name))[1])
    rows = [(c, t, "user", f"{t}" if t < c else f"own {c}") for c in range(40) for t in range(c + 1)]
    assert rows_of(tries.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), False)) == brute(rows, False)
    assert sum(n.startswith("handed") for n in saved) <= 3


def test_query_equals_sql_and_plain_trie(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = rows_of(tries.op11_prefix_trie(spark, sf_dir))
    assert got == sorted(con.sql(tries.OP11_SQL).fetchall(), key=str)
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
