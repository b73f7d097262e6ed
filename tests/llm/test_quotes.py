"""Quotation linking on hand-worked messages and against its SQL."""

import random

import duckdb

from tesserae.llm import quotes

ROWS = [
    (1, 0, "user", "Hello there my friend\nhow are you doing today"),
    (1, 1, "assistant", "> how are you doing today\nI am fine thank you"),
    (1, 2, "user", "> > how are you doing today\n> I am fine thank you\nGood to hear that indeed"),
    (1, 2, "user", "> > how are you doing today\n> I am fine thank you\nGood to hear that indeed"),
    (2, 0, "user", ">I am   FINE thank you\nquoted from elsewhere\n>nobody ever said this line"),
    (2, 1, None, None),
    (2, 2, "x", ""),
    (2, 3, "x", "quoted from elsewhere\n> quoted from elsewhere\n\ntail > no quote"),
    (3, 0, "user", "> ok\n>>\n"),
    (3, 5, "user", "> later words are not a source"),
    (3, 6, "user", "later words are not a source"),
]


def test_hand_worked(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, level int")
    got = {(r.conv_id, r.turn): r for r in quotes.threads(df).collect()}
    assert len(got) == 10  # the repeated row counts once
    link = lambda c, t: (got[c, t].reply_conv, got[c, t].reply_turn, got[c, t].n_quoted, got[c, t].n_linked, got[c, t].max_level)
    assert link(1, 0) == (None, None, 0, 0, 0)
    assert link(1, 1) == (1, 0, 1, 1, 1) and got[1, 1].body == "I am fine thank you"
    assert link(1, 2) == (1, 1, 2, 2, 2) and got[1, 2].body == "Good to hear that indeed" and got[1, 2].position == 3
    assert link(2, 0) == (1, 1, 2, 1, 1)
    assert got[2, 1].body == got[2, 2].body == ""
    assert link(2, 3) == (2, 0, 1, 1, 1) and got[2, 3].body == "quoted from elsewhere\n\ntail > no quote"
    assert link(3, 0) == (None, None, 2, 0, 2) and got[3, 0].body == ""
    assert link(3, 5) == (None, None, 1, 0, 1)
    assert quotes.threads(df.limit(0)).count() == 0


def test_passages_trees_and_sources_elsewhere(spark):
    wrapped = "this paragraph of the first message is long\nenough to be wrapped by mail clients again"
    rows = [
        (1, 0, "a", f"{wrapped}\n\nsecond paragraph with other words"),
        (1, 1, "b", "> this paragraph of the first\n> message is long enough to\n> be wrapped by mail clients again\nI agree with it all"),
        (1, 2, "c", "> second paragraph with other words\nand with this one too"),
        (1, 3, "a", "> > be wrapped by mail clients\n> I agree with it all\nthanks for saying so"),
        (1, 4, "d", "a new thread of its own"),
        (2, 3, "x", "> a line that two conversations have\nmine"),
        (2, 5, "x", "a line that two conversations have"),
        (3, 1, "y", "a line that two conversations have"),
        (None, 0, "z", "no conversation at all"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    at = lambda c, t: (got[c, t].reply_conv, got[c, t].reply_turn, got[c, t].thread_turn, got[c, t].depth)
    assert at(1, 1) == (1, 0, 0, 1) and at(1, 2) == (1, 0, 0, 1) and at(1, 3) == (1, 1, 0, 2) and at(1, 4) == (None, None, 4, 0)
    assert [got[1, t].position for t in range(5)] == [1, 2, 3, 4, 5]
    assert at(2, 3) == (3, 1, 3, 0)  # the later line of its own conversation hides no other
    assert got[None, 0].position == 1 and got[None, 0].body == "no conversation at all"


def test_rows_without_conversation(spark):
    """They are one conversation, after all others: a passage of theirs hides no other's, and they link among themselves."""
    rows = [(1, 1, "a", "these are some words"), (2, 2, "b", "> these are some words\nyes"), (None, 5, "c", "these are some words")]
    rows += [(None, 6, "d", "only said where nobody knows"), (None, 7, "e", "> only said where nobody knows\nno"), (3, 0, "f", "> only said where nobody knows")]
    got = {(r.conv_id, r.turn): r for r in quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[2, 2].reply_conv, got[2, 2].reply_turn) == (1, 1)
    assert (got[None, 7].reply_conv, got[None, 7].reply_turn, got[None, 7].thread_turn, got[None, 7].depth) == (None, 6, 6, 1)
    assert (got[3, 0].reply_conv, got[3, 0].reply_turn) == (None, 6) and len(got) == len(rows)


def made(seed=1, conversations=60, turns=40):
    """Conversations at scale: nested, re-wrapped, partial and cross-conversation quotes, and lines that everyone writes."""
    rng, rows, said = random.Random(seed), [], []
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    wrap = lambda text, n: [" ".join(text.split()[k : k + n]) for k in range(0, len(text.split()), n)]
    for c in range(conversations):
        own = []
        for t in range(turns if c else 20 * turns):
            parts = []
            for _ in range(rng.choice([0, 1, 1, 2])):
                pool = own if own and rng.random() < 0.8 else said
                if not pool:
                    continue
                old, kind = rng.choice(pool[-50:]), rng.random()
                lines = old if kind < 0.4 else wrap(" ".join(old), rng.randrange(4, 9)) if kind < 0.7 else rng.sample(old, 1)
                parts += [rng.choice([">", "> ", ">> ", " > > "]) + x for x in lines]
            mine = [words(rng.randrange(2, 12)) for _ in range(rng.randrange(1, 5))] + ["best regards to everyone here"] * (rng.random() < 0.2)
            text = "\n".join(parts + mine + (["", words(6)] if rng.random() < 0.3 else []))
            rows.append((c, t if rng.random() < 0.97 else max(0, t - 1), rng.choice(["user", "assistant", None]), text))
            own.append(mine)
            said.append(mine)
    return rows


def test_query_equals_sql(spark, sf_dir, tmp_path):
    rows = ROWS + [(1000 + c, *rest) for c, *rest in made()] + [(None, *rest) for c, *rest in made(seed=2, conversations=3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    for d, files in ((str(tmp_path), "conversations.parquet/*.parquet"), (sf_dir, "conversations.parquet")):
        df = quotes.op6_quote_threads(spark, d)
        cols = sorted(df.columns)
        db = duckdb.connect()
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{d}/{files}')")
        want = db.execute(f"SELECT {', '.join(cols)} FROM ({quotes.OP6_SQL})").fetchall()
        got = df.select(*cols).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        if d == str(tmp_path):
            assert sum(r.reply_conv is not None for r in got) > 1000 and max(r.depth for r in got) >= 8 and sum(r.reply_conv not in (None, r.conv_id) for r in got) > 50
