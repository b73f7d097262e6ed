"""Line dedup against a plain computation and its SQL."""

import collections
import re

import duckdb
from pyspark.sql import functions as F

from tesserae.llm import lines


def plain(rows, sites, min_words):
    spread, texts = collections.defaultdict(set), collections.defaultdict(set)
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    judged = lambda x: bool(norm(x)) and norm(x).count(" ") >= min_words - 1
    for _, text, source in rows:
        for x in text.split("\n") if text is not None else []:
            if judged(x):
                spread[norm(x)].add(source or "")
                texts[norm(x)].add(text)
    out = []
    for doc, text, _ in rows:
        parts = text.split("\n") if text is not None else []
        gone = [judged(x) and min(len(spread[norm(x)]), len(texts[norm(x)])) >= sites for x in parts]
        kept = "\n".join(x for x, g in zip(parts, gone, strict=True) if not g)
        whole = not any(gone) or not kept.strip()
        out.append((doc, text if whole else kept, 0 if whole else sum(gone)))
    return sorted(out, key=str)


def test_against_plain_python(spark):
    banner, passage = "Subscribe to   our newsletter\tright now", "this passage of many words " * 15
    rows = [(i, f"own words of document {i} here\n{banner.upper() if i % 2 else banner}\nend {i}", f"s{i % 7}") for i in range(20)]
    rows += [(100 + i, f"{passage}\nshort {i}", f"s{i}") for i in range(6)]
    rows += [(200 + i, "copy line one is long\ncopy line two is long\ncopy line three is long\nmine", f"s{i}") for i in range(6)]
    rows += [(300 + i, "seen on four sites only ok\nx", f"s{i}") for i in range(4)] + [(310 + i, "ok ok\nok ok", f"s{i}") for i in range(9)]
    rows += [(400, None, "s1"), (401, "", None), (402, "\n\n", "s2"), (403, banner, None), (5, rows[5][1], rows[5][2]), (None, banner + "\nno id here at all", "s1")]
    rows += [(5, "another text of the same id\n" + passage, "s3")]
    names = ["line", "hits", "_hits", "row", "doc", "parts", "rest", "cut", "n", "a b"]  # extra columns with the names of ours
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{x}` string" for x in names))
    out = lines.remove_boilerplate(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted([(r.doc_id, r.text, r.n_removed) for r in out.collect()], key=str) == plain(rows, 5, 5)
    assert all(tuple(r)[3:13] == tuple(names) for r in out.collect())
    assert lines.remove_boilerplate(df.limit(0)).count() == 0
    clash = df.select("doc_id", "text", "source", F.lit(7).alias("n_lines"))
    assert lines.remove_boilerplate(clash).columns == ["doc_id", "text", "source", "n_lines", "n_removed"]


def test_copies_count_once_and_carriers_lose_all(spark):
    block = "licensed to everyone under these terms\nall rights of others are reserved\nplease read the terms of use first"
    rows = [(i, f"{block}\nown {i}", f"s{i % 7}") for i in range(14)]  # short pages, each of its own, under a long header
    rows += [(100 + i, "one text on many sites as copies\nand nowhere else at all", f"s{i}") for i in range(9)]
    rows += [(200 + i, f"{block}\ncopied page", f"s{i}") for i in range(2)] + [(300, block, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.remove_boilerplate(df).collect()}
    assert all(got[i] == (f"own {i}", 3) for i in range(14)) and got[200] == got[201] == ("copied page", 3)
    assert all(got[100 + i] == (rows[14][1], 0) for i in range(9)) and got[300] == (block, 0)
    assert lines.remove_boilerplate(df).count() == len(rows)


def test_every_site_of_a_text_counts(spark):
    """Six texts, each on site a and on one more: their line is on seven sites."""
    rows = [(10 * i + k, f"a line that seven sites have\nown words {i}", site) for i in range(6) for k, site in enumerate(("a", "bcdefg"[i]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = lines.remove_boilerplate(df).collect()
    assert all(r.n_removed == 1 for r in got) and sorted((r.doc_id, r.text, r.n_removed) for r in got) == plain(rows, 5, 5)


def test_near_threshold_counts_are_exact(spark):
    for n in (39, 40, 41):
        rows = [(i, f"a line of more than five words\nown {i}", f"site{i % n}") for i in range(2 * n)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = lines.remove_boilerplate(df, sites=40, log_k=4).agg(F.sum("n_removed")).first()[0]
        assert got == (2 * n if n >= 40 else 0)


def test_query_equals_sql(spark, sf_dir):
    got = sorted(map(tuple, lines.op3_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_removed", "text_md5").collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    assert got == sorted(db.execute(f"SELECT doc_id, n_lines, n_removed, text_md5 FROM ({lines.OP3_SQL})").fetchall())
