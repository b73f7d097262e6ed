"""What every stage over filings repeats is read once: markup by one pattern, texts by one look for each pattern."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import catalogue, numbers
from tesserae.plans import registry
from tesserae.sources import html

MARKUP = [
    "", "no tags", "<p>a &amp; b &lt c &</p>tail &am", "<H2>Business</H2><P Class=\"x\">" + "word " * 20 + "</P>", "a<br/>b", "<p>1 < 2</p>", "<script>if (a<b) '<p>'</script><p>x</p>", "<title>a<b></title>",
    "<table><tr><th colspan=2>A</th></tr><tr><td rowspan=\"2\">s</td><td>1</td></tr><tr><td>2</td></tr></table>", "<img src=\"/x/a.png?y=1\" alt=\"\" width=\"12px\" height=7><img src alt=b>", "<!-- <p> --><p>x", "<p>x</p", "<p a=\"&quot;q\">y</p>",
]


class Events(html.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, attrs))

    def handle_endtag(self, tag):
        self.seen.append(("/", tag))

    def handle_data(self, data):
        self.seen.append(("text", data))


def merged(seen):
    """Events with neighbouring texts as one: the parser may cut a text where it waits for more."""
    out = []
    for e in seen:
        if e[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + e[1])
        else:
            out.append(e)
    return out


@pytest.mark.parametrize("markup", MARKUP)
def test_read_calls_the_handlers_that_the_parser_calls(markup):
    fast, slow = Events(), Events()
    html.read(fast, markup)
    slow.feed(markup)
    slow.close()
    assert merged(fast.seen) == merged(slow.seen)


def test_plain_markup_needs_no_parser():
    class Never(Events):
        def feed(self, data):
            raise AssertionError("fed")

    html.read(Never(), MARKUP[3])


def test_bounds_are_asked_for_once():
    assert catalogue.one_of([r"\ba\b", r"\bb"]) == r"(?i)\b(?:a\b|b)"
    assert catalogue.one_of([r"\ba|c", r"\bb"]) == r"(?i)\ba|c|\bb" and catalogue.one_of(["a", r"\bb"]) == r"(?i)a|\bb"


def test_spans_read_a_text_once(spark):
    rows = spark.createDataFrame([("ab 1 cd 22, 3",), ("none",), ("",), (None,)], "t string")
    got = [r.s for r in rows.select(catalogue.spans(F.col("t"), r"\d+").alias("s")).collect()]
    assert [[tuple(x) for x in s] for s in got[:3]] == [[("1", 3, 4), ("22", 8, 10), ("3", 12, 13)], [], []] and got[3] is None
    plan = rows.select(catalogue.spans(F.col("t"), r"\d+").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("split(") == 1


def test_each_computes_its_array_once(spark):
    rows = spark.createDataFrame([("1 2",), ("none",), (None,)], "t string")
    plan = catalogue.each(rows, "n", catalogue.spans(F.col("t"), r"\d+"))
    assert sorted(r.n.match for r in plan.collect()) == ["1", "2"] and plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_a_sentence_is_cut_out_once(spark):
    rows = spark.createDataFrame([("In Q2 2024 it rose. Then 5 fell.", 26), ("Nothing. As of March 3, 2024 it was 5.", 37), ("", 1), (None, 1)], "t string, at int")
    text, at = F.col("t"), F.col("at")
    period = numbers.infer_period(None, numbers.sentence_at(text, at), F.lit("2020-01-31").cast("date"), numbers.around(text, at))
    got = rows.select(period.alias("p"))
    assert [(r.p.period_type, str(r.p.start), r.p.confidence) for r in got.collect()] == [("quarterly", "2024-04-01", 0.5), ("point_in_time", "2024-03-03", 0.7), ("point_in_time", "2020-01-31", 0.3), ("point_in_time", "2020-01-31", 0.3)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2


def test_numbers_read_each_group_once(spark):
    rows = spark.createDataFrame([("$1.5 million",), ("45 %",), ("-3k",), ("2x",), ("x",), (None,)], "t string")
    got = rows.select(numbers.parse_number(F.col("t")).alias("n"))
    assert [r.n and (r.n.value, r.n.unit, r.n.raw) for r in got.collect()] == [(1.5e6, "currency", "$1.5 million"), (45.0, "percent", "45 %"), (-3000.0, "count", "-3k"), (2.0, "ratio", "2x"), None, None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 6


def test_repair_json_closes_what_a_reader_of_characters_would(spark):
    """Brackets and quotes in strings, escapes, cut strings and what was never opened."""
    from tesserae.functions import text as X

    def plain(body):
        close, said, escaped = "", False, False
        for c in body:
            if not said and c in "{[":
                close = ("}" if c == "{" else "]") + close
            elif not said and c in "}]":
                close = close[1:]
            quote = c == '"' and not escaped
            escaped = said and c == "\\" and not escaped
            said = said != quote
        return body + ('"' if said else "") + close

    rng = random.Random(3)
    bodies = ["{" + "".join(rng.choice('{}[]"\\a\n:') for _ in range(rng.randrange(14))) + "x" for _ in range(400)]
    got = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string").select("k", X.repair_json(F.col("b")).alias("r")).collect()
    assert {r.k: r.r for r in got} == {k: plain(b) for k, b in enumerate(bodies)}


def test_texts_are_cut_and_read_once(spark, sf_dir):
    """Plans in which a text was cut or a number read again for each use or hit."""
    plan = lambda name: registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("word_windows").count("split(") == 1
    assert plan("chart_presence").count("from_json(") + plan("chart_presence").count("jsontostructs(") <= 1
    assert plan("percent_promotion").count("regexp_extract(") <= 6  # a number's six parts
    assert plan("respectively_pairs").count("split(") == 1


def test_distinct_counts_without_a_row_for_each(spark, sf_dir):
    assert "Expand" not in registry.QUERIES["extraction_summary"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_words_that_every_match_holds():
    assert catalogue.words_in(r"\bactive\s+customers?\b") == ["customer", "active"] and catalogue.words_in(r"\b(?:average\s+)?revenue\s+per\s+(?:user|account)\b") == ["revenue", "per"]
    for unclear in (r"\ba1\b|\bb2\b", r"(?u)\bkg\b", r"(?x) a b", r"\x41bc", r"\p{L}ab", r"[a[bc]]de", "straße"):
        assert catalogue.words_in(unclear) == []
    assert catalogue.words_in(r"ab*c{0}d+[xy]ef\.gh(?!ij)") == ["ef", "gh"]
    for m, patterns, _ in catalogue.METRICS:
        assert all(map(catalogue.words_in, patterns)), m


def test_texts_are_tried_for_the_metrics_whose_words_they_hold(spark):
    """Hits and names are those that the patterns alone give, also in other letters, without the words, and in empty and null texts."""
    rng = random.Random(5)
    words = ["Active", "customers", "customer", "CHURN", "rate", "net", "new", "MAUs", "aov", "KARPU", "gross", "merchandise", "volume", "\n", "employee", "￿", "acquired", "12", "İ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(300)] + [None, ""]
    metrics = [*catalogue.METRICS, ("odd", [r"\bnew\b|\b12\b"], [r"\brate\b"])]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    t = F.col("t")
    alone = F.flatten(F.array(*[catalogue._hits(t, *entry) for entry in metrics]))
    got = rows.select("k", catalogue.candidates(t, metrics).alias("hits"), alone.alias("want"), catalogue.named(t, [(*e, F.lit(e[0])) for e in metrics]).alias("names")).collect()
    for r in got:
        assert r.hits == r.want and set(r.names) == {h.metric_id for h in r.want or []}
        assert all(texts[r.k][h.start : h.end] == h.match for h in r.hits or [])
    assert sum(len(r.hits or []) for r in got) > 100


def test_a_heading_is_prepared_once(spark):
    from tesserae.functions import text as X

    rows = spark.createDataFrame([("Management’s  discussion and analysis",), ("  business ",), ("Note 7 x",), ("Business plan",), ("MD&A " + "x" * 200,), (None,)], "t string")
    got = rows.select(X.section_of(F.col("t")).alias("s"))
    assert [r.s for r in got.collect()] == ["mda", "business", "notes", None, None, None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1


def test_values_are_bound_where_their_mention_is(spark, sf_dir):
    """A mention's numbers are compared in its row: no shuffle, and copies of a filing are no rivals."""
    from tesserae.plans import dataflow

    text = "Active customers reached 5,000 at last. It was 7,000 before."
    said = spark.createDataFrame([(1, 1, text, "mda")] * 2, "filing_id long, seq long, text string, section string")
    got = dataflow.bindings(dataflow.candidates(said)).select("value", "confidence", "at").collect()
    assert [tuple(r) for r in got] == [(5000.0, 0.5, 26)] * 2
    assert "Exchange" not in registry.QUERIES["nearest_value"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_rows(spark, sf_dir, monkeypatch):
    from tesserae.plans import base

    want = sorted(map(tuple, registry.QUERIES["company_disclosure"](spark, sf_dir).collect()))
    monkeypatch.setattr(base, "ROWS", 500)
    got = registry.QUERIES["company_disclosure"](spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == want
    lines = base.table(spark, sf_dir, "lineitem")
    assert base.parted(lines, lines.count(), "l_orderkey").rdd.getNumPartitions() == -(-lines.count() // 500)
    assert "hashpartitioning(company_id" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["marker_rows", "table_cells"])
def test_memory_of_a_task_over_filings_follows_no_table(spark, sf_dir, monkeypatch, name):
    """Orders are as many as the input has and aren't broadcast, and what is sorted after a shuffle is so many lines and no more."""
    from tesserae.plans import base, dataflow

    want = sorted(map(str, registry.QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(dataflow, "LINES", 500)
    got = registry.QUERIES[name](spark, sf_dir)
    assert sorted(map(str, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert f", {-(-base.table(spark, sf_dir, 'lineitem').count() // 500)})" in plan  # partitions of the shuffle of lines


def test_texts_of_lines_are_made_behind_the_sorts(spark, sf_dir):
    from tesserae.plans import dataflow

    plan = dataflow.filings(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("active customers") < plan.index("Join Inner")  # the plan's top comes first


@pytest.mark.parametrize("sources", [0, 3, 63, 64, 70])
def test_phrases_of_sources_are_grouped_once(spark, sf_dir, tmp_path, sources):
    """A bit for each source up to 63 of them and one for none; more are grouped as rows."""
    names = [f"s{k:02}" for k in range(sources)]
    rows = [(k, "Alpha beta, alpha beta!", s) for k, s in enumerate([*names, None, *names[-1:]])]
    rows += [(1000 + k, "gamma_1 delta", s) for k, s in enumerate([*names[-2:], None])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["cross_metric_phrases"](spark, str(tmp_path)).select("phrase", "sources", "n", "examples").collect()))
    want = [(p, sources + 1, sources + 2, "|".join(names[:5])) for p in ("alpha beta", "beta alpha")] + [("gamma_1 delta", 3, 3, "|".join(names[-2:]))]
    assert got == (want if sources else [])
    plan = registry.QUERIES["cross_metric_phrases"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ObjectHashAggregate" not in plan


def test_spelled_numbers_need_the_name_of_a_scale(spark):
    said = ["about two million", "Nearly Twelve THOUSAND", "three", "one hundredth", "zero hundred", "five billion €", "two mil about lion", "ten-million", "7 million"]
    rows = spark.createDataFrame([(x,) for x in said], "t string")
    got = {r.t: r.n and (r.n.value, r.n.unit) for r in rows.select("t", numbers.cell_number(F.col("t")).alias("n")).collect()}
    assert got == {said[0]: (2e6, "count"), said[1]: (12e3, "count"), said[2]: None, said[3]: None, said[4]: (0.0, "count"), said[5]: (5e9, "currency"), said[6]: None, said[7]: None, said[8]: (7e6, "count")}


def test_what_is_computed_once_is_computed_before_the_generator(spark):
    # A generator with a lambda evaluates all of its expression node by node; a projection is compiled.
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string")
    seen = catalogue.once(rows, "n", F.size(F.filter(F.split("t", " "), lambda x: x != "a")))
    assert seen.count() == 2 and [r.n for r in seen.collect() if r.id == 1] == [1]
    assert seen.columns == ["id", "t", "n"] and "Generate explode(array(_once#" in seen._jdf.queryExecution().optimizedPlan().toString()
