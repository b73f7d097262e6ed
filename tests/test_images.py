"""Image triage and simulation on hand-worked cases."""

from pyspark.sql import functions as F

from tesserae.functions import catalogue
from tesserae.operators import simulation, triage
from tesserae.sources import html

FAR = "plain words go on and on here " * 20


def picture(src, size="", caption="", heading=""):
    return f"<h2>{heading}</h2><p>{FAR}</p><p>{caption}</p><img src='{src}' {size}><p>{FAR}</p>"


def test_images_of():
    got = html.images_of("<h1>Business</h1><p>before</p><img src='/x/a.png?y=1' alt='Alt' width='12px' height=7><script>no</script><p>after</p><img>")
    assert [(k, t, w, h) for k, t, _, w, h, _ in got] == [("heading", "Business", 0, 0), ("image", "a.png", 12, 7), ("image", "", 0, 0)]
    assert got[1][2] == "Alt Business before after" and got[1][5] == len("Business before after")
    assert html.images_of(None) == [] and html.images_of("<img width='x' src>")[0][3:5] == (0, 0)
    long = html.images_of("a" * 2000 + "<img src=b.png>" + "c" * 2000)[0]
    assert long[2].strip() == "a" * 500 + "c" * 500


def test_classes_and_relevance(spark):
    cases = [
        ("logo.png", "width=200 height=120", "", "Business", "logo", 0.15), ("logo.png", "width=20 height=20", "", "", "decorative", 0.0), ("sign_2.png", "", "", "", "signature", 0.0),
        ("x.png", "width=900 height=300", "Total revenue", "", "table_image", 0.48), ("my-chart.png", "", "", "MD&A", "chart", 0.7), ("x.png", "width=900 height=700", "retention", "", "chart", 0.58),
        ("x.png", "width=400 height=380", "retention", "", "unknown", 0.28), ("x.png", "width=400 height=380", "churn", "Risk Factors", "unknown", 0.38), ("x.png", "width=900 height=100", "", "", "decorative", 0.0),
        ("x.png", "width=400 height=380", "", "Signatures", "decorative", 0.0), ("x.png", "", "cohort churn ltv cac nrr", "", "chart", 0.82),
    ]
    pages = spark.createDataFrame([(i, picture(*c[:4])) for i, c in enumerate(cases)] + [(100, None), (101, "no image")], "page long, html string")
    got = {r.page: r for r in triage.triage(html.images(pages, "page"), "page").collect()}
    assert [(got[i]["class"], got[i].relevance) for i in range(len(cases))] == [c[4:] for c in cases] and len(got) == len(cases)
    assert got[7].manual and got[7].queued and not got[6].queued and got[6].section == "unknown"
    assert triage.triage(html.images(pages.limit(0), "page"), "page").count() == 0


def test_repeated_files_and_decks(spark):
    same = "".join(picture("chart.png", "width=500 height=400", "retention") for _ in range(6))
    deck = "<p>cover</p>" + "".join(f"<img src=p{k}.jpg width=1000 height=1300>" for k in range(7)) + "<img src=logo.png width=100 height=100><img src=q.jpg>"
    few = "".join(f"<img src=p{k}.jpg width=1000 height=1300>" for k in range(4))
    got = triage.triage(html.images(spark.createDataFrame([(1, same), (2, deck), (3, few)], "page long, html string"), "page"), "page").collect()
    kinds = lambda page: sorted(r["class"] for r in got if r.page == page)
    assert kinds(1) == ["decorative"] * 6 and {r.relevance for r in got if r.page == 1} == {0.0}
    assert kinds(2) == ["full_page_scan"] * 8 + ["logo"] and kinds(3) == ["unknown"] * 4
    assert all(r.queued and r.relevance == 0.6 for r in got if r["class"] == "full_page_scan")


def test_simulation(spark):
    before = [("m", [r"\bold\s+name\b"], []), ("same", [r"\bsame\b"], [])]
    after = simulation.patched(before, added={"m": [r"\bnew\s+name\b"], "fresh": [r"\bfresh\b"]}, removed={"m": [r"\bold\s+name\b"]}, exclusions={"same": [r"\bnot\b"]})
    assert [m for m, _, _ in after] == ["m", "same", "fresh"] and after[1][2] == [r"\bnot\b"]
    assert simulation.patched(before, removed={"m": before[0][1]}) == before[1:]
    texts = [(1, "the old name"), (1, "the new name"), (2, "the old name"), (3, "a new name and same"), (4, "not the same"), (5, "fresh"), (6, None), (7, "")]
    found = simulation.presence(spark.createDataFrame(texts, "doc long, text string"), "doc", before, after)
    got = {(r.doc, r.metric_id): (r.before, r.after) for r in found.collect()}
    assert got == {(1, "m"): (True, True), (2, "m"): (True, False), (3, "m"): (False, True), (3, "same"): (True, True), (4, "same"): (True, False), (5, "fresh"): (False, True)}
    gold = spark.createDataFrame([(1, "m"), (1, "m"), (2, "m"), (9, "m"), (3, "same")], "doc long, metric_id string")
    r = {r.metric_id: r for r in simulation.scores(found, gold, "doc").collect()}
    assert set(r) == {"m", "same"} and (r["m"].tp_before, r["m"].fp_before, r["m"].fn_before, r["m"].tp_after, r["m"].fp_after, r["m"].fn_after) == (2, 0, 1, 1, 1, 2)
    assert (r["m"].recall_delta, r["m"].precision_delta, r["m"].coverage_facts, r["m"].coverage_documents) == (round(1 / 3, 6) - round(2 / 3, 6), -0.5, 4, 3)
    assert (r["same"].precision_before, r["same"].precision_after) == (0.5, 1.0)
    tiers = {t.tier: t.regressed for t in simulation.tier_recall(simulation.scores(found, gold, "doc"), {"one": ["m"], "two": ["same", "fresh"]}).collect()}
    assert tiers == {"one": True, "two": False}
    assert simulation.presence(spark.createDataFrame([], "doc long, text string"), "doc", catalogue.METRICS, after).groupBy().agg(F.count("*")).first()[0] == 0


def test_lines_of_one_number_are_files_of_their_own(spark, tmp_path):
    # Six lines of one number in an order: files named after it were taken for one repeated file, which the SQL knows nothing of.
    from tesserae.plans import images

    spark.createDataFrame([(4, 7)] * 6 + [(3, 2)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(3,), (4,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.filing_id: (r["class"], r.n) for r in images.image_triage(spark, str(tmp_path)).collect()}
    assert got == {4: ("table_image", 6), 3: ("unknown", 1)}
    names = html.images(images.illustrated(spark, str(tmp_path)), "filing_id").where("kind = 'image'")
    assert names.groupBy("filing_id", "text").count().where("count > 1").count() == 0


def test_pages_are_read_once_and_their_texts_not_sent(spark, sf_dir):
    from tesserae.plans import images

    plan = images.image_triage(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1  # the parser ran three times: for the images, their repeated files and the decks
    sent = triage.looked_at(html.images(spark.createDataFrame([(1, picture("a.png"))], "page long, html string"), "page"), "page")
    assert "nearby" not in sent.columns


def test_lines_make_the_page_behind_their_groups(spark, sf_dir):
    from tesserae.plans import images

    plan = images.illustrated(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "plain words" not in plan[plan.index("Aggregate") :]  # blocks of 1,300 characters were sorted and collected
