"""Definitions near mentions on hand-worked segments."""

from pyspark.sql import functions as F

from tesserae.operators import definitions as D


def test_definitions(spark):
    segments = [(1, 0, "new customers"), (1, 3, "We  define it as a first purchase"), (1, 4, "calculated by formula"), (1, 5, "defined as the second"), (1, 11, "the term means more")]
    segments += [(2, 0, "new customers"), (2, 6, "defined as too far"), (3, 2, "x " * 400 + " refers to"), (3, 1, None), (4, 1, "methodology of GAAP revenue by tenure cohort in a period")]
    said = [(1, 0, "cm_new_customers_acquired"), (1, 12, "cm_other"), (2, 0, "cm_gmv"), (3, 1, "cm_gmv"), (4, 1, "cm_revenue_by_cohort"), (4, 1, "cm_revenue_by_cohort"), (5, 1, "cm_gmv")]
    got = {(r.doc, r.metric_id): r for r in D.definitions(spark.createDataFrame(segments, "doc long, seq long, text string"), spark.createDataFrame(said, "doc long, seq long, metric_id string"), "doc").collect()}
    assert set(got) == {(1, "cm_new_customers_acquired"), (1, "cm_other"), (3, "cm_gmv"), (4, "cm_revenue_by_cohort")}
    one = got[1, "cm_new_customers_acquired"]
    assert (one.definition, one.methodology, one.alignment) == ("We define it as a first purchase", "calculated by formula", "not_aligned")
    assert got[1, "cm_other"].definition == "the term means more" and got[1, "cm_other"].alignment == "unknown"
    assert len(got[3, "cm_gmv"].definition) == 503 and got[3, "cm_gmv"].definition.endswith("...")
    assert (got[4, "cm_revenue_by_cohort"].definition, got[4, "cm_revenue_by_cohort"].alignment) == ("", "aligned")


def test_types(spark):
    texts = ["What this means", "a formula", "meanwhile", "definition of the methodology", None, ""]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(D.segment_type(F.col("x")).alias("t")).collect()]
    assert got == ["definition", "methodology", "paragraph", "definition", "paragraph", "paragraph"]
