"""Every stage of the pipeline on its predecessor's result."""

import hashlib

import numpy as np

import corpus_pipeline as cp
from tesserae.llm import bpe, lines, mixing, neardup, toxicity
from tesserae.llm.scratch import Scratch


def test_stages(spark, sf_dir):
    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    before = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        after = scratch.save(stage(spark, before, sf_dir), name)
        assert after.columns == columns or k == len(cp.STAGES) - 1
        kept[name] = before, after
        before = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    a, b = kept["toxicity"]
    weights = toxicity.fit_on_labels(spark, a, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(b) == ids(toxicity.score(a, weights).where("score < 0.5"))

    a, b = kept["line_dedup"]
    assert {tuple(r) for r in b.select("doc_id", "text").collect()} == {tuple(r) for r in lines.remove_boilerplate(a).select("doc_id", "text").collect()}
    assert b.where("length(text) <> n_chars").count() == 0

    a, b = kept["minhash_neardup"]
    assert ids(b) == ids(neardup.near_duplicates(a).where("kept")) and b.count() == len(ids(b))

    a, b = kept["source_mix"]
    assert ids(b) <= ids(a)
    mixed, _ = mixing.mix(a)
    assert b.count() == mixed.where("first = 0").count()

    a, b = kept["byte_bpe"]
    texts = {r.doc_id: r.text for r in a.collect()}
    codec = bpe.Codec(*bpe.vocabulary())
    assert b.count() == a.count()
    for r in b.collect():
        assert codec.decode(r.ids) == texts[r.doc_id].encode()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(np.frombuffer(r.ids, "<u4"))


def test_run_is_the_stages(spark, sf_dir):
    one = sorted(map(str, cp.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()))
    assert one == sorted(map(str, cp.run(spark, sf_dir).select("doc_id", "ids_sha256").collect())) and len(one) > 50


def test_awkward_documents(spark, tmp_path):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "some words " * 40, "en", "a", 440), (3, "some words " * 40, "en", "a", 440), (None, "no id at all", "en", "b", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for df in (docs, docs.limit(0)):
        left, counts = df.count(), []
        for _, stage in cp.STAGES:
            df = Scratch(spark, "odd").save(stage(spark, df, str(tmp_path)), "x")
            counts.append(df.count())
        # Without labels nothing is toxic; the repeated row goes as a copy; mixing leaves each document once at least here.
        assert counts[:3] == ([5, 5, 4] if left else [0, 0, 0]) and counts[4] == counts[3]
        assert (counts[3] > 0) == (left > 0)
