"""From raw documents to token ids: each stage works on all that its predecessor kept.

1. toxicity: documents that the FTRL model, trained on the labels, scores 0.5 or more go.
2. line dedup: boilerplate lines that many sites share go from the texts.
3. near dedup: of each group of near copies (five-word shingles, similarity 0.8) one document stays.
4. mixing: documents come as often as the mix of sources to target weights takes them.
5. byte-level BPE: ids of every document, and proof that they decode to its bytes.

A stage's result is written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, lines, mixing, neardup, ranks, toxicity
from tesserae.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = toxicity.fit_on_labels(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, weights)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = lines.remove_boilerplate(docs, counts=False)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows equal in doc_id and text, the one with the least hash of its other columns stays."""
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text")))
    repeated = docs.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k")
    return ranks.unpacked(ranks.one_of_each(rest, key, repeated, ["doc_id", "text"]), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.documents_in_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, *bpe.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", clean_lines),
    ("minhash_neardup", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # SQL cannot express the training, the signatures or the merges; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
