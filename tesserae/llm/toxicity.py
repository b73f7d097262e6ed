"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between them of a text, hashed to ``2**bits``
coordinates. Each coordinate has its own learning rate, and L1 regularisation keeps most weights at zero; the others are
a table that is at most ``2**bits`` rows long, whatever the corpus, and is broadcast for scoring.

Training takes at most ``max_rows`` labelled documents (those of least hash of doc_id that are in the corpus) and
``max_features`` features of them, whichever ends first: the documented bounds of rows and of memory. They are broadcast to
the scan of the documents, cut to features by all executors and learned from in one task, in the order of that hash. Of a
doc_id that repeats, the text of least hash teaches, once; a document with more than a thousandth of ``max_features`` is
passed over, so that none takes the place of many.
Features of fewer than ``min_docs`` of these documents would be learnt by heart and are left out. Labels join by doc_id; of
several labels for one document the largest holds, and null labels teach nothing.

Edge cases: null and empty texts have no features and score as the bias says. Without any labelled row, or with labels
of one class only, the score is the smoothed share of label 1 for every text; then no text is told from another, and
``reject`` leaves all rows. Equal texts get equal scores. A row without
doc_id has no label and counts as held out. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .scratch import Scratch
from .words import batches, encode, mix, tidy, word_hashes

BITS, MAX_ROWS, MAX_FEATURES, MIN_DOCS = 20, 20_000, 60_000_000, 3
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 5.0, 0.0, 4

_U = np.uint64


def grams(raw: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features of all documents, repeats included, and the document of each."""
    h, at = word_hashes(raw)
    doc = np.repeat(np.arange(len(raw)), np.diff(at))
    found, owner = [mix(h)], [doc]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        found.append(mix(h[:-gap][same] * _U(2 * gap + 1) + mix(h[gap:][same] + _U(gap))))
        owner.append(doc[gap:][same])
    return (np.concatenate(found) >> _U(64 - bits)).astype(np.int64), np.concatenate(owner)


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features. The bias isn't regularised."""

    def __init__(self, bits: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.bias, self.bias_n = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -35, 35))) - y)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_n += g * g
        self.bias -= self.alpha * g / (self.beta + np.sqrt(self.bias_n))


def train(
    docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = EPOCHS, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS
) -> DataFrame:
    """index and weight of the coordinates that matter; index -1 is the bias. ``labels`` has doc_id and label."""
    ship(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    chosen = labels.where("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    # Ids and hashes only; a label without document takes no place, and one text stands for each id.
    versions = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("version"))
    chosen = chosen.join(versions, "doc_id")
    chosen = scratch.save(chosen.withColumn("turn", F.xxhash64(F.lit(7), "doc_id")).orderBy("turn", "doc_id").limit(max_rows), "chosen")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("version")).join(F.broadcast(chosen), ["doc_id", "version"]).select("text", "label", "turn", "doc_id")  # max_rows at most

    def cut(tables):
        seen = set()  # max_rows at most: copies of a row are cut once a task
        for t in tables:
            new = [k for k, i in enumerate(t.column(3).to_pylist()) if i not in seen and not seen.add(i)]
            for texts, label, turn, doc_id in batches(t.take(pa.array(new, pa.int64())), ["text", "label", "turn", "doc_id"]) if new else ():
                at, doc = grams(encode(texts), bits)
                distinct = np.unique(doc << bits | at)
                ends = np.searchsorted(distinct, np.arange(len(texts) + 1) << bits)
                flat = (distinct & (1 << bits) - 1).astype(np.int32)
                features = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(label, pa.float64()), features], ["turn", "doc_id", "label", "features"])

    def fit(tables):
        flat, sizes, y = [], [], []
        for t in tables:
            flat.append(t.column(3).flatten().to_numpy().copy())  # else each view keeps its whole batch
            sizes += [len(f) for f in t.column(3)]
            y += t.column(2).to_pylist()
        flat, ends = np.concatenate([*flat, np.zeros(0, np.int32)]), np.cumsum([0, *sizes])
        model, share = Ftrl(bits), (sum(y) + 0.5) / (len(y) + 1)
        model.bias = float(np.log(share / (1 - share)))
        if len(set(y)) > 1:
            often = np.bincount(flat, minlength=1 << bits)[flat] >= min_docs
            kept = np.concatenate([[0], np.cumsum(often)])[ends]
            flat = flat[often]
            rare = max(1.0, np.sqrt(len(y) / (2 * sum(y))))  # the rarer label 1, the more each of its rows counts
            for _ in range(epochs):
                for b, e, label in zip(kept[:-1].tolist(), kept[1:].tolist(), y, strict=True):
                    model.learn(flat[b:e], label, rare if label else 1.0)
        w = model.weights(slice(None))
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1), pa.int64()), pa.array(np.append(w[kept], model.bias))], ["index", "weight"])

    features = scratch.save(rows.mapInArrow(tidy(cut), "turn long, doc_id long, label double, features array<int>"), "features")
    features = scratch.load("features", features).dropDuplicates(["turn", "doc_id"])  # equal copies that several tasks met
    sizes = features.select("turn", "doc_id", F.size("features").cast("long").alias("n")).where(F.col("n") <= max_features // 1000)
    ends = Window.orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # max_rows
    fitting = sizes.withColumn("upto", F.sum("n").over(ends)).where(F.col("upto") <= max_features).select("turn", "doc_id")
    features = features.join(F.broadcast(fitting), ["turn", "doc_id"])
    return features.repartition(1).select("turn", "doc_id", "label", "features").sortWithinPartitions("turn", "doc_id").mapInArrow(tidy(fit), "index long, weight double")


def scorer(spark: SparkSession, weights: DataFrame, bits: int):
    """A function of texts on executors that gives their scores."""
    ship(spark)
    table = weights.toPandas()  # 2**bits + 1 rows at most
    dense = np.zeros(1 << bits, np.float32)
    own = table["index"] >= 0
    dense[table["index"][own].to_numpy()] = table["weight"][own].to_numpy()
    bias = float(table["weight"][~own].sum())
    index = np.flatnonzero(dense).astype(np.int32)
    shared = spark.sparkContext.broadcast((index, dense[index], bias))

    def prepare():
        index, values, bias = shared.value
        w = np.zeros(1 << bits)
        w[index] = values
        matters = w != 0

        def scores(texts: list) -> np.ndarray:
            at, doc = grams(encode(texts), bits)
            hit = matters[at]
            pairs = np.unique(doc[hit] << bits | at[hit])
            logit = bias + np.bincount(pairs >> bits, w[pairs & (1 << bits) - 1], len(texts))
            return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))

        return scores

    return prepare


def score(docs: DataFrame, weights: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id and score, the probability of label 1 in 0 to 1."""
    prepare = scorer(docs.sparkSession, weights, bits)

    def run(tables):
        scores = prepare()
        for t in tables:
            for texts, ids in batches(t, ["text", "doc_id"]):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores(texts))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def reject(docs: DataFrame, weights: DataFrame, threshold: float = 0.5, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; all rows where no coordinate has a
    weight, as then nothing was learned that tells texts apart."""
    if not weights.where("index >= 0").limit(1).count():
        return docs
    prepare = scorer(docs.sparkSession, weights, bits)
    at = docs.columns.index("text")

    def run(tables):
        scores = prepare()
        for t in tables:
            begin = 0
            for (texts,) in batches(t, ["text"]):
                part = t.slice(begin, len(texts))
                begin += len(texts)
                yield part.filter(pa.array(scores(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(doc_id="doc_id"):
    """Whether the row is kept from training: CRC-32 of the id's digits divisible by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_on_labels(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    labels = labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out())
    scratch = Scratch(spark, "toxicity")
    return scratch.save(train(docs, labels, scratch), "weights")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = fit_on_labels(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
