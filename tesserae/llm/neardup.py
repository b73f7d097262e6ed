"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles gives minima; b = 16 bits of the first ``CHUNKS * ROWS`` are the signature, and 2 bits
of all PLACES a sketch of a few longs. Two signatures differ in some number of places; split into chunks, by the pigeonhole principle at least one chunk differs in no more
than ERRORS places if all differ in no more than ``CHUNKS * (ERRORS + 1) - 1``. So each chunk enters the index once for
every choice of ERRORS places left out, and two documents meet if they agree on such a key. Places differ with
probability 1 - J: at J = 0.8 a pair misses all keys with probability 2.4e-5, and every pair under the distance of 20
places is found with certainty.

Texts of equal sets fall into classes first, so copies cost one member. Within a bucket of the index, members are
compared with one leader, on whole sets of shingles; links make components. Members then outside are
compared with the member of the bucket that has most links, in a group of near copies often the text they all come from.
Buckets that still hold several components get their remaining pairs across components compared as well. Between small
components that is one by one in buckets of HOT members at most, and in larger ones by blocks of sets, whose size is
bounded in rows and in shingles and which give a spanning forest of their links. A component of more than BIG meets the
documents that share a bucket with it in such blocks too, after sketches alone have told which of them can be near. So
no link that meets in a bucket is lost, while large groups never give out their pairs. Pairs whose sketches or sizes rule
out the threshold (SIGMAS standard deviations for sketches, under 1e-4 at the threshold) neither leave a join nor get
verified: documents that share a long passage, and no more, meet in many buckets and part there.

Shingles are 64-bit hashes; two different shingles of one document, or of a verified pair, collide with probability
under 1e-9.

Edge cases: null and empty texts, and texts without words, have an empty set and link with nothing; they are kept. A
text of fewer words than a shingle has the whole sequence as its one shingle. Repeated doc_ids act as one document with
several texts: each row keeps its own set, links are those of any of them, and the component is that of the id. Rows
without a doc_id link with nothing, have no component and are kept. An empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .components import connected, forest
from .ranks import bounded
from .scratch import Scratch
from .words import batches, encode, mix, shingle_sets, tidy

CHUNKS, ROWS, ERRORS = 10, 6, 1
PLACES, SIGMAS = 512, 4.0
WORDS = PLACES // 32  # longs of a sketch, 2 bits a place
SHINGLE, PERCENT = 5, 80
BIG, HOT = 32, 64  # members of a component, and of a bucket, that are compared in blocks
CELL, CELL_SHINGLES = 256, 500_000  # rows and shingles of a block

_U, _V = np.uint64, np.uint32
_seed = mix(np.arange(1, 2 * PLACES + 1, dtype=_U) * _U(0xD1342543DE82EF95))
_A, _B = ((_seed[k::2] >> _U(31)).astype(_V) | _V(1) for k in (0, 1))
_LEFT_OUT = list(combinations(range(ROWS), ERRORS))
_SKETCH = [f"w{k}" for k in range(WORDS)]


def minima(s: np.ndarray) -> np.ndarray:
    """16 bits of each of the minima over the set's hashes."""
    x = (s >> _U(32)).astype(_V) ^ s.astype(_V)
    least = np.full(PLACES, 0xFFFFFFFF, _V)
    for begin in range(0, len(x), 512):
        y = x[None, begin : begin + 512] * _A[:, None]
        y ^= y >> _V(15)
        y *= _B[:, None]
        np.minimum(least, y.min(axis=1), out=least)
    return (mix(least.astype(_U)) >> _U(48)).astype(np.uint16)


def sketches(least: np.ndarray) -> np.ndarray:
    """Rows of PLACES minima to rows of WORDS longs."""
    two = (least & 3).astype(np.uint8).reshape(len(least), -1, 4)
    return np.ascontiguousarray(two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6).view(np.int64)


def distance_limit(percent: int) -> int:
    """Places of a sketch that may differ before a pair at the threshold is that unlikely."""
    p = (1 - percent / 100) * 0.75
    return int(np.ceil(PLACES * p + SIGMAS * np.sqrt(PLACES * p * (1 - p))))


def may_reach(percent: int, a: str, b: str):
    """Whether sizes and sketches, in columns with these suffixes, leave the threshold possible."""
    differ = []
    for w in _SKETCH:
        x = F.col(w + a).bitwiseXOR(F.col(w + b))
        differ.append(F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))))
    least, most = F.least("n" + a, "n" + b), F.greatest("n" + a, "n" + b)
    return (least * 100 >= most * percent) & (sum(differ[1:], differ[0]) <= distance_limit(percent))


def sides(df: DataFrame, id_: str, suffix: str, *more: str) -> DataFrame:
    """The columns that may_reach compares, with a suffix."""
    return df.select(F.col("rep").alias(id_), F.col("n_shingles").alias("n" + suffix), *[F.col(w).alias(w + suffix) for w in _SKETCH], *more)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row (the hash of the text), n_shingles, two hashes of the whole set, the signature and the sketch (null for
    the empty set)."""
    ship(docs.sparkSession)

    def run(tables):
        for t in tables:
            for texts, ids, rows in batches(t, ["text", "doc_id", "row"]):
                sets = shingle_sets(encode(texts), width)
                marks = [[int(mix(s).sum(dtype=_U)), int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))] for s in sets]
                marks = np.asarray(marks, dtype=_U).reshape(-1, 2).view(np.int64)
                least = np.stack([minima(s) for s in sets])
                none = np.array([len(s) == 0 for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(rows, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(marks[:, 0]),
                        pa.array(marks[:, 1]),
                        pa.array([x.tobytes() if len(s) else None for s, x in zip(sets, least[:, : CHUNKS * ROWS], strict=True)], pa.binary()),
                        *[pa.array(w, mask=none) for w in sketches(least).T],
                    ],
                    ["doc_id", "row", "n_shingles", "f1", "f2", "sig", *_SKETCH],
                )

    made = "doc_id long, row long, n_shingles long, f1 long, f2 long, sig binary, " + ", ".join(f"{w} long" for w in _SKETCH)
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(tidy(run), made)


def keys_of(signatures: list[bytes]) -> np.ndarray:
    """For each signature its keys: every chunk with every choice of ERRORS places left out."""
    sigs = np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, CHUNKS, ROWS).astype(_U)
    keys = np.zeros((len(sigs), CHUNKS, len(_LEFT_OUT)), _U)
    for k, left in enumerate(_LEFT_OUT):
        h = mix(np.arange(CHUNKS, dtype=_U)[None, :] * _U(1000) + _U(k + 1) + np.zeros((len(sigs), 1), _U))
        for r in range(ROWS):
            if r not in left:
                h = mix(h ^ (sigs[:, :, r] + _U(1)) * _U(0x9E3779B97F4A7C15))
        keys[:, :, k] = h
    return keys.reshape(len(sigs), -1).view(np.int64)


def index_keys(classes: DataFrame) -> DataFrame:
    """rep and key, for each key of its signature."""

    def run(tables):
        for t in tables:
            for begin in range(0, t.num_rows, 2048):
                part = t.slice(begin, 2048)
                keys = keys_of(part.column(1).to_pylist())
                reps = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(keys.reshape(-1))], ["rep", "key"])

    return classes.select("rep", "sig").mapInArrow(tidy(run), "rep long, key long")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches don't rule out the threshold."""
    both = pairs.join(sides(classes, "a", "_a"), "a").join(sides(classes, "b", "_b"), "b")
    return both.where(may_reach(percent, "_a", "_b")).select("a", "b")


def texts_of(reps: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """rep and one text of each class in ``reps``, that of the document which stands for it."""
    at = bounded(reps.join(classes.select("rep", "at_id", "at_row"), "rep"))  # if few, the documents aren't shuffled
    found = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").join(at, (F.col("doc_id") == F.col("at_id")) & (F.col("row") == F.col("at_row")))
    return found.groupBy("rep").agg(F.first("text").alias("text"))  # the same text, if rows repeat


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that meet the threshold on their whole sets, from their whole texts."""
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    texts = texts_of(wanted, classes, docs)
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("ta", "tb", "a", "b")

    def run(tables):
        known: dict[int, np.ndarray] = {}  # leaders come again and again
        for t in tables:
            for ta, tb, a, b in batches(t, ["ta", "tb", "a", "b"], texts=2):
                if len(known) + 2 * len(a) > 2000 or sum(map(len, known.values())) > 4_000_000:
                    known.clear()
                new = {k: x for ks, xs in ((a, ta), (b, tb)) for k, x in zip(ks, xs, strict=True) if k not in known}
                known.update(zip(new, shingle_sets(encode(list(new.values())), width), strict=True))
                good = []
                for x, y in zip(a, b, strict=True):
                    u, v = known[x], known[y]
                    shared = len(u) + len(v) - len(np.union1d(u, v))
                    good.append(100 * shared >= percent * (len(u) + len(v) - shared))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)], ["a", "b"])

    return both.mapInArrow(tidy(run), "a long, b long")


def sketch_matrix(frame: pd.DataFrame) -> np.ndarray:
    return frame[_SKETCH].to_numpy(np.int64).view(_U)


def near_sketches(one: np.ndarray, many: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of ``many`` the sketch ``one`` leaves possible."""
    x = many ^ one
    return np.bitwise_count((x | x >> _U(1)) & _U(0x5555555555555555)).sum(1, dtype=np.int64) <= distance_limit(percent)


class Sets:
    """The sets of a block, to find which of them another set is linked to."""

    def __init__(self, texts: list, width: int):
        sets = shingle_sets(encode(texts), width)
        self.n = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(flat, kind="stable")
        self.sets, self.flat, self.owner = sets, flat[order], owner[order]

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        low, high = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        at = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange((high - low).sum())
        shared = np.bincount(self.owner[at], minlength=len(self.n))
        return 100 * shared >= percent * (self.n + len(s) - shared)


def blocks_of(members: DataFrame, group: str, classes: DataFrame, name: str) -> DataFrame:
    """group and the number of blocks its members are dealt to, bounded in rows and in shingles."""
    sized = members.select(group, "rep").join(classes.select("rep", "n_shingles"), "rep")
    n = F.ceil(F.greatest(F.count("*") / CELL, F.sum("n_shingles") / CELL_SHINGLES))
    return sized.groupBy(group).agg(n.cast("int").alias(name))


def deal(n: str):
    return F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")


def every(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def verify_hot(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """For buckets with many members (key, rep, part): links that join what all links between their parts join."""
    dealt = members.join(blocks_of(members, "key", classes, "n_blocks"), "key").withColumn("own", deal("n_blocks")).withColumn("other", every("n_blocks"))
    dealt = dealt.select("key", "rep", "part", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    texts = texts_of(members.select("rep").distinct(), classes, docs)
    dealt = dealt.join(classes.select("rep", "n_shingles", "sig", *_SKETCH), "rep").join(texts, "rep")

    def run(key, df):
        df = df.sort_values("rep", ignore_index=True)
        bucket, x, y = (int(v) for v in key)
        own, part, n, keys, marks = df["own"].to_numpy(), df["part"].to_numpy(), df["n_shingles"].to_numpy(), keys_of(df["sig"].tolist()), sketch_matrix(df)
        right = np.flatnonzero(own == y)
        tests = []
        for i in np.flatnonzero(own == x).tolist():
            js = right[right > i] if x == y else right
            js = js[(part[js] != part[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
            js = js[near_sketches(marks[i], marks[js], percent)]
            same = np.where(keys[js] == keys[i], keys[i], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            js = js[same == bucket]  # a pair that shares several keys is compared for one
            if len(js):
                tests.append((i, js))
        out = []
        if tests:
            rows = np.unique(np.concatenate([[i] + js.tolist() for i, js in tests]))
            block, place = Sets(df["text"].iloc[rows].tolist(), width), {r: k for k, r in enumerate(rows.tolist())}
            links = []
            for i, js in tests:
                good = block.linked(block.sets[place[i]], percent)
                links += [(i, j) for j in js.tolist() if good[place[j]]]
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            out = [(int(df["rep"].iloc[i]), int(df["rep"].iloc[j])) for i, j in forest(len(df), a, b)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("key", "x", "y").applyInPandas(run, "a long, b long")


def verify_blocks(against: DataFrame, own: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """For components big with members ``own``: of the documents in ``against``, those linked to a member, one link for
    each block of members. Both have big and rep."""
    sizes = blocks_of(own, "big", classes, "own_blocks").join(blocks_of(against, "big", classes, "blocks"), "big")
    marks = classes.select("rep", "n_shingles", *_SKETCH)
    left = against.join(sizes, "big").select("big", "rep", deal("blocks").alias("x"), every("own_blocks").alias("y")).join(marks, "rep")
    right = own.join(sizes, "big").select("big", "rep", deal("own_blocks").alias("y"), every("blocks").alias("x")).join(marks, "rep")
    key = ["big", "x", "y"]

    def meets(key, q, m):
        out = []
        if len(q) and len(m):
            one, many, n = sketch_matrix(q), sketch_matrix(m), m["n_shingles"].to_numpy()
            for rep, k, mark in zip(q["rep"].tolist(), q["n_shingles"].tolist(), one, strict=True):
                if (near_sketches(mark, many, percent) & (100 * np.minimum(n, k) >= percent * np.maximum(n, k))).any():
                    out.append((*key, rep))
        return pd.DataFrame(out, columns=["big", "x", "y", "rep"]).astype({"big": "int64", "x": "int32", "y": "int32", "rep": "int64"})

    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meets, "big long, x int, y int, rep long")
    near = scratch.save(near, "near-blocks")
    members = own.join(sizes, "big").select("big", "rep", deal("own_blocks").alias("y"))
    members = members.join(scratch.load("near-blocks", near).select(*key).distinct(), ["big", "y"]).select(*key, "rep")
    texts = texts_of(near.select("rep").union(members.select("rep")).distinct(), classes, docs)

    def run(key, q, m):
        out = []
        if len(q) and len(m):
            block = Sets(m["text"].tolist(), width)
            for rep, s in zip(q["rep"].tolist(), shingle_sets(encode(q["text"].tolist()), width), strict=True):
                linked = np.flatnonzero(block.linked(s, percent))
                if len(linked):
                    out.append((rep, int(m["rep"].iloc[linked[0]])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    queries, held = (df.join(texts, "rep").select(*[F.col(c).alias(c) for c in (*key, "rep", "text")]) for df in (near, members))
    return queries.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(run, "a long, b long")


def place(members: DataFrame, parts: DataFrame) -> DataFrame:
    """key, rep and part, the component that rep is in so far."""
    return members.join(parts, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept, of every row."""
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select("doc_id", "text")
    described = scratch.save(describe(docs, width), "described")
    full = described.where("n_shingles > 0 and doc_id is not null")
    same = ["f1", "f2", "n_shingles"]
    classes = full.groupBy(*same).agg(F.min(F.struct("doc_id", "row")).alias("at"), *[F.min(c).alias(c) for c in ("sig", *_SKETCH)])
    # A class has a number of its own, as a doc_id may stand for several classes. It is fixed once the table is written.
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("rep"), *same, F.col("at.doc_id").alias("at_id"), F.col("at.row").alias("at_row"), "sig", *_SKETCH), "classes")

    keys = scratch.save(index_keys(classes), "keys")
    # The order is the same in all buckets, so a document has few leaders, and few pairs of texts meet.
    leader = F.min(F.struct(F.xxhash64("rep").alias("h"), "rep"))["rep"]
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), leader.alias("leader")).where("n > 1").select("key", "leader")
    members = scratch.save(keys.join(buckets, "key").select("key", "rep", "leader"), "members")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = scratch.save(members.where("rep != leader").select(*ordered("rep", "leader")).distinct(), "stars")
    links = scratch.save(verify(scratch.save(plausible(stars, classes, percent), "near"), classes, docs, width, percent), "links")
    parts = connected(links, scratch, "parts")

    placed = scratch.save(place(members, parts), "placed")
    degrees = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
    ranked = placed.join(degrees, "rep", "left").select("key", "rep", "part", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.xxhash64("rep").alias("h"), "rep", "part").alias("rank"))
    hubs = ranked.groupBy("key").agg(F.max("rank").alias("hub"))
    spokes = placed.join(hubs, "key").where("part != hub.part").select(*ordered("rep", "hub.rep")).distinct().join(stars, ["a", "b"], "left_anti")
    spokes = scratch.save(spokes, "spokes")
    hub_links = scratch.save(verify(scratch.save(plausible(spokes, classes, percent), "near-hubs"), classes, docs, width, percent), "links-hubs")
    as_links = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts = connected(as_links.unionByName(hub_links), scratch, "parts-hubs")

    # What is left open: pairs in a bucket that are in different components and weren't compared yet.
    placed = scratch.save(place(members, parts), "placed-hubs")
    # A bucket is judged by its components, so members of a large one aren't brought to every bucket they are in.
    shares = scratch.save(placed.groupBy("key", "part").agg(F.count("*").alias("n")), "shares")
    split = shares.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.sum("n").alias("n"))
    split = scratch.save(split.where("low != high and n > 2").select("key"), "split")  # of two, one was the leader
    open_ = scratch.save(shares.join(split, "key", "left_semi").select("key", "part"), "open")
    sizes = parts.groupBy(F.col("component").alias("part")).agg(F.count("*").alias("n_part")).where(F.col("n_part") > BIG)
    big = scratch.save(sizes.join(open_.select("part").distinct(), "part", "left_semi"), "big").select("part")

    small = placed.join(big, "part", "left_anti").join(split, "key", "left_semi")
    small = scratch.save(small.select("key", "rep", "part"), "small")
    few = scratch.load("small", small)
    hot = scratch.save(small.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), "hot-keys")
    more = scratch.save(verify_hot(scratch.load("small", small).join(hot, "key", "left_semi"), classes, docs, width, percent), "links-hot")
    own_keys = scratch.load("small", small).groupBy("rep").agg(F.collect_list("key").alias("keys"))  # no more than a signature has
    small = small.join(hot, "key", "left_anti").join(own_keys, "rep").join(classes.select("rep", "n_shingles", *_SKETCH), "rep")
    one, two = (sides(small, c, f"_{c}", "key", F.col("part").alias(f"part_{c}"), F.col("keys").alias(f"keys_{c}")) for c in "ab")
    first = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")  # a pair that shares several keys comes once
    rest = one.join(two, "key").where("a < b and part_a != part_b").where(may_reach(percent, "_a", "_b")).where(first).select("a", "b").distinct()
    rest = scratch.save(rest.join(stars, ["a", "b"], "left_anti").join(spokes, ["a", "b"], "left_anti"), "near-rest")
    more = more.unionByName(scratch.save(verify(rest, classes, docs, width, percent), "links-rest"))

    of_big = scratch.save(open_.join(big, "part", "left_semi").select("key", F.col("part").alias("big")), "of-big")
    # Of two large components in a bucket the lesser one's members there are the documents, the other's all are members.
    several = of_big.groupBy("key").agg(F.min("big").alias("low"), F.max("big").alias("high")).where("low != high").select("key")
    outside = few.join(scratch.load("of-big", of_big), "key")
    lesser = scratch.load("placed-hubs", placed).join(big, "part", "left_semi").join(several, "key", "left_semi").join(scratch.load("of-big", of_big), "key").where("part < big")
    against = outside.select("big", "rep").unionByName(lesser.select("big", "rep")).distinct()
    own = parts.join(big, F.col("component") == F.col("part"), "left_semi").select(F.col("component").alias("big"), F.col("node").alias("rep"))
    blocks = verify_blocks(scratch.save(against, "against"), scratch.save(own, "own"), classes, docs, width, percent, scratch)
    more = more.unionByName(scratch.save(blocks, "links-blocks"))

    # Classes of one doc_id belong together as well.
    owned = scratch.save(full.join(classes.select(*same, "rep"), same).select("doc_id", *same, "rep"), "owned")
    several = owned.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least != most")
    loops = owned.join(several, "doc_id").select(F.col("least").alias("a"), F.col("rep").alias("b")).where("a != b").distinct()
    found = connected(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(loops), scratch, "all")
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("rep", "at_id", *same, F.coalesce("component", "rep").alias("component"))
    named = scratch.save(named, "named")
    least = named.groupBy("component").agg(F.min("at_id").alias("component_id"))
    ids = scratch.load("named", named).join(least, "component").select(*same, "component_id")
    out = described.select("doc_id", *same).join(ids, same, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8 or more, over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80)
