"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Every source's documents are laid end to end in a shuffled order (that of the MD5 of a seed, the id, the source and the
text) and cut into blocks of BLOCK words. The mix is a row of slots. Slot i has the golden-ratio point i * phi mod 1, in
exact 31-bit integers; the cumulative weights map it to a source, so that every stretch of slots has the sources near
their weights. A slot's rank among those of its source names the block: the blocks in order, then again for the next
epoch, three epochs at most. Joined with the blocks, the schedule says which words of which documents come when.

Slots count as BLOCK words, which the last block of a source has not. That is little for a source of many blocks, but
would starve a short one; so a source under SHORT words takes its target to the word instead: whole epochs and the first
words of one more, in slots spread evenly over the row, which other sources share with it. From SHORT words on a source
misses at most a block an epoch for that, besides the few blocks of the points' discrepancy.

Nothing is ordered in one task: ranks and positions are counts per chunk of slots, or per cell of hashes, summed up in
order over coarse cells and then within them, plus a rank within the chunk or cell. A source with a third of all rows has
its cells like any other, and rows that repeat are counted first. Slots meet their source in a join on cells of points,
whose number grows with that of the sources. Only totals reach the driver.

Edge cases: a null source is a source of its own, the last. Null and empty texts have size 0 and are never taken. Rows
that repeat are rows of their own, each with its position. An empty table gives an empty result; sources without words
have target 0. Extra columns are not read by the mix, and documents_in_mix keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import before, bounded, copies, one_of_each, unpacked
from .scratch import Scratch

BLOCK, CHUNK, EPOCHS, SEED = 128, 65_536, 3, "mix:"
GOLDEN, POINTS = 1_327_217_885, 1 << 31  # 2**31 / phi, odd
SHORT = 16 * BLOCK


def row_key() -> Column:
    """The same for rows equal in doc_id, source and text, and in a shuffled order."""
    id_, source, text = F.col("doc_id").cast("string"), F.concat(F.lit("s"), F.col("source")), F.col("text")
    return F.md5(F.concat(F.lit(SEED), F.coalesce(id_, F.lit("")), F.lit("|"), F.coalesce(source, F.lit("n")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), the shuffle key and n, the number of rows equal in these."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), row_key().alias("key"))
    return rows.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("n"))


def targets(rows: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = EPOCHS) -> DataFrame:
    """source, number, source_size, n_blocks, target and its stretch of points, begin to end, for each source.

    Targets share the total by weight; none exceeds ``most`` times its source, and what is cut off goes to the others by
    weight. That is min(cap, level * weight), with the level at which the total comes out."""
    total = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    total = total.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("number") % len(cycle) + 1).cast("int")).cast("long")
    total = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    total = total.withColumn("level", left.cast("double") / weights)
    # The first source, by ratio, that the level doesn't fill sets the level; those before it are full.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "number", "level")))
    level = level.over(Window.partitionBy(F.lit(1)))["level"]
    total = total.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight")))
    part = F.floor(F.col("target") * 1024).cast("long")
    in_order = Window.orderBy("number")
    upto, all_ = F.sum(part).over(in_order), F.sum(part).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    end = F.floor(upto.cast("double") / F.nullif(all_, F.lit(0)).cast("double") * float(POINTS)).cast("long")
    n_blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    total = total.select("source", "number", "source_size", n_blocks.alias("n_blocks"), "target", F.coalesce(end, F.lit(0)).alias("end"))
    return total.withColumn("begin", F.coalesce(F.lag("end").over(in_order), F.lit(0)))


def schedule(spark: SparkSession, sources: DataFrame, scratch: Scratch, most: int = EPOCHS) -> DataFrame:
    """slot, number (of the source), epoch, block and upto, the words of the block that the slot takes at most."""
    words, n = sources.agg(F.sum("source_size"), F.count("*")).first()
    slots = -(-(words or 0) // BLOCK)
    width = POINTS >> max(12, min(24, n.bit_length()))  # of a cell of points: a few sources meet in each
    cell = F.explode(F.sequence(F.expr(f"begin div {width}"), F.expr(f"(end - 1) div {width}")))
    stretches = scratch.save(sources.where("begin < end").select("number", "begin", "end", cell.alias("cell")), "stretches")
    point = F.expr(f"(id % {POINTS}) * {GOLDEN} % {POINTS}")
    placed = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"), F.expr(f"id div {CHUNK}").alias("chunk")).withColumn("cell", F.expr(f"point div {width}"))
    placed = placed.join(bounded(stretches), "cell").where("point >= begin and point < end").select("slot", "number", "chunk")
    placed = scratch.save(placed, "placed")
    counts = before(placed.groupBy("number", "chunk").agg(F.count("*").alias("n")), ["number"], "chunk", F.expr("chunk div 1024")).drop("n")
    rank = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("rank", rank).join(counts, ["number", "chunk"]).withColumn("rank", F.col("rank") + F.col("base"))
    long_ = sources.where(F.col("source_size") >= SHORT).select("number", "n_blocks")
    ranked = ranked.join(long_, "number").where(F.col("rank") < F.col("n_blocks") * most).withColumn("upto", F.lit(BLOCK).cast("long"))
    ranked = ranked.select("slot", "number", "n_blocks", "rank", "upto").unionByName(short_slots(sources, slots))
    return ranked.select("slot", "number", F.expr("rank div n_blocks").alias("epoch"), F.expr("rank % n_blocks").alias("block"), "upto")


def short_slots(sources: DataFrame, slots: int) -> DataFrame:
    """slot, number, n_blocks, rank and upto of the sources under SHORT words, whose slots give their target to the word."""
    short = sources.where((F.col("source_size") > 0) & (F.col("source_size") < SHORT)).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    short = short.withColumn("rest", F.expr("words % source_size")).withColumn("n", F.expr(f"(words div source_size) * n_blocks + (rest + {BLOCK - 1}) div {BLOCK}"))
    short = short.where("n > 0").select("number", "n_blocks", "rest", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("rank"))
    upto = F.when((F.col("rank") == F.col("n") - 1) & (F.expr(f"rest % {BLOCK}") > 0), F.expr(f"rest % {BLOCK}")).otherwise(F.lit(BLOCK))
    shift = (F.col("number").cast("long") * GOLDEN % POINTS) / float(POINTS)  # so that sources of equal targets don't meet in the same slots
    slot = F.least(F.floor((F.col("rank") + shift) / F.col("n") * slots), F.lit(slots - 1))
    return short.select(slot.cast("long").alias("slot"), "number", "n_blocks", "rank", upto.cast("long").alias("upto"))


def positions(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row, copies one by one, with its source's number and start, the words before it in the source's shuffled
    order."""
    of = sources.select(F.col("source").alias("_source"), "number", "source_size", "target")
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("cell", F.substring("key", 1, 4))
    words = F.col("size") * F.col("n")
    base = before(rows.groupBy("number", "cell").agg(F.sum(words).alias("n")), ["number"], "cell", F.substring("cell", 1, 2)).drop("n")
    inner = Window.partitionBy("number", "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(words).over(inner), F.lit(0))).join(base, ["number", "cell"])
    start = F.col("start") + F.col("base") + F.col("copy") * F.col("size")
    return copies(rows, "n", "copy").select("number", "key", "doc_id", "size", "source_size", "target", F.col("n").alias("n_copies"), start.alias("start"))


def segments(placed: DataFrame) -> DataFrame:
    """number, block, doc_id, key, n_copies, start, and the words first to last (exclusive, from the document's start) that
    are in the block."""
    block = F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")))
    cut = placed.where("size > 0").select("number", "doc_id", "key", "n_copies", "start", "size", block.alias("block"))
    first, last = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0)), F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size"))
    return cut.select("number", "block", "doc_id", "key", "n_copies", "start", first.alias("first"), last.alias("last"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """The mix, a row for each piece of a document in each slot (slot, epoch, number, block, doc_id, key, n_copies, start,
    first, last); and the documents with number, key, start, size, source_size, target and n_copies."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(sized(docs), "rows")
    sources = scratch.save(targets(rows, cycle), "sources")
    placed = scratch.save(positions(rows, sources), "positions")
    mixed = schedule(docs.sparkSession, sources, scratch).join(segments(placed), ["number", "block"])
    last = F.least(F.col("last"), F.col("block") * BLOCK + F.col("upto") - F.col("start"))
    return mixed.withColumn("last", last).where("first < last").drop("upto"), placed


def taken(mixed: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each row."""
    words = mixed.groupBy("number", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    words = words.select(F.col("number").alias("_n"), F.col("start").alias("_s"), "taken")
    out = placed.join(words, (F.col("number") == F.col("_n")) & (F.col("start") == F.col("_s")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def documents_in_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: each time that it takes the block with a document's first
    word, the whole document comes. Documents without words never come. Rows equal in doc_id, source and text are one
    row with the places of all of them; if they differ in other columns, the one with the least hash of these stands."""
    mixed, placed = mix(docs)
    picks = mixed.where("first = 0").select(F.col("key").alias("k"))
    repeated = placed.where("n_copies > 1").select(F.col("key").alias("k")).distinct()
    return unpacked(one_of_each(docs, row_key(), repeated, ["doc_id", "source", "text"]).join(picks, "k"), docs.columns)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of all documents."""
    return taken(*mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP5_SQL = f"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce('s' || source, 'n') || '|' || md5(coalesce(text, ''))) AS key FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM rows_ GROUP BY source
), w AS (SELECT *, number % 3 + 1 AS weight, source_size * 3 AS cap FROM per),
lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lam AS (SELECT level FROM lev WHERE level * weight <= cap ORDER BY cap / weight, number LIMIT 1),
tgt AS (SELECT w.*, least(cap::DOUBLE, level * weight) AS target FROM w, lam),
parts AS (SELECT *, CAST(floor(target * 1024) AS BIGINT) AS part FROM tgt),
src AS (
  SELECT *, CAST(ceil(source_size / {BLOCK}) AS BIGINT) AS n_blocks,
         CAST(floor(CAST(sum(part) OVER (ORDER BY number) AS DOUBLE) / CAST(sum(part) OVER () AS DOUBLE) * {float(POINTS)}) AS BIGINT) AS fin
  FROM parts
), spans AS (SELECT *, coalesce(lag(fin) OVER (ORDER BY number), 0) AS beg FROM src),
slots AS (
  SELECT i AS slot, (i % {POINTS}) * {GOLDEN} % {POINTS} AS point
  FROM range((SELECT CAST((sum(source_size) + {BLOCK - 1}) // {BLOCK} AS BIGINT) FROM per)) AS r(i)
), ranked AS (
  SELECT number, n_blocks, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS rank
  FROM slots JOIN spans ON point >= beg AND point < fin
), times AS (
  SELECT number, rank % n_blocks AS block, count(*) AS n FROM ranked WHERE rank < 3 * n_blocks GROUP BY ALL
), pos AS (
  SELECT r.*, s.number, s.source_size, s.target,
         CAST(sum(size) OVER (PARTITION BY s.number ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM rows_ r JOIN src s ON r.source IS NOT DISTINCT FROM s.source
), seg AS (
  SELECT number, start, size, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM pos WHERE size > 0
), got AS (
  SELECT s.number, s.start, sum(n * (least((s.block + 1) * {BLOCK}, start + size) - greatest(s.block * {BLOCK}, start))) AS taken
  FROM seg s JOIN times t ON s.number = t.number AND s.block = t.block GROUP BY ALL
)
SELECT doc_id, size, source_size, target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
FROM pos p LEFT JOIN got g ON p.number = g.number AND p.start = g.start AND p.size > 0
"""
