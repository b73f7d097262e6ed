"""Quotation linking: conversations in reply order, without what messages quote. Built of DataFrame functions only.

A line's level is the number of quote marks (``>``, white space between them allowed) it begins with. Runs of lines of
one level in a message, up to a blank line, are passages. A quoted passage is normalised as a whole (marks off, all white
space collapsed, lower case), so that other line breaks make no difference, hashed to 128 bits and joined with the
messages that have it as a passage of their own. Where none has, its lines are hashed and joined one by one, and the
passage goes to the message that has most of them. Of several messages with a passage or line, the earliest of the same
conversation before the quoting turn is taken, or else the one of least conv_id, and in that of least turn, among the
other conversations (conversations carry no time); rows without conv_id are one conversation, the last of all. A message replies to what most of its level-1 lines quote, deeper
levels next, the earlier message in a tie.

Replies within a conversation make trees: thread_turn is the turn of a message's root and depth its distance from that,
found by doubling the reach of each step. Position counts a conversation's messages thread by thread, and in a thread by
depth, by the turn of the message answered, and by turn; so every message comes after the one it answers.

Originals are grouped to one message for each hash and conversation before the join, so a line that everyone writes joins
like any other. Positions come from a range partitioning and counts of its parts, so a conversation of any length is
spread over tasks.

Edge cases: a null or empty text has no quotes and an empty body. Rows equal in all of conv_id, turn, role and text are
one message; several texts for one turn are messages of their own, in the order of role and text. Passages and lines of
fewer than ``min_words`` words link nothing. Links to itself or to later turns of the conversation don't exist, so
replies never form a cycle in a conversation. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import before, bounded
from .scratch import Scratch

MIN_WORDS = 3
_MARKS = r"^([ \t]*>)+"
_SPACE = r"[\x20\x09-\x0D]+"
_BLANK_LINES = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"


def normalised(text) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, _SPACE, " ")))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, msg, pos, level, line (marks off), norm and passage, a number that is the same within a run."""
    lines = messages.select("conv_id", "turn", "msg", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    marks = F.regexp_extract("raw", _MARKS, 0)
    lines = lines.select("conv_id", "turn", "msg", "pos", (F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"), F.substr("raw", F.length(marks) + 1).alias("line"))
    lines = lines.withColumn("norm", normalised("line"))
    in_order = Window.partitionBy("conv_id", "msg").orderBy("pos")  # one message
    starts = ((F.col("level") != F.lag("level", 1, -1).over(in_order)) | (F.lag("norm", 1, "").over(in_order) == "")).cast("int")
    return lines.withColumn("starts", starts).withColumn("passage", F.sum("starts").over(in_order)).drop("starts")


def units(df: DataFrame, whole: bool, min_words: int) -> DataFrame:
    """Passages or lines of enough words (norm), with hashes."""
    long_ = df.where(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) >= min_words - 1).where("norm != ''")
    return long_.withColumn("whole", F.lit(whole)).withColumn("h1", F.xxhash64("norm")).withColumn("h2", F.xxhash64(F.lit(1), "norm")).drop("norm")


def passages_of(lines: DataFrame) -> DataFrame:
    """conv_id, turn, msg, passage, level, n (lines with words) and norm of each passage."""
    own = lines.where("norm != ''").groupBy("conv_id", "turn", "msg", "passage", "level")
    own = own.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return own.select("conv_id", "turn", "msg", "passage", "level", "n", normalised(F.array_join(F.transform("lines", lambda x: x["line"]), " ")).alias("norm"))


def originals(lines: DataFrame, plain: DataFrame, min_words: int) -> DataFrame:
    """conv_id, turn, msg, whole, h1, h2 of what messages say themselves."""
    keep = ["conv_id", "turn", "msg"]
    said = lines.where("level = 0")
    pieces = lambda by: plain.select(*keep, F.explode(F.split("text", by)).alias("piece")).select(*keep, normalised("piece").alias("norm"))
    whole = passages_of(said).select(*keep, "norm").unionByName(pieces(_BLANK_LINES))
    single = said.select(*keep, "norm").unionByName(pieces("\n"))
    return units(whole, True, min_words).unionByName(units(single, False, min_words))


def link_passages(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """conv_id, turn, msg, passage, level, and src (conv_id, turn, msg; null: none) and n_found lines of each quoted passage.
    Both have whole, h1 and h2; ``quoted`` also n, the lines that a match stands for."""
    by = ["whole", "h1", "h2"]
    own = own.join(bounded(quoted.select(*by).distinct()), by, "left_semi")
    here = own.groupBy(*by, "conv_id").agg(F.min(F.struct("turn", "msg")).alias("here"))
    # The least message of all, and the least outside its conversation.
    at = F.struct("conv_id", F.col("here.turn").alias("turn"), F.col("here.msg").alias("msg"))
    first = here.groupBy(*by).agg(F.min(at).alias("first"))
    second = here.join(first, by).where(F.col("conv_id") != F.col("first.conv_id")).groupBy(*by).agg(F.min(at).alias("second"))
    joined = quoted.join(here, [*by, "conv_id"], "left").join(first, by, "left").join(second, by, "left")
    elsewhere = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    source = F.when(F.col("here.turn") < F.col("turn"), at).otherwise(elsewhere)
    passage = ["conv_id", "turn", "msg", "passage", "level"]
    votes = joined.withColumn("src", source).groupBy(*passage, "whole", "src").agg(F.sum("n").alias("n"))
    best = F.min(F.when(F.col("src").isNotNull(), F.struct((~F.col("whole")).alias("lines"), (-F.col("n")).alias("n"), "src")))
    return votes.groupBy(*passage).agg(best.alias("best")).select(*passage, F.col("best.src").alias("src"), (-F.col("best.n")).alias("n_found"))


def ancestors(replies: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, msg, root, root_turn and depth of messages that reply within their conversation (conv_id, msg, up, up_turn)."""
    now = scratch.save(replies.select("conv_id", "msg", F.col("up").alias("root"), F.col("up_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "reach-0")
    step = 0
    while True:
        step += 1
        above = scratch.load(f"reach-{step - 1}", now).select("conv_id", F.col("msg").alias("root"), F.col("root").alias("above"), F.col("root_turn").alias("above_turn"), F.col("depth").alias("more"))
        both = now.join(above, ["conv_id", "root"], "left")
        further = both.select("conv_id", "msg", F.coalesce("above", "root").alias("root"), F.coalesce("above_turn", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        further = scratch.save(further, f"reach-{step}")
        if further.agg(F.sum("depth")).first()[0] == now.agg(F.sum("depth")).first()[0]:
            return further
        now = further


def positions(keys: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """conv_id, msg and position, from 1, of the rows of ``keys`` in each conv_id in the given order."""
    dealt = scratch.save(keys.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "dealt")
    counts = before(dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")), ["conv_id"], "part", F.expr("part div 1024")).drop("n")
    rank = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    counts = counts.withColumnsRenamed({"conv_id": "_conv", "part": "_part"})
    ranked = dealt.withColumn("rank", rank).join(counts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    return ranked.select("conv_id", "msg", (F.col("rank") + F.col("base")).cast("long").alias("position"))


def threads(conversations: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """conv_id, turn, role, position in reply order, body without quotes, thread_turn, depth, reply_conv and reply_turn
    (null: quotes nothing known), n_quoted lines, n_linked passages and max_level of every message."""
    scratch = Scratch(conversations.sparkSession, "quotes")
    # In a struct a null conv_id equals another and comes after all others, so no join or comparison loses it.
    conv = F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id"))
    messages = conversations.select(conv.alias("conv_id"), "turn", "role", "text").distinct()
    messages = messages.withColumn("msg", F.md5(F.concat_ws("|", F.col("turn").cast("string"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("\x00")))))
    messages = scratch.save(messages, "messages")
    lines = scratch.save(parse(messages.where(F.contains("text", F.lit(">")))), "lines")
    plain = messages.where(F.coalesce(~F.contains("text", F.lit(">")), F.lit(False)))
    said = lines.where("level > 0")
    quoted = units(passages_of(said), True, min_words).unionByName(units(said.select("conv_id", "turn", "msg", "passage", "level", F.lit(1).cast("long").alias("n"), "norm"), False, min_words))
    passages = scratch.save(link_passages(scratch.save(quoted, "quoted"), originals(lines, plain, min_words)), "passages")
    # Level 1 is what the message answers; deeper levels are what that one answers.
    votes = passages.where("src is not null").groupBy("conv_id", "msg", "src")
    votes = votes.agg(F.sum(F.when(F.col("level") == 1, F.col("n_found")).otherwise(0)).alias("first"), F.sum("n_found").alias("all"))
    reply = votes.groupBy("conv_id", "msg").agg(F.min(F.struct((-F.col("first")).alias("x"), (-F.col("all")).alias("y"), "src"))["src"].alias("src"))
    reply = scratch.save(reply, "replies")
    linked = passages.groupBy("conv_id", "msg").agg(F.count_if(F.col("src").isNotNull()).alias("n_linked"))
    kept = lines.groupBy("conv_id", "msg").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("rest"),
        F.count_if(F.col("level") > 0).alias("n_quoted"),
        F.max("level").alias("max_level"),
    )
    within = reply.where("src.conv_id = conv_id").select("conv_id", "msg", F.col("src.msg").alias("up"), F.col("src.turn").alias("up_turn"))
    tree = ancestors(within, scratch).join(within, ["conv_id", "msg"])
    keys = messages.select("conv_id", "turn", "role", "msg").join(tree, ["conv_id", "msg"], "left")
    keys = keys.select("conv_id", "turn", "role", "msg", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("root", "msg").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), "up_turn")
    keys = scratch.save(keys, "keys")
    placed = positions(keys, ["root_turn", "root", "depth", "up_turn", "turn", "role", "msg"], scratch)
    told = scratch.load("keys", keys).select("conv_id", "msg", F.col("root_turn").alias("thread_turn"), "depth")
    out = messages
    for more in (told, placed, kept, reply, linked):  # a null conv_id is a conversation too
        more = more.withColumnsRenamed({"conv_id": "_conv", "msg": "_msg"})
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("msg") == F.col("_msg")), "left").drop("_conv", "_msg")
    return out.select(
        "conv_id.id", "turn", "role", "position", "thread_turn", "depth",
        F.coalesce("rest", "text", F.lit("")).alias("body"),
        F.col("src.conv_id.id").alias("reply_conv"), F.col("src.turn").alias("reply_turn"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"),
    ).withColumnRenamed("id", "conv_id")


def op6_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of conversations in reply order, with the MD5 of its body without quotes."""
    out = threads(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumn("body_md5", F.md5("body")).drop("body")


OP6_SQL = """
WITH RECURSIVE m AS (
  SELECT DISTINCT struct_pack(n := conv_id IS NULL, id := conv_id) AS conv_id, turn, role, text,
         md5(concat_ws('|', CAST(turn AS VARCHAR), coalesce(role, ''), coalesce(text, chr(0)))) AS msg FROM conversations
), l AS (
  SELECT conv_id, turn, msg, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS raw FROM m
), p AS (
  SELECT conv_id, turn, msg, pos, regexp_extract(raw, '^([ \\t]*>)+', 0) AS marks, raw FROM l
), q AS (
  SELECT conv_id, turn, msg, pos, length(marks) - length(replace(marks, '>', '')) AS level, substr(raw, length(marks) + 1) AS line FROM p
), n AS (SELECT *, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm FROM q
), r AS (
  SELECT *, CASE WHEN level <> lag(level, 1, -1) OVER w OR lag(norm, 1, '') OVER w = '' THEN 1 ELSE 0 END AS s
  FROM n WINDOW w AS (PARTITION BY conv_id, msg ORDER BY pos)
), t AS (SELECT *, sum(s) OVER (PARTITION BY conv_id, msg ORDER BY pos) AS passage FROM r),
u AS (
  SELECT conv_id, turn, msg, passage, level, count(*) AS n, true AS whole,
         lower(trim(regexp_replace(string_agg(line, ' ' ORDER BY pos), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm
  FROM t WHERE norm <> '' GROUP BY conv_id, turn, msg, passage, level
  UNION ALL SELECT conv_id, turn, msg, passage, level, 1, false, norm FROM t
), k AS (SELECT * FROM u WHERE norm <> '' AND length(norm) - length(replace(norm, ' ', '')) >= 2),
here AS (SELECT whole, norm, conv_id AS c, min(struct_pack(t := turn, m := msg)) AS h FROM k WHERE level = 0 GROUP BY ALL),
j AS (
  SELECT k.*, coalesce(
    (SELECT struct_pack(c := c, t := h.t, m := h.m) FROM here WHERE here.whole = k.whole AND here.norm = k.norm AND c = k.conv_id AND h.t < k.turn),
    (SELECT min(struct_pack(c := c, t := h.t, m := h.m)) FROM here WHERE here.whole = k.whole AND here.norm = k.norm AND c <> k.conv_id)) AS src
  FROM k WHERE level > 0
), votes AS (SELECT conv_id, msg, passage, level, whole, src, sum(n) AS n FROM j GROUP BY ALL),
best AS (
  SELECT conv_id, msg, passage, level, min(struct_pack(l := NOT whole, n := -n, src := src)) FILTER (WHERE src IS NOT NULL) AS b FROM votes GROUP BY ALL
), per AS (
  SELECT conv_id, msg, b.src AS src, sum(CASE WHEN level = 1 THEN -b.n ELSE 0 END) AS f, sum(-b.n) AS a FROM best WHERE b IS NOT NULL GROUP BY ALL
), rep AS (SELECT conv_id, msg, min(struct_pack(x := -f, y := -a, src := src)).src AS src FROM per GROUP BY ALL),
lk AS (SELECT conv_id, msg, count(b) AS n_linked FROM best GROUP BY ALL),
kept AS (
  SELECT conv_id, msg, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0), '') AS rest,
         count(*) FILTER (WHERE level > 0) AS n_quoted, max(level) AS max_level FROM t GROUP BY ALL
), node AS (
  SELECT m.conv_id, m.turn, m.role, m.msg, CASE WHEN src.c = m.conv_id THEN src.m END AS up, CASE WHEN src.c = m.conv_id THEN src.t END AS up_turn
  FROM m LEFT JOIN rep USING (conv_id, msg)
), tree AS (
  SELECT conv_id, msg, msg AS root, turn AS root_turn, 0 AS depth FROM node WHERE up IS NULL
  UNION ALL SELECT n.conv_id, n.msg, tree.root, tree.root_turn, tree.depth + 1 FROM node n JOIN tree ON n.conv_id = tree.conv_id AND n.up = tree.msg
)
SELECT m.conv_id.id AS conv_id, m.turn, m.role, CAST(root_turn AS BIGINT) AS thread_turn, CAST(depth AS BIGINT) AS depth,
       row_number() OVER (PARTITION BY m.conv_id ORDER BY root_turn, root, depth, up_turn NULLS FIRST, m.turn, m.role NULLS FIRST, m.msg) AS position,
       rep.src.c.id AS reply_conv, rep.src.t AS reply_turn, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked,
       CAST(coalesce(max_level, 0) AS BIGINT) AS max_level, md5(coalesce(rest, m.text, '')) AS body_md5
FROM m JOIN node n USING (conv_id, msg) JOIN tree USING (conv_id, msg)
LEFT JOIN kept USING (conv_id, msg) LEFT JOIN rep USING (conv_id, msg) LEFT JOIN lk USING (conv_id, msg)
"""
