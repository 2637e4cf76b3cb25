"""Quotation linking in DataFrame and SQL functions only.

Lines of a message that start with quote marks are quoted; the number of marks is the level, and
adjoining lines of one level form a passage.  Passages are folded (case, white space) and hashed,
and so are the messages' own texts, passages and paragraphs, and each run of lines in one of their
own passages; equal hashes link a passage to its original.  Runs are hashed in lengths of powers
of two: a run is known by its first and its last such part, which overlap.  The original must come
before: the nearest kind is an earlier turn of the same conversation, else the first message of
all that has it.  Conversations that quote each other form one thread, in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import connected
from tessera.llm.shared import Scratch

_MARKS = r"^[ \t]*(>[ \t]?)+"


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _passages(text: Column) -> Column:
    """array<struct<level int, body string>>: runs of lines of one level, marks taken off."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")

    def read(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 0)
        return F.struct((F.length(marks) - F.length(F.translate(marks, ">", ""))).alias("level"), F.regexp_replace(line, _MARKS, "").alias("body"))

    return F.transform(lines, read)


def _runs(lines: Column) -> Column:
    """Starts (0-based) of the runs of one level."""
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    return F.filter(at, lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, body, passages): the text without quoted lines, and the passages in
    order with their level, 0 for the message's own."""
    d = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), "role", _passages(F.col(text_col)).alias("lines"))
    d = d.withColumn("starts", _runs(F.col("lines")))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("lines")))

    def passage(start: Column, end: Column) -> Column:
        part = F.slice(F.col("lines"), start + 1, end - start)
        return F.struct(F.get(F.col("lines"), start)["level"].alias("level"), F.array_join(F.transform(part, lambda x: x["body"]), "\n").alias("body"))

    d = d.withColumn("passages", F.zip_with("starts", ends, passage))
    own = F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: F.trim(F.regexp_replace(p["body"], r"^\s+|\s+$", "")))
    body = F.array_join(F.filter(own, lambda x: x != ""), "\n")
    return d.select("conv", "turn", "role", body.alias("body"), "passages")


def _units(body: Column, passages: Column) -> Column:
    """Folded texts by which a message can be quoted: all of it, its own passages, their paragraphs."""
    own = F.transform(F.filter(passages, lambda p: p["level"] == 0), lambda p: p["body"])
    paragraphs = F.flatten(F.transform(own, lambda x: F.split(x, r"\n\s*\n")))
    parts = F.concat(F.array(body), F.split(body, r"\n\s*\n"), own, paragraphs)
    return F.array_distinct(F.filter(F.transform(parts, _folded), lambda x: x != ""))


def _line_hashes(body: Column) -> Column:
    lines = F.filter(F.transform(F.split(body, r"\n"), _folded), lambda x: x != "")
    return F.transform(lines, lambda x: F.xxhash64(x))


def _run_hashes(d: DataFrame, most: int) -> DataFrame:
    """``d`` (with h0, line hashes) and h1 .. h{most}: hashes of the runs of 2^k lines from each line."""
    for k in range(most):
        step, have = 1 << k, F.col(f"h{k}")
        double = F.transform(F.sequence(F.lit(0), F.size(have) - 1 - step), lambda p: F.xxhash64(F.get(F.col(f"h{k}"), p), F.get(F.col(f"h{k}"), p + step)))
        d = d.withColumn(f"h{k + 1}", F.when(F.size(have) > step, double).otherwise(F.array().cast("array<bigint>")))
    return d


def _quoted_runs(known: DataFrame, quoted: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``quoted`` with ``run``, the hash of its lines, and (run, conv, first): the first turn of
    each conversation with these lines in a row in one of its own passages."""
    quoted = quoted.withColumn("h0", _line_hashes(F.col("body"))).withColumn("m", F.size("h0"))
    longest = quoted.agg(F.max("m")).first()[0] or 1
    most = int(longest).bit_length() - 1
    quoted = _run_hashes(quoted, most).withColumn("k", F.length(F.bin("m")) - 1)
    head = F.coalesce(*(F.when(F.col("k") == k, F.get(F.col(f"h{k}"), F.lit(0))) for k in range(most + 1)))
    tail = F.coalesce(*(F.when(F.col("k") == k, F.get(F.col(f"h{k}"), F.col("m") - (1 << k))) for k in range(most + 1)))
    quoted = quoted.withColumns({"head": head, "tail": tail}).withColumn("run", F.xxhash64("m", "head", "tail"))
    quoted = scratch.cut(quoted.select("conv", "turn", "key", "at", "level", "folded", "hash", "run", "k", "m", "head", "tail"), "quoted")

    own = known.select("conv", "turn", "key", F.posexplode("passages").alias("at", "p")).where("p.level = 0")
    own = _run_hashes(own.dropDuplicates(["conv", "turn", "key", "at"]).withColumn("h0", _line_hashes(F.col("p.body"))), most)

    def placed(k: int) -> Column:
        return F.transform(F.col(f"h{k}"), lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("i"), h.alias("h")))

    places = F.flatten(F.array(*(placed(k) for k in range(most + 1))))
    own = own.select("conv", "turn", "key", "at", F.explode(places).alias("x")).select("conv", "turn", "key", "at", "x.*")
    heads = quoted.select("k", F.col("head").alias("h"), "m").distinct()
    tails = quoted.select("k", F.col("tail").alias("h")).distinct()
    begun = own.join(heads, ["k", "h"]).select("conv", "turn", "key", "at", "k", "m", F.col("h").alias("head"), (F.col("i") + F.col("m") - F.expr("cast(pow(2, k) as int)")).alias("i"))
    ended = own.join(tails, ["k", "h"], "left_semi").withColumnRenamed("h", "tail")
    runs = begun.join(ended, ["conv", "turn", "key", "at", "k", "i"]).select(F.xxhash64("m", "head", "tail").alias("run"), "conv", "turn")
    return quoted, runs.groupBy("run", "conv").agg(F.min("turn").alias("first"))


def link(messages: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row for each message: (conv, turn, role, body, thread_id, position, reply_conv,
    reply_turn, n_quotes, n_linked, max_level).

    reply_conv and reply_turn name the original of the outermost quoted passage that has one, or
    are null.  thread_id is the smallest conversation linked by quotes, whichever passage makes
    the link.  position counts a thread's messages from 0 in reply order: a conversation's
    messages by turn, and a conversation whose first reply elsewhere goes to some message follows
    that message at once; what follows one message, and what replies to nothing, by conversation.
    A null text counts as empty; a null conversation or turn is a message on its own that neither
    quotes nor is quoted, with null thread_id if the conversation is null.  Repeated rows are kept
    and follow each other.
    """
    parsed = parse(messages.select(*(F.col(c) for c in dict.fromkeys((conv_col, turn_col, "role", text_col)))), conv_col, turn_col, text_col)
    parsed = scratch.cut(parsed.withColumn("key", F.xxhash64("conv", "turn", "role", F.col("passages"))), "parsed")
    known = parsed.where("conv is not null and turn is not null")
    quoted = known.select("conv", "turn", "key", F.posexplode("passages").alias("at", "p")).where("p.level > 0")
    quoted = quoted.select("conv", "turn", "key", "at", "p.level", "p.body", _folded(F.col("p.body")).alias("folded")).where("folded <> ''")
    quoted = scratch.cut(quoted.dropDuplicates(["conv", "turn", "key", "at"]).withColumn("hash", F.xxhash64("folded")), "passages")
    quoted, runs = _quoted_runs(known, quoted, scratch)

    wanted = quoted.select("hash").distinct()
    units = known.select("conv", "turn", F.explode(_units(F.col("body"), F.col("passages"))).alias("folded")).withColumn("hash", F.xxhash64("folded"))
    units = units.join(wanted, "hash", "left_semi").groupBy("hash", "folded", "conv").agg(F.min("turn").alias("first"))
    # A run has no text of its own here: its hash stands for it.
    units = scratch.cut(units.unionByName(runs.select(F.col("run").alias("hash"), F.lit("").alias("folded"), "conv", "first")), "units")
    near = units.select("hash", "folded", "conv", F.col("first").alias("near_turn"))
    far = units.groupBy("hash", "folded").agg(F.min(F.struct("conv", F.col("first").alias("turn"))).alias("far"))
    asked = F.explode(F.array(F.struct("hash", "folded"), F.struct(F.col("run").alias("hash"), F.lit("").alias("folded"))))
    sought = quoted.select("conv", "turn", "key", "at", "level", asked.alias("x")).select("conv", "turn", "key", "at", "level", "x.*")
    found = sought.join(near, ["hash", "folded", "conv"], "left").join(far, ["hash", "folded"], "left")
    found = found.groupBy("conv", "turn", "key", "at", "level").agg(F.min("near_turn").alias("near_turn"), F.min("far").alias("far"))
    this, here = F.struct("conv", "turn"), F.struct("conv", F.col("near_turn").alias("turn"))
    origin = F.when(F.col("near_turn") < F.col("turn"), here).when(F.col("far") < this, F.col("far"))
    found = scratch.cut(found.withColumn("origin", origin).select("conv", "turn", "key", "at", "level", "origin"), "found")
    crossing = found.where("origin.conv <> conv").select(F.col("conv").alias("a"), F.col("origin.conv").alias("b"))
    roots = scratch.cut(connected(crossing, scratch).select(F.col("node").alias("conv"), F.col("root")), "roots")
    found = scratch.cut(found.groupBy("conv", "turn", "key").agg(
        F.count("*").alias("n_quotes"),
        F.count("origin").alias("n_linked"),
        F.max("level").alias("max_level"),
        F.min(F.when(F.col("origin").isNotNull(), F.struct("level", "at", "origin"))).alias("reply"),
    ), "links")

    d = parsed.join(found, ["conv", "turn", "key"], "left").join(roots, "conv", "left").join(_paths(found, scratch), "conv", "left")
    d = d.withColumn("thread_id", F.coalesce("root", "conv"))
    # Turns without a number come last in their conversation.
    turn = F.coalesce("turn", F.lit((1 << 63) - 1))
    d = d.withColumn("path", F.concat(F.coalesce("path", F.array("conv")), F.array(turn)))
    return _positions(d, scratch)


def _paths(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, path) of the conversations that reply to another: conversation and turn, alternately,
    from the first of all down to this one.  Paths double in each round."""
    replies = found.where("reply.origin.conv <> conv").groupBy("conv").agg(F.min(F.struct("turn", "key", "reply.origin")).alias("first"))
    now = scratch.cut(replies.select("conv", F.col("first.origin.conv").alias("up"), F.array("first.origin.turn", "conv").alias("path")), "paths")
    while now.where("up is not null").limit(1).count():
        above = now.select(F.col("conv").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"), F.lit(True).alias("is"))
        joined = now.join(above, "up", "left")
        path = F.when(F.col("is"), F.concat("head", "path")).when(F.col("up").isNotNull(), F.concat(F.array("up"), "path")).otherwise(F.col("path"))
        now = scratch.cut(joined.select("conv", F.col("next").alias("up"), path.alias("path")), "paths")
    return now.select("conv", "path")


_ORDER = ["thread_id", "path", "role", "key"]


def _positions(d: DataFrame, scratch: Scratch) -> DataFrame:
    """Positions inside threads without gathering a thread in one task: the rows are range-sorted
    whole, numbered inside their partition, and shifted by what earlier partitions hold of the
    same thread, which only concerns the one thread a partition starts with."""
    d = d.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    d = scratch.cut(d.withColumn("place", F.monotonically_increasing_id()), "ordered")
    d = d.withColumn("part", F.shiftright("place", 33))
    pieces = d.groupBy("thread_id", "part").agg(F.count("*").alias("rows"), F.min("place").alias("start"))
    earlier = Window.partitionBy("thread_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("shift", F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("start"))
    keyed = pieces.select(F.coalesce("thread_id", F.lit(0)).alias("t"), F.isnull("thread_id").alias("z"), "part", "shift")
    d = d.withColumns({"t": F.coalesce("thread_id", F.lit(0)), "z": F.isnull("thread_id")}).join(keyed, ["t", "z", "part"])
    return d.select(
        "conv", "turn", "role", "body", "thread_id",
        F.when(F.col("thread_id").isNotNull(), F.col("place") + F.col("shift")).alias("position"),
        F.col("reply.origin.conv").alias("reply_conv"),
        F.col("reply.origin.turn").alias("reply_turn"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).alias("max_level"),
    )
