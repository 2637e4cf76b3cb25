"""Mixing sources to target weights by a low-discrepancy schedule.

Targets are found by resharing: a source stops at a multiple of its words, the rest goes to the
others by weight.  The words of each source, documents in shuffled order, form one run that is cut
into blocks of equal length.  Slot n of the mix has the n-th point of the golden-ratio sequence;
the point falls into the interval of one source in the cumulative targets, and the r-th slot of
a source takes its r-th block, from the first again when all are used.  A source's last slot is cut at
its target, later slots of it lapse, and the few slots that a source lacks at the schedule's
end follow after it, so each source gives the words of its target exactly.

No step has the rows of one source in one task.  Runs of documents are sums inside hash buckets
of a source plus the totals of the buckets before; slots are ranked inside ranges of n in the same
way; points are met with sources inside ranges of the unit interval, which the sequence fills evenly.
Everything is DataFrame operations; past the word count only narrow rows move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights by the source's place, repeating; words of the mix in hundredths of all words; most
#: repeats of a source; words of a block.
WEIGHTS, PERCENT, REPEATS, BLOCK = (5, 2, 1), 150, 2, 512
#: Points are multiples of 1 / SPAN; GOLDEN is SPAN over the golden ratio, odd, so that SPAN
#: points in a row are all different.
SPAN, GOLDEN = 1 << 31, 1327217885
#: Hexadecimal digits that name a source's hash bucket, ranges of the unit interval, and slots
#: ranked together.
DIGITS, RANGES, CHUNK = 3, 4096, 1 << 16


def sized(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, key, size, mix, bucket) of every row, as written: words, the source in code point order
    with null last, and what shuffles the rows of a source."""
    words = F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("2"))
    # Rows without an id are told apart by their texts.
    mixed = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text_col, F.lit("")))))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), words.alias("size"), mixed.alias("mix"))
    return scratch.cut(rows.withColumn("bucket", F.substring("mix", 1, DIGITS)), "sized")


def _placed(frame: DataFrame, key: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``frame`` in ranges of ``key`` with its range, and a window over such a range in order."""
    out = scratch.cut(frame.repartitionByRange(F.col(key)).withColumn("range", F.spark_partition_id()), "ranged")
    return out, Window.partitionBy("range").orderBy(key)


def _before(frame: DataFrame, amount: str, key: str) -> DataFrame:
    """(range, base): sum of ``amount`` in all lower ranges.  One row for each range."""
    sums = frame.groupBy("range").agg(F.sum(amount).alias("base"))
    return sums.select("range", (F.sum("base").over(Window.orderBy("range")) - F.col("base")).alias("base"))


def sources(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """(key, place, source_size, weight, target, quota, blocks, slots, low, high) of every source:
    the words of its target, its blocks and slots, and its interval of points.

    Each round of resharing is one aggregation and one row at the driver: the sources that
    their share would exceed stop, and the rest of the budget is shared by the weights of the others.
    """
    every = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    every, inside = _placed(every, "key", scratch)
    ones = _before(every.withColumn("one", F.lit(1)), "one", "key")
    place = F.row_number().over(inside) + F.col("base") - 1
    of_place = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights)).cast("int") + 1)
    every = every.join(ones, "range").withColumn("place", place).drop("base").withColumn("weight", of_place)
    every = scratch.cut(every, "sources")

    words, weight = every.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = percent * (words or 0), -1.0
    if weight:
        left = budget
        while weight and left / (100 * weight) > level:
            level = left / (100 * weight)
            stopped = F.col("weight") * F.lit(level) >= repeats * F.col("source_size")
            held, free = every.agg(F.sum(F.when(stopped, repeats * F.col("source_size"))), F.sum(F.when(~stopped, F.col("weight")))).first()
            left, weight = budget - 100 * (held or 0), free or 0
    target = F.least(F.col("weight") * F.lit(level), (repeats * F.col("source_size")).cast("double"))
    every = every.withColumn("target", target).withColumn("quota", F.floor("target"))
    every = every.withColumn("blocks", F.ceil(F.col("source_size") / block))
    full, rest = F.expr("quota div source_size"), F.col("quota") % F.col("source_size")
    slots = F.when(F.col("quota") > 0, full * F.col("blocks") + F.ceil(rest / block)).otherwise(0)
    every = scratch.cut(every.withColumn("slots", slots.cast("long")), "quotas")

    total = float(every.agg(F.sum("quota")).first()[0] or 1)
    through = F.sum("quota").over(inside) + F.col("base")

    def point(words: Column) -> Column:
        return F.floor(words / F.lit(total) * F.lit(float(SPAN)))

    out = every.join(_before(every, "quota", "key"), "range").withColumn("through", through)
    out = out.withColumn("low", point(F.col("through") - F.col("quota"))).withColumn("high", point(F.col("through")))
    return scratch.cut(out.drop("range", "base", "through"), "intervals")


def schedule(every: DataFrame, scratch: Scratch) -> DataFrame:
    """(slot, place, rank, and source_size, quota, blocks of the source): which source has each slot
    of the mix and which of its slots it is, from 0.  Slots after the source's last lapse; what
    sources lack at the end follows, ``slot`` being the length of the schedule plus their place.
    """
    spark, width = every.sparkSession, SPAN // RANGES
    of_source = F.struct("place", "source_size", "quota", "blocks", "slots")
    n = every.agg(F.sum("slots")).first()[0] or 0
    slots = spark.range(n).select(F.col("id").alias("slot"), F.expr(f"(id % {SPAN}) * {GOLDEN} % {SPAN}").alias("point"))
    spans = every.where("low < high").select("low", "high", of_source.alias("s"), F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")).alias("range"))
    starts = spans.select("range", F.greatest("low", F.col("range") * width).alias("point"), F.lit(-1).cast("long").alias("slot"), "s")
    points = slots.select((F.expr(f"point div {width}")).alias("range"), "point", "slot", F.lit(None).cast(starts.schema["s"].dataType).alias("s"))
    met = starts.unionByName(points)
    upto = Window.partitionBy("range").orderBy("point", "slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = met.withColumn("s", F.last("s", ignorenulls=True).over(upto)).where("slot >= 0").select("slot", "s.*")
    drawn = scratch.cut(drawn.withColumn("chunk", F.expr(f"slot div {CHUNK}")), "drawn")

    have = drawn.groupBy("place", "chunk").agg(F.count("*").alias("have"))
    base = (F.sum("have").over(Window.partitionBy("place").orderBy("chunk")) - F.col("have")).alias("base")
    within = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot"))
    ranked = drawn.join(have.select("place", "chunk", base), ["place", "chunk"]).withColumn("rank", within + F.col("base") - 1)
    ranked = ranked.where("rank < slots")
    drawn_of = have.groupBy("place").agg(F.sum("have").alias("have"))
    lacking = every.join(drawn_of, "place", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    lacking = lacking.withColumn("rank", F.explode(F.expr("sequence(have, slots - 1)"))).withColumn("slot", F.col("place") + n)
    columns = ["slot", "place", "rank", "source_size", "quota", "blocks"]
    return ranked.select(*columns).unionByName(lacking.select(*columns))


def runs(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Rows of ``sized`` with their source's columns and ``at``, the words of the source's run
    before them."""
    inside = Window.partitionBy("key", "bucket").orderBy("mix", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("key", "bucket").agg(F.sum("size").alias("total"))
    totals = totals.withColumn("base", F.sum("total").over(Window.partitionBy("key").orderBy("bucket")) - F.col("total"))
    of_source = every.select("key", "place", "source_size", "target", "quota", "blocks")
    totals = totals.join(of_source, "key").drop("total")
    local = rows.withColumn("at", F.sum("size").over(inside) - F.col("size"))
    return local.join(totals, ["key", "bucket"]).withColumn("at", F.col("at") + F.col("base")).drop("base", "bucket", "mix")


def pieces(placed: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, place, rank, id, row_at, start, length) of the mix: words ``start`` to ``start +
    length`` of each document in each slot.  ``row_at`` is the document's place in its source."""
    ends = placed.where("size > 0 and quota > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    first = F.greatest(F.col("at"), F.col("block") * block)
    last = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    parts = ends.select("place", "block", "id", F.col("at").alias("row_at"), (first - F.col("at")).alias("start"), (last - first).alias("words"), (first - F.col("block") * block).alias("offset"))
    used = plan.withColumn("block", F.col("rank") % F.col("blocks"))
    before = F.expr("rank div blocks") * F.col("source_size") + F.col("block") * block
    used = used.select("slot", "place", "rank", "block", (F.col("quota") - before).alias("room"))
    out = parts.join(used, ["place", "block"]).withColumn("length", F.least("words", F.col("room") - F.col("offset"))).where("length > 0")
    return out.select("slot", "place", "rank", "id", "row_at", "start", "length")


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their source's figures, and the pieces of the mix."""
    rows = sized(docs, scratch, id_col, text_col, source_col)
    every = sources(rows, scratch, weights, percent, repeats, block)
    placed = scratch.cut(runs(rows, every), "placed")
    return placed, pieces(placed, schedule(every, scratch), block)


def mix_report(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, size, source_size, target, taken) of every row: its words, its source's words and
    target, and the words of it that the mix takes, repeats counted.

    A source's taken words are its target, rounded down; no row gives more than ``repeats`` times its
    size.  A null text has no words and gives none; null sources are one source, the last.  Rows that
    repeat an id are rows of their own.  The same table gives the same result however it is
    partitioned.  An empty table gives no rows; sources without words have target 0.
    """
    placed, parts = mix(docs, scratch, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    columns = ["id", "place", "at", "size", "source_size", "target"]
    taken = parts.groupBy("place", F.col("row_at").alias("at")).agg(F.sum("length").alias("taken"))
    out = placed.where("size > 0").select(*columns).join(taken, ["place", "at"], "left")
    out = out.unionByName(placed.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
