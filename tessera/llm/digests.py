"""Canonical exact digests, in DataFrame and SQL functions only.

Canonical text: compatibility composition, full case folding, composition again (folding can
undo it), runs of white space as one space, none at the ends.  Two xxhash64 values with different
seeds make a 128-bit digest.  Documents of one digest form a bucket; the smallest and largest
canonical bytes of a bucket are compared, and only where they differ, which takes a collision of
128 bits, each member's fingerprint also gets its SHA-256, and so does an edited text's with that
digest.  So fingerprints of equal canonical texts are equal, and those of others differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch

_MASK33 = (1 << 33) - 1
#: Parts that the rows of one digest are dealt to.
SALTS = 256


def _compose(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """Canonical form of a text; null counts as empty."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(_compose(folded), r"(?U)[\s\x1c-\x1f]+", " "))


def wide_hash(*columns: Column) -> tuple[Column, Column]:
    return F.xxhash64(*columns), F.xxhash64(F.lit("wide"), *columns)


def _hex(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def _sizes(rows: DataFrame, *extra: Column) -> DataFrame:
    """(h1, h2, salt, bucket, ..) of each digest: how many rows have it in all, and sums of the
    ``extra`` columns' least values, once for each salt its rows have.  Rows join on the salt too,
    so that a digest that a third of all rows share is not in one task."""
    parts = rows.groupBy("h1", "h2", "salt").agg(F.count("*").alias("part"), *extra)
    names = [c for c in parts.columns if c not in ("h1", "h2", "salt", "part")]
    whole = parts.groupBy("h1", "h2").agg(F.sum("part").alias("bucket"), *(F.min(c).alias(c) for c in names))
    return parts.select("h1", "h2", "salt").join(whole, ["h1", "h2"])


def _clashes(rows: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(h1, h2) of the digests whose bucket holds different canonical bytes; None if there are
    none, as ever but for a collision of 128 bits.  Copies merge before the exchange."""
    ends = rows.groupBy("h1", "h2").agg(F.min("canon").alias("a"), F.max("canon").alias("b"))
    found = scratch.cut(ends.where("a <> b").select("h1", "h2", F.lit(True).alias("clash")), "clashes")
    return found if found.count() else None


def _told_apart(d: DataFrame, clash: DataFrame | None, h1: str, h2: str, canon: Column, name: str) -> DataFrame:
    """``d`` with the fingerprint ``name`` of digest (h1, h2), and of the bytes if digests clash."""
    mark = F.concat(_hex(h1), _hex(h2))
    if clash is None:
        return d.withColumn(name, mark)
    joined = d.join(F.broadcast(clash.toDF(h1, h2, "clash")), [h1, h2], "left")
    return joined.withColumn(name, F.when(F.col("clash"), F.concat(mark, F.lit("-"), F.sha2(canon, 256))).otherwise(mark)).drop("clash")


def exact_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, group_id, group_size): group_id is the smallest id among the documents
    of equal canonical text.  Repeated rows and null ids stay; an all-null group has a null id."""
    d = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("canon"))
    h1, h2 = wide_hash(F.col("canon"))
    d = d.select("id", "canon", h1.alias("h1"), h2.alias("h2"))
    d = _told_apart(d, _clashes(d, scratch), "h1", "h2", F.col("canon"), "fingerprint")
    # Group by the whole fingerprint: its hashes take the place of the digest.
    g1, g2 = wide_hash(F.col("fingerprint"))
    d = scratch.cut(d.select("id", "fingerprint", g1.alias("h1"), g2.alias("h2"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")), "digests")
    groups = _sizes(d, F.min("id").alias("group_id"))
    return d.join(groups, ["h1", "h2", "salt"]).select(F.col("id").alias(id_col), "fingerprint", "group_id", F.col("bucket").alias("group_size"))


def edit_report(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    Edited text: the last floor(n/3) code points replaced by the first as many (or all) of the
    next document in descending id order; after the last comes the first.  A null text counts as
    empty and a null id comes last.  Of rows with one id, texts follow each other in hash order;
    rows that repeat id and text are one document in that order, and each gets its result.
    near_edited and near_next are 1.0 if digest and canonical bytes are equal, else 0.0: an exact
    digest knows no other likeness.

    Ids, lengths and hashes alone are put in order; each text then moves once, to the row that
    holds its neighbours, and a third of its predecessor's length moves on from there.  Rows that
    repeat id and text merge before they move, and are repeated at the end.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    r1, r2 = wide_hash(F.isnull("id"), F.col("id"), F.col("text"))
    base = base.select("id", "text", r1.alias("r1"), r2.alias("r2"))

    h1, h2 = wide_hash(F.col("canon"))
    info = base.select("id", "r1", "r2", F.char_length("text").cast("long").alias("n"), canonical(F.col("text")).alias("canon"))
    info = info.select("id", "r1", "r2", "n", h1.alias("h1"), h2.alias("h2"))
    info = info.groupBy("r1", "r2").agg(F.count("*").alias("times"), *(F.min(c).alias(c) for c in ("id", "n", "h1", "h2")))
    ordered = info.repartitionByRange(F.col("id").desc_nulls_last(), "r1", "r2").sortWithinPartitions(F.col("id").desc_nulls_last(), "r1", "r2")
    ordered = scratch.cut(ordered.withColumn("place", F.monotonically_increasing_id()), "order")
    ordered = ordered.withColumn("part", F.shiftright("place", 33)).withColumn("row", F.col("place").bitwiseAND(F.lit(_MASK33)))
    # One row for each partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    ordered = ordered.join(F.broadcast(starts), "part").withColumn("pos", F.col("start") + F.col("row")).drop("part", "row", "start", "place")
    ordered = ordered.withColumn("salt", F.pmod(F.col("pos"), F.lit(SALTS)))
    total = max(ordered.count(), 1)
    ahead = ordered.select(
        F.pmod(F.col("pos") - 1, F.lit(total)).alias("pos"),
        *(F.col(c).alias(f"next_{c}") for c in ("r1", "r2", "h1", "h2")),
    )
    behind = ordered.select(
        F.pmod(F.col("pos") + 1, F.lit(total)).alias("pos"),
        *(F.col(c).alias(f"prev_{c}") for c in ("r1", "r2", "n", "h1", "h2")),
    )
    sizes = _sizes(ordered).where("bucket > 1")
    meta = ordered.join(ahead, "pos").join(behind, "pos").join(sizes, ["h1", "h2", "salt"], "left").drop("id", "pos", "salt")
    meta = scratch.cut(meta, "neighbours")

    rows = base.dropDuplicates(["r1", "r2"]).join(meta, ["r1", "r2"])
    passed = rows.select(
        F.col("prev_r1").alias("r1"),
        F.col("prev_r2").alias("r2"),
        F.col("id").alias("next_id"),
        F.left("text", F.floor(F.col("prev_n") / 3).cast("int")).alias("head"),
        F.when((F.col("h1") == F.col("prev_h1")) & (F.col("h2") == F.col("prev_h2")), canonical(F.col("text"))).alias("next_canon"),
    )
    clash = _clashes(rows.where("bucket > 1").select("h1", "h2", canonical(F.col("text")).alias("canon")), scratch)
    kept = F.left("text", (F.col("n") - F.floor(F.col("n") / 3)).cast("int"))
    out = rows.join(passed, ["r1", "r2"]).withColumn("edited", F.concat(kept, F.col("head"))).withColumn("edited_canon", canonical(F.col("edited")))
    e1, e2 = wide_hash(F.col("edited_canon"))
    out = out.withColumns({"e1": e1, "e2": e2, "edited_sha256": F.sha2("edited", 256)})
    same_next = (F.col("h1") == F.col("next_h1")) & (F.col("h2") == F.col("next_h2")) & F.col("next_canon").isNotNull()
    same_edited = (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2"))
    out = out.withColumns({
        "near_edited": F.when(same_edited, (canonical(F.col("text")) == F.col("edited_canon")).cast("double")).otherwise(0.0),
        "near_next": F.when(same_next, (canonical(F.col("text")) == F.col("next_canon")).cast("double")).otherwise(0.0),
    })
    out = _told_apart(out, clash, "h1", "h2", canonical(F.col("text")), "fingerprint")
    out = _told_apart(out, clash, "e1", "e2", F.col("edited_canon"), "edited_fingerprint")
    # Repeats in thousands, so that no list is long.
    out = out.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / 1000).cast("int"))))
    out = out.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(1000), F.col("times") - 1000 * F.col("lot")).cast("int"))))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id")
