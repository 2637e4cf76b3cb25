"""Filter interaction audit over a packed bitmap index.

One pass over the texts leaves a narrow table of signals: part, digest and the bits of the failed
conditions.  The table-wide condition, a copy of an earlier text, is found on the digests: each row
looks for itself as the first of its text, so the join's key is spread however many copies a text
has.  Then each task packs its rows into a bitmap index, a bitset for each filter and label, rows
laid out by part, each part from a fresh byte on.  For every set of filters that may come before
a filter, an AND-NOT and a popcount give what the filter removes there; the tasks' counts are
summed, and every order of the filters reads its steps off these sums.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, give_back

#: Filters by letter; the first four see one text, the last the whole table.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10
SYMBOLS = re.compile(rb"[#$%&*|]")
_UPPER_AZ = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of one bitmap index, which bounds a task's memory.
ROWS_INDEXED = 1 << 17


def failed(text: bytes, n_chars: int) -> int:
    """Bits of the conditions A to D that a text fails."""
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER_AZ))
    few, repetitive = len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words)
    return few | repetitive << 1 | (100 * upper > MAX_UPPER * n_chars) << 2 | (SYMBOLS.search(text) is not None) << 3


def signals(docs: DataFrame, scratch: Scratch, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, digest binary, bits int) of every row, as written: SHA-256 of the whole text and
    the failed conditions of its own.  A null text counts as empty, a null part as the empty string."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            chars = pc.utf8_length(b.column(2)).to_pylist()
            texts = b.column(2).cast(pa.binary())
            digests, bits = [], []
            for raw, n in zip(texts, chars):
                text = raw.as_py()
                digests.append(hashlib.sha256(text).digest())
                bits.append(failed(text, n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(bits, pa.int32())], names=["id", "part", "digest", "bits"])
            give_back()

    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    named = docs.select(F.col(id_col).cast("long").alias("id"), part, F.coalesce(text_col, F.lit("")).alias("text"))
    return scratch.cut(named.mapInArrow(run, "id long, part string, digest binary, bits int"), "signals")


def with_copies(marked: DataFrame) -> DataFrame:
    """Sets the last filter's bit of each row whose text a row of a smaller id has.

    A text's first id is sought by (digest, id), which are as many keys as rows: a group of copies
    of any size is dealt to all tasks.  Rows with a null id are no one's earlier copy and never fail.
    """
    first = marked.groupBy("digest").agg(F.min("id").alias("first")).where("first is not null")
    first = first.select(F.col("digest").alias("d"), "first")
    found = marked.join(first, (F.col("digest") == F.col("d")) & (F.col("id") == F.col("first")), "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return found.select("id", "part", (F.col("bits") + F.when(copy, F.lit(1 << FILTERS.index("E"))).otherwise(0)).alias("bits"))


def with_labels(marked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``good`` and ``toxic``: whether any label row of the id has quality 1, toxic 1."""
    one = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    one = one.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Null ids are dealt by their bits rather than to one task.
    one = one.withColumnRenamed("id", "label_id")
    out = marked.join(one, F.col("id") == F.col("label_id"), "left")
    return out.select("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


class BitmapIndex:
    """Packed bitsets of some rows: one for each filter, for each label, and of the rows there
    are.  Rows are laid out by part, each part from a fresh byte on, so a part is a run of bytes."""

    def __init__(self, part: np.ndarray, n_parts: int, bits: np.ndarray, good: np.ndarray, toxic: np.ndarray):
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=n_parts)
        room = (sizes + 7) // 8
        self.starts = np.cumsum(room) - room
        place = np.arange(len(part)) + np.repeat(8 * self.starts - (np.cumsum(sizes) - sizes), sizes)
        self._order, self._place, self._bytes = order, place, int(room.sum())
        self.rows = self._packed(np.ones(len(part), bool))
        self.filters = [self._packed(bits >> i & 1 != 0) for i in range(len(FILTERS))]
        self.good, self.toxic = self._packed(good), self._packed(toxic)

    def _packed(self, flags: np.ndarray) -> np.ndarray:
        wide = np.zeros(8 * self._bytes, bool)
        wide[self._place] = flags[self._order]
        return np.packbits(wide, bitorder="little")

    def counts(self, bitset: np.ndarray) -> np.ndarray:
        """Popcount of each part."""
        return np.add.reduceat(np.bitwise_count(bitset).astype(np.int64), self.starts)

    def prefixes(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(filters before, filter, kept, removed, good_lost, toxic_lost by part) for every set of
        filters and every filter outside it."""
        for before in range(1 << len(FILTERS)):
            gone = np.zeros_like(self.rows)
            for i, f in enumerate(self.filters):
                if before >> i & 1:
                    gone |= f
            for i, f in enumerate(self.filters):
                if not before >> i & 1:
                    removed = f & ~gone
                    yield before, i, self.counts(self.rows & ~(gone | f)), self.counts(removed), self.counts(removed & self.good), self.counts(removed & self.toxic)


COUNTS = ["kept", "removed", "good_lost", "toxic_lost"]


def prefix_counts(marked: DataFrame) -> DataFrame:
    """(part, before int, filter int, kept, removed, good_lost, toxic_lost long) summed over all
    tasks' bitmap indexes of ``marked`` (part, bits, good, toxic)."""

    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        parts = t.column("part").combine_chunks().dictionary_encode()
        columns = [t.column(c).to_numpy() for c in ("bits", "good", "toxic")]
        index = BitmapIndex(parts.indices.to_numpy(), len(parts.dictionary), *columns)
        found = list(index.prefixes())
        n = len(parts.dictionary)
        names = pa.concat_arrays([parts.dictionary] * len(found))
        mask, which = (np.repeat(np.array([x[i] for x in found], np.int32), n) for i in (0, 1))
        sums = [np.concatenate([x[i] for x in found]) for i in range(2, 6)]
        return pa.RecordBatch.from_arrays([names, *(pa.array(x) for x in (mask, which, *sums))], names=["part", "before", "filter", *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]):
        held, rows = [], 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS_INDEXED):
                held.append(b.slice(at, ROWS_INDEXED))
                rows += held[-1].num_rows
                if rows >= ROWS_INDEXED:
                    yield counted(held)
                    held, rows = [], 0
        if rows:
            yield counted(held)

    schema = "part string, before int, filter int, " + ", ".join(f"{c} long" for c in COUNTS)
    counts = marked.select("part", "bits", "good", "toxic").mapInArrow(run, schema)
    return counts.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, before, filter) of every step of every order."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), step, before, f))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley), one row for each part, order of the filters and step, zeros included.

    Counts are of rows, so rows that repeat an id count each; label rows that repeat an id count
    once.  Null ids have no labels.  A null text is empty, a null part the empty string.  An empty
    table has no parts and gives no rows.  Other columns are ignored.
    """
    marked = with_labels(with_copies(signals(docs, scratch, part_col, id_col, text_col)), labels, id_col)
    counts = scratch.cut(prefix_counts(marked), "counts")
    n = len(FILTERS)
    size = F.bit_count("before")
    # An order has the filters of ``before`` first in |before|! (n - 1 - |before|)! ways.
    ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), size + 1)
    whole = counts.groupBy("part", "filter").agg(
        F.sum(F.when(size == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * ways).cast("long").alias("shapley"),
    )
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, before int, filter int")
    # 600 rows and no more, whatever the data.
    out = counts.join(whole, ["part", "filter"]).join(F.broadcast(steps), ["before", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
