"""Connected components of an edge table by alternating large and small stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the smallest node it
sees.  Rounds are joins and aggregations of edge tables written to the shared folder; no links
reach the driver, only a count and a checksum that tell when nothing changes any more, and the
number of tasks, so that a few thousand links don't cost a task and its files a shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch

#: Edges of a task, where there are too few to give each shuffle partition as many.
TASK_EDGES = 20_000


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; loops are ignored, null ends must
    not occur), root being the smallest node of its component."""
    now, state = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), scratch)
    while state[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _packed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), state[0])
        large = _packed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), state[0])
        least = _packed(large.groupBy("u").agg(F.min("v").alias("m")), state[0])
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        before, last = state, now
        now, state = _kept(_packed(small.distinct(), state[0]), scratch)
        scratch.drop(last)
        if state == before:
            break
        scratch.release()
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _packed(rows: DataFrame, edges: int) -> DataFrame:
    """These rows in as many tasks as so many edges need, if shuffles would make more."""
    tasks = 1 + edges // TASK_EDGES
    return rows.coalesce(tasks) if tasks < int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _kept(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple[int, int | None]]:
    """The edges as a table, their number and a checksum, which the tasks take while they write it."""
    seen = Observation()
    out = scratch.cut(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
    return out, (seen.get["n"], seen.get["x"])
