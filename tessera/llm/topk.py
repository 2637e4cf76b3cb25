"""Exact top-k by inner product over vector-approximation files.

The approximation file holds each component as one byte, a cell with a lower and an upper end; the
exact vectors are a table of their own.  Each block of queries scans the cells, which bound every
score from both sides: a task keeps the rows whose upper bound reaches the k-th best lower bound it
has seen, and the k-th best lower bound of all tasks rules out more.  The exact vectors of the
rest are read in descending order of their upper bound, a lot at a time, until the next bound
of each query cannot reach its k-th result.

Copies of a vector have one score: the few of the smallest ids can be results, and only they are
scanned.  Where a row's upper bound equals the k-th lower bound, the smaller id decides, so equal
scores leave no more than k rows either.

Queries go out in blocks of a fixed size, one after another; each block's candidates are written
and its broadcast destroyed before the next, so neither the driver nor what is broadcast grows
with the data.  The exact vectors are read for all blocks together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch

#: Queries broadcast at once (2 MB at 64 components), cells of a component, rows scanned together,
#: and exact vectors read in the first lot for each result asked for.
QUERIES_AT_ONCE, CELLS, ROWS_AT_ONCE, QUERIES_TOGETHER, READ_AT_ONCE = 4096, 256, 4096, 256, 4


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<long>): floor(scale * x), x as double.  Rows with a null id, a null vector, or
    null or non-finite components are left out."""
    x: Column = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    d = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"), good.alias("good"))
    return d.where("good").select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


class Bounds:
    """Candidates of each query: rows whose upper bound exceeds the k-th best lower bound, or equals
    it and has no k rows before it that are as good for certain, by lower bound and smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        none = np.zeros(0, np.int64)
        self.rows = [(none, none, np.zeros(0), np.zeros(0)) for _ in range(n)]  # row, id, lower, upper

    def add(self, q: int, *more: np.ndarray) -> None:
        some = [np.concatenate(x) for x in zip(self.rows[q], more)]
        row, id_, lower, upper = some
        if len(lower) < self.k:
            self.rows[q] = tuple(some)
            return
        self.floor[q] = floor = max(self.floor[q], np.partition(lower, len(lower) - self.k)[len(lower) - self.k])
        kept = upper >= floor
        even = np.flatnonzero(lower == floor)
        room = self.k - int((lower > floor).sum())
        if len(even) > room:
            last = even[np.lexsort((row[even], id_[even]))[room - 1]]
            kept &= (upper > floor) | (id_ < id_[last]) | ((id_ == id_[last]) & (row <= row[last]))
        self.rows[q] = tuple(x[kept] for x in some)


def _search(bounds: Bounds, first: int, query_ids: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float, places: np.ndarray, ids: np.ndarray) -> None:
    k, plus, minus = bounds.k, np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    upper = plus @ high.T + minus @ low.T + slack
    lower = plus @ low.T + minus @ high.T - slack
    own = query_ids[:, None] == ids[None, :]
    upper[own], lower[own] = -np.inf, -np.inf
    floors = bounds.floor[first : first + len(queries)]
    if len(ids) >= k:
        floors = np.maximum(floors, np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k])
    q_at, row_at = np.nonzero((upper >= floors[:, None]) & ~own)
    ends = np.searchsorted(q_at, np.arange(len(queries) + 1))
    for q in np.flatnonzero(np.diff(ends)):
        rows = row_at[ends[q] : ends[q + 1]]
        bounds.add(first + q, places[rows], ids[rows], lower[q, rows], upper[q, rows])


def cells_of(exact: np.ndarray, least: np.ndarray, width: np.ndarray) -> np.ndarray:
    return ((exact - least) // width).astype(np.uint8)


def ends_of(cells: np.ndarray, least: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper end of each cell."""
    low = least + cells.astype(np.int64) * width
    return low.astype(np.float64), (low + width - 1).astype(np.float64)


def _rows_by_length(ids: np.ndarray, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vectors in a column."""
    lengths = np.diff(lists.offsets.to_numpy())
    values, start = lists.flatten().to_numpy(), np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        mine = np.flatnonzero(lengths == d)
        yield mine, values[start[mine][:, None] + np.arange(d)]


def grid(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, every component's least value and its cells' width.  A partition sends
    its extremes only."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for _, x in _rows_by_length(b.column(0), b.column(1)):
                low, high = x.min(axis=0), x.max(axis=0)
                was = seen.get(x.shape[1], (low, high))
                seen[x.shape[1]] = np.minimum(low, was[0]), np.maximum(high, was[1])
        columns = [pa.array([lo for lo, _ in seen.values()], pa.list_(pa.int64())), pa.array([hi for _, hi in seen.values()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["least", "most"])

    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in vectors.mapInArrow(run, "least array<long>, most array<long>").collect():
        low, high = np.array(r.least, np.int64), np.array(r.most, np.int64)
        was = out.get(len(low), (low, high))
        out[len(low)] = np.minimum(low, was[0]), np.maximum(high, was[1])
    return {d: (low, np.maximum((high - low) // CELLS + 1, 1)) for d, (low, high) in out.items()}


def approximation_file(vectors: DataFrame, cell_grid: dict[int, tuple[np.ndarray, np.ndarray]], scratch: Scratch) -> DataFrame:
    """(row, id, cells binary) of vectors (row, id, v), as written: one byte a component."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            cells: list[bytes] = [b""] * b.num_rows
            for mine, x in _rows_by_length(b.column(1), b.column(2)):
                for row, c in zip(mine, cells_of(x, *cell_grid[x.shape[1]])):
                    cells[row] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.binary())], names=["row", "id", "cells"])

    return scratch.cut(vectors.select("row", "id", "v").mapInArrow(run, "row long, id long, cells binary"), "cells")


def search(vectors: DataFrame, queries: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, rank, vec_id, score) for each query id in ``queries``, both as made by
    ``integer_vectors``: its k best rows of another id, fewer if there are fewer; ties go to the
    smaller id.  Rows that repeat an id are candidates each; of queries with one id the least
    vector counts.  Vectors of another length than the query's take no part in it, and those
    without components have product 0 with each other.  Scores must fit 63 bits.
    """
    spark = vectors.sparkSession
    one = queries.groupBy("id").agg(F.min("v").alias("v"))
    stored = scratch.cut(one.repartitionByRange(F.col("id")).sortWithinPartitions("id").withColumn("place", F.monotonically_increasing_id()), "queries")
    starts = sorted((r[0], r[1], r[2]) for r in stored.groupBy(F.shiftright("place", 33)).agg(F.min("id"), F.count("*")).collect())
    cuts = _block_starts(stored, starts)
    # Rows that repeat an id are told apart by their place.
    copy = F.unhex(F.sha2(F.array_join("v", ","), 256)).alias("copy")
    exact = scratch.cut(vectors.select("id", "v", copy).withColumn("row", F.monotonically_increasing_id()), "vectors")
    cell_grid = grid(exact.select("id", "v"))
    file = approximation_file(exact, cell_grid, scratch)
    first = scratch.cut(_first_copies(exact, k), "first")
    if first.count() < exact.count():
        file = scratch.cut(file.join(first.hint("merge"), "row", "left_semi"), "cells")
    found = []
    for a, b in zip(cuts, [*cuts[1:], None]):
        block = stored.where(F.col("id") >= a) if b is None else stored.where((F.col("id") >= a) & (F.col("id") < b))
        shared = spark.sparkContext.broadcast(_by_length(block.select("id", "v").collect()))  # QUERIES_AT_ONCE at most
        found.append(scratch.cut(_scan(file, cell_grid, shared, k), "bounds"))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _refine(reduce(DataFrame.unionAll, found), exact, stored, k, scratch)


def _first_copies(exact: DataFrame, k: int) -> DataFrame:
    """(row) of those that can be among any query's k best: of equal vectors the k + 1 smallest ids,
    since one may be the query's own, and k rows of each.  Vectors are told apart by SHA-256.  Each
    task passes on as many of a group at most."""
    rows = exact.select("copy", "id", "row")
    of_id = F.row_number().over(Window.partitionBy("copy", "id").orderBy("row"))
    rows = rows.withColumn("n", of_id).where(F.col("n") <= k).select("copy", "id", "row")
    ids = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("copy").orderBy("id")))
    return ids.where(F.col("n") <= k + 1).select("row")


def _refine(near: DataFrame, exact: DataFrame, queries: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Results from the bounds (query_id, row, vec_id, lower, upper) of the tasks' candidates."""
    by_lower, by_upper = (Window.partitionBy("query_id").orderBy(F.col(c).desc(), "vec_id", "row") for c in ("lower", "upper"))
    sure = near.withColumn("n", F.row_number().over(by_lower)).where(F.col("n") == k)
    sure = sure.select("query_id", F.col("lower").alias("least"), F.struct("vec_id", "row").alias("last"))
    near = near.join(sure, "query_id", "left").where(_may_enter("upper"))
    near = scratch.cut(near.select("query_id", "row", "vec_id", "upper").withColumn("at", F.row_number().over(by_upper)), "near")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "row")
    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    score = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    now, before, done, lot = near.where(F.col("at") <= READ_AT_ONCE * k), None, 0, READ_AT_ONCE * k
    while True:
        scores = now.join(exact.select("row", "v"), "row").join(asked, "query_id").select("query_id", "row", "vec_id", score.alias("score"))
        scores = scores if before is None else scores.unionAll(before.select("query_id", "row", "vec_id", "score"))
        before = scratch.cut(scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        done, lot = done + lot, 4 * lot
        kth = before.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"), F.struct("vec_id", "row").alias("last"))
        rest = near.where(F.col("at") > done).join(kth, "query_id", "left").where(_may_enter("upper")).drop("least", "last")
        if not rest.limit(1).count():
            return before.select("query_id", "rank", "vec_id", "score")
        now = rest.where(F.col("at") <= done + lot)


def _may_enter(bound: str) -> Column:
    """Whether a row may rank before the k-th of its query, ``last`` with score ``least``, or is it."""
    even = (F.col(bound) == F.col("least")) & (F.struct("vec_id", "row") <= F.col("last"))
    return F.col("least").isNull() | (F.col(bound) > F.col("least")) | even


def _block_starts(stored: DataFrame, starts: list[tuple[int, int, int]]) -> list[int]:
    """First id of each block of QUERIES_AT_ONCE queries, from the partitions' counts."""
    cuts, at = [], 0
    for part, first, count in starts:
        wanted = [x for x in range(-at % QUERIES_AT_ONCE, count, QUERIES_AT_ONCE)]
        if wanted == [0]:
            cuts.append(first)
        elif wanted:
            places = [(part << 33) + x for x in wanted]
            cuts += sorted(r[0] for r in stored.where(F.col("place").isin(places)).select("id").collect())
        at += count
    return cuts


def _by_length(rows) -> list[tuple[np.ndarray, np.ndarray]]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.v), []).append(r)
    return [(np.array([r.id for r in some], np.int64), np.array([r.v for r in some], np.float64)) for some in by.values()]


def _slack(queries: np.ndarray, least: np.ndarray, width: np.ndarray) -> float:
    """How far rounding can move a bound; nothing while all sums are exact."""
    ends = np.maximum(np.abs(least), np.abs(least + CELLS * width)).astype(np.float64)
    most = float(np.abs(queries).max(initial=0.0) * ends.sum()) if len(ends) else 0.0
    return 0.0 if most < 2.0**53 else most * (len(ends) + 2) * 2.0**-52


def _scan(file: DataFrame, cell_grid: dict[int, tuple[np.ndarray, np.ndarray]], shared, k: int) -> DataFrame:
    """(query_id, row, vec_id, lower, upper) of each task's candidates."""

    def run(batches: Iterator[pa.RecordBatch]):
        groups = shared.value
        bounds = [Bounds(len(ids), k) for ids, _ in groups]
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                places, every, cells = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2)
                lengths = pc.binary_length(cells).to_numpy()
                for (query_ids, q), kept in zip(groups, bounds):
                    d = q.shape[1]
                    mine = np.flatnonzero(lengths == d)
                    if not len(mine) or d not in cell_grid:
                        continue
                    bytes_ = b"".join(cells.filter(pa.array(lengths == d)).to_pylist())
                    low, high = ends_of(np.frombuffer(bytes_, np.uint8).reshape(len(mine), d), *cell_grid[d])
                    slack = _slack(q, *cell_grid[d])
                    for i in range(0, len(q), QUERIES_TOGETHER):
                        _search(kept, i, query_ids[i : i + QUERIES_TOGETHER], q[i : i + QUERIES_TOGETHER], low, high, slack, places[mine], every[mine])
        for (query_ids, _), kept in zip(groups, bounds):
            for i in range(0, len(query_ids), QUERIES_TOGETHER):
                some = kept.rows[i : i + QUERIES_TOGETHER]
                ids = np.repeat(query_ids[i : i + QUERIES_TOGETHER], [len(r[0]) for r in some])
                columns = [ids, *(np.concatenate([r[j] for r in some]) for j in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "row", "vec_id", "lower", "upper"])

    return file.mapInArrow(run, "query_id long, row long, vec_id long, lower double, upper double")
