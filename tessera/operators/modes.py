"""Leading eigenvectors of large symmetric operators, with vectors as tables.

A block of vectors is a table (node, z array); the operator is a join and an aggregation, so
neither a matrix of nodes by nodes nor a vector of all nodes is ever in one place.  Krylov
blocks of a few powers are projected on (Rayleigh-Ritz): the products of the blocks' columns are
summed task by task, and what reaches the driver is a matrix as small as the number of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import window_models
from tessera.sources.shared import Rounds

#: Powers of the operator in a Krylov block, and columns beyond those asked for.
DEPTH, MORE = 4, 5


def array_sum(z: Column) -> Column:
    """Sum of arrays of equal length, component by component."""
    return vector_to_array(Summarizer.sum(array_to_vector(z)))


def scaled(z: Column, by: Column) -> Column:
    return F.transform(z, lambda x: x * by)


def gram(df: DataFrame, *columns: str) -> np.ndarray:
    """Products of all pairs of components of the arrays laid side by side, summed over the rows.
    Each task passes on one matrix, whose entries are summed by their place."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for b in batches:
            parts = [np.array(c.to_pylist(), float) for c in b.columns]
            if b.num_rows:
                x = np.concatenate(parts, axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g"])

    entries = df.select(*columns).mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    flat = np.array([r.x for r in entries.orderBy("at").collect()])
    n = round(len(flat) ** 0.5)
    return flat.reshape(n, n)


def _combined(q: Column, weights: np.ndarray) -> Column:
    """Linear combinations of an array's components, one for each column of ``weights``."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in column)) for column in weights.T))
    return F.transform(rows, lambda w: F.aggregate(F.zip_with(q, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def leading_pairs(nodes: DataFrame, apply: Callable[[DataFrame], DataFrame], k: int, tolerance: float = 1e-8, rounds: int = 20, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """The k largest eigenvalues of a symmetric operator, in falling order, and (node, z array<double>)
    of its orthonormal eigenvectors, the largest entry of each positive.

    ``apply`` takes (node, z) to its image.  Starting vectors come from hashes of the nodes.  Rounds of
    DEPTH powers end when the residual of every pair asked for is below ``tolerance`` times the
    largest value, or when rounding keeps it from falling."""
    tables = Rounds(nodes.sparkSession)
    width = k + MORE

    def draw(c: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(seed), F.lit(c)), F.lit(1 << 30)) / float(1 << 30) - 0.5

    now = tables.cut(nodes.select("node", F.array(*(draw(c) for c in range(width))).alias("z")))
    values, before = np.zeros(0), np.inf
    for _ in range(rounds):
        held = None
        for _ in range(DEPTH):
            image = apply(now).withColumnRenamed("z", "w")
            step = now.join(image, "node")
            if held is not None:
                step = step.join(held, "node").select("node", "z", "w", F.concat("q", "z").alias("q"), F.concat("p", "w").alias("p"))
            else:
                step = step.select("node", "z", "w", F.col("z").alias("q"), F.col("w").alias("p"))
            step = tables.cut(step)
            held, now = step.select("node", "q", "p"), step.select("node", F.col("w").alias("z"))
        products = gram(held, "q", "p")
        m = len(products) // 2
        scale = np.sqrt(np.maximum(np.diag(products)[:m], 1e-300))
        g, t = (x / np.outer(scale, scale) for x in (products[:m, :m], (products[:m, m:] + products[m:, :m]) / 2))
        lengths, axes = np.linalg.eigh(g)
        kept = lengths > lengths.max() * 1e-12
        white = axes[:, kept] / np.sqrt(lengths[kept])
        values, turn = np.linalg.eigh(white.T @ t @ white)
        values, y = values[::-1][:width], (white @ turn)[:, ::-1][:, :width] / scale[:, None]
        n = min(k, len(values))
        both = tables.cut(held.select("node", _combined(F.col("q"), y).alias("z"), _combined(F.col("p"), y[:, :n]).alias("w")))
        now = both.select("node", "z")
        theta = F.array(*(F.lit(float(x)) for x in values[:n]))
        gap = F.zip_with("w", F.zip_with(F.slice("z", 1, n), theta, lambda a, b: a * b), lambda a, b: (a - b) * (a - b))
        residual = max(both.agg(array_sum(gap).alias("r")).first().r) ** 0.5 / max(np.abs(values).max(), 1e-300)
        if residual <= tolerance or residual > 0.5 * before and residual < 1e-6:
            break
        before = residual
    n = min(k, len(values))
    peaks = now.agg(*(F.max_by(F.col("z")[c], F.abs(F.col("z")[c])).alias(f"c{c}") for c in range(n))).first()
    signs = F.array(*(F.lit(float(np.sign(x) or 1.0)) for x in peaks))
    return values[:n], now.select("node", F.zip_with(F.slice("z", 1, n), signs, lambda a, b: a * b).alias("z"))


def covariance_modes(series: DataFrame, k: int) -> tuple[list[tuple[int, float]], DataFrame]:
    """Shares of variance of the k leading modes of a long series (t, i, f), and (node, z) of their
    loadings.  The covariance acts as two joins, over nodes and over times; a missing value counts as its
    node's mean."""
    tables = Rounds(series.sparkSession)
    mean = series.groupBy("i").agg(F.avg("f").alias("m"))
    x = tables.cut(series.where("f IS NOT NULL").join(mean, "i").select("t", F.col("i").alias("node"), (F.col("f") - F.col("m")).alias("x")))
    times = x.select("t").distinct().count()
    total = x.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0
    nodes = x.select("node").distinct()

    def apply(z: DataFrame) -> DataFrame:
        seen = x.join(z, "node").groupBy("t").agg(array_sum(scaled(F.col("z"), F.col("x"))).alias("z"))
        return x.join(seen, "t").groupBy("node").agg(array_sum(scaled(F.col("z"), F.col("x") / max(times - 1, 1))).alias("z"))

    values, vectors = leading_pairs(nodes, apply, k)
    whole = total / max(times - 1, 1)
    return [(i, float(v / whole) if whole else 0.0) for i, v in enumerate(values)], vectors


def spectral_embedding(edges: DataFrame, k: int, background: float = 1e-6) -> tuple[np.ndarray, DataFrame]:
    """The k largest eigenvalues of the normalised affinities of undirected edges (i, j, w), each
    once, and (node, z): the eigenvectors divided by the root of the degree.

    ``background`` is added to every pair's weight, a node's own included, so that the graph is
    connected; it acts through one sum over the nodes instead of as edges."""
    tables = Rounds(edges.sparkSession)
    both = edges.where("i <> j").select("i", "j", "w").unionAll(edges.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    both = tables.cut(both)
    n = both.select("i").distinct().count()
    root = tables.cut(both.groupBy(F.col("i").alias("node")).agg(F.sqrt(F.sum("w") + background * n).alias("root")))

    def apply(z: DataFrame) -> DataFrame:
        u = z.join(root, "node").select("node", scaled(F.col("z"), 1 / F.col("root")).alias("u"))
        near = both.join(u.withColumnRenamed("node", "j"), "j").groupBy(F.col("i").alias("node")).agg(array_sum(scaled(F.col("u"), F.col("w"))).alias("near"))
        every = F.array(*(F.lit(background * x) for x in u.agg(array_sum(F.col("u")).alias("s")).first().s))
        return near.join(root, "node").select("node", F.transform(F.zip_with("near", every, lambda a, b: a + b), lambda x: x / F.col("root")).alias("z"))

    values, vectors = leading_pairs(root.select("node"), apply, k)
    return values, vectors.join(root, "node").select("node", scaled(F.col("z"), 1 / F.col("root")).alias("z"))


def spectral_clusters(edges: DataFrame, k: int, seed: int = 42, starts: int = 10) -> DataFrame:
    """(i, pred): k-means on the spectral embedding of the k largest eigenvalues."""
    _, points = spectral_embedding(edges, k)
    rows = points.select(F.lit(0).alias("_one"), F.col("node").alias("id"), F.col("z").alias("v"))
    fitted = window_models.fit_kmeans(rows, ["_one"], k, starts, seed, tolerance=1e-8)
    return window_models.assign(rows, fitted.drop("loss"), ["_one"]).select(F.col("id").alias("i"), F.col("cluster").alias("pred"))
