"""Clustering of cross-sections: PCA and k-means, density methods, density filter, soft k-means."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import argmax, dot, sigmoid, softmax, unit
from tessera.operators import hierarchy
from tessera.operators.neighbours import Space
from tessera.sources.shared import Rounds

#: Rows of a snapshot turned to columns at a time.
MAPPED = 4096


def min_points(n: int) -> int:
    return max(3, int(math.log(n))) if n > 0 else 3


def l1(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def pca_kmeans(df: DataFrame, features: list[str], components: int, clusters: int, seed: int = 42, inits: int = 10):
    """Standardised features to principal components to the best of several k-means runs.
    Returns (predictions with column cluster, fitted pipeline parts)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    d = VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip").transform(df)
    scaler = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True).fit(d)
    d = scaler.transform(d)
    pca = PCA(k=min(components, len(features)), inputCol="_std", outputCol="_pc").fit(d)
    d = pca.transform(d).persist()
    fits = [KMeans(k=clusters, seed=seed + i, featuresCol="_pc", predictionCol="cluster").fit(d) for i in range(inits)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(d).drop("_raw", "_std"), (scaler, pca, best)


def density_filter(df: DataFrame, vector: str = "v", cluster: str = "cluster", percentile: float = 0.95) -> DataFrame:
    """Cluster -1 for members further (L1) from their mean than the cluster's percentile."""
    long = df.select(cluster, F.posexplode(vector).alias("d", "x")).where(F.col(cluster) != -1)
    centre = long.groupBy(cluster, "d").agg(F.avg("x").alias("m")).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("_c"))
    d = df.join(centre, cluster, "left").withColumn("dist", l1(vector, "_c"))
    cut = d.groupBy(cluster).agg(F.percentile("dist", percentile).alias("_cut"))
    return d.join(cut, cluster, "left").withColumn(cluster, F.when(F.col("dist") > F.col("_cut"), -1).otherwise(F.col(cluster))).drop("_c", "_cut")


def knn_distance(df: DataFrame, k: int, id_col: str = "id", vector: str = "v") -> DataFrame:
    """L1 distance of each row to its k-th nearest other row, NULL if there are fewer; exact, by
    metric partitioning (``neighbours.Space``) instead of all pairs."""
    space = Space(df, [], Rounds(df.sparkSession), id_col, vector)
    few = space.rows.count() <= k
    return space.nearest(k).select(F.col("id").alias(id_col), F.lit(None).cast("double").alias("dist") if few else F.col("dist"))


def dynamic_eps(df: DataFrame, k: int, quantile: float, id_col: str = "id", vector: str = "v") -> DataFrame:
    return knn_distance(df, k, id_col, vector).agg(F.percentile("dist", quantile).alias("eps"))


def soft_assign(df: DataFrame, centres: list[list[float]], temperature: float, gate_at: float, vector: str = "v") -> DataFrame:
    """Cosine similarities to the (unit) centres, softmax shares, gate for outliers, hard label."""
    u = unit(F.col(vector).cast("array<double>"))
    sizes = [math.sqrt(sum(x * x for x in c)) + 1e-8 for c in centres]
    d = df.withColumn("_u", u)
    sims = F.array(*(dot(F.col("_u"), F.array(*(F.lit(float(x / s)) for x in c))) for c, s in zip(centres, sizes)))
    d = d.withColumn("sim", sims)
    d = d.withColumn("share", softmax(F.transform("sim", lambda x: x / temperature)))
    return d.withColumns({"gate": sigmoid(20.0 * (F.array_max("sim") - gate_at)), "label": argmax(F.col("sim")).cast("int")}).drop("_u")


def cluster_consensus(df: DataFrame, by: list[str], vector: str, clusters: int, share: str = "share", gate: str = "gate") -> DataFrame:
    """Gate- and share-weighted mean vector of each cluster in each group: (by, k, consensus)."""
    long = df.select(*by, gate, F.posexplode(share).alias("k", "a"), vector).select(*by, gate, "k", "a", F.posexplode(vector).alias("d", "x"))
    mean = long.groupBy(*by, "k", "d").agg((F.sum(F.col(gate) * F.col("a") * F.col("x")) / (F.sum(F.col(gate) * F.col("a")) + 1e-8)).alias("m"))
    return mean.groupBy(*by, "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("consensus"))


def adjacency(labels: DataFrame, id_col: str = "id", cluster: str = "cluster") -> DataFrame:
    """Edges i < j between members of one cluster."""
    a = labels.where(F.col(cluster) >= 0)
    pairs = a.select(cluster, F.col(id_col).alias("i")).join(a.select(cluster, F.col(id_col).alias("j")), cluster).where("i < j")
    return pairs.select("i", "j", F.lit(1.0).alias("w"))


def _mapped(parts: Iterator[np.ndarray]) -> np.ndarray:
    """The rows of all parts as one array, column by column in a file of the task's own temp folder that
    is gone with the array: memory is that of a part, whatever the number of rows."""
    with tempfile.TemporaryFile() as rows, tempfile.TemporaryFile() as columns:
        n = width = 0
        for x in parts:
            rows.write(np.ascontiguousarray(x, float).data)
            n, width = n + len(x), x.shape[1]
        rows.flush()
        by_row = np.memmap(rows, float, "r", shape=(n, width))
        by_column = np.memmap(columns, float, "w+", shape=(width, n))
        for at in range(0, n, MAPPED):
            by_column[:, at : at + MAPPED] = by_row[at : at + MAPPED].T
        return by_column.view(np.ndarray).T


def _snapshot(df: DataFrame, by: list[str], id_col: str, vector: str, label: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(by.., id, cluster) by ``label`` of the vectors of each snapshot in order of ids.  A snapshot comes to its task
    batch by batch; its vectors lie in a file there, and memory holds their ids and what ``label`` keeps."""
    kind = df.schema[id_col].dataType.simpleString()
    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    names = [*by, id_col]

    def pieces(batches: Iterator[pa.RecordBatch]):
        """(key, piece): pieces of batches within one snapshot."""
        for b in batches:
            key = list(zip(*(b.column(c).to_pylist() for c in by)))
            at = 0
            for k, same in groupby(key):
                n = sum(1 for _ in same)
                yield k, b.slice(at, n)
                at += n

    def run(batches: Iterator[pa.RecordBatch]):
        for _, some in groupby(pieces(batches), lambda x: x[0]):
            kept = []

            def vectors():
                for _, piece in some:
                    kept.append(piece.select(names).take(pa.array(range(piece.num_rows))))  # a copy: a slice would hold the vectors
                    yield piece.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)

            found, at = label(_mapped(vectors())), 0
            for piece in kept:
                cluster = pa.array(found[at : at + piece.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([*piece.columns, cluster], names=[*names, "cluster"])
                at += piece.num_rows

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(*names, vector).repartition(parts, *by).sortWithinPartitions(*names)
    return ordered.mapInArrow(run, f"{keys}, {id_col} {kind}, cluster int")


def snapshot_sizes(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by.., k, m): the neighbours that a row of each snapshot needs, at most all others, and the
    rows that make a core."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    m = F.greatest(F.lit(3), F.floor(F.log("n")).cast("int"))
    return n.select(*by, m.alias("m"), F.greatest(F.least(m, F.col("n") - 1), F.lit(1)).cast("int").alias("k"))


def dbscan(df: DataFrame, by: list[str], eps: float | None = None, quantile: float = 0.5, id_col: str = "id", vector: str = "v") -> DataFrame:
    """(by.., id, cluster) of DBSCAN under L1 in each snapshot; without ``eps`` the quantile of the
    kth-neighbour distances, k being the logarithm of the snapshot's size.

    A snapshot is not one task: neighbours come by metric partitioning, clusters as components of
    core links (``neighbours.Space.density_clusters``).  Clusters are numbered by their smallest
    core's id; a border row goes to the first of those that reach it."""
    tables = Rounds(df.sparkSession)
    keyed = df.withColumn("_one", F.lit(0))
    by_ = by or ["_one"]
    space = Space(keyed, by_, tables, id_col, vector)
    sizes = tables.cut(snapshot_sizes(space.rows, by_))
    if eps is None:
        dist = space.nearest(sizes.select(*by_, "k"))
        reach = dist.groupBy(*by_).agg(F.coalesce(F.percentile("dist", quantile), F.lit(0.0)).alias("eps"))
    else:
        reach = sizes.select(*by_, F.lit(float(eps)).alias("eps"))
    reach = tables.cut(reach)
    space.forget()
    out = space.density_clusters(reach, sizes.select(*by_, F.col("m").alias("k")))
    return out.select(*by, F.col("id").alias(id_col), "cluster")


def agglomerative(df: DataFrame, by: list[str], threshold: float, id_col: str = "id", vector: str = "v") -> DataFrame:
    """Average linkage under L1, merging while the closest pair is nearer than the threshold.  A
    snapshot's rows are one task's, without a matrix of distances; snapshots run in parallel."""

    def label(x):
        return hierarchy.average_clusters(x, threshold)

    return _snapshot(df, by, id_col, vector, label)


def optics(df: DataFrame, by: list[str], xi: float = 0.05, max_eps: float = math.inf, id_col: str = "id", vector: str = "v") -> DataFrame:
    """OPTICS under L1 with xi extraction: innermost clusters of the reachability order that have
    the logarithm of the snapshot's size in rows or more; noise is -1.  A snapshot's rows are one
    task's, without a matrix of distances; snapshots run in parallel."""

    def label(x):
        k = min(min_points(len(x)), len(x))
        order, reach, before = hierarchy.reachability_order(x, k, max_eps)
        return hierarchy.leaf_labels(order, hierarchy.xi_clusters(order, reach, before, k, xi))

    return _snapshot(df, by, id_col, vector, label)
