"""Models of many windows at once: scaling, principal components and k-means keyed by window.

Rows are (keys.., id, v array<double>), the keys naming a window.  A model is a table too, its rows
keyed by the same columns, so fitting all windows takes the jobs of one, a model is kept and
read back like any table, and prediction is a join.  A step of k-means is one join of rows with
their window's centres and one aggregation; nothing is grouped into one task by window but
sums, matrices of features by features, and centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import dot
from tessera.sources.shared import Rounds

#: Lloyd steps planned together between two written tables of centres.
STEPS = 4
#: Rows of a window whose vectors are packed together.
PACK = 4096
#: Windows whose matrices a task holds before it passes them on.
HELD = 256


def moments(rows: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """(by.., mean array, sd array, n): population moments of each window; a constant feature has
    deviation 1."""
    x = array_to_vector(vector)
    d = rows.groupBy(*by).agg(vector_to_array(Summarizer.mean(x)).alias("mean"), vector_to_array(Summarizer.variance(x)).alias("var"), F.count("*").alias("n"))
    sd = F.transform("var", lambda s: F.sqrt(s * (F.col("n") - 1) / F.col("n")))
    return d.select(*by, "mean", F.transform(sd, lambda s: F.when(s > 0, s).otherwise(1.0)).alias("sd"), "n")


def standardise(rows: DataFrame, fitted: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """Rows with ``vector`` less its window's mean, in units of its deviation."""
    d = rows.join(fitted.select(*by, "mean", "sd"), by)
    centred = F.zip_with(F.col(vector), F.col("mean"), lambda x, m: x - m)
    return d.withColumn(vector, F.zip_with(centred, F.col("sd"), lambda x, s: x / s)).drop("mean", "sd")


def components(rows: DataFrame, by: list[str], k: int, vector: str = "v") -> DataFrame:
    """(by.., axes array<array<double>>, explained array<double>): the k leading principal axes of
    each window of centred rows and their shares of variance; the largest entry of an axis is
    positive.  Tasks pass on sums of products, a matrix for each window they have seen."""
    keys = rows.select(*by)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)

    def products(batches: Iterator[pa.RecordBatch]):
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in held], batch.schema.field(i).type) for i in range(len(by))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))], names=[*by, "xx"])

        for batch in batches:
            named = [batch.column(i).to_pylist() for i in range(len(by))]
            x, where = np.array(batch.column(len(by)).to_pylist(), float), {}
            for row, key in enumerate(zip(*named)):
                where.setdefault(key, []).append(row)
            for key, at in where.items():
                part = x[at].T @ x[at]
                held[key] = held[key] + part if key in held else part
            if len(held) >= HELD:
                yield out()
                held = {}
        if held:
            yield out()

    def axes(key, pdf):
        total = np.sum(np.stack(pdf["xx"].to_numpy()), axis=0)
        n = round(len(total) ** 0.5)
        values, vectors = np.linalg.eigh(total.reshape(n, n))
        best = vectors.T[::-1][:k]
        best = best * np.sign(best[np.arange(len(best)), np.abs(best).argmax(axis=1)])[:, None]
        shares = values[::-1][:k] / max(values.sum(), 1e-300)
        return pd.DataFrame({**{b: [v] for b, v in zip(by, key)}, "axes": [best.tolist()], "explained": [shares.tolist()]})

    parts = rows.select(*by, vector).mapInArrow(products, f"{kinds}, xx array<double>")
    return parts.groupBy(*by).applyInPandas(axes, f"{kinds}, axes array<array<double>>, explained array<double>")


def project(rows: DataFrame, fitted: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    d = rows.join(fitted.select(*by, "axes"), by)
    return d.withColumn(vector, F.transform("axes", lambda a: dot(F.col(vector), a))).drop("axes")


def first_centres(rows: DataFrame, by: list[str], k: int, starts: int = 1, seed: int = 42, id_col: str = "id", vector: str = "v") -> DataFrame:
    """(by.., start, cluster, centre): in each window and start the rows of the k smallest hashes of
    seed, start and id, which does not depend on how rows are dealt."""
    d = rows.select(*by, id_col, vector).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    drawn = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("start").cast("string"), F.col(id_col).cast("string")))
    n = F.row_number().over(Window.partitionBy(*by, "start").orderBy(drawn, id_col))
    # The number itself is bounded, so Spark leaves k rows of a window in each task before they meet in one.
    return d.withColumn("n", n).where(F.col("n") <= k).select(*by, "start", (F.col("n") - 1).alias("cluster"), F.col(vector).alias("centre"))


def _distance(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y)


def assign(rows: DataFrame, centres: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """Rows with ``cluster`` of the nearest centre of their window, the smaller number on ties, and
    its squared ``cost``; once for each start of ``centres``, if it has that column."""
    each = [*by, *(c for c in ("start",) if c in centres.columns)]
    held = centres.groupBy(*each).agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("held"))
    d = rows.join(held, by)
    near = F.array_min(F.transform("held", lambda h: F.struct(_distance(F.col(vector), h["centre"]).alias("cost"), h["cluster"].alias("cluster"))))
    return d.withColumn("near", near).select(*(c for c in d.columns if c != "held"), "near.cluster", "near.cost")


def lloyd_step(rows: DataFrame, centres: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """Centres at the means of the rows nearest to them; one without rows stays where it is."""
    each = [*by, "start", "cluster"]
    mean = assign(rows, centres, by, vector).groupBy(*each).agg(vector_to_array(Summarizer.mean(array_to_vector(vector))).alias("mean"))
    return centres.join(mean, each, "left").select(*each, F.coalesce("mean", "centre").alias("centre"))


def _kinds(rows: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)


def packed(rows: DataFrame, by: list[str], id_col: str = "id", vector: str = "v") -> DataFrame:
    """(by.., x array<double>, n): the vectors of up to PACK rows of a window end to end.  Large windows
    are spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(by)))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for first, last in zip(cuts, cuts[1:]):
                for at in range(first, last, PACK):
                    some = b.slice(at, min(PACK, last - at))
                    x = some.column(len(by)).flatten()
                    yield pa.RecordBatch.from_arrays([*(some.column(i).slice(0, 1) for i in range(len(by))), pa.ListArray.from_arrays([0, len(x)], x), pa.array([len(some)], pa.int32())], names=[*by, "x", "n"])

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(parts, *by, id_col).sortWithinPartitions(*by, id_col).select(*by, F.col(vector).cast("array<double>"))
    return dealt.mapInArrow(run, f"{_kinds(rows, by)}, x array<double>, n int")


def packed_means(data: DataFrame, centres: DataFrame, by: list[str]) -> DataFrame:
    """(by.., start, cluster, n, mean, cost): of the rows nearest to each centre, the smaller number on ties,
    how many there are, their mean and their sum of squared distances.  A task passes on sums."""
    held = centres.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "cluster", "centre"))).alias("held"))
    d = data.join(held, by).select(*by, "x", "n", "held")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found: dict[tuple, list] = {}
            for row in range(b.num_rows):
                key = tuple(b.column(i)[row].as_py() for i in range(len(by)))
                x = b.column("x")[row].values.to_numpy(zero_copy_only=False).reshape(b.column("n")[row].as_py(), -1)
                if key not in found:
                    starts: dict[int, list] = {}
                    for h in b.column("held")[row].as_py():
                        starts.setdefault(h["start"], []).append((h["cluster"], h["centre"]))
                    found[key] = [(s, [k for k, _ in c], np.array([v for _, v in c]), np.zeros(len(c), np.int64), np.zeros((len(c), x.shape[1])), np.zeros(len(c))) for s, c in starts.items()]
                for _, _, centre, n, sums, cost in found[key]:
                    dist = np.zeros((len(x), len(centre)))
                    for k in range(x.shape[1]):
                        dist += (x[:, k, None] - centre[:, k]) ** 2
                    nearest = dist.argmin(axis=1)
                    n += np.bincount(nearest, minlength=len(centre))
                    cost += np.bincount(nearest, dist[np.arange(len(x)), nearest], len(centre))
                    for k in range(x.shape[1]):
                        sums[:, k] += np.bincount(nearest, x[:, k], len(centre))
            out = [(key, s, c, int(n[i]), sums[i], cost[i]) for key, each in found.items() for s, ids, _, n, sums, cost in each for i, c in enumerate(ids) if n[i]]
            if out:
                columns = [pa.array([o[0][i] for o in out], b.schema.field(i).type) for i in range(len(by))]
                columns += [pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int64()), pa.array([o[4] for o in out], pa.list_(pa.float64())), pa.array([o[5] for o in out], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*by, "start", "cluster", "n", "sums", "cost"])

    each = [*by, "start", "cluster"]
    parts = d.mapInArrow(run, f"{_kinds(data, by)}, start int, cluster int, n long, sums array<double>, cost double")
    summed = parts.groupBy(*each).agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    return summed.select(*each, "n", F.transform("sums", lambda x: x / F.col("n")).alias("mean"), "cost")


def fit_kmeans(rows: DataFrame, by: list[str], k: int, starts: int = 10, seed: int = 42, rounds: int = 6, tolerance: float = 1e-4, id_col: str = "id", vector: str = "v") -> DataFrame:
    """(by.., cluster, centre, loss): k-means of every window, of several starts the one of the
    smallest sum of squares, the earlier one on ties.

    All windows and starts take their steps together, STEPS of them a round, until no centre moves by
    more than ``tolerance`` (squared) or for ``rounds``; the number of jobs is that of the
    rounds.  A window of fewer than k rows has as many clusters as rows.
    """
    tables = Rounds(rows.sparkSession)
    rows = tables.cut(rows.select(*by, id_col, vector))
    data, each = tables.cut(packed(rows, by, id_col, vector)), [*by, "start", "cluster"]
    centres = tables.cut(first_centres(rows, by, k, starts, seed, id_col, vector))
    for _ in range(rounds):
        now = centres
        for _ in range(STEPS):
            means = packed_means(data, now, by).select(*each, "mean")
            now = now.join(means, each, "left").select(*each, F.coalesce("mean", "centre").alias("centre"))
        now, before = tables.cut(now), centres.withColumnRenamed("centre", "was")
        moved = now.join(before, [*by, "start", "cluster"]).agg(F.max(_distance(F.col("centre"), F.col("was")))).first()[0]
        centres = now
        if moved is None or moved <= tolerance:
            break
    loss = packed_means(data, centres, by).groupBy(*by, "start").agg(F.sum("cost").alias("loss"))
    first = Window.partitionBy(*by).orderBy(F.round("loss", 9), "start")
    best = loss.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return tables.cut(centres.join(best, [*by, "start"]).select(*by, "cluster", "centre", "loss"))


def keep_best(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Of two fitted models of each window the rows of the one of smaller loss, the old one on ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(*by).agg(F.min(F.struct("loss", "_new")).alias("_b")).select(*by, F.col("_b._new").alias("_new"))
    return both.join(best, [*by, "_new"]).drop("_new")


def window_clusters(snapshots: DataFrame, by: list[str], clusters: int, parts: int = 5, starts: int = 10, least: int = 50, seed: int = 42, id_col: str = "id", vector: str = "v") -> DataFrame:
    """(by.., id, cluster) of every window's rows: standardised, on their leading components, by
    k-means.  Windows of fewer than ``least`` rows are left out; rows whose vector holds NULL too."""
    tables = Rounds(snapshots.sparkSession)
    good = snapshots.where(F.forall(vector, lambda x: x.isNotNull())).select(*by, id_col, vector)
    fitted = moments(good, by, vector)
    d = tables.cut(standardise(good, tables.cut(fitted.where(F.col("n") >= least)), by, vector))
    d = tables.cut(project(d, components(d, by, parts, vector), by, vector))
    return assign(d, fit_kmeans(d, by, clusters, starts, seed, id_col=id_col, vector=vector).drop("loss"), by, vector).select(*by, id_col, "cluster")
