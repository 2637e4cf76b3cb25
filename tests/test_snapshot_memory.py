"""Snapshots that one task clusters without holding their vectors."""

import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import clustering


def test_vectors_of_a_snapshot_are_not_held(spark):
    """The label function says how many MB its worker holds without mapped files."""

    def held(x):
        mb = re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]
        return np.full(len(x), int(mb) // 1024, np.int32) if len(x) and np.isfinite(x[-1]).all() else None

    def most(n):
        d = spark.range(0, n, 1, 4).select("id", F.lit(0).alias("g"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.rand(3) + k).alias("v"))
        return clustering._snapshot(d, ["g"], "id", "v", held).agg(F.max("cluster")).first()[0]

    assert most(150_000) - most(10) < 50  # the vectors alone have 77 MB


def test_snapshots_come_in_order_and_apart(spark):
    """Vectors in order of ids, of one snapshot only, whatever the batches."""
    rows = [(k % 3, i, [float(i), float(k % 3)]) for i, k in enumerate(np.random.default_rng(1).integers(0, 9, 700).tolist())]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        d = spark.createDataFrame(rows, "g int, id int, v array<double>").repartition(5)
        got = clustering._snapshot(d, ["g"], "id", "v", lambda x: (x[:, 0] * 10 + len(set(x[:, 1]))).astype(np.int32)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.g, r.id, r.cluster) for r in got) == sorted((g, i, i * 10 + 1) for g, i, _ in rows)
