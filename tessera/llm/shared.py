"""What the training-data operators share: the shared folder, table cuts, prefix offsets."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir

ROOT = str(Path(__file__).resolve().parents[2])


#: Rows of one Arrow batch: texts are long, and Spark's default of 10,000 rows would make a
#: worker hold tens of MB of them twice.
ARROW_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if it isn't installed on their path, and keep
    their batches small unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def give_back() -> None:
    """Return a worker's free memory to the system: workers outlive the stage that needed it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Scratch:
    """Written tables in the shared folder that cut lineage: a lost executor costs a re-read only.

    Tables go when ``drop`` is called or the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        path = self._hadoop(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def cut(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps, which it does when their
        frames are collected as garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        path = self._hadoop(df._tessera_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def part_offsets(df: DataFrame, part: str, total: str) -> dict[int, int]:
    """Sum of ``total`` in all lower parts, by part.  One row for each partition reaches the driver."""
    sums = {r[0]: r[1] for r in df.groupBy(part).agg(F.sum(total)).collect()}
    out, at = {}, 0
    for p in sorted(sums):
        out[p] = at
        at += sums[p]
    return out

