"""Tables written to the shared folder between the rounds of an iterative operator."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where that is unset, one of our own if driver and
    executors are one process; on a cluster it has to be set, as no local folder is shared."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


class Rounds:
    """Cuts lineage: each table is written once and read back, so that a lost executor costs a
    re-read and a plan stays as long as one round.  Tables go when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def cut(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no step reads again, and let Spark delete the shuffle files of finished steps."""
        for df in tables:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
