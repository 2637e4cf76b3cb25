"""First centres of one window with all rows."""

import hashlib

from pyspark.sql import functions as F

from tessera.operators import window_models


def test_rows_of_a_window_do_not_meet_in_one_task(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.lit(0).alias("w"), F.col("id").cast("string").alias("id"), F.array(F.col("id").cast("double")).alias("v"))
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = window_models.first_centres(rows, ["w"], 3, 2).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert shuffled() - before < 1000
    want = {(s, c, float(i)) for s in (0, 1) for c, i in enumerate(sorted(range(20_000), key=lambda i: hashlib.md5(f"42:{s}:{i}".encode()).hexdigest())[:3])}
    assert {(r.start, r.cluster, r.centre[0]) for r in got} == want
