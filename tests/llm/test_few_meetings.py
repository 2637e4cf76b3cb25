"""Unrelated documents that meet in small cells, and what components cost the driver."""

import random

from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import connected
from tessera.llm.shared import Scratch


def test_few_that_meet_are_no_crowd(spark):
    """Three of a value are compared at once, and their shingles are not read; more than FEW in a cell are a crowd."""
    r = random.Random(12)
    values = [v for v in (r.getrandbits(30) for _ in range(40)) for _ in range(3)] + [5, 5, 4, 7, 5, 5, 4, 4, 7, 5, 5]
    rows = [(i, i % 5 if i < 120 else i, 9, v, *[0] * 11) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, root long, n long, " + ", ".join(f"f{i} long" for i in range(12)))
    pairs, met = simhash._meetings(df, [(0, simhash._band(0))], Scratch(spark))
    crowd = {x.id for x in met.where("cell is null").collect()}
    found = [(x.a, x.b) for x in simhash._few_pairs(met.where("cell is not null")).collect()]
    assert crowd == set(range(120, 131)) and len(found) == len(set(found))
    found = {*found, *((x.a, x.b) for x in pairs.collect())}
    meet = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] != y[1] and (x[3] ^ y[3]).bit_count() <= 2}
    assert found <= meet and all(p in found or crowd >= set(p) for p in meet)


def test_a_round_of_components_is_one_execution(spark, monkeypatch):
    """The driver keeps the plan of each execution."""
    cuts, cut = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, *a: cuts.append(1) or cut(self, *a))
    store = spark._jsparkSession.sharedState().statusStore()
    edges = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    out = connected(edges, Scratch(spark))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert store.executionsCount() - before == len(cuts) > 3
    assert {x.root for x in out.collect()} == {0} and out.count() == 201
