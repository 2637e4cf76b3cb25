"""Cells of near-dedup that count, pairs that leave them, and the tasks of components."""

import random

from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import connected
from tessera.llm.shared import Scratch

SCHEMA = "id long, root long, n long, " + ", ".join(f"f{i} long" for i in range(12))


def test_a_pair_counts_in_one_cell(spark):
    """Documents of one value share 31 cells and are listed in one; whoever meets is a pair or in the crowd."""
    rows = [(i, i, 9, 77, *[0] * 11) for i in range(5)]
    _, met = simhash._meetings(spark.createDataFrame(rows, SCHEMA), [(0, simhash._band(0))], Scratch(spark))
    assert met.count() == 5 and simhash._few_pairs(met).count() == 10
    r = random.Random(3)
    values = [v ^ 1 << r.randrange(30) ^ (1 << r.randrange(30)) * r.randrange(2) for v in (r.getrandbits(30) for _ in range(12)) for _ in range(r.randrange(1, 16))]
    rows = [(i, i % 11, 9, v, *[0] * 11) for i, v in enumerate(values)]
    pairs, met = simhash._meetings(spark.createDataFrame(rows, SCHEMA), [(0, simhash._band(0))], Scratch(spark), 6)
    crowd = {x.id for x in met.where("cell is null").collect()}
    found = {(x.a, x.b) for x in pairs.unionAll(simhash._few_pairs(met.where("cell is not null"))).collect()}
    meet = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] != y[1] and (x[3] ^ y[3]).bit_count() <= 2}
    assert crowd and found and found <= meet and all(p in found or crowd >= set(p) for p in meet)


def test_pairs_that_leave_a_cell_are_alike(spark):
    """Of 20 documents of a value those pairs only whose whole fingerprints and sizes allow the similarity."""
    r = random.Random(5)
    lanes = [[simhash._signed(r.getrandbits(64)) for _ in range(11)] for _ in range(4)]
    rows = [(i, i, 100 if i < 16 else 300, 77, *lanes[i % 4]) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    _, met = simhash._meetings(df, [(0, simhash._band(0))], Scratch(spark), simhash.FEW_ALIKE)
    assert met.where("cell is null").isEmpty()
    found = {(x.a, x.b) for x in simhash._few_pairs(met, df.drop("root"), 0.8).collect()}
    assert found == {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[2] == y[2] and x[4:] == y[4:]}


def test_few_edges_take_few_tasks(spark):
    """Whatever the number of shuffle partitions, 200 edges are one file."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(0, 200).select(F.col("id").alias("a"), ((F.col("id") * 7 + 1) % 201).alias("b"))
        out = connected(edges, Scratch(spark))
        assert len(out.inputFiles()) == 1
        got = {x.node: x.root for x in out.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    label = {x: x for x in got}
    for _ in range(201):
        for a in range(200):
            b = (a * 7 + 1) % 201
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
