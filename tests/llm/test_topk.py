import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk
from tessera.llm.shared import Scratch


def brute(rows, k, every):
    vecs = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in vecs:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vecs if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def rows_for(seed, n=300, dim=8, kind="normal"):
    r = random.Random(seed)
    draw = {"normal": lambda: r.gauss(0, 1), "ties": lambda: r.choice([-1.0, 0.0, 0.5]), "same": lambda: 0.25}[kind]
    rows = [(i, [draw() for _ in range(dim)]) for i in range(n)]
    rows += [(n + 1, None), (n + 2, []), (n + 50, [float("nan")] * dim), (n + 4, [None] * dim), (n + 5, [float("inf")] + [0.0] * (dim - 1)), (50, rows[50][1]), (None, [1.0] * dim), (3, [9.0] * dim), (100, [1.0] * (dim - 3)), (7, [1.0] * (dim - 3)), (-50, [-30.0] * dim)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["normal", "ties", "same"])
@pytest.mark.parametrize("at_once", [4096, 3])
def test_op3(spark, kind, at_once, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", at_once)
    rows = rows_for(kind, kind=kind)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    v = topk.integer_vectors(df)
    got = topk.search(v, v.where("id % 50 = 0"), 5, Scratch(spark))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 50)


def test_op3_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    v = topk.integer_vectors(df)
    assert topk.search(v, v, 5, Scratch(spark)).count() == 0
    v = topk.integer_vectors(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in topk.search(v, v.where("id = 0"), 5, Scratch(spark)).collect()] == [(0, 1, 1, 256 * 512)]


def test_cells_bound(spark):
    x = np.random.default_rng(0).integers(-1000, 1000, (500, 7))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<long>").repartition(4)
    grid = topk.grid(df)
    least, width = grid[7]
    assert least.tolist() == x.min(axis=0).tolist() and (width <= 2000 // 256 + 1).all()
    for r in topk.approximation_file(df.withColumn("row", df.id + 1000), grid, Scratch(spark)).collect():
        cells = np.frombuffer(bytes(r.cells), np.uint8)
        low, high = topk.ends_of(cells, least, width)
        assert r.row == r.id + 1000 and (low <= x[r.id]).all() and (x[r.id] <= high).all()


def test_one_broadcast_lives_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 2)
    live, most, real = [], [], topk._scan

    def scan(file, grid, shared, k):
        live.append(shared)
        destroy = shared.destroy
        monkeypatch.setattr(shared, "destroy", lambda: (live.remove(shared), destroy()))
        most.append((len(live), sum(len(ids) for ids, _ in shared.value)))
        return real(file, grid, shared, k)

    monkeypatch.setattr(topk, "_scan", scan)
    v = topk.integer_vectors(spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(20)], "vec_id long, embedding array<float>"))
    assert topk.search(v, v.where("id % 2 = 0"), 3, Scratch(spark)).count() == 30
    assert len(most) >= 5 and not live and all(n == 1 and size <= 2 for n, size in most)


@pytest.mark.parametrize("scale", [1.0, 2.0**19, 2.0**22])
def test_wide_values(spark, monkeypatch, scale):
    """Few exact vectors at a time, many candidates, and sums beyond 53 bits."""
    monkeypatch.setattr(topk, "READ_AT_ONCE", 1)
    r = random.Random(7)
    rows = [(i, [scale * (1 + r.randrange(-9, 9) * 2.0**-8) for _ in range(3)]) for i in range(200)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    got = topk.search(v, v.where("id % 50 = 0"), 5, Scratch(spark))
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, 5, 50)


@pytest.mark.parametrize("kind", ["copies", "scores"])
def test_ties_leave_k_rows(spark, monkeypatch, kind):
    """Copies of one vector, or vectors of one score, make k candidates a query and task, not all rows."""
    seen, real = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name: seen.append((name, real(self, df, name))) or seen[-1][1])
    n, wide = 600, 300.0  # cells wider than one value, so that bounds of copies are not exact
    rows = [(i, [1.0, 2.0, wide] if kind == "copies" else [1.0, float(i % 90), 0.0]) for i in range(n)]
    if kind == "copies":
        rows.append((10_001, [-wide, 5.0, 0.0]))
        queries = "id % 50 = 0"
    else:
        rows += [(50_000 + i, [1.0, 0.0, 0.0]) for i in range(4)]
        queries = "id >= 50000"
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    asked = v.where(queries)
    got = topk.search(v, asked, 5, Scratch(spark))
    ids = {r.id for r in asked.collect()}
    vecs = {i: [math.floor(256 * x) for x in w] for i, w in rows}
    for q in ids:
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got.where(f"query_id = {q}").collect())
        want = sorted((-sum(a * b for a, b in zip(vecs[q], w)), i) for i, w in vecs.items() if i != q)[:5]
        assert [(i, s) for _, i, s in mine] == [(i, -s) for s, i in want]
    per_task = [r["count"] for name, f in seen if name == "bounds" for r in f.groupBy("query_id", F.input_file_name()).count().collect()]
    assert per_task and (max(per_task) <= 5 or kind == "copies" and max(per_task) <= 7)
    if kind == "copies":
        named = v.withColumns({"copy": F.unhex(F.sha2(F.array_join("v", ","), 256)), "row": F.monotonically_increasing_id()})
        assert topk._first_copies(named, 5).count() == 7
