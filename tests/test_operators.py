"""Edge semantics by hand-made rows."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import dates
from tessera.functions.exprs import Layers, Panel, clip, div, safe_log, signed_ratio
from tessera.operators import clustering, cross_section, daily_factors, dynamics, extended_factors, firm_factors, graph, hierarchy, joins, modes, neighbours, portfolio, window_models
from tessera.plans import walkforward
from tessera.sources import panels as sources
from tessera.sources.shared import Rounds
from tessera.streaming.bars import tumbling_bars

D = dt.date


def day(i):
    return D(2024, 1, 1) + dt.timedelta(days=i)


def test_rolling_gate_and_skew(spark):
    r = random.Random(1)
    x = [None if i in (3, 4, 9, 15, 16, 20, 25) else r.gauss(0, 1) for i in range(40)]
    flat = [(2, day(i), 0.25) for i in range(30)]
    df = spark.createDataFrame([(1, day(i), v) for i, v in enumerate(x)] + flat, "e int, t date, x double")
    p = Panel("e", "t")
    got = Layers({"m": p.roll("avg", "x", 21, 15), "s": p.roll("stddev_samp", "x", 21, 15), "k": p.roll_skew("x", 21, 15)}).apply(df).orderBy("e", "t").collect()
    s = pd.Series(x, dtype=float).rolling(21, min_periods=15)
    for g, m, sd, sk in zip(got, s.mean(), s.std(), s.skew()):
        for a, b in ((g.m, m), (g.s, sd), (g.k, sk)):
            assert (a is None and math.isnan(b)) or abs(a - b) < 1e-9
    assert {g.k for g in got[54:]} == {0.0}


def test_ratios_and_logs(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, None), (4.0, 2.0)], "a double, b double")
    got = df.select(F.expr(div("a", "b")).alias("d"), F.expr(signed_ratio("a", "b")).alias("r"), F.expr(safe_log("a")).alias("l"), F.expr(clip("b", -1, 1)).alias("c"), C.clip(F.col("b"), -1, 1).alias("e")).collect()
    assert [g.d for g in got] == [None, None, None, None, 2.0]
    assert [g.r for g in got] == [1e300, -1e300, None, None, 2.0]
    assert got[1].l is None and got[2].l is None and [g.c for g in got] == [g.e for g in got] == [0, 0, 0, None, 1]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,)], "x double")
    assert [r.x for r in C.clean_frame(odd).collect()] == [None, None, None, 1.0]


def test_asof(spark):
    left = spark.createDataFrame([("a", day(5), 1), ("a", day(10), 2), ("a", day(60), 3), ("b", day(5), 4), ("c", day(5), 5), (None, day(5), 6), ("a", None, 7), ("a", day(1), 8)], "k string, date date, x int")
    right = spark.createDataFrame([("a", day(5), None, 1), ("a", day(10), 7.0, 1), ("a", day(10), 8.0, 2), ("b", day(6), 1.0, 1), (None, day(1), 9.0, 1)], "k string, d date, v double, x int")
    got = {r.x: (r.d, r.v, r.x_r) for r in joins.asof_join(left, right, ["k"], "date", "d", 45, tie=["x"]).collect()}
    assert got == {1: (day(5), None, 1), 2: (day(10), 8.0, 2), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None), 8: (None, None, None)}
    assert joins.asof_join(left, right, ["k"], "date", "d").where("x = 3").first().v in (7.0, 8.0)


def test_asof_buckets(spark):
    r = random.Random(9)
    left = spark.createDataFrame([(i % 3, day(r.randrange(400)), i) for i in range(300)], "k int, date date, x int")
    right = spark.createDataFrame([(r.randrange(3), day(r.randrange(400)), float(i)) for i in range(60)], "k int, d date, v double")
    plain = {x.x: (x.d, x.v) for x in joins.asof_join(left, right, ["k"], "date", "d", 45).collect()}
    for days in (1, 30, 1000):
        assert {x.x: (x.d, x.v) for x in joins.asof_join(left, right, ["k"], "date", "d", 45, bucket_days=days).collect()} == plain
    with pytest.raises(ValueError):
        joins.asof_join(left, right, ["k"], "date", "d", bucket_days=3)


def test_intervals(spark):
    left = spark.createDataFrame([("u", day(i)) for i in (1, 5, 10, 50)], "k string, d date")
    link = spark.createDataFrame([("u", day(1), day(5), 1), ("u", day(5), day(10), 2), ("u", day(40), None, 3), ("z", day(0), None, 4)], "n string, a date, b date, p int")
    got = sorted((r.d, r.p) for r in joins.interval_join(left, link, "k", "n", "d", "a", "b").collect())
    assert got == [(day(1), 1), (day(5), 1), (day(5), 2), (day(10), 2), (day(50), 3)]
    assert joins.interval_join(left, link, "k", "n", "d", "a", "b", respect_end=False).count() == 8


def test_calendar(spark):
    cal = spark.createDataFrame([(day(i),) for i in (1, 2, 5, 9)], "date date")
    df = spark.createDataFrame([(day(i),) for i in (0, 1, 2, 4, 5, 9, 12)], "d date")
    assert [r.next_td for r in dates.next_trading_day(df, cal, "d").orderBy("d").collect()] == [day(1), day(2), day(5), day(5), day(9), None, None]
    assert dates.next_trading_day(df, cal.limit(0), "d").first().next_td is not None
    assert dates.completeness_cutoffs(D(2024, 5, 15)) == {"year": D(2023, 12, 31), "quarter": D(2024, 3, 31), "month": D(2024, 4, 30)}
    week = spark.createDataFrame([(D(2024, 3, 4 + i),) for i in range(7)], "d date")  # Monday to Sunday
    got = week.orderBy("d").select(dates.add_weekdays(F.col("d"), 1).alias("n"), dates.add_weekdays(F.col("d"), -1).alias("p")).collect()
    assert [r.n.day for r in got] == [5, 6, 7, 8, 11, 11, 11] and [r.p.day for r in got] == [1, 4, 5, 6, 7, 7, 7]


def test_stop_entry_against_steps(spark):
    r = random.Random(2)
    rows = [(e, day(t), r.choice([-1, 0, 1])) for e in range(40) for t in range(7)]
    df = spark.createDataFrame(rows, "permno int, date date, pos int")
    for last in (3, 7, 20):
        got = {(x.permno, x.date): x.pos for x in portfolio.stop_entries(df, last).collect()}
        for e in range(40):
            raw = [p for q, _, p in rows if q == e]
            pos, n = list(raw), min(last, 7)
            for t in range(7 - n, 7):
                pos[t] = 0 if t == 0 or raw[t] == 0 else pos[t - 1]
            pos[-1] = 0
            assert [got[e, day(t)] for t in range(7)] == pos


def test_sequential_backtest(spark):
    r = random.Random(3)
    w = [[r.uniform(-1, 1) for _ in range(3)] for _ in range(6)]
    ret = [[r.uniform(-0.1, 0.1) for _ in range(3)] for _ in range(6)]
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1 + i), a, b) for i, (a, b) in enumerate(zip(w, ret))], "pf int, t timestamp, weights array<double>, rets array<double>")
    got = portfolio.sequential_backtest(df, 10.0, "pf", "t").orderBy("step").collect()
    equity, held = 1.0, [0.0] * 3
    for g, a, b in zip(got, w, ret):
        target = [x * equity for x in a]
        traded = sum(abs(x - y) for x, y in zip(target, held))
        equity += -traded * 0.001 + sum(x * y for x, y in zip(target, b))
        held = [x * (1 + y) for x, y in zip(target, b)]
        assert abs(g.equity - equity) < 1e-12 and abs(g.turnover - traded) < 1e-12


def test_rank_signal_overlap(spark):
    df = spark.createDataFrame([(1, day(0), 0, None), (2, day(0), 0, 1.0), (3, day(0), 0, 1.0), (4, day(0), 0, 2.0)], "permno int, date date, cluster int, z_score double")
    got = {r.permno: r.pos for r in portfolio.rank_signal(60.0, "permno", "date").apply(df).collect()}
    assert got == {1: 0, 2: 1, 3: -1, 4: -1}


def test_laplacian_rows_sum_to_zero(spark):
    e = graph.both_ways(spark.createDataFrame([(0, 1, 0.5), (1, 2, 1.0), (0, 3, 2.0)], "i int, j int, w double"))
    sums = graph.laplacian(e).groupBy("i").agg(F.sum("l").alias("s")).collect()
    assert len(sums) == 4 and all(abs(r.s) < 1e-12 for r in sums)
    f = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((1, 2, 4, 8))], "t int, i int, f double")
    got = {r.i: (r.force, r.stiffness) for r in graph.force(e, f).collect()}
    assert got == {0: (2 * (0.5 * 1 + 2 * 7), 5.0), 1: (2 * (-0.5 + 2.0), 3.0), 2: (-4.0, 2.0), 3: (-28.0, 4.0)}
    one = graph.similarity(e.where("i < j"), e.where("i < j"), 4).first()
    assert abs(one.similarity - 1) < 1e-12


def test_student_p():
    assert abs(graph.student_p(2.0, 10) - 0.07338803) < 1e-7
    assert abs(graph.student_p(0.5, 3) - 0.65145) < 1e-4 and graph.student_p(0.0, 5) == 1.0


def test_agreement_perfect(spark):
    d = spark.createDataFrame([(i % 3, (i % 3) + 10) for i in range(30)], "truth int, pred int")
    assert graph.cluster_agreement(d).first()[:] == pytest.approx((1.0, 1.0, 1.0))


def blobs(spark):
    r = random.Random(4)
    rows = [(1, i, [10.0 * (i % 3) + r.gauss(0, 0.1), r.gauss(0, 0.1)]) for i in range(60)] + [(1, 99, [500.0, 500.0])]
    return spark.createDataFrame(rows, "day int, id int, v array<double>")


@pytest.mark.parametrize("method", ["dbscan", "agglomerative", "optics"])
def test_density_methods_find_blobs(spark, method):
    d = blobs(spark)
    run = {"dbscan": lambda: clustering.dbscan(d, ["day"], 1.0), "agglomerative": lambda: clustering.agglomerative(d, ["day"], 5.0), "optics": lambda: clustering.optics(d, ["day"], 0.5)}[method]
    got = {r.id: r.cluster for r in run().collect()}
    assert all(len({got[i] for i in range(60) if i % 3 == k}) <= 2 for k in range(3))
    assert got[99] == -1 or list(got.values()).count(got[99]) == 1
    main = [max({got[i] for i in range(60) if i % 3 == k}, key=[got[i] for i in range(60) if i % 3 == k].count) for k in range(3)]
    assert len(set(main)) == 3


def test_organisation_capital_is_the_recursion(spark):
    x = [3.0, None, 5.0, 7.0]
    df = spark.createDataFrame([(1, t, v, 2.0, 1.0) for t, v in enumerate(x)], "gvkey int, fyear int, xsga double, cpi double, at double")
    got = [r.orgcap for r in extended_factors.organisation_capital(df, "gvkey", "fyear").orderBy("fyear").collect()]
    c, want = None, []
    for v in x:
        s = (v or 0.0) / 2
        c = s / 0.25 if c is None else c * 0.85 + s
        want.append(c)
    assert got == pytest.approx(want)


def test_delisting_and_ratings(spark):
    df = spark.createDataFrame([(0.1, None, 500, 1), (None, None, 520, 3), (0.1, -0.5, 100, 2), (0.1, None, None, 1), (None, -3.0, 1, 1), (None, None, 1, 1)], "r double, d double, c int, l int")
    got = [x[0] for x in df.select(extended_factors.delisting_return(*(F.col(c) for c in "rdcl"))).collect()]
    assert got[:5] == pytest.approx([0.1 - 0.35, -0.55, -0.4, 0.1, -1.0]) and got[5] is None
    r = spark.createDataFrame([("AAA",), ("D",), ("x",), (None,)], "r string").select(extended_factors.rating_number(F.col("r"))).collect()
    assert [x[0] for x in r] == [1, 22, 0, 0]


def test_nincr_streak(spark):
    ib = [1, 2, 3, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    names = firm_factors.QUARTERLY_INPUTS
    df = spark.createDataFrame([(1, day(90 * i), *([float(v)] * len(names))) for i, v in enumerate(ib)], "gvkey int, datadate date, " + ", ".join(f"{n} double" for n in names))
    got = [r.nincr for r in firm_factors.quarterly_layers().apply(df).orderBy("datadate").collect()]
    assert got == [0, 1, 2, 0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8]


def test_event_window_is_calendar_days(spark):
    daily = spark.createDataFrame([(1, day(i), 0.1) for i in (0, 1, 2, 5, 9)], "permno int, date date, ret double")
    ev = spark.createDataFrame([(1, day(1)), (1, day(1)), (1, day(7)), (2, day(1)), (1, None)], "permno int, rdq date")
    got = {r.rdq: (r.n_days, round(r.ear_ea, 6), r.valid_from) for r in daily_factors.event_window_factors(daily, ev).collect()}
    assert got == {day(1): (3, round(1.1**3 - 1, 6), day(5)), day(7): (1, 0.1, day(11))}


def test_bars_error():
    with pytest.raises(ValueError):
        daily_factors.bars_to_days(None, ["k"], "close", "median")


def test_universe(spark):
    df = spark.createDataFrame([(day(d), t, 1.0) for d in range(3) for t in "ab"], "date date, ticker string, v double")
    u = spark.createDataFrame([(day(0), "a", 1), (day(1), "b", 0)], "date date, ticker string, in_univ int")
    got = {(r.date, r.ticker): r.v for r in cross_section.universe_mask(df, u, ["v"]).collect()}
    assert got == {(day(0), "a"): 1.0, (day(0), "b"): None, (day(1), "a"): None, (day(1), "b"): None}
    late = u.withColumn("date", F.date_add("date", 100))
    assert cross_section.universe_mask(df, late, ["v"]).count() == 6
    assert cross_section.universe_members(df, u).count() == 1 + 0 + 2
    assert cross_section.useful_features(df.withColumn("n", F.lit(None).cast("double")).withColumn("t", F.day("date")), ["v", "n", "t"]) == ["t"]


def test_sources(spark, tmp_path):
    rows = [(1, D(2020 + i % 3, 1 + i % 12, 5), float(i)) for i in range(36)]
    df = spark.createDataFrame(rows, "permno int, date date, x double")
    path = str(tmp_path / "panel")
    sources.write_panel(df, path)
    assert sources.existing_years(spark, path) == {2020, 2021, 2022}
    assert sources.PartitionedSource(path).load(spark, D(2021, 1, 1), D(2021, 12, 31)).count() == 12
    built = []
    cache = str(tmp_path / "cache")
    build = lambda a, b: built.append((a, b)) or df
    assert sources.cached_years(spark, cache, [2020, 2021], build).count() == 24
    assert sources.cached_years(spark, cache, [2020, 2021, 2022], build).count() == 36 and built == [(2018, 2021), (2020, 2022)]
    a, b = str(tmp_path / "w/a"), str(tmp_path / "w/b")
    spark.createDataFrame([(day(0), 1.0)], "date date, t1 double").write.parquet(a)
    spark.createDataFrame([(day(1), 2.0, 3.0)], "date date, t1 double, t2 double").write.parquet(b)
    wide = sources.read_wide(spark, str(tmp_path / "w/*"), "close")
    assert sorted((r.date, r.ticker, r.close) for r in wide.collect() if r.close is not None) == [(day(0), "t1", 1.0), (day(1), "t1", 2.0), (day(1), "t2", 3.0)]
    assert sources.read_or_empty(spark, str(tmp_path / "none"), df.schema).count() == 0
    assert sources.key_ranges(1, 25, 10, 6) == [("000001", "000010"), ("000011", "000020"), ("000021", "000025")]
    assert len(sources.pull_predicates("date", D(2024, 1, 15), D(2024, 3, 2), "permno", sources.key_ranges(1, 20, 10))) == 6
    assert sources.derive_missing(spark.createDataFrame([(2.0, 1.0)], "ibq double, txtq double"), ["piq", "zzz"]).first()[2:] == (3.0, 0.0)
    assert sources.random_walks(spark, 10, 20, 2, shock=(0, 5, 9, 20.0)).count() == 200


def test_walkforward(spark):
    assert walkforward.year_windows(2010, 2016, 3, 2) == [(2010, 2012, 2013, 2014), (2012, 2014, 2015, 2016)]
    assert len(walkforward.grid({"a": [1, 2], "b": [1, 2, 3]})) == 6
    one = walkforward.run_grid(walkforward.grid({"a": [1, 2], "m": ["x"]}), lambda p: spark.range(1).select(F.lit(float(p["a"])).alias("sharpe")))
    assert walkforward.best_by(one, ["m"], "sharpe").first().a == 2


def test_stream_equals_table(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.select("user_id", "ts", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz, value double").parquet(str(tmp_path / "in"))
    q = tumbling_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    table = {tuple(r) for r in tumbling_bars(e).collect()}
    assert {tuple(r) for r in spark.table("bars").collect()} == table


def test_ple_and_vectors(spark):
    row = spark.range(1).select(C.encode_ple(F.lit(0.5), 8, -4.0, 4.0).alias("p"), C.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("s"), C.argmax(F.array(F.lit(1.0), F.lit(3.0))).alias("a"), C.zscore_vector(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("z")).first()
    assert row.p == [1, 1, 1, 1, 0.5, 0, 0, 0] and row.s == [0.5, 0.5] and row.a == 1 and row.z == pytest.approx([-1, 0, 1], abs=1e-6)


def test_graph_recovery(spark):
    truth, labels = dynamics.cluster_graph(spark, 12, 3)
    assert labels.count() == 12 and truth.where("w < 0").isEmpty()
    series = dynamics.simulate(truth, 12, 1500, noise=0.5)
    for lasso in (None, 1e-4):
        pred = dynamics.recover_graph(series, 0.01, lasso=lasso)
        row = dynamics.weight_errors(pred, truth).first()
        assert row.frobenius_share < 1.0
        assert graph.edge_scores(pred, truth.where("w > 0.5"), 12, 0.4).first().recall > 0.8
    report = dynamics.dynamics_report(truth, series, 0.01).first()
    assert report.verdict in ("green", "yellow", "red") and report.ic_mean > 0
    full = dynamics.recovery_report(spark, 12, 3, 800).first()
    assert 0 <= full.nmi <= 1 and full.tp + full.fp + full.fn + full.tn == 66


def test_losses(spark):
    d = spark.createDataFrame([(i, [float(i == k) for k in range(4)], [float(i == k) for k in range(4)]) for i in range(4)], "i int, a array<double>, b array<double>")
    assert dynamics.info_nce(d).first().loss < 0.01
    e = spark.createDataFrame([([0.5, 0.5],), ([0.5, 0.5],)], "share array<double>")
    assert dynamics.cluster_entropy(e).first().entropy == pytest.approx(math.log(2), abs=1e-6)
    walk = spark.createDataFrame([(1, t, 0.5**t) for t in range(20)], "i int, t int, f double")
    good, bad = (dynamics.mean_reversion_nll(walk, k, 0.1).first().nll for k in (math.log(2), 5.0))
    assert good < bad
    assert dynamics.augment(walk, ["f"], mask=1.0).agg(F.max("f")).first()[0] == 0.0


def test_edge_controller_and_age_gate(spark):
    e = graph.both_ways(spark.createDataFrame([(0, 1, 0.5), (0, 2, 2.0)], "i int, j int, w double"))
    f = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (0, 2, -100.0)], "t int, i int, f double")
    got = {r.i: r.pos for r in portfolio.edge_controller(e, f, 1.0).collect()}
    assert got == pytest.approx({0: 0.5 * math.tanh(1) - 2.0, 1: -0.5 * math.tanh(1), 2: 2.0})
    rows = [(1, t, p) for t, p in enumerate([0, 1, 1, 1, -1, -1, 1, 0, 0, 1])]
    d = portfolio.age_gate(spark.createDataFrame(rows, "e int, t int, pos int"), 2, "e", "t")
    assert [r.pos for r in d.orderBy("t").collect()] == [0, 1, 1, 0, -1, -1, 1, 0, 0, 1]


def test_join_helpers(spark):
    left = spark.createDataFrame([(1, day(10)), (1, day(200)), (2, day(10))], "k int, d date")
    right = spark.createDataFrame([(1, day(9), "a"), (1, day(20), "b")], "k int, r date, v string")
    assert sorted(x.v for x in joins.band_join(left, right, "k", "d", "r", -1, 3).collect()) == ["a"]
    got = {(x.k, x.d): x.v for x in joins.months_join(left, right.limit(1), "k", "d", "r", 6, 8).collect()}
    assert got == {(1, day(10)): None, (1, day(200)): "a", (2, day(10)): None}
    assert joins.without_overlap(right.withColumn("d", F.lit(1)), left, ["k"]).columns == ["k", "r", "v"]
    stitched = walkforward.stitch([left.withColumn("x", F.lit(1)), left.limit(1).withColumn("x", F.lit(2))], ["k", "d"])
    assert sorted(x.x for x in stitched.collect()) == [1, 1, 2]


def walks(n=4, steps=120, seed=5):
    import numpy as np

    rng = np.random.default_rng(seed)
    f = rng.normal(size=(steps, n))
    f[1:, 1] += 0.8 * f[:-1, 0]  # 0 leads 1
    f[:, 2] = np.cumsum(f[:, 2])  # a unit root
    f[:, 3] = f[:, 0] + 0.1 * f[:, 3]
    return f


def series_of(spark, f):
    return spark.createDataFrame([(t, i, float(f[t, i])) for t in range(f.shape[0]) for i in range(f.shape[1])], "t int, i int, f double")


def test_granger_unit_root_and_modes(spark):
    import numpy as np

    f = walks()
    s = series_of(spark, f)
    pairs = spark.createDataFrame([(0, 1), (1, 0)], "i int, j int")
    got = {(r.i, r.j): r for r in graph.granger(s, pairs).collect()}
    y, x = f[:, 1], f[:, 0]
    own = np.column_stack([np.ones(119), y[:-1]])
    full = np.column_stack([own, x[:-1]])
    rss = [((y[1:] - m @ np.linalg.lstsq(m, y[1:], rcond=None)[0]) ** 2).sum() for m in (own, full)]
    assert got[0, 1].f_stat == pytest.approx((rss[0] - rss[1]) / (rss[1] / 116))
    assert got[0, 1].p < 1e-6 and got[1, 0].p > 0.001
    adf = {r.i: r.adf for r in graph.dickey_fuller(s).collect()}
    assert adf[2] > -2.86 and adf[0] < -2.86
    two = graph.granger(s, pairs, 2).where("i = 0").first()
    full2 = np.column_stack([np.ones(118), y[1:-1], y[:-2], x[1:-1], x[:-2]])
    rss2 = [((y[2:] - m @ np.linalg.lstsq(m, y[2:], rcond=None)[0]) ** 2).sum() for m in (full2[:, :3], full2)]
    assert two.f_stat == pytest.approx((rss2[0] - rss2[1]) / 2 / (rss2[1] / 113)) and 0 <= two.p < 1e-6
    assert {(r.i, r.j) for r in graph.granger_graph(s, pairs, 3, 1e-4).collect()} == {(0, 1)}
    p = {r.i: r.p for r in graph.dickey_fuller(s).collect()}
    assert p[0] < 0.05 < p[2]
    values = np.linalg.eigvalsh(np.cov(f.T))[::-1]
    assert [v for _, v in modes.covariance_modes(s, 3)[0]] == pytest.approx(list(values[:3] / values.sum()))


def test_graph_stability(spark):
    import numpy as np

    f = walks(steps=60)
    got = {r.start: (r.jaccard, r.cosine) for r in graph.stability(series_of(spark, f), 20, 10, 0.1).collect()}
    edges = {}
    for start in range(0, 40, 10):
        c = np.abs(np.corrcoef(f[start : start + 20].T))
        edges[start] = {(i, j): c[i, j] for i in range(4) for j in range(i + 1, 4) if c[i, j] > 0.1}
    for start in (10, 20, 30):
        a, b = edges[start], edges[start - 10]
        both, either = set(a) & set(b), set(a) | set(b)
        cosine = sum(a[k] * b[k] for k in both) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        assert got[start] == pytest.approx((len(both) / len(either), cosine))


def test_price_delay(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    r = rng.normal(0, 0.02, (80, 5))
    df = spark.createDataFrame([(i, day(7 * t), float(r[t, i])) for t in range(80) for i in range(5)], "permno int, week date, wkret double")
    got = {x.permno: x.pricedelay for x in extended_factors.price_delay(df).collect()}
    m = r.mean(axis=1)
    lagged = np.column_stack([m[4 - k : 80 - k] for k in range(5)])
    for i in range(5):
        y, adj = r[4:, i], []
        for x in (lagged[:, :1], lagged):
            X = np.column_stack([np.ones(76), x])
            e = y - X @ np.linalg.lstsq(X, y, rcond=None)[0]
            adj.append(1 - (e @ e) / ((y - y.mean()) ** 2).sum() * 75 / (76 - X.shape[1]))
        assert got[i] == pytest.approx(1 - adj[0] / adj[1], rel=1e-6)


def test_intraday_against_pandas(spark):
    r = random.Random(7)
    rows, price = [], 100.0
    for i in range(60):
        price *= 1 + r.gauss(0, 0.01)
        rows.append((1, i, price * 0.999, price * 1.01, price * 0.99, price, float(r.randrange(1, 50))))
    df = spark.createDataFrame(rows, "k int, ts int, open double, high double, low double, close double, volume double")
    got = daily_factors.intraday_features(df, ["k"]).first()
    p = df.toPandas()
    ret = p["close"].pct_change().dropna()
    assert got.realized_kurtosis == pytest.approx(ret.kurtosis()) and got.realized_skew == pytest.approx(ret.skew())
    assert got.price_vol_corr == pytest.approx(ret.corr(p["volume"].iloc[1:])) and got.autocorr_1min == pytest.approx(ret.autocorr(1))
    import numpy as np

    rs = np.log(p.high / p.close) * np.log(p.high / p.open) + np.log(p.low / p.close) * np.log(p.low / p.open)
    assert got.rogers_satchell_vol == pytest.approx(math.sqrt(rs.mean()))
    grown = (1 + ret).cumprod()
    assert got.intraday_max_drawdown == pytest.approx((grown / grown.cummax() - 1).min())


def test_p_values():
    # With two and two, or one and any, degrees of freedom the shares have closed forms.
    for f in (0.1, 1.0, 3.7, 40.0):
        assert graph.f_p(f, 2, 2) == pytest.approx(1 / (1 + f))
        assert graph.f_p(f, 1, 17) == pytest.approx(graph.student_p(math.sqrt(f), 17))
        assert graph.f_p(f, 2, 10) == pytest.approx((1 + f / 5) ** -5)
    # Published critical values of the test with a constant.
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert graph.dickey_fuller_p(t) == pytest.approx(p, abs=0.002)
    assert graph.dickey_fuller_p(-30.0) == 0 and graph.dickey_fuller_p(5.0) == 1
    assert math.isnan(graph.dickey_fuller_p(math.nan))


def test_warehouse_pull(spark):
    """Statements with their company over JDBC, a task for each month and key range."""
    url = "jdbc:derby:memory:tessera;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(f"{g:06d}", D(2020, m, 15), float(g * m), "STD" if g % 2 else "OTH") for g in range(1, 8) for m in (1, 2, 3)]
    spark.createDataFrame(rows, "GVKEY string, DATADATE date, SALE double, DATAFMT string").write.option("createTableColumnTypes", "GVKEY VARCHAR(6), DATAFMT VARCHAR(3)").jdbc(url, "FUNDA", "overwrite", driver)
    spark.createDataFrame([(f"{g:06d}", str(2000 + g), "1111") for g in range(1, 6)], "GVKEY string, SIC string, NAICS string").write.option("createTableColumnTypes", "GVKEY VARCHAR(6), SIC VARCHAR(4), NAICS VARCHAR(6)").jdbc(url, "COMPANY", "overwrite", driver)
    query = sources.statement_query("FUNDA", ["GVKEY", "DATADATE", "SALE"], "COMPANY", {"DATAFMT": "STD"})
    whole = sources.pull(spark, url, query, None, driver)
    want = {(r[0], r[1], r[2], str(2000 + int(r[0])) if int(r[0]) < 6 else None) for r in rows if r[3] == "STD"}
    assert {(r.GVKEY, r.DATADATE, r.SALE, r.SIC) for r in whole.collect()} == want
    # Derby takes a day as text rather than as a literal.
    parts = [p.replace("DATE '", "'") for p in sources.pull_predicates("DATADATE", D(2020, 1, 10), D(2020, 2, 29), "GVKEY", sources.key_ranges(1, 7, 4, 6), True)]
    pulled = sources.pull(spark, url, query, parts, driver)
    assert pulled.rdd.getNumPartitions() == len(parts) == 4
    assert {(r.GVKEY, r.DATADATE, r.SALE, r.SIC) for r in pulled.collect()} == {w for w in want if w[1] < D(2020, 3, 1)}


def test_files(spark, tmp_path):
    long = spark.createDataFrame([(day(0), "A", 1.0), (day(0), "B", 2.0), (day(1), "A", 3.0)], "date date, ticker string, close double")
    sources.write_wide(long, f"{tmp_path}/wide/close", "close", ["A", "B"])
    back = {(r.date, r.ticker): r.close for r in sources.read_wide(spark, f"{tmp_path}/wide/close", "close").collect()}
    assert back == {(day(0), "A"): 1.0, (day(0), "B"): 2.0, (day(1), "A"): 3.0, (day(1), "B"): None}
    long.write.parquet(f"{tmp_path}/wide/open")
    assert sources.list_variables(spark, f"{tmp_path}/wide") == ["close", "open"]
    assert sources.list_variables(spark, f"{tmp_path}/none") == []
    assert sources.describe(long, "date").first() == (3, day(0), day(1))

    for year in (2019, 2020):
        pd.DataFrame({"x": [year]}).to_parquet(tmp_path / f"panel_{year}_v2.parquet")
    (tmp_path / "years").mkdir()
    for year in (2019, 2020):
        (tmp_path / f"panel_{year}_v2.parquet").rename(tmp_path / "years" / f"panel_{year}_v2.parquet")
    pd.DataFrame({"x": [0]}).to_parquet(tmp_path / "years" / "panel.parquet")
    assert {(r.x, r.file_year) for r in sources.with_file_year(spark, f"{tmp_path}/years").collect()} == {(2019, 2019), (2020, 2020), (0, None)}

    (tmp_path / "days.csv").write_text("date\n2024-01-03\nnone\n2024-01-02\n2024-01-03\n")
    assert [r.date for r in sources.read_calendar(spark, f"{tmp_path}/days.csv").collect()] == [day(1), day(2)]
    sources.write_results(long, f"{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 1
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 3


def test_feature_columns(spark):
    d = spark.createDataFrame([(1, "a", 1.0, 2, 3.0)], "permno int, name string, x double, n int, x_y double")
    assert C.feature_columns(d, {"permno"}) == ["x", "n"]


def test_bounded_nodes(spark):
    with pytest.raises(ValueError, match="more than 3 nodes"):
        dynamics.recover_graph(series_of(spark, walks()), 0.01, most=3)


def test_samples_and_batches(spark):
    d = spark.range(50).select("id", F.lit(day(0)).alias("date")).unionAll(spark.range(7).select("id", F.lit(day(40)).alias("date")))
    got = cross_section.monthly_batches(d, 16, "id").groupBy("month", "batch").count().collect()
    assert sorted((r.month.month, r.batch, r["count"]) for r in got) == [(1, 0, 16), (1, 1, 16), (1, 2, 16), (1, 3, 2), (2, 0, 7)]
    some = [r.id for r in cross_section.sample_rows(spark.range(50), 10, "id").collect()]
    assert len(set(some)) == 10 and some == [r.id for r in cross_section.sample_rows(spark.range(50).repartition(7), 10, "id").collect()]
    assert cross_section.sample_rows(spark.range(5), 10, "id").count() == 5
    assert cross_section.sample_rows(spark.range(0), 10, "id").count() == 0


def test_markdown_and_missing_inputs(spark):
    d = spark.createDataFrame([("a|b", 1, 0.5), ("c", None, None)], "name string, n int, x double")
    assert sources.markdown_table(d, digits=2) == "| name | n | x |\n| - | - | - |\n| a\\|b | 1 | 0.50 |\n| c |  |  |"
    q = spark.createDataFrame([(2.0, 5.0)], "ibq double, ltq double")
    assert sources.derive_missing(q, ["niq", "dlttq", "ibq"]).first().asDict() == {"ibq": 2.0, "ltq": 5.0, "niq": 2.0, "dlttq": 0.0}
    assert sources.derive_missing(q, ["niq", "dlttq", "other"], None).first().asDict() == {"ibq": 2.0, "ltq": 5.0, "niq": 2.0, "dlttq": None, "other": None}
