"""Fitted models against dense or brute-force versions on hand-made rows."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clustering, components, dynamics, extended_factors, graph, hierarchy, modes, neighbours, portfolio, training, window_models
from tessera.plans import model_queries
from tessera.sources import panels as sources
from tessera.sources.shared import Rounds


def month(i):
    return dt.date(2020 + i // 12, i % 12 + 1, 1)


# Models of many windows.
def snapshots(seed, windows=4, n=40, dims=6):
    r = np.random.default_rng(seed)
    rows = []
    for w in range(windows):
        centres = r.normal(0, 6, (3, dims))
        for i in range(n):
            rows.append((w, i, (centres[i % 3] + r.normal(0, 1, dims)).tolist()))
    return rows


def test_standardised_components(spark):
    rows = snapshots(1)
    df = spark.createDataFrame(rows, "w int, id int, v array<double>").repartition(5)
    z = window_models.standardise(df, window_models.moments(df, ["w"]), ["w"])
    fitted = window_models.components(z, ["w"], 3)
    scores = {(r.w, r.id): r.v for r in window_models.project(z, fitted, ["w"]).collect()}
    for r in fitted.collect():
        x = np.array([v for w, _, v in rows if w == r.w])
        x = (x - x.mean(axis=0)) / x.std(axis=0)
        values, vectors = np.linalg.eigh(x.T @ x)
        assert r.explained == pytest.approx((values[::-1] / values.sum())[:3])
        for k, axis in enumerate(r.axes):
            assert max(axis, key=abs) > 0 and abs(np.dot(axis, vectors[:, -1 - k])) == pytest.approx(1)
        ids = [i for w, i, _ in rows if w == r.w]
        assert np.allclose([scores[r.w, i] for i in ids], x @ np.array(r.axes).T)


def plain_kmeans(x, centres, steps=60):
    for _ in range(steps):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(centres)])
    return centres, ((x - centres[near]) ** 2).sum(), near


def test_kmeans_of_all_windows(spark):
    rows = snapshots(2) + [(9, 0, [1.0] * 6), (9, 1, [2.0] * 6)]
    df = spark.createDataFrame(rows, "w int, id int, v array<double>").repartition(4)
    starts = window_models.first_centres(df, ["w"], 3, 5, 7).collect()
    fitted = window_models.fit_kmeans(df, ["w"], 3, 5, 7, rounds=20, tolerance=0.0)
    model = {}
    for r in fitted.collect():
        model.setdefault(r.w, {})[r.cluster] = (r.centre, r.loss)
    labels = {(r.w, r.id): r.cluster for r in window_models.assign(df, fitted.drop("loss"), ["w"]).collect()}
    for w in range(4):
        x = np.array([v for a, _, v in rows if a == w])
        runs = []
        for s in range(5):
            first = sorted((r.cluster, r.centre) for r in starts if r.w == w and r.start == s)
            assert len(first) == 3
            runs.append(plain_kmeans(x, np.array([c for _, c in first])))
        centres, loss, near = min(runs, key=lambda t: round(t[1], 9))
        assert model[w][0][1] == pytest.approx(loss)
        assert np.allclose([model[w][k][0] for k in range(3)], centres)
        assert [labels[w, i] for i in range(40)] == near.tolist()
    assert len(model[9]) == 2 and model[9][0][1] == pytest.approx(0)


def test_model_rows_are_kept_by_loss(spark):
    a = spark.createDataFrame([(1, 0, [0.0], 5.0), (1, 1, [1.0], 5.0), (2, 0, [2.0], 1.0)], "w int, cluster int, centre array<double>, loss double")
    b = spark.createDataFrame([(1, 0, [9.0], 3.0), (2, 0, [8.0], 1.0), (3, 0, [7.0], 4.0)], "w int, cluster int, centre array<double>, loss double")
    got = sorted((r.w, r.cluster, r.centre[0]) for r in window_models.keep_best(a, b, ["w"]).collect())
    assert got == [(1, 0, 9.0), (2, 0, 2.0), (3, 0, 7.0)]


def test_jobs_do_not_grow_with_windows(spark):
    def jobs(windows):
        spark.sparkContext.setJobGroup(f"w{windows}", "")
        df = spark.createDataFrame(snapshots(3, windows, 12), "w int, id int, v array<double>")
        window_models.fit_kmeans(df, ["w"], 3, 2, rounds=1).count()
        out = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"w{windows}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out

    assert jobs(12) <= jobs(2) + 2


def test_labels_come_from_the_past(spark):
    """A month's clusters and trades do not see the month itself or anything after it."""
    r = random.Random(4)
    price = [(i, month(t), 100 * math.exp(r.gauss(0, 0.1))) for i in range(12) for t in range(20)]

    def run(change):
        rows = [(i, d, p * (3 if change and d >= month(17) and i % 2 else 1)) for i, d, p in price]
        df = spark.createDataFrame(rows, "id int, date date, x double")
        snap = df.select(F.add_months("date", 1).alias("month"), "id", F.array("x", F.col("x") * F.col("x"), F.col("x") % 7).alias("v"))
        return {(x.month, x.id): x.cluster for x in window_models.window_clusters(snap, ["month"], 2, 2, 2, 5).collect()}

    a, b = run(False), run(True)
    assert {k: v for k, v in a.items() if k[0] <= month(17)} == {k: v for k, v in b.items() if k[0] <= month(17)} and len(a) == 240
    assert a != b
    panel = spark.createDataFrame([(i, d, p / 100 - 1) for i, d, p in price], "permno int, date date, ret double")
    labels = spark.createDataFrame([(m, i, c) for (m, i), c in a.items()], "month date, id int, cluster int")
    out = model_queries.fitted_returns(panel, labels).collect()
    assert len({x.date for x in out}) == len(out) and min(x.date for x in out) == month(1)


# Neighbours.
def cloud(seed, n=300, dims=4, groups=6):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 20, (groups, dims))
    x = centres[r.integers(0, groups, n)] + r.normal(0, 1, (n, dims))
    x[5:25] = x[5]  # copies
    return x.round(3)


@pytest.mark.parametrize(("slice_", "visitors", "pivots"), [(512, 2048, 64), (7, 5, 6), (1, 3, 1)])
def test_nearest_is_exact(spark, monkeypatch, slice_, visitors, pivots):
    for name, value in (("SLICE", slice_), ("VISITORS", visitors), ("PIVOTS", pivots)):
        monkeypatch.setattr(neighbours, name, value)
    n = 300 if slice_ > 1 else 60
    x = cloud(1, n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [1.0, None, 1.0, 1.0])], "id int, v array<double>").repartition(3)
    got = {r.id: r.dist for r in clustering.knn_distance(df, 4).collect()}
    dist = np.sort(neighbours.l1_matrix(x, x), axis=1)[:, 4]
    assert got == pytest.approx(dict(enumerate(dist)))


def test_few_pairs_are_compared(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE", 50)
    x = cloud(2, 3000, 4, 40)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    space = neighbours.Space(df, [], Rounds(spark))
    radius = space.nearest(5).select("id", F.col("dist").alias("radius"))
    held = space.rows.groupBy("slice").agg(F.count("*").alias("n"))
    pairs = space.visits(radius, True).join(held, "slice").agg(F.sum("n")).first()[0]
    assert pairs < 0.15 * 3000**2
    assert clustering.knn_distance(df.limit(3), 5).where("dist is not null").count() == 0


def plain_dbscan(x, eps, k):
    near = neighbours.l1_matrix(x, x) <= eps
    core = near.sum(axis=1) >= k
    label, now = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], now
            while todo:
                p = todo.pop()
                for q in np.flatnonzero(near[p] & (label < 0)):
                    label[q] = now
                    if core[q]:
                        todo.append(q)
            now += 1
    return label.tolist()


@pytest.mark.parametrize("small", [False, True])
def test_density_clusters_across_tasks(spark, monkeypatch, small):
    if small:
        for name, value in (("SLICE", 9), ("VISITORS", 6), ("PIVOTS", 5)):
            monkeypatch.setattr(neighbours, name, value)
    days = {"a": cloud(3, 150, 3), "b": cloud(4, 90, 3, 3), "c": np.array([[1.0, 2, 3], [1, 2, 4]])}
    r = np.random.default_rng(6)
    days["d"] = r.uniform(0, 12, (120, 2)).round(2) @ np.array([[1.0, 0, 0], [0, 1, 0]])
    df = spark.createDataFrame([(d, i, v.tolist()) for d, x in days.items() for i, v in enumerate(x)], "day string, id int, v array<double>").repartition(3)
    got = {}
    for x in clustering.dbscan(df, ["day"], 1.6).collect():
        got.setdefault(x.day, {})[x.id] = x.cluster
    for d, x in days.items():
        assert [got[d][i] for i in range(len(x))] == plain_dbscan(x, 1.6, clustering.min_points(len(x))), d
    assert len(set(got["d"].values())) > 3
    free = {}
    for x in clustering.dbscan(df, ["day"]).collect():
        free.setdefault(x.day, {})[x.id] = x.cluster
    for d, x in days.items():
        k = clustering.min_points(len(x))
        eps = float(np.quantile(np.sort(neighbours.l1_matrix(x, x), axis=1)[:, min(k, len(x) - 1)], 0.5))
        assert [free[d][i] for i in range(len(x))] == plain_dbscan(x, eps, k), d


def test_components_of_structs(spark):
    edges = spark.createDataFrame([(("a", 1), ("a", 2)), (("a", 2), ("a", 3)), (("b", 1), ("b", 2)), (("b", 9), ("b", 9))], "a struct<d:string,i:int>, b struct<d:string,i:int>")
    got = {tuple(r.node): tuple(r.root) for r in components.connected(edges, Rounds(spark)).collect()}
    assert got == {("a", 1): ("a", 1), ("a", 2): ("a", 1), ("a", 3): ("a", 1), ("b", 1): ("b", 1), ("b", 2): ("b", 1)}


# Hierarchies.
def plain_areas(r, xi, least):
    """All maximal steep areas by their definition."""
    n = len(r) - 1
    out = []
    for down in (True, False):
        steep = [not (math.isinf(r[i]) and math.isinf(r[i + 1])) and (r[i] * (1 - xi) >= r[i + 1] if down else r[i] <= r[i + 1] * (1 - xi)) for i in range(n)]

        def fits(a, b):
            if not (steep[a] and steep[b]):
                return False
            if any((r[i] < r[i + 1]) if down else (r[i] > r[i + 1]) for i in range(a, b)):
                return False
            idle = 0
            for i in range(a, b + 1):
                idle = 0 if steep[i] else idle + 1
                if idle > least:
                    return False
            return True

        at = 0
        while at < n:
            ends = [b for b in range(at, n) if fits(at, b)]
            if ends:
                out.append((down, at, max(ends)))
                at = max(ends) + 1
            else:
                at += 1
    return sorted(out, key=lambda x: x[1])


def plain_clusters(r, xi, least):
    """Every pair of a downward and a later upward area by the conditions, without a sweep."""
    r = np.append(r, np.inf)
    areas, out = plain_areas(r, xi, least), set()
    for down, a, b in areas:
        for other, c, d in areas:
            if not down or other or c <= b:
                continue
            begin, end = r[a], r[d + 1]
            if max(r[b + 1 : c + 1]) > min(begin, end) * (1 - xi):
                continue
            first, last = a, d
            if begin * (1 - xi) >= end:
                first = max((x for x in range(a, b + 1) if r[x] > end), default=a)
            elif end * (1 - xi) >= begin:
                last = max(x for x in range(c, d + 1) if r[x] < begin)
            if last - first + 1 >= least:
                out.add((first, last))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_xi_clusters_by_definition(seed):
    r = random.Random(seed)
    reach = [math.inf] + [r.choice([1.0, 1.04, 1.1, 2.0, 2.5, 4.0, 7.0, 7.2]) for _ in range(r.randrange(5, 60))]
    if seed % 3 == 0:
        reach[r.randrange(1, len(reach))] = math.inf
    n = len(reach)
    least, xi = r.choice([2, 3, 5]), r.choice([0.05, 0.3])
    # Each row reached from the one before it: no correction at the end.
    got = hierarchy.xi_clusters(np.arange(n), np.array(reach), np.arange(n) - 1, least, xi)
    assert set(got) == plain_clusters(np.array(reach), xi, least)


def test_nested_clusters():
    reach = np.array([np.inf, 1, 1, 1, 5, 1, 1, 1, 20, 2, 2, 2, 2])
    got = hierarchy.xi_clusters(np.arange(13), reach, np.arange(13) - 1, 3, 0.3)
    assert set(got) == {(0, 3), (4, 7), (0, 7), (8, 12), (0, 12)} or {(0, 3), (4, 7), (0, 7), (8, 12)} <= set(got)
    assert hierarchy.leaf_labels(np.arange(13), got).tolist() == [0] * 4 + [1] * 4 + [2] * 5
    # The end of a cluster that was reached from outside it goes, unless its beginning is higher.
    r, order = np.array([9.0, 2, 1, 1, 2.5]), np.arange(5)
    assert hierarchy._corrected(r, order, np.array([-1, 0, 1, 2, 0]), 1, 4) == (1, 3)
    assert hierarchy._corrected(r, order, np.array([-1, 0, 1, 2, 2]), 1, 4) == (1, 4)
    assert hierarchy._corrected(r, order, np.array([-1, 0, 0, 0, 0]), 0, 4) == (0, 4)
    assert hierarchy._corrected(np.array([1.0, 2, 2]), np.arange(3), np.array([-1, -1, -1]), 0, 2) is None


def test_optics_finds_nested_density(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(0, 0.1, (30, 2)), r.normal(1.5, 0.1, (30, 2)), r.normal(20, 0.5, (30, 2)), r.uniform(-60, 60, (6, 2))])
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "day int, id int, v array<double>")
    label = [y.cluster for y in clustering.optics(df, ["day"], 0.7).orderBy("id").collect()]
    for a in (0, 30, 60):
        most = max(set(label[a : a + 30]) - {-1}, key=label[a : a + 30].count)
        assert label[a : a + 30].count(most) >= 15 and most not in label[:a] + label[a + 30 :]


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage(seed):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (25, 3))
    d = neighbours.l1_matrix(x, x)
    groups = {i: [i] for i in range(25)}
    heights = []
    while len(groups) > 1:
        keys = sorted(groups)
        h, a, b = min((d[np.ix_(groups[a], groups[b])].mean(), a, b) for a in keys for b in keys if a < b)
        heights.append(h)
        groups[a] = groups[a] + groups.pop(b)
    merges = hierarchy.average_linkage(d)
    assert [h for *_, h in merges] == pytest.approx(heights)
    for threshold in (0.5, 1.5, 2.5):
        label = hierarchy.cut_tree(25, merges, threshold)
        groups = {i: [i] for i in range(25)}
        while len(groups) > 1:
            h, a, b = min((d[np.ix_(groups[a], groups[b])].mean(), a, b) for a in groups for b in groups if a < b)
            if h >= threshold:
                break
            groups[a] = groups[a] + groups.pop(b)
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label)} == {frozenset(g) for g in groups.values()}


# Modes.
def test_covariance_modes_beyond_a_matrix(spark):
    r = np.random.default_rng(8)
    f = r.normal(size=(90, 5)) @ (r.normal(size=(5, 400)) * np.array([9.0, 6, 4, 3, 2])[:, None]) + r.normal(size=(90, 400))
    series = spark.createDataFrame([(t, i, float(f[t, i])) for t in range(90) for i in range(400)], "t int, i int, f double")
    shares, loadings = modes.covariance_modes(series, 5)
    values, vectors = np.linalg.eigh(np.cov(f.T))
    assert [v for _, v in shares] == pytest.approx((values[::-1] / values.sum())[:5], abs=1e-6)
    z = np.array([x.z for x in loadings.orderBy("node").collect()])
    assert np.abs((z * vectors[:, ::-1][:, :5]).sum(axis=0)) == pytest.approx(np.ones(5), abs=1e-6)


def planted(seed, n=300, k=4, inside=0.12, between=0.01):
    r = np.random.default_rng(seed)
    truth = np.arange(n) % k
    draw = np.triu(r.random((n, n)) < np.where(truth[:, None] == truth[None], inside, between), 1)
    return truth, [(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(draw))]


def test_spectral_embedding(spark):
    truth, edges = planted(9)
    df = spark.createDataFrame(edges, "i int, j int, w double")
    values, points = modes.spectral_embedding(df, 4)
    a = np.full((300, 300), 1e-6)
    for i, j, w in edges:
        a[i, j] += w
        a[j, i] += w
    root = np.sqrt(a.sum(axis=1))
    exact, vectors = np.linalg.eigh(a / root[:, None] / root[None])
    assert values == pytest.approx(exact[::-1][:4], abs=1e-8)
    z = np.array([x.z for x in points.orderBy("node").collect()]) * root[:, None]
    want = vectors[:, ::-1][:, :4]
    want = want * np.sign(want[np.abs(want).argmax(axis=0), range(4)])
    assert np.abs(z - want).max() < 1e-6
    pred = modes.spectral_clusters(df, 4)
    pairs = pred.join(spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "i int, truth int"), "i")
    assert graph.cluster_agreement(pairs.select("truth", "pred")).first().nmi > 0.95


def test_spectral_clusters_of_parts(spark):
    """Separate parts, which have equal eigenvalues."""
    edges = [(a + i, a + j, 1.0) for a in (0, 10, 20) for i in range(5) for j in range(i)]
    got = {x.i: x.pred for x in modes.spectral_clusters(spark.createDataFrame(edges, "i int, j int, w double"), 3).collect()}
    assert len({tuple(sorted(i for i, p in got.items() if p == k)) for k in set(got.values())}) == 3
    assert all(got[a] == got[a + i] for a in (0, 10, 20) for i in range(5))


# Paths and factors.
def test_backtest_goes_on_from_batch_to_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(10)
        rows = [(p, t, [r.uniform(-1, 1)], [r.uniform(-0.1, 0.1)]) for p in ("a", "b", "c") for t in range(25)]
        df = spark.createDataFrame(rows, "pf string, t int, weights array<double>, rets array<double>").repartition(5)
        got = {(x.pf, x.t): (x.step, x.equity, x.turnover) for x in portfolio.sequential_backtest(df, 10.0, "pf", "t").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p in ("a", "b", "c"):
        equity, held = 1.0, 0.0
        for q, t, w, ret in rows:
            if q == p:
                target = w[0] * equity
                traded = abs(target - held)
                equity += -traded * 0.001 + target * ret[0]
                held = target * (1 + ret[0])
                assert got[p, t] == (t, pytest.approx(equity), pytest.approx(traded))


def test_calendar_beta_window(spark):
    """Weeks from the first day of the month 36 back to the first day of the month before."""
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=7 * k) for k in range(180)]
    r = random.Random(11)
    rows = [(i, d, r.gauss(0, 0.02)) for i in range(4) for d in days]
    weekly = spark.createDataFrame(rows, "permno int, week date, wkret double")
    asked = [dt.date(2023, 1, 1), dt.date(2023, 5, 1), dt.date(2021, 2, 1)]
    months = spark.createDataFrame([(i, d) for i in range(4) for d in asked], "permno int, date date")
    got = {(x.permno, x.date): x for x in extended_factors.calendar_beta(weekly, months).collect()}
    market = {d: np.mean([x for _, w, x in rows if w == d]) for d in days}
    for i in range(4):
        for d in asked:
            low = dt.date(d.year - 3, d.month, 1)
            high = (d - dt.timedelta(days=1)).replace(day=1)
            y = [(x, market[w]) for p, w, x in rows if p == i and low <= w <= high]
            if len(y) < 52:
                assert (i, d) not in got
                continue
            a, b = np.array(y).T
            slope, level = np.polyfit(b, a, 1)
            assert got[i, d].n_weeks == len(y) and got[i, d].beta == pytest.approx(slope)
            assert got[i, d].idiovol == pytest.approx(math.sqrt(((a - slope * b - level) ** 2).sum() / (len(y) - 2)))


def test_cointegrated_prices(spark):
    d = sources.cointegrated_prices(spark, 2, 3, 400, shock=(1, 100, 110, 50.0)).toPandas()
    wide = d.pivot(index="t", columns="entity", values="price")
    assert wide.shape == (400, 6) and sorted(d[d.cluster == 1].entity.unique()) == [1, 3, 5]
    gap = (wide[0] - wide[2]).to_numpy()
    assert abs(gap).max() < 12 and np.corrcoef(gap[1:], gap[:-1])[0, 1] < 0.97
    assert (wide[1] - wide[3]).loc[100:110].mean() > 40 and abs((wide[1] - wide[3]).loc[150:]).max() < 12
    again = sources.cointegrated_prices(spark, 2, 3, 400, shock=(1, 100, 110, 50.0)).repartition(3).toPandas()
    assert again.sort_values(["entity", "t"]).price.tolist() == d.sort_values(["entity", "t"]).price.tolist()


@pytest.mark.parametrize("lasso", [None, 0.02])
def test_regressions_in_tasks(spark, monkeypatch, lasso):
    """The same edges as from one dense matrix, with the nodes spread over several tasks."""
    monkeypatch.setattr(dynamics, "TARGETS", 3)
    f = np.cumsum(np.random.default_rng(15).normal(size=(120, 8)), axis=0) / 5
    series = spark.createDataFrame([(t, i, float(f[t, i])) for t in range(120) for i in range(8)], "t int, i int, f double")
    got = {(x.i, x.j): x.w for x in dynamics.recover_graph(series, 0.5, lasso=lasso).collect()}
    x, v = f[:-1], np.diff(f, axis=0) / 0.5
    gram, cross = x.T @ x, x.T @ v
    if lasso is None:
        coef = np.linalg.solve(gram + 1e-6 * np.eye(8), cross)
    else:
        coef = np.zeros((8, 8))
        for k in range(8):
            for _ in range(3000):
                for d in range(8):
                    rho = cross[d, k] - gram[d] @ coef[:, k] + gram[d, d] * coef[d, k]
                    coef[d, k] = np.sign(rho) * max(abs(rho) - lasso * 119, 0) / gram[d, d]
    w = (coef + coef.T) / 2
    want = {(i, j): w[i, j] for i in range(8) for j in range(i + 1, 8) if w[i, j] > 1e-9}
    assert {k: v for k, v in got.items() if v > 1e-9} == pytest.approx(want, abs=1e-6)


# Training.
def system(seed, n=9, times=14, dims=4):
    r = np.random.default_rng(seed)
    rows = []
    for t in range(times):
        for i in range(n):
            if r.random() < 0.9:
                x = r.normal(size=dims)
                rows.append((t + 3, i, (x / np.linalg.norm(x)).tolist(), float(r.normal(0, 1.5)), float(r.normal(0, 0.03))))
    return rows


SYSTEM = training.Settings(entry=0.5, stop=2.5, similarity=0.2, temperature=0.3, scale=2.0, most_leverage=0.2, turnover_penalty=0.1)


def plain_loss(rows, centres, s):
    """The objective written out for the whole history at once."""
    w = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    net, turns, excess, before = [], [], [], {}
    for t in sorted({r[0] for r in rows}):
        now = [r for r in rows if r[0] == t]
        x, z = np.array([r[2] for r in now]), np.array([r[3] for r in now])
        sim = x @ w.T
        gate = 1 / (1 + np.exp(-20 * (sim.max(axis=1) - s.similarity)))
        a = np.exp(sim / s.temperature)
        a /= a.sum(axis=1, keepdims=True)
        g = a * gate[:, None]
        signal = z - a @ ((g * z[:, None]).sum(axis=0) / (g.sum(axis=0) + 1e-6))
        band = 1 / (1 + np.exp(-s.scale * (np.abs(signal) - s.entry))) * (1 - 1 / (1 + np.exp(-s.scale * (np.abs(signal) - s.stop))))
        weights = dict(zip([r[1] for r in now], -0.1 * np.tanh(s.scale * signal) * band * gate))
        turn = sum(abs(weights.get(i, 0) - before.get(i, 0)) for i in {*weights, *before})
        net.append(sum(weights[r[1]] * r[4] for r in now) - s.cost * turn)
        turns.append(turn)
        excess.append(max(sum(map(abs, weights.values())) - s.most_leverage, 0) ** 2)
        before = weights
    return -np.mean(net) / (np.std(net, ddof=1) + 1e-6) + s.turnover_penalty * np.mean(turns) + s.leverage_penalty * np.mean(excess)


def test_gradient_of_the_system(spark):
    rows = system(12)
    df = spark.createDataFrame(rows, "t int, i int, x array<double>, z double, ret double").repartition(3)
    centres = np.random.default_rng(13).normal(size=(3, 4))
    for length in (4, 100):
        blocks = training.time_blocks(df, length, Rounds(spark))
        loss, slope = training.objective(training.sums_of(blocks, centres, SYSTEM), centres, SYSTEM)
        assert loss == pytest.approx(plain_loss(rows, centres, SYSTEM))
        for k in range(3):
            for d in range(4):
                step = np.zeros((3, 4))
                step[k, d] = 1e-6
                want = (plain_loss(rows, centres + step, SYSTEM) - plain_loss(rows, centres - step, SYSTEM)) / 2e-6
                assert slope[k, d] == pytest.approx(want, rel=1e-4, abs=1e-7)


def test_training_lowers_the_loss(spark):
    """Two groups that revert to their own mean: the loss falls, and the best centres are kept."""
    df = spark.createDataFrame(system(14, 12, 40), "t int, i int, x array<double>, z double, ret double")
    model, losses = training.train_clusters(df, 3, 12, 0.02, SYSTEM, block=8)
    assert len(losses) == 13 and losses[-1] < losses[0] - 0.01
    assert sum(b < a for a, b in zip(losses, losses[1:])) >= 10
    kept = model.orderBy("cluster").collect()
    assert kept[0].loss == min(losses)
    again = training.objective(training.sums_of(training.time_blocks(df, 8, Rounds(spark)), np.array([r.centre for r in kept]), SYSTEM), np.array([r.centre for r in kept]), SYSTEM)[0]
    assert again == pytest.approx(min(losses))
