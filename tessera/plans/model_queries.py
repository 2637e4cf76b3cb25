"""Registered queries of fitted models: many windows at once, exact neighbours, modes of networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import dynamics, extended_factors, firm_factors, graph, modes, portfolio, training, window_models
from tessera.plans.panels import MONTH, NATION, plain, run
from tessera.plans.queries import _pnl, _pnl_sql, r6, register
from tessera.sources.shared import Rounds

#: Features of the fitted walk-forward: momenta of one to twelve months.
FEATURES = [f"mom{i}" for i in range(1, 13)]
CLUSTERS, LEAST_ROWS, HISTORY = 3, 5, 12


def month_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, id, v): the features of the month before, which is all that a month's model sees."""
    panel = firm_factors.momentum_suite("permno", "date", 12).apply(MONTH.frame(spark, sf_dir))
    d = panel.select(F.add_months("date", 1).alias("month"), F.col("permno").alias("id"), F.array(*FEATURES).alias("v"))
    return d.where(F.forall("v", lambda x: x.isNotNull()))


_SNAPSHOT_SQL = f"""s AS (SELECT CAST(date + INTERVAL 1 MONTH AS DATE) AS month, permno AS id, [{', '.join(FEATURES)}] AS v
        FROM {MONTH.source(firm_factors.momentum_suite('permno', 'date', 12))} WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}),
    x AS (SELECT month, id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM s),
    m AS (SELECT month, d, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd FROM x GROUP BY month, d)"""


@register(f"""WITH {_SNAPSHOT_SQL} SELECT month, CAST(d - 1 AS INT) AS d, round(m, 6) + 0.0e0 AS mean, round(sd, 6) AS sd FROM m""")
def window_moments(spark, sf_dir):
    d = window_models.moments(month_snapshots(spark, sf_dir), ["month"])
    return d.select("month", F.posexplode(F.arrays_zip("mean", "sd")).alias("d", "x")).select("month", "d", F.col("x.mean").alias("mean"), F.col("x.sd").alias("sd")).select("month", "d", r6("mean"), r6("sd"))


@register(f"""WITH {_SNAPSHOT_SQL}, z AS (SELECT month, id, d, (x - m) / sd AS z FROM x JOIN m USING (month, d)),
    o AS (SELECT month, id, row_number() OVER (PARTITION BY month ORDER BY md5(concat_ws(':', '42', '0', CAST(id AS VARCHAR))), id) - 1 AS cluster FROM s),
    c AS (SELECT z.month, cluster, d, z AS c FROM z JOIN o ON z.month = o.month AND z.id = o.id AND cluster < {CLUSTERS}),
    dist AS (SELECT z.month, z.id, cluster, sum((z - c) ** 2) AS cost FROM z JOIN c USING (month, d) GROUP BY z.month, z.id, cluster),
    near AS (SELECT month, id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY month, id ORDER BY cost, cluster) AS n FROM dist) WHERE n = 1)
    SELECT month, CAST(cluster AS INT) AS cluster, CAST(d - 1 AS INT) AS d, round(avg(z), 5) + 0.0e0 AS centre FROM z JOIN near USING (month, id) GROUP BY month, cluster, d""")
def window_kmeans_step(spark, sf_dir):
    """One step of k-means in every month from centres drawn by hash."""
    s = month_snapshots(spark, sf_dir)
    z = window_models.standardise(s, window_models.moments(s, ["month"]), ["month"])
    c = window_models.lloyd_step(z, window_models.first_centres(z, ["month"], CLUSTERS), ["month"])
    return c.select("month", "cluster", F.posexplode("centre").alias("d", "x")).select("month", "cluster", "d", (F.round("x", 5) + 0.0).alias("centre"))


def fitted_returns(panel: DataFrame, labels: DataFrame, cost_bps: float = 10.0, window: int = 6, entry: float = 1.0) -> DataFrame:
    """(date, gross_ret, turnover, daily_ret): in each month's window its clusters hold for the
    months before too, so that residuals are warm; only the month itself is traded.  All windows
    are rows of one plan."""
    back = F.explode(F.sequence(F.lit(0), F.lit(HISTORY - 1)))
    held = panel.select("permno", "date", "ret", back.alias("_k")).withColumn("month", F.expr("add_months(date, _k)")).drop("_k")
    held = held.join(labels.withColumnRenamed("id", "permno"), ["month", "permno"])
    keyed = held.withColumns({"entity": F.struct("month", "permno"), "slot": F.struct("month", "date")})
    layers = portfolio.residual_layers("entity", "slot", window=window) + portfolio.threshold_signal(entry) + portfolio.portfolio_layers("entity", "slot")
    return portfolio.daily_pnl(layers.apply(keyed).where("date = month"), cost_bps)


@register()
def walk_forward_fitted(spark, sf_dir):
    """Each month's clusters come from a model fitted on the month before: standardised momenta,
    five principal components, the best of ten k-means; residuals, signals and profit follow."""
    labels = window_models.window_clusters(month_snapshots(spark, sf_dir), ["month"], CLUSTERS, 5, 10, LEAST_ROWS)
    out = fitted_returns(MONTH.frame(spark, sf_dir).select("permno", "date", "ret"), labels)
    return out.select("date", r6("gross_ret"), r6("turnover"), r6("daily_ret"))


# Statistics by sums of products, against the regressions of the library.
_NODES = plain(NATION.sql)


@register(f"""WITH s AS ({_NODES}), m AS (SELECT x.i, y.i AS j, x.t, y.f AS y, x.f AS x FROM s x JOIN s y ON x.t = y.t AND x.i <> y.i),
    p AS (SELECT * FROM (SELECT i, j, y, lag(y) OVER w AS a, lag(x) OVER w AS b FROM m WINDOW w AS (PARTITION BY i, j ORDER BY t)) WHERE a IS NOT NULL),
    c AS (SELECT i, j, count(*) AS n, var_pop(y) * count(*) AS yy, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(y, a) * count(*) AS ya, covar_pop(y, b) * count(*) AS yb, covar_pop(a, b) * count(*) AS ab FROM p GROUP BY i, j),
    r AS (SELECT i, j, n, yy - ya * ya / aa AS own, yy - (ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa) / (aa * bb - ab * ab) AS whole FROM c)
    SELECT i, j, round((own - whole) / (whole / (n - 3)), 3) + 0.0e0 AS f_stat FROM r""")
def granger_statistics(spark, sf_dir):
    s = NATION.frame(spark, sf_dir)
    n = s.select("i").distinct()
    pairs = n.join(n.select(F.col("i").alias("j")), F.col("i") != F.col("j"))
    return graph.granger(s, pairs).select("i", "j", (F.round("f_stat", 3) + 0.0).alias("f_stat"))


@register(f"""WITH d AS (SELECT i, t, f - lag(f) OVER w AS y, lag(f) OVER w AS a FROM ({_NODES}) WINDOW w AS (PARTITION BY i ORDER BY t)),
    p AS (SELECT i, y, a, lag(y) OVER (PARTITION BY i ORDER BY t) AS b FROM d),
    c AS (SELECT i, count(*) AS n, var_pop(y) * count(*) AS yy, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(y, a) * count(*) AS ya, covar_pop(y, b) * count(*) AS yb, covar_pop(a, b) * count(*) AS ab FROM p WHERE b IS NOT NULL GROUP BY i),
    r AS (SELECT i, n, bb / (aa * bb - ab * ab) AS inv, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS slope, yy - (ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa) / (aa * bb - ab * ab) AS rss FROM c)
    SELECT i, round(slope / sqrt(rss / (n - 3) * inv), 3) + 0.0e0 AS adf FROM r""")
def unit_root_statistic(spark, sf_dir):
    return graph.dickey_fuller(NATION.frame(spark, sf_dir)).select("i", (F.round("adf", 3) + 0.0).alias("adf"))


_WEEKS = """SELECT l_suppkey AS permno, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, avg(l_extendedprice) AS prc FROM {lineitem} GROUP BY 1, 2"""
_WEEKLY = f"(SELECT permno, week, prc / nullif(lag(prc) OVER (PARTITION BY permno ORDER BY week), 0) - 1 AS wkret FROM ({plain(_WEEKS)}))"


@register(f"""WITH w AS (SELECT *, avg(wkret) OVER (PARTITION BY week) AS mk FROM {_WEEKLY} WHERE wkret IS NOT NULL),
    b AS (SELECT m.permno, m.date, count(*) AS n_weeks, regr_slope(wkret, mk) AS beta, regr_r2(wkret, mk) AS r2, stddev_samp(wkret) AS sd FROM (SELECT permno, date FROM {MONTH.source()}) m
      JOIN w ON w.permno = m.permno AND w.week BETWEEN m.date - INTERVAL 36 MONTH AND m.date - INTERVAL 1 MONTH GROUP BY m.permno, m.date HAVING count(*) >= 20)
    SELECT permno, date, n_weeks, round(beta, 4) + 0.0e0 AS beta, round(beta * beta, 4) AS betasq, round(sd * sqrt(greatest(1 - r2, 0) * (n_weeks - 1) / (n_weeks - 2)), 4) AS idiovol FROM b""")
def calendar_beta(spark, sf_dir):
    """Beta of weekly returns over 36 calendar months before each month."""
    weeks = run(spark, sf_dir, _WEEKS)
    ret = F.try_divide("prc", F.lag("prc").over(Window.partitionBy("permno").orderBy("week"))) - 1
    d = extended_factors.calendar_beta(weeks.withColumn("wkret", ret), MONTH.frame(spark, sf_dir), least=20)
    return d.select("permno", "date", "n_weeks", r6("beta", 4), r6("betasq", 4), r6("idiovol", 4))


_FORECASTS = {
    "medest": "CASE WHEN permno % 3 = 0 THEN NULL ELSE vol / 50.0e0 END",
    "actual": "CASE WHEN (permno + month(date)) % 5 = 0 THEN NULL ELSE vol / 40.0e0 END",
    "meanest": "CASE WHEN permno % 4 = 0 THEN 0.0e0 ELSE vol / 45.0e0 END",
    "stdev": "0.1e0 + vol / 1000.0e0",
    "numest": "CASE WHEN permno % 2 = 0 THEN NULL ELSE CAST(permno % 11 AS INT) END",
    "fgr5yr": "CASE WHEN permno % 5 < 2 THEN NULL ELSE 10.0e0 + permno % 7 END",
    "che": "vol - 25.0e0",
    "mveq": "prc * 10.0e0",
    "prccq": "prc",
}


@register(f"""SELECT permno, date, round(CASE WHEN medest IS NULL OR actual IS NULL THEN che / nullif(mveq, 0) ELSE (actual - medest) / nullif(abs(prccq), 0) END, 6) + 0.0e0 AS sue,
    round(stdev / CASE WHEN meanest = 0 THEN 0.01e0 ELSE abs(meanest) END, 6) AS disp, coalesce(numest, CASE WHEN date >= DATE '1995-01-01' THEN 0 END) AS nanalyst,
    CASE WHEN date < DATE '1995-01-01' THEN NULL WHEN fgr5yr IS NULL THEN 0 ELSE 1 END AS ltg, fgr5yr, round(meanest / nullif(abs(prccq), 0), 6) + 0.0e0 AS sfe
    FROM (SELECT permno, date, {', '.join(f'{e} AS {n}' for n, e in _FORECASTS.items())} FROM {MONTH.source()})""")
def analyst_levels(spark, sf_dir):
    d = MONTH.frame(spark, sf_dir).withColumns({n: F.expr(e) for n, e in _FORECASTS.items()})
    d = extended_factors.forecast_levels("date", 1995).apply(d.select("permno", "date", *_FORECASTS))
    return d.select("permno", "date", r6("sue"), r6("disp"), "nanalyst", "ltg", "fgr5yr", r6("sfe"))


@register(f"""SELECT round(avg(daily_ret) / stddev_samp(daily_ret) * sqrt(252), 6) AS sharpe, round(avg(CASE WHEN daily_ret > 0 THEN 1.0e0 ELSE 0 END), 6) AS win_rate, count(*) AS n_days FROM ({_pnl_sql(10.0)})""")
def plain_performance(spark, sf_dir):
    return portfolio.plain_performance(_pnl(spark, sf_dir)).select(r6("sharpe"), r6("win_rate"), "n_days")


@register(f"""WITH e AS (SELECT i AS pf, t AS step, exp(f / 50) AS equity FROM ({_NODES})), r AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER w - 1 AS dd FROM e WINDOW w AS (PARTITION BY pf ORDER BY step))
    SELECT pf, round(avg(r) / stddev_samp(r) * sqrt(252), 6) + 0.0e0 AS sharpe, round(min(dd), 6) + 0.0e0 AS max_drawdown, round(arg_max(equity, step) / arg_min(equity, step) - 1, 6) + 0.0e0 AS total_return FROM r GROUP BY pf""")
def equity_performance(spark, sf_dir):
    e = NATION.frame(spark, sf_dir).select(F.col("i").alias("pf"), F.col("t").alias("step"), F.exp(F.col("f") / 50).alias("equity"))
    return portfolio.equity_performance(e, ["pf"]).select("pf", r6("sharpe"), r6("max_drawdown"), r6("total_return"))


@register(f"""WITH s AS ({_NODES}), w AS (SELECT CAST(unnest(range(0, (SELECT max(t) FROM s) - 24 + 1, 10)) AS INT) AS start)
    SELECT start, a.i, b.i AS j, round(CASE WHEN min(a.f) < max(a.f) AND min(b.f) < max(b.f) THEN abs(corr(a.f, b.f)) END, 5) AS w
    FROM w JOIN s a ON a.t >= start AND a.t < start + 24 JOIN s b ON b.t = a.t AND a.i < b.i GROUP BY start, a.i, b.i""")
def rolling_correlations(spark, sf_dir):
    """Correlations of all pairs in overlapping windows."""
    d = graph.window_correlations(NATION.frame(spark, sf_dir), 24, 10)
    return d.select("start", "i", "j", F.round("w", 5).alias("w"))


@register(f"""WITH p AS (SELECT t, i, f FROM ({_NODES}) WHERE i IN (2, 3)), v AS (SELECT *, lead(f) OVER (PARTITION BY i ORDER BY t) - f AS v FROM p),
    o AS (SELECT sum(CASE WHEN i = 2 THEN f * f END) + 1e-6 AS xx, sum(CASE WHEN i = 3 THEN f * f END) + 1e-6 AS yy, sum(CASE WHEN i = 2 THEN f * v END) AS xvx, sum(CASE WHEN i = 3 THEN f * v END) AS yvy FROM v WHERE v IS NOT NULL),
    m AS (SELECT sum(a.f * b.f) AS xy, sum(a.f * b.v) AS xvy, sum(b.f * a.v) AS yvx FROM v a JOIN v b ON a.t = b.t AND a.i = 2 AND b.i = 3 AND a.v IS NOT NULL AND b.v IS NOT NULL),
    s AS (SELECT * FROM o, m),
    c AS (SELECT (xx * yvx - xy * xvx) / (xx * yy - xy * xy) AS a, (yy * xvy - xy * yvy) / (xx * yy - xy * xy) AS b FROM s)
    SELECT CAST(2 AS INT) AS i, CAST(3 AS INT) AS j, round((a + b) / 2, 4) AS w FROM c WHERE a + b > 0""")
def recovered_pair(spark, sf_dir):
    """The graph of two nations from regressions of velocities on states."""
    d = dynamics.recover_graph(NATION.frame(spark, sf_dir).where("i IN (2, 3)"), 1.0)
    return d.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("w", 4).alias("w"))


@register()
def recovered_graph(spark, sf_dir):
    return dynamics.recover_graph(NATION.frame(spark, sf_dir), 1.0).select("i", "j", r6("w", 4))


@register()
def spectral_groups(spark, sf_dir):
    """Clusters of the correlation graph on its spectral embedding."""
    return modes.spectral_clusters(graph.correlation_graph(NATION.frame(spark, sf_dir), 0.1), 3)


# The differentiable trading system on monthly prices.
_WINDOW = 6
_SETTINGS = training.Settings(entry=0.5, stop=3.0, similarity=0.3, temperature=0.2, cost=0.001, turnover_penalty=0.05, leverage_penalty=1.0, most_leverage=1.0)


def system_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, i, x, z, ret): unit vectors of standardised log prices of the last months, the last
    standardised value, and the return that follows."""
    w = Window.partitionBy("permno").orderBy("date")
    d = MONTH.frame(spark, sf_dir).select("permno", "date", "prc").withColumn("ln", F.log(F.col("prc") + 1e-8))
    d = d.withColumns({"held": C.window_vectors("ln", "permno", "date", _WINDOW), "ret": F.lead("prc").over(w) / (F.col("prc") + 1e-8) - F.col("prc") / (F.col("prc") + 1e-8)})
    d = d.where("held IS NOT NULL AND ret IS NOT NULL").withColumn("zs", C.zscore_vector(F.col("held")))
    return d.select((F.year("date") * 12 + F.month("date")).alias("t"), F.col("permno").alias("i"), C.unit(F.col("zs")).alias("x"), F.element_at("zs", -1).alias("z"), "ret")


_SYSTEM_CENTRES = [[1.0, 0.5, 0.0, -0.5, -1.0, 0.25], [-1.0, -0.5, 0.25, 0.5, 1.0, 0.5], [0.5, -1.0, 0.5, -0.25, 0.75, -1.0]]
_UNIT = [[x / sum(y * y for y in c) ** 0.5 for x in c] for c in _SYSTEM_CENTRES]
_DOTS = ", ".join("list_sum(list_transform(list_zip(x, [{0}]), lambda q: q[1] * q[2]))".format(", ".join(f"{v!r}e0" for v in c)) for c in _UNIT)


@register(f"""WITH p AS (SELECT permno AS i, date, year(date) * 12 + month(date) AS t, prc, ln(prc + 1e-8) AS l FROM {MONTH.source()}),
    h AS (SELECT i, t, lead(prc) OVER e / (prc + 1e-8) - prc / (prc + 1e-8) AS ret, list(l) OVER (e ROWS BETWEEN {_WINDOW - 1} PRECEDING AND CURRENT ROW) AS v FROM p WINDOW e AS (PARTITION BY i ORDER BY date)),
    z AS (SELECT i, t, ret, list_transform(v, lambda q: (q - list_avg(v)) / (list_stddev_samp(v) + 1e-8)) AS zs FROM h WHERE len(v) = {_WINDOW} AND ret IS NOT NULL),
    x AS (SELECT i, t, ret, zs[{_WINDOW}] AS z, list_transform(zs, lambda q: q / (sqrt(list_sum(list_transform(zs, lambda y: y * y))) + 1e-8)) AS x FROM z),
    s AS (SELECT i, t, ret, z, [{_DOTS}] AS sim FROM x),
    a AS (SELECT *, 1 / (1 + exp(-20 * (list_max(sim) - {_SETTINGS.similarity}))) AS g, list_transform(sim, lambda q: exp((q - list_max(sim)) / {_SETTINGS.temperature})) AS e FROM s),
    k AS (SELECT i, t, ret, z, g, generate_subscripts(e, 1) AS k, unnest(e) / list_sum(e) AS a FROM a),
    c AS (SELECT t, k, sum(a * g * z) / (sum(a * g) + 1e-6) AS c FROM k GROUP BY t, k),
    r AS (SELECT i, t, any_value(ret) AS ret, any_value(g) AS g, any_value(z) - sum(a * c) AS s FROM k JOIN c USING (t, k) GROUP BY i, t),
    w AS (SELECT i, t, ret, 0.1e0 * g * (2 / (1 + exp(2 * 5 * s)) - 1) / (1 + exp(-5 * (abs(s) - {_SETTINGS.entry}))) * (1 - 1 / (1 + exp(-5 * (abs(s) - {_SETTINGS.stop})))) AS w FROM r),
    u AS (SELECT i, t, w, ret FROM w UNION ALL SELECT i, t + 1, 0, 0 FROM w),
    v AS (SELECT i, t, sum(w) AS w, sum(ret) AS ret FROM u WHERE t IN (SELECT t FROM w) GROUP BY i, t),
    d AS (SELECT v.t, v.i, v.w, v.ret, coalesce(b.w, 0) AS before FROM v LEFT JOIN v b ON b.i = v.i AND b.t = v.t - 1),
    n AS (SELECT t, sum(w * ret) - {_SETTINGS.cost} * sum(abs(w - before)) AS net, sum(abs(w - before)) AS turn, greatest(sum(abs(w)) - {_SETTINGS.most_leverage}, 0) AS excess FROM d GROUP BY t)
    SELECT count(*) AS n_times, round(-avg(net) / (stddev_samp(net) + 1e-6) + {_SETTINGS.turnover_penalty} * avg(turn) + {_SETTINGS.leverage_penalty} * avg(excess * excess), 6) AS loss FROM n""")
def system_loss(spark, sf_dir):
    """The objective of the differentiable system at given centres, over the whole history."""
    blocks = training.time_blocks(system_rows(spark, sf_dir), 16, Rounds(spark))
    centres = np.array(_SYSTEM_CENTRES)
    sums = training.sums_of(blocks, centres, _SETTINGS)
    loss, _ = training.objective(sums, centres, _SETTINGS)
    return spark.createDataFrame([(int(sums[4]), round(loss, 6))], "n_times long, loss double")


@register()
def system_training(spark, sf_dir):
    """The trained centres of the differentiable system, one row a cluster and component."""
    model, _ = training.train_clusters(system_rows(spark, sf_dir), 3, 8, 0.05, _SETTINGS)
    return model.select("cluster", F.posexplode("centre").alias("d", "x"), "loss").select("cluster", "d", r6("x"), r6("loss"))
