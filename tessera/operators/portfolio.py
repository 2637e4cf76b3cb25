"""Signals, positions, weights, backtests and performance measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import dot, sigmoid
from tessera.functions.exprs import Layers, Panel


def residual_layers(entity: str, time: str, window: int = 20, group: str = "cluster") -> Layers:
    """Return less its cluster's mean, summed over the window, in units of its own deviation."""
    p = Panel(entity, time)
    return Layers(
        {"cluster_ret": f"avg(ret) OVER (PARTITION BY {time}, {group})"},
        {"idio_ret": "coalesce(ret - cluster_ret, 0)"},
        {"z_score": f"{p.roll('sum', 'idio_ret', window, window)} / ({p.roll('stddev_samp', 'idio_ret', window, window)} + 1e-6)"},
    )


def threshold_signal(entry: float) -> Layers:
    return Layers({"pos": f"CAST(CASE WHEN z_score < -{entry} THEN 1 WHEN z_score > {entry} THEN -1 ELSE 0 END AS INT)"})


def rank_signal(percent: float, entity: str, time: str, group: str = "cluster") -> Layers:
    """Lowest ranks of a cluster long, highest short; the short leg wins where they overlap."""
    by = f"PARTITION BY {time}, {group}"
    return Layers(
        {"n_": f"count(z_score) OVER ({by})", "rank_": f"CASE WHEN z_score IS NOT NULL THEN row_number() OVER ({by} ORDER BY z_score NULLS LAST, {entity}) END"},
        {"k_": f"ceil(n_ * {percent / 100.0!r}e0)"},
        {"pos": "CAST(CASE WHEN rank_ > n_ - k_ THEN -1 WHEN rank_ <= k_ THEN 1 ELSE 0 END AS INT)"},
    )


def stop_entries(df: DataFrame, last: int, entity: str = "permno", time: str = "date", pos: str = "pos") -> DataFrame:
    """On the last n dates no position opens, one that the signal closes stays closed, and the
    last date is flat.  Needs a row for every entity and date.  Closed form: the position before
    the stretch, while every signal since has been non-zero."""
    days = df.select(time).distinct()
    ranked = days.withColumn("_d", F.row_number().over(Window.orderBy(F.col(time).desc())))  # one row a date
    n = F.least(F.lit(last), F.lit(days.count()))
    d = df.join(F.broadcast(ranked), time)
    w = Window.partitionBy(entity).orderBy(time)
    base = F.last(F.when(F.col("_d") > n, F.col(pos)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    alive = F.min(F.when(F.col("_d") <= n, (F.col(pos) != 0).cast("int"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = F.when(F.col("_d") == 1, 0).when(F.col("_d") <= n, F.coalesce(base * alive, F.lit(0))).otherwise(F.col(pos))
    return d.withColumn(pos, held.cast("int")).drop("_d")


def portfolio_layers(entity: str, time: str) -> Layers:
    """Lagged positions to weights of gross exposure one, and their daily change.  Needs a dense
    panel; a missing return counts as zero."""
    p = Panel(entity, time)
    return Layers(
        {"lag_pos": f"coalesce({p.lag('pos')}, 0)"},
        {"gross_": f"sum(abs(lag_pos)) OVER (PARTITION BY {time})"},
        {"weight": "lag_pos / CASE WHEN gross_ = 0 THEN 1.0e0 ELSE CAST(gross_ AS DOUBLE) END"},
        {"trade": f"coalesce(abs(weight - {p.lag('weight')}), 0)", "pnl": "weight * coalesce(ret, 0)"},
    )


def linear_cost(bps: float):
    """Cost model: traded volume to cost.  The impact model of the same name is linear too."""
    return lambda traded: traded * (bps / 10000.0)


def daily_pnl(df: DataFrame, cost_bps: float = 0.0, time: str = "date") -> DataFrame:
    d = df.groupBy(time).agg(F.sum("pnl").alias("gross_ret"), F.sum("trade").alias("turnover"))
    return d.withColumn("daily_ret", F.col("gross_ret") - linear_cost(cost_bps)(F.col("turnover")))


def next_return_backtest(df: DataFrame, cost_bps: float, entity: str, time: str, by: list[str] | None = None) -> DataFrame:
    """Weights earn the following return; cost on the change of weights, the first included.
    Columns price, weight; (time, gross_ret, turnover, cost, daily_ret, cum_ret)."""
    by = by or []
    w = Window.partitionBy(*by, entity).orderBy(time)
    d = df.withColumns({"_r": F.coalesce((F.lead("price").over(w) - F.col("price")) / (F.col("price") + 1e-8), F.lit(0.0)), "_p": F.coalesce(F.lag("weight").over(w), F.lit(0.0))})
    out = d.groupBy(*by, time).agg(F.sum(F.col("weight") * F.col("_r")).alias("gross_ret"), F.sum(F.abs(F.col("weight") - F.col("_p"))).alias("turnover"))
    out = out.withColumn("cost", linear_cost(cost_bps)(F.col("turnover"))).withColumn("daily_ret", F.col("gross_ret") - F.col("cost"))
    run = Window.partitionBy(*by).orderBy(time) if by else Window.orderBy(time)  # one row a period
    return out.withColumn("cum_ret", F.sum("daily_ret").over(run))


def sequential_backtest(df: DataFrame, cost_bps: float, portfolio: str, time: str, initial: float = 1.0) -> DataFrame:
    """Equity path of each portfolio: rebalance to target weights, pay for what is traded, earn
    the next period's return, let holdings drift.  Rows (portfolio, time, weights array, rets
    array), the return being that of the following period; (portfolio, step, equity, turnover,
    cost).

    Periods come sorted in batches, and what goes on from one to the next is a portfolio's equity and
    holdings alone: a path takes time in proportion to its length, and memory for one batch."""
    cost_of = linear_cost(cost_bps)
    d = df.select(portfolio, time, F.col("weights").cast("array<double>"), F.col("rets").cast("array<double>"))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, step, equity, held = object(), 0, initial, None
        for b in batches:
            out = []
            for name, weights, rets in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                target_share, gain = np.array(weights, float), np.array(rets, float)
                if name != key:
                    key, step, equity, held = name, 0, initial, np.zeros(len(target_share))
                target = target_share * equity
                traded = float(np.abs(target - held).sum())
                cost = cost_of(traded)
                equity = equity - cost + float(target @ gain)
                held = target * (1.0 + gain)
                out.append((step, equity, traded, cost))
                step += 1
            steps, *rest = zip(*out) if out else ([], [], [], [])
            columns = [b.column(0), pa.array(steps, pa.int32()), b.column(1), *(pa.array(x, pa.float64()) for x in rest)]
            yield pa.RecordBatch.from_arrays(columns, names=[portfolio, "step", time, "equity", "turnover", "cost"])

    schema = f"{portfolio} {kinds[portfolio]}, step int, {time} {kinds[time]}, equity double, turnover double, cost double"
    return d.repartition(portfolio).sortWithinPartitions(portfolio, time).mapInArrow(run, schema)


def performance(returns: DataFrame, by: list[str] | None = None, time: str = "date", ret: str = "daily_ret", population: bool = False, compound: bool = True, eps: float = 0.0, year: int = 252) -> DataFrame:
    """One row (a group): sharpe, total_return, annualized_return, volatility, max_drawdown,
    calmar, win_rate, n_days.

    The definitions in use differ only in the deviation (sample or population), in compounding or
    summing returns, and in what is added to the deviation; all are options.  No rows or no
    deviation give zeros.  Periods of a group are folded by one window, groups in parallel.
    """
    by = by or []
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = part.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    d = returns.where(F.col(ret).isNotNull())
    grown = F.product(1 + F.col(ret)).over(w) if compound else 1 + F.sum(ret).over(w)
    d = d.withColumn("_g", grown).withColumn("_dd", F.try_divide("_g", F.max("_g").over(w)) - 1)
    sd = (F.stddev_pop if population else F.stddev_samp)(ret)
    n = F.count(ret)
    agg = d.groupBy(*by).agg(
        n.alias("n_days"), F.avg(ret).alias("_m"), sd.alias("_sd"), F.max_by("_g", time).alias("_last"), F.min("_dd").alias("_dd"),
        F.avg((F.col(ret) > 0).cast("double")).alias("_win"),
    )
    live = F.coalesce(F.col("_sd"), F.lit(0.0)) > 0
    total = F.col("_last") - 1
    annual = F.when(F.col("_last") > 0, F.pow(F.col("_last"), F.lit(float(year)) / F.col("n_days")) - 1) if compound else F.col("_m") * year
    out = {
        "sharpe": F.col("_m") / (F.col("_sd") + eps) * math.sqrt(year),
        "total_return": total,
        "annualized_return": annual,
        "volatility": F.col("_sd") * math.sqrt(year),
        "max_drawdown": F.col("_dd"),
        "calmar": F.try_divide(annual, F.abs("_dd")),
        "win_rate": F.col("_win"),
    }
    return agg.select(*by, "n_days", *(F.when(live, e).otherwise(0.0).alias(k) for k, e in out.items()))


def plain_performance(returns: DataFrame, by: list[str] | None = None, ret: str = "daily_ret", year: int = 252) -> DataFrame:
    """(by.., sharpe, win_rate, n_days): mean over sample deviation and the share of gains; a flat
    or single return has a Sharpe ratio of 0."""
    sd = F.stddev_samp(ret)
    sharpe = F.when(F.coalesce(sd, F.lit(0.0)) > 0, F.avg(ret) / sd * math.sqrt(year)).otherwise(0.0)
    win = F.avg((F.col(ret) > 0).cast("double"))
    return returns.where(F.col(ret).isNotNull()).groupBy(*(by or [])).agg(sharpe.alias("sharpe"), win.alias("win_rate"), F.count(ret).alias("n_days"))


def equity_performance(path: DataFrame, by: list[str], step: str = "step", equity: str = "equity", year: int = 252) -> DataFrame:
    """(by.., sharpe, max_drawdown, total_return) of equity curves: returns are those of the curve
    itself, drawdowns from its running peak."""
    w = Window.partitionBy(*by).orderBy(step)
    r = F.try_divide(F.col(equity), F.lag(equity).over(w)) - 1
    dd = F.try_divide(F.col(equity), F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1
    d = path.withColumns({"_r": r, "_dd": dd})
    sd = F.stddev_samp("_r")
    return d.groupBy(*by).agg(
        F.when(F.coalesce(sd, F.lit(0.0)) > 0, F.avg("_r") / sd * math.sqrt(year)).otherwise(0.0).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"),
        (F.try_divide(F.max_by(equity, step), F.min_by(equity, step)) - 1).alias("total_return"),
    )


def weight_rule(df: DataFrame, rule: str, time: str = "date", pos: str = "pos") -> DataFrame:
    """gross: absolute weights sum to one; equal: by the number of active positions; independent:
    a tenth of the position."""
    w = Window.partitionBy(time)
    p = F.col(pos)
    rules = {
        "gross": p / (F.sum(F.abs(p)).over(w) + 1e-8),
        "equal": p / F.greatest(F.count_if(F.abs(p) > 1e-8).over(w), F.lit(1)),
        "independent": p * 0.1,
    }
    return df.withColumn("weight", rules[rule])


def band_pass_position(signal: Column, gate: Column, entry: float, stop: float, scale: float) -> Column:
    """Against the residual, between entry and stop, smoothly; off for outliers."""
    size = F.abs(signal)
    inside = sigmoid(scale * (size - entry)) * (1.0 - sigmoid(scale * (size - stop)))
    return -F.tanh(scale * signal) * inside * gate


def force_controller(force: Column, stiffness: Column, velocity: Column | None = None) -> Column:
    """Position against the potential, scaled by the square root of stiffness; none while force
    and velocity oppose each other."""
    push = -force * F.sqrt(F.greatest(stiffness, F.lit(0.0)))
    return push if velocity is None else F.when(-force * velocity < 0, 0.0).otherwise(push)


def edge_controller(edges: DataFrame, series: DataFrame, scale: float) -> DataFrame:
    """(t, i, pos) from each edge's own bounded pull, so that one far neighbour cannot dominate:
    the weighted sum of tanh of the neighbour's lead.  Directed edges (i, j, w)."""
    near = edges.join(series.select("t", F.col("i").alias("j"), F.col("f").alias("fj")), "j").join(series.select("t", "i", "f"), ["t", "i"])
    pull = F.sum(F.col("w") * F.tanh((F.col("fj") - F.col("f")) / scale))
    return near.groupBy("t", "i").agg(pull.alias("pos"))


def age_gate(df: DataFrame, longest: int, entity: str, time: str, pos: str = "pos") -> DataFrame:
    """Positions held in one direction for more than ``longest`` periods are closed until the
    direction changes; ``age`` counts the periods of the present run."""
    w = Window.partitionBy(entity).orderBy(time)
    turn = (F.signum(pos) != F.coalesce(F.lag(F.signum(pos)).over(w), F.lit(0.0))).cast("int")
    d = df.withColumn("_turn", turn)
    d = d.withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("age", F.row_number().over(Window.partitionBy(entity, "_run").orderBy(time)))
    return d.withColumn(pos, F.when(F.col("age") > longest, 0).otherwise(F.col(pos))).drop("_turn", "_run")
