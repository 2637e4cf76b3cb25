"""Daily, event-window, technical and intraday factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import Layers, Panel, clip, div

DAILY_FACTORS = (
    "amihud_1m turnover_var dvol_cv_1m parkinson_vol_1m downside_vol_1m upside_vol_1m max_ret_1m skew_1m ret_gap_vol_1m "
    "clv_mean_1m zero_ret_pct_1m avg_trade_size_1m illiq_numtrd_1m payout_yield_1m intraday_ret_1m intraday_vol_1m"
).split()
WINDOW, LEAST = 21, 15


def split_adjusted() -> Layers:
    """adj_* from raw prices and volume by the cumulative factors; a zero factor is missing."""
    price = {f"adj_{x}": div(x, "cfacpr") for x in ("prc", "openprc", "askhi", "bidlo")}
    return Layers(price | {"adj_vol": "vol * cfacshr"})


def daily_layers(entity: str = "permno", time: str = "date", adjusted: bool = True) -> Layers:
    """Sixteen factors over 21 rows, 15 of them present.  A missing return counts as zero in the
    up, down and zero-return factors."""
    p = Panel(entity, time)
    close, open_, high, low, volume = ("adj_prc", "adj_openprc", "adj_askhi", "adj_bidlo", "adj_vol") if adjusted else ("prc", "openprc", "askhi", "bidlo", "vol")
    close = f"abs({close})"
    basic = {
        "close_": close,
        "prev_": p.lag(close),
        "dvol_": f"{close} * {volume}",
        "turn_": div(volume, "shrout"),
        "down2_": "CASE WHEN ret < 0 THEN ret * ret ELSE 0 END",
        "up2_": "CASE WHEN ret > 0 THEN ret * ret ELSE 0 END",
        "zero_": "CASE WHEN ret = 0 THEN 1.0e0 ELSE 0.0e0 END",
        "hl_": f"CASE WHEN {low} > 0 AND {high} >= {low} THEN ln({high} / {low}) END",
        "clv_": f"CASE WHEN {high} - {low} > 0 THEN {clip(f'({close} - {low}) / ({high} - {low})', 0.0, 1.0)} WHEN {high} - {low} <= 0 THEN 0.5e0 END",
        "size_": div(volume, "numtrd"),
        "impact_": div("abs(ret)", "numtrd"),
        "pay_": "ret - retx",
        "day_": f"CASE WHEN {open_} > 0 THEN {close} / {open_} - 1 END",
    }
    daily = {"amihud_": div("abs(ret)", "dvol_"), "gap_": f"CASE WHEN {open_} > 0 AND prev_ > 0 THEN {open_} / prev_ - 1 END", "park_": "hl_ * hl_ / (4 * ln(2.0e0))"}

    def roll(f: str, x: str) -> str:
        return p.roll(f, x, WINDOW, LEAST)

    factors = {
        "amihud_1m": roll("avg", "amihud_"),
        "turnover_var": roll("stddev_samp", "turn_"),
        "dvol_cv_1m": div(roll("stddev_samp", "dvol_"), roll("avg", "dvol_")),
        "parkinson_vol_1m": f"sqrt({roll('avg', 'park_')})",
        "downside_vol_1m": f"sqrt({roll('avg', 'down2_')})",
        "upside_vol_1m": f"sqrt({roll('avg', 'up2_')})",
        "max_ret_1m": roll("max", "ret"),
        "skew_1m": p.roll_skew("ret", WINDOW, LEAST),
        "ret_gap_vol_1m": roll("stddev_samp", "gap_"),
        "clv_mean_1m": roll("avg", "clv_"),
        "zero_ret_pct_1m": roll("avg", "zero_"),
        "avg_trade_size_1m": roll("avg", "size_"),
        "illiq_numtrd_1m": roll("avg", "impact_"),
        "payout_yield_1m": roll("sum", "pay_"),
        "intraday_ret_1m": roll("avg", "day_"),
        "intraday_vol_1m": roll("stddev_samp", "day_"),
    }
    return Layers(basic, daily, factors)


def technical_layers(entity: str, time: str, value: str = "close") -> Layers:
    """Volatility and momentum over 20 and 60 rows, and the 14-row strength index with plain means."""
    p = Panel(entity, time)
    change = {"ret_": f"{value} / nullif({p.lag(value)}, 0) - 1", "diff_": f"{value} - {p.lag(value)}"}
    sides = {"gain_": "CASE WHEN diff_ > 0 THEN diff_ WHEN diff_ IS NOT NULL THEN 0 END", "loss_": "CASE WHEN diff_ < 0 THEN -diff_ WHEN diff_ IS NOT NULL THEN 0 END"}
    means = {"mg_": p.roll("avg", "gain_", 14, 14), "ml_": p.roll("avg", "loss_", 14, 14)}
    out = {f"vol_{n}d": p.roll("stddev_samp", "ret_", n, n) for n in (20, 60)}
    out |= {f"mom_{n}d": f"{value} / nullif({p.lag(value, n)}, 0) - 1" for n in (20, 60)}
    out["rsi_14"] = "CASE WHEN ml_ = 0 AND mg_ > 0 THEN 100 WHEN ml_ > 0 THEN 100 - 100 / (1 + mg_ / ml_) END"
    return Layers(change, sides, means, out)


def event_window_factors(daily: DataFrame, events: DataFrame, entity: str = "permno", date: str = "date", event_date: str = "rdq", before: int = 1, after: int = 3) -> DataFrame:
    """Compounded return and population deviation from ``before`` days before to ``after`` days
    after each event, in calendar days, with the day from which they are known.

    Each event meets only the days of its own window: the join is on entity and day, the window
    being spelled out on the small side, so a frequent entity fans out by the window's length.
    """
    days = events.select(entity, event_date).where(F.col(event_date).isNotNull()).distinct()
    days = days.withColumn(date, F.explode(F.expr(f"sequence(date_sub({event_date}, {before}), date_add({event_date}, {after}))")))
    found = days.join(daily.select(entity, F.col(date).cast("date").alias(date), "ret"), [entity, date])
    out = found.groupBy(entity, event_date).agg((F.product(F.lit(1) + F.col("ret")) - 1).alias("ear_ea"), F.stddev_pop("ret").alias("aeavol_ea"), F.count("ret").alias("n_days"))
    return out.withColumn("valid_from", F.date_add(event_date, after + 1))


def event_columns(after: int = 3) -> Layers:
    """After the as-of attachment: days since the event (9999 days clipped to 3650 if none) and
    the clipped effect."""
    since = f"coalesce(datediff(date, valid_from) + {after + 1}, 9999)"
    return Layers({"ea_days_since": {"spark": clip(since, 0, 3650), "duckdb": clip(f"coalesce(datediff('day', valid_from, date) + {after + 1}, 9999)", 0, 3650)}, "ea_effect": clip("coalesce(ear_ea, 0)", -1.0, 1.0)})


INTRADAY_FEATURES = (
    "realized_vol realized_skew realized_kurtosis downside_vol upside_vol intraday_max_drawdown parkinson_vol rogers_satchell_vol "
    "high_low_ratio tail_risk_ratio amihud_illiquidity volume_volatility price_vol_corr volume_skew signed_volume_imbalance "
    "autocorr_1min price_path_length jump_count reversal_intensity hurst_exponent intraday_mom close_dist_high"
).split()


def _skew(x: str) -> Column:
    n = F.count(x)
    return F.when(n >= 3, F.when(F.min(x) == F.max(x), 0.0).otherwise(F.sqrt(n * (n - 1.0)) / (n - 2) * F.skewness(x)))


def _kurtosis(x: str) -> Column:
    n = F.count(x)
    full = (n - 1) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n >= 4, F.when(F.min(x) == F.max(x), 0.0).otherwise(full))


def _corr(a: str, b: str) -> Column:
    pair = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(pair, F.col(a)), F.when(pair, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def intraday_features(bars: DataFrame, keys: list[str], time: str = "ts", least: int = 10, ratio=F.try_divide, log=F.log) -> DataFrame:
    """22 moments for each group (a stock and day): one window stage for returns, running
    products and peaks, then one aggregation.  Bars have open, high, low, close, volume; groups
    shorter than ``least`` give NULL features.  ``ratio`` and ``log`` decide what a price of zero makes of
    ratios of prices: by default they are missing, in Rogers-Satchell terms always."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(time)
    whole, so_far = Window.partitionBy(*keys), w.rowsBetween(Window.unboundedPreceding, 0)
    d = bars.withColumn("r", F.try_divide("close", F.lag("close").over(w)) - 1)
    d = d.withColumns({
        "r1": F.lag("r").over(w),
        "grow": F.product(1 + F.col("r")).over(so_far),
        "sd": F.stddev_samp("r").over(whole),
        "mean_r": F.avg("r").over(whole),
        "rv": F.try_divide(F.abs("r"), F.col("close") * F.col("volume")),
    })
    d = d.withColumns({"peak": F.max("grow").over(so_far), "walk": F.sum(F.col("r") - F.col("mean_r")).over(so_far)})
    hl, co = log(ratio(F.col("high"), F.col("low"))), lambda a, b: F.log(F.try_divide(a, b))
    rs = co("high", "close") * co("high", "open") + co("low", "close") * co("low", "open")
    n, first, last = F.count("*"), F.min_by("open", time), F.max_by("close", time)
    signed = F.when(F.col("r") > 0, F.col("volume")).when(F.col("r") < 0, -F.col("volume")).otherwise(0)
    spread = F.max("walk") - F.min("walk")
    hurst = F.when((F.stddev_samp("r") > 0) & (spread > 0), F.log(spread / F.stddev_samp("r")) / F.log(F.count("r").cast("double")))
    quantiles = F.percentile("r", F.array(F.lit(0.05), F.lit(0.95)))
    f = {
        "realized_vol": F.stddev_samp("r"),
        "realized_skew": _skew("r"),
        "realized_kurtosis": _kurtosis("r"),
        "downside_vol": F.coalesce(F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))), F.lit(0.0)),
        "upside_vol": F.coalesce(F.stddev_samp(F.when(F.col("r") > 0, F.col("r"))), F.lit(0.0)),
        "intraday_max_drawdown": F.min(F.try_divide("grow", "peak") - 1),
        "parkinson_vol": F.sqrt(F.avg(hl * hl) / (4 * F.log(F.lit(2.0)))),
        "rogers_satchell_vol": F.when(F.avg(rs) >= 0, F.sqrt(F.avg(rs))),
        "high_low_ratio": ratio(F.max("high") - F.min("low"), first),
        "tail_risk_ratio": F.abs(quantiles[1]) + F.abs(quantiles[0]),
        "amihud_illiquidity": F.avg("rv"),
        "volume_volatility": F.stddev_samp("volume") / (F.avg("volume") + 1e-6),
        "price_vol_corr": _corr("r", "volume"),
        "volume_skew": _skew("volume"),
        "signed_volume_imbalance": F.sum(signed) / (F.sum("volume") + 1e-6),
        "autocorr_1min": _corr("r", "r1"),
        "price_path_length": F.sum(F.abs("r")),
        "jump_count": F.count_if((F.col("sd") > 0) & (F.abs(F.col("r")) > 3 * F.col("sd"))).cast("double"),
        "reversal_intensity": F.try_divide(F.count_if(F.col("r") * F.col("r1") < 0).cast("double"), F.count("r")),
        "hurst_exponent": F.coalesce(hurst, F.lit(0.5)),
        "intraday_mom": ratio(last, first) - 1,
        "close_dist_high": ratio(F.max("high") - last, F.max("high")),
    }
    return d.groupBy(*keys).agg(*(F.when(n >= least, e).alias(k) for k, e in f.items()))


def bars_to_days(bars: DataFrame, keys: list[str], value: str, how: str, time: str = "ts", is_price: bool = False) -> DataFrame:
    """Bars to one value a group: sum, mean, std (of returns if it is a price), last, or rv, the
    sum of squared returns.  Any other name is an error."""
    from pyspark.sql import Window

    if how not in ("sum", "mean", "std", "last", "rv"):
        raise ValueError(f"unknown aggregation {how!r}")
    d, x = bars, value
    if how == "rv" or (how == "std" and is_price):
        w = Window.partitionBy(*keys).orderBy(time)
        d, x = bars.withColumn("_r", F.try_divide(value, F.lag(value).over(w)) - 1), "_r"
    agg = {"sum": F.sum(x), "mean": F.avg(x), "std": F.stddev_samp(x), "last": F.max_by(x, time), "rv": F.sum(F.col(x) * F.col(x))}[how]
    return d.groupBy(*keys).agg(agg.alias(f"{value}_{how}"))
