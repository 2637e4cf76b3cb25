"""Characteristics that only the specification program defines: industry structure, health
scores, ratings, organisation capital, delisting, daily aggregates and weekly betas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import week_end
from tessera.functions.exprs import Layers, Panel, div, flag

#: Rating letters in order, 1 for the best.
RATINGS = "AAA AA+ AA AA- A+ A A- BBB+ BBB BBB- BB+ BB BB- B+ B B- CCC+ CCC CCC- CC C D".split()
#: Corporate tax rate from each fiscal year on, first match from the top.
TAX_RATES = [(1993, 0.35), (1988, 0.34), (1987, 0.40), (1979, 0.46), (0, 0.48)]
#: Consumer prices by year.
CPI = {
    2015: 236.53, 2014: 229.91, 2013: 229.17, 2012: 229.594, 2011: 224.939, 2010: 218.056, 2009: 214.537, 2008: 215.303, 2007: 207.342,
    2006: 201.6, 2005: 195.3, 2004: 188.9, 2003: 183.96, 2002: 179.88, 2001: 177.1, 2000: 172.2, 1999: 166.6, 1998: 163.00, 1997: 160.5,
    1996: 156.9, 1995: 152.4, 1994: 148.2, 1993: 144.5, 1992: 140.3, 1991: 136.2, 1990: 130.7, 1989: 124.00, 1988: 118.3, 1987: 113.6,
    1986: 109.6, 1985: 107.6, 1984: 103.9, 1983: 99.6, 1982: 96.5, 1981: 90.9, 1980: 82.4, 1979: 72.6, 1978: 65.2, 1977: 60.6,
    1976: 56.9, 1975: 53.8, 1974: 49.3,
}
#: Assumed delisting returns by exchange group, and the least possible return.
DELIST_LISTED, DELIST_OTHER, LEAST_RETURN = -0.35, -0.55, -1.0


def industry_structure(entity: str = "gvkey", time: str = "datadate", by: str = "fyear, sic2") -> Layers:
    """age, industry sales, Herfindahl concentration, in two window passes."""
    p = Panel(entity, time)
    return Layers({"age": p.row(), "indsale": f"sum(sale) OVER (PARTITION BY {by})"}, {"share_": div("sale", "indsale")}, {"herf": f"sum(share_ * share_) OVER (PARTITION BY {by})"})


def health_score(df: DataFrame, by: list[str], above: list[str], below: list[str]) -> DataFrame:
    """One point for each measure above (or below) its group's median; a missing one scores none."""
    names = above + below
    med = df.groupBy(*by).agg(*(F.percentile(c, 0.5).alias(f"md_{c}") for c in names))
    d = df.join(med, by, "left")
    points = [F.coalesce((F.col(c) > F.col(f"md_{c}")).cast("int"), F.lit(0)) for c in above]
    points += [F.coalesce((F.col(c) < F.col(f"md_{c}")).cast("int"), F.lit(0)) for c in below]
    return d.withColumn("ms", sum(points[1:], points[0])).drop(*(f"md_{c}" for c in names))


def rating_number(rating: Column) -> Column:
    """Ordinal of a rating letter, 0 for an unknown or missing one."""
    letters = F.create_map(*(F.lit(v) for i, r in enumerate(RATINGS) for v in (r, i + 1)))
    return F.coalesce(letters[rating], F.lit(0))


def tax_rate(year: Column) -> Column:
    out = F.lit(TAX_RATES[-1][1])
    for first, rate in reversed(TAX_RATES[:-1]):
        out = F.when(year >= first, rate).otherwise(out)
    return out


def with_cpi(df: DataFrame, year: str = "fyear") -> DataFrame:
    """Consumer prices of the year as ``cpi``; a table of a few dozen rows."""
    prices = F.create_map(*(F.lit(v) for pair in sorted(CPI.items()) for v in pair))
    return df.withColumn("cpi", prices[F.col(year)])


def industry_momentum(time: str = "date", industry: str = "sic2") -> Layers:
    return Layers({"indmom": f"avg(mom12m) OVER (PARTITION BY {industry}, {time})"})


def announcement_factors(daily: DataFrame, events: DataFrame, entity: str = "permno", date: str = "date", announced: str = "rdq") -> DataFrame:
    """Abnormal volume and return around announcements, in weekdays: volume from one before to
    one after against the mean from 30 to 10 before, and the sum of returns.  Days of a window
    are spelled out for each event, so both are equality joins."""
    from tessera.functions.dates import add_weekdays

    e = events.select(entity, announced).where(F.col(announced).isNotNull()).distinct()
    d = daily.select(entity, F.col(date).cast("date").alias("_d"), "vol", "ret")

    def window(first: int, last: int, *aggs):
        days = e.withColumn("_d", F.explode(F.sequence(add_weekdays(F.col(announced), first), add_weekdays(F.col(announced), last))))
        return days.join(d, [entity, "_d"], "left").groupBy(entity, announced).agg(*aggs)

    before = window(-30, -10, F.avg("vol").alias("avgvol"))
    around = window(-1, 1, F.avg("vol").alias("_v"), F.sum("ret").alias("ear"))
    out = around.join(before, [entity, announced])
    return out.select(entity, announced, F.try_divide(F.col("_v") - F.col("avgvol"), F.col("avgvol")).alias("aeavol"), "ear")


def organisation_capital(df: DataFrame, entity: str, time: str, spend: str = "xsga", price: str = "cpi", decay: float = 0.15, growth: float = 0.10, assets: str | None = "at") -> DataFrame:
    """Perpetual inventory of real spending: the first year's over (growth + decay), then
    depreciated and added to; over assets if given.  The recursion is a sum of decayed terms:
    both factors are window sums of x / (1 - decay)^n, so no row waits for another."""
    w = Window.partitionBy(entity).orderBy(time)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_x", F.coalesce(F.try_divide(spend, price), F.lit(0.0))).withColumn("_n", F.row_number().over(w) - 1)
    first = F.when(F.col("_n") == 0, F.col("_x") / (growth + decay)).otherwise(F.col("_x"))
    d = d.withColumn("orgcap", F.sum(first / F.pow(F.lit(1 - decay), "_n")).over(so_far) * F.pow(F.lit(1 - decay), "_n"))
    if assets:
        d = d.withColumn("orgcap", F.try_divide("orgcap", assets))
    return d.drop("_x", "_n")


def delisting_return(ret: Column, dlret: Column, code: Column, exchange: Column) -> Column:
    """Return plus the delisting's, alone where the return is missing.  A performance delisting
    without a return gets its exchange group's; none is below a total loss."""
    performance = (code == 500) | code.between(520, 584)
    known = F.when(dlret.isNotNull(), F.greatest(dlret, F.lit(LEAST_RETURN)))
    assumed = F.when(performance & exchange.isin(1, 2), DELIST_LISTED).when(performance & (exchange == 3), DELIST_OTHER).otherwise(0.0)
    extra = F.coalesce(known, assumed)
    return F.when(ret.isNull() & (extra != 0), extra).otherwise(ret + extra)


def monthly_from_daily(daily: DataFrame, entity: str = "permno", time: str = "date", ratio=F.try_divide, log=F.log) -> DataFrame:
    """Nine measures of each month of daily data, one aggregation.  ``ratio`` and ``log`` decide the
    days without dollar volume: by default they are missing in ``ill`` and ``std_dolvol``."""
    dollar = F.abs("prc") * F.col("vol")
    spread = (F.col("askhi") - F.col("bidlo")) / ((F.col("askhi") + F.col("bidlo")) / 2)
    return daily.groupBy(entity, F.year(time).alias("year"), F.month(time).alias("month")).agg(
        F.max("ret").alias("maxret"),
        F.stddev_samp("ret").alias("retvol_d"),
        F.avg(F.when(F.col("askhi") + F.col("bidlo") > 0, spread)).alias("baspread"),
        F.stddev_samp(log(dollar)).alias("std_dolvol"),
        F.stddev_samp(F.try_divide("vol", "shrout")).alias("std_turn"),
        F.avg(ratio(F.abs("ret"), dollar)).alias("ill"),
        F.count_if(F.col("vol") == 0).alias("countzero"),
        F.count("*").alias("ndays"),
        F.sum(F.try_divide("vol", "shrout")).alias("turn_d"),
    )


def zero_trade(deflator: float = 480000.0) -> Layers:
    return Layers({"zerotrade": f"(countzero + {div('1 / nullif(turn_d, 0)', repr(deflator) + 'e0')}) * 21.0e0 / ndays"})


def weekly_returns(daily: DataFrame, entity: str = "permno", time: str = "date") -> DataFrame:
    """Returns compounded over weeks that end on Saturday."""
    return daily.where("ret > -1").groupBy(entity, week_end(F.col(time)).alias("week")).agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("wkret"), F.count("ret").alias("n"))


def market_beta(weekly: DataFrame, entity: str = "permno", time: str = "week", weeks: int = 156, least: int = 52) -> DataFrame:
    """beta, betasq, idiovol of weekly returns on the equal-weighted market over trailing weeks."""
    d = weekly.withColumn("ewmkt", F.avg("wkret").over(Window.partitionBy(time)))
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(1 - weeks, 0)
    n = F.count("wkret").over(w)
    slope, r2, sd = F.regr_slope("wkret", "ewmkt").over(w), F.regr_r2("wkret", "ewmkt").over(w), F.stddev_samp("wkret").over(w)
    d = d.withColumns({"n_": n, "b_": slope, "r2_": r2, "sd_": sd}).where(F.col("n_") >= least)
    # Residual deviation with the regression's two degrees of freedom.
    resid = F.col("sd_") * F.sqrt(F.greatest(1 - F.col("r2_"), F.lit(0.0)) * (F.col("n_") - 1) / (F.col("n_") - 2))
    return d.withColumns({"beta": F.col("b_"), "betasq": F.col("b_") ** 2, "idiovol": resid}).drop("n_", "b_", "sd_", "r2_")


def calendar_beta(weekly: DataFrame, months: DataFrame, entity: str = "permno", week: str = "week", month: str = "date", back: int = 36, least: int = 52) -> DataFrame:
    """(entity, month, n_weeks, beta, betasq, idiovol) over the weeks whose end lies from the first day of
    the ``back``-th month before a month to the first day of the month before it.

    Weeks and months are stacked on one scale, two steps a calendar month (its first day, and the
    rest), on which the window is a RANGE frame of fixed width: one sort, and no join of ranges."""
    d = weekly.where("wkret IS NOT NULL").withColumn("ewmkt", F.avg("wkret").over(Window.partitionBy(week)))

    def step(day: Column) -> Column:
        return 2 * (F.year(day) * 12 + F.month(day))

    weeks = d.select(entity, (step(F.col(week)) + F.when(F.dayofmonth(week) > 1, 1).otherwise(0)).alias("_s"), F.lit(None).cast("date").alias(month), "wkret", "ewmkt")
    asked = months.select(entity, (step(F.col(month)) - 2).alias("_s"), F.col(month).cast("date").alias(month), F.lit(None).cast("double").alias("wkret"), F.lit(None).cast("double").alias("ewmkt")).distinct()
    w = Window.partitionBy(entity).orderBy("_s").rangeBetween(-2 * (back - 1), 0)
    n, r2, sd = F.count("wkret").over(w), F.regr_r2("wkret", "ewmkt").over(w), F.stddev_samp("wkret").over(w)
    out = weeks.unionByName(asked).withColumns({"n_weeks": n, "beta": F.regr_slope("wkret", "ewmkt").over(w), "_r2": r2, "_sd": sd})
    out = out.where(F.col(month).isNotNull() & (F.col("n_weeks") >= least))
    resid = F.col("_sd") * F.sqrt(F.greatest(1 - F.col("_r2"), F.lit(0.0)) * (F.col("n_weeks") - 1) / (F.col("n_weeks") - 2))
    return out.select(entity, month, "n_weeks", "beta", (F.col("beta") ** 2).alias("betasq"), resid.alias("idiovol"))


def price_delay(weekly: DataFrame, entity: str = "permno", time: str = "week", lags: int = 4) -> DataFrame:
    """1 - R2 of the market alone over R2 with its lags, adjusted.  The normal equations of each
    entity come from grouped sums; a small system is then solved for each row."""
    m = weekly.select(time, "wkret").groupBy(time).agg(F.avg("wkret").alias("x0"))
    w = Window.orderBy(time)  # one row a week
    m = m.withColumns({f"x{k}": F.lag("x0", k).over(w) for k in range(1, lags + 1)}).dropna()
    names = ["one", *(f"x{k}" for k in range(lags + 1))]
    d = weekly.join(m, time).withColumn("one", F.lit(1.0)).withColumn("y", F.col("wkret"))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate([*names, "y"]) for b in [*names, "y"][i:]]
    s = d.groupBy(entity).agg(*sums)
    kind = s.schema[entity].dataType.simpleString()

    def solve(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                g = lambda a, b: r[f"{a}_{b}"] if f"{a}_{b}" in r else r[f"{b}_{a}"]
                n, tss = r["one_one"], r["y_y"] - r["one_y"] ** 2 / r["one_one"]
                adj = []
                for use in (names[:2], names):
                    A = np.array([[g(a, b) for b in use] for a in use], float)
                    v = np.array([g(a, "y") for a in use], float)
                    beta = np.linalg.lstsq(A, v, rcond=None)[0]
                    k = len(use) - 1
                    adj.append(1 - (r["y_y"] - beta @ v) / tss * (n - 1) / (n - k - 1) if tss > 0 and n > k + 1 else np.nan)
                out.append((r[entity], 1 - adj[0] / adj[1] if adj[1] else np.nan))
            yield pd.DataFrame(out, columns=[entity, "pricedelay"])

    return s.mapInPandas(solve, f"{entity} {kind}, pricedelay double")


def analyst_changes(entity: str, time: str) -> Layers:
    """Changes of forecasts, recommendations and coverage against earlier months."""
    p = Panel(entity, time)
    return Layers({"chfeps": f"meanest - {p.lag('meanest')}", "chrec": f"meanrec - {p.lag('meanrec')}", "chnanalyst": f"numest - {p.lag('numest', 3)}", "disp": div("stdev", "abs(meanest)"), "sfe": div("meanest", "abs(prc)")})


def forecast_levels(time: str, since: int = 1989) -> Layers:
    """Standardised surprise (from forecasts where there are any, else from the change of earnings),
    dispersion with a floor for a mean of zero, coverage and long-term growth, which count as none from
    the year on in which the source covers all firms."""
    covered = f"year({time}) >= {since}"
    return Layers(
        {
            "sue": f"CASE WHEN medest IS NULL OR actual IS NULL THEN {div('che', 'mveq')} ELSE {div('actual - medest', 'abs(prccq)')} END",
            "disp": f"CASE WHEN meanest = 0 THEN stdev / 0.01e0 ELSE {div('stdev', 'abs(meanest)')} END",
            "nanalyst": f"CASE WHEN numest IS NULL AND {covered} THEN 0 ELSE numest END",
            "ltg": f"CASE WHEN {covered} THEN {flag('fgr5yr IS NOT NULL')} END",
            "sfe": div("meanest", "abs(prccq)"),
        }
    )


def announcement_month(month: Column, announced: Column) -> Column:
    return F.coalesce((F.trunc(month, "MM") == F.trunc(announced, "MM")).cast("int"), F.lit(0))


def enough_history(names: dict[str, int], entity: str, time: str) -> Layers:
    """Factors that need k earlier rows are NULL on an entity's first k rows."""
    p = Panel(entity, time)
    return Layers({"row_": p.row()}, {n: f"CASE WHEN row_ > {k} THEN {n} END" for n, k in names.items()})


def downgrade(entity: str, time: str) -> Layers:
    return Layers({"credrat_dwn": flag(f"credrat > {Panel(entity, time).lag('credrat')}")})
