"""Graph operators on edge lists (i, j, w) and long series (t, i, f), with their statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_corr(x: str, y: str) -> Column:
    """Pearson's correlation; NULL where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_ranks(series: DataFrame, by: str = "i", value: str = "f") -> DataFrame:
    """Ranks with ties at their mean, for rank correlation."""
    w = Window.partitionBy(by).orderBy(value)
    ties = Window.partitionBy(by, value)
    return series.withColumn(value, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)


def correlation_graph(series: DataFrame, threshold: float, method: str = "pearson") -> DataFrame:
    """Edges i < j whose absolute correlation over common times exceeds the threshold.

    The pairs of a time are those of its cross-section, which is what the graph is made of.
    """
    s = average_ranks(series) if method == "spearman" else series
    a, b = s.select("t", "i", F.col("f").alias("x")), s.select("t", F.col("i").alias("j"), F.col("f").alias("y"))
    pairs = a.join(b, "t").where("i < j").groupBy("i", "j").agg(F.abs(guarded_corr("x", "y")).alias("w"))
    return pairs.where(F.col("w") > threshold)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j", "w").unionAll(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def laplacian(edges: DataFrame) -> DataFrame:
    """(i, j, l) of degree minus adjacency from directed edges, diagonal included."""
    e = edges.where("i <> j")
    return e.groupBy("i").agg(F.sum("w").alias("l")).select("i", F.col("i").alias("j"), "l").unionAll(e.select("i", "j", (-F.col("w")).alias("l")))


def force(edges: DataFrame, series: DataFrame) -> DataFrame:
    """(t, i, f, force, stiffness): -2 L f and 2 diag(L), from directed edges."""
    reached = edges.join(series.select("t", F.col("i").alias("j"), F.col("f").alias("fj")), "j")
    pull = reached.groupBy("t", "i").agg(F.sum("w").alias("deg"), F.sum(F.col("w") * F.col("fj")).alias("pull"))
    d = series.join(pull, ["t", "i"], "left").fillna({"deg": 0.0, "pull": 0.0})
    return d.select("t", "i", "f", (-2.0 * (F.col("deg") * F.col("f") - F.col("pull"))).alias("force"), (2.0 * F.col("deg")).alias("stiffness"))


def euler_forecast(edges: DataFrame, series: DataFrame, dt: float, horizon: int = 1) -> DataFrame:
    """Prediction f - h dt L f against the value h rows on: (t, i, f, pred, actual)."""
    d = force(edges, series).withColumn("pred", F.col("f") + F.col("force") / 2 * (horizon * dt))
    actual = F.lead("f", horizon).over(Window.partitionBy("i").orderBy("t"))
    return d.withColumn("actual", actual).where("actual is not null").select("t", "i", "f", "pred", "actual")


def forecast_errors(pred: DataFrame) -> DataFrame:
    right = F.signum(F.col("pred") - F.col("f")) == F.signum(F.col("actual") - F.col("f"))
    e = F.col("pred") - F.col("actual")
    return pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(right.cast("double")).alias("direction_accuracy"))


def top_k_edges(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k heaviest edges (ties by partner), symmetrised by the mean of both halves."""
    w = Window.partitionBy("i").orderBy(F.col("w").desc(), "j")
    kept = edges.where("i <> j").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return both_ways(kept.select("i", "j", (F.col("w") / 2).alias("w"))).groupBy("i", "j").agg(F.sum("w").alias("w"))


def fuse_prior(prior: DataFrame, edges: DataFrame, alpha: float) -> DataFrame:
    parts = prior.select("i", "j", (F.col("w") * alpha).alias("w")).unionAll(edges.select("i", "j", (F.col("w") * (1 - alpha)).alias("w")))
    return parts.groupBy("i", "j").agg(F.sum("w").alias("w"))


def similarity(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Of two undirected edge lists (i < j) on n nodes: correlation of all pair weights, Jaccard,
    cosine, and their mean.  Pairs without an edge weigh 0 and enter through their number."""
    d = a.select("i", "j", F.col("w").alias("x")).join(b.select("i", "j", F.col("w").alias("y")), ["i", "j"], "full").fillna({"x": 0.0, "y": 0.0})
    m = float(n * (n - 1) // 2)
    s = d.agg(*(F.coalesce(F.sum(e), F.lit(0.0)).alias(k) for k, e in {"sx": F.col("x"), "sy": F.col("y"), "xx": F.col("x") ** 2, "yy": F.col("y") ** 2, "xy": F.col("x") * F.col("y")}.items()),
              F.count_if(F.expr("x > 0 and y > 0")).alias("both"), F.count_if(F.expr("x > 0 or y > 0")).alias("any"))
    cov = F.col("xy") - F.col("sx") * F.col("sy") / m
    corr = F.try_divide(cov, F.sqrt((F.col("xx") - F.col("sx") ** 2 / m) * (F.col("yy") - F.col("sy") ** 2 / m)))
    s = s.select(F.coalesce(corr, F.lit(0.0)).alias("correlation"), F.coalesce(F.try_divide(F.col("both").cast("double"), F.col("any")), F.lit(0.0)).alias("jaccard"), F.coalesce(F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0)).alias("cosine"))
    return s.withColumn("similarity", (F.col("correlation") + F.col("jaccard") + F.col("cosine")) / 3)


def window_correlations(series: DataFrame, window: int, step: int) -> DataFrame:
    """(start, i, j, w): absolute correlation of every pair i < j over the times start .. start +
    window - 1, for the starts 0, step, 2 step, .. of whole windows; NULL where a side is constant.

    Products are summed once in blocks of the greatest length that divides window and step; a window is
    a RANGE frame over its blocks.  So a row is shuffled once, however much windows overlap."""
    g = math.gcd(window, step)
    centred = series.join(series.groupBy("i").agg(F.avg("f").alias("_m")), "i").select("t", "i", (F.col("f") - F.col("_m")).alias("f"))
    a, b = centred.select("t", "i", F.col("f").alias("x")), centred.select("t", F.col("i").alias("j"), F.col("f").alias("y"))
    sums = {"n": F.count("*"), "x": F.sum("x"), "y": F.sum("y"), "xx": F.sum(F.col("x") ** 2), "yy": F.sum(F.col("y") ** 2), "xy": F.sum(F.col("x") * F.col("y"))}
    ends = {"x0": F.min("x"), "x1": F.max("x"), "y0": F.min("y"), "y1": F.max("y")}
    blocks = a.join(b, "t").where("i < j").groupBy("i", "j", F.floor(F.col("t") / g).cast("int").alias("block")).agg(*(e.alias(k) for k, e in {**sums, **ends}.items()))
    last = series.agg(F.max("t")).first()[0]
    starts = list(range(0, (last if last is not None else -1) - window + 1, step))
    blank = blocks.select("i", "j").distinct().withColumn("block", F.explode(F.lit([x // g for x in starts]).cast("array<int>"))).withColumn("_start", F.lit(True))
    both = blocks.withColumn("_start", F.lit(False)).unionByName(blank, allowMissingColumns=True)
    w = Window.partitionBy("i", "j").orderBy("block").rangeBetween(0, window // g - 1)
    both = both.withColumns({k: F.sum(k).over(w) for k in sums} | {k: (F.min if k.endswith("0") else F.max)(k).over(w) for k in ends}).where("_start")
    cov = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    spread = F.sqrt((F.col("xx") - F.col("x") ** 2 / F.col("n")) * (F.col("yy") - F.col("y") ** 2 / F.col("n")))
    corr = F.when((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")), F.abs(F.try_divide(cov, spread)))
    return both.where("n > 0").select((F.col("block") * g).alias("start"), "i", "j", corr.alias("w"))


def stability(series: DataFrame, window: int, step: int, threshold: float) -> DataFrame:
    """Similarity of the correlation graphs of successive windows of times 0, step, 2 step, ..:
    (window, similarity to the one before).  t counts from 0."""
    last = series.agg(F.max("t")).first()[0] or 0
    e = window_correlations(series, window, step).where(F.col("w") > threshold)
    prev = e.select((F.col("start") + step).alias("start"), "i", "j", F.col("w").alias("v"))
    both = e.join(prev, ["start", "i", "j"], "full").fillna({"w": 0.0, "v": 0.0})
    out = both.groupBy("start").agg(F.try_divide(F.count_if(F.expr("w > 0 and v > 0")).cast("double"), F.count("*")).alias("jaccard"), F.try_divide(F.sum(F.col("w") * F.col("v")), F.sqrt(F.sum(F.col("w") ** 2) * F.sum(F.col("v") ** 2))).alias("cosine"))
    return out.where((F.col("start") > 0) & (F.col("start") + window <= last))


def information_coefficients(pairs: DataFrame, by: str = "t", x: str = "x", y: str = "y") -> DataFrame:
    """Correlation in each cross-section (or series); 0 where a side is flat."""
    flat = (F.stddev_pop(x) < 1e-8) | (F.stddev_pop(y) < 1e-8)
    return pairs.groupBy(by).agg(F.when(flat, 0.0).otherwise(F.coalesce(guarded_corr(x, y), F.lit(0.0))).alias("ic"), F.count("*").alias("n"))


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / ((1.0 + num * d) or tiny)
                c = (1.0 + num / c) or tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return h

    if x < (a + 1.0) / (a + b + 2.0):
        return front * fraction(x, a, b) / a
    return 1.0 - front * fraction(1.0 - x, b, a) / b


def student_p(t: float, df: int) -> float:
    """Two-sided p-value of a t statistic."""
    return _beta_share(df / (df + t * t), df / 2.0, 0.5)


def f_p(f: float, df1: int, df2: int) -> float:
    """Upper p-value of an F statistic."""
    return _beta_share(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0) if f > 0 else 1.0


#: MacKinnon's approximation (1994) for one series with a constant: below the first
#: bound p is 0, above the last 1; polynomials of the statistic up to the middle bound and beyond.
ADF_BOUNDS, ADF_LOW, ADF_HIGH = (-18.83, -1.61, 2.74), (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def dickey_fuller_p(t: float) -> float:
    """Approximate p-value of a unit-root statistic, the normal share of a polynomial in it."""
    if not ADF_BOUNDS[0] <= t <= ADF_BOUNDS[2]:
        return math.nan if math.isnan(t) else float(t > 0)
    z = sum(c * t**k for k, c in enumerate(ADF_LOW if t <= ADF_BOUNDS[1] else ADF_HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean, population deviation, ratio, share above zero, one-sample t."""
    n = F.count("ic").cast("double")
    d = ics.agg(n.alias("n"), F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("win_rate"), F.stddev_samp("ic").alias("_s"))
    return d.select("n", "ic_mean", "ic_std", F.try_divide("ic_mean", "ic_std").alias("ic_ir"), "win_rate", F.try_divide(F.col("ic_mean") * F.sqrt("n"), F.col("_s")).alias("t_stat"))


def regression_through_origin(pairs: DataFrame, by: list[str] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """beta = sum xy / sum xx, r2 = 1 - residual over total sum of squares about the mean."""
    X, Y = F.col(x), F.col(y)
    d = pairs.groupBy(*(by or [])).agg(F.sum(X * Y).alias("xy"), F.sum(X * X).alias("xx"), F.sum(Y * Y).alias("yy"), F.sum(Y).alias("sy"), F.count("*").alias("n"))
    beta = F.try_divide("xy", "xx")
    left = F.col("yy") - 2 * beta * F.col("xy") + beta * beta * F.col("xx")
    return d.select(*(by or []), beta.alias("beta"), (1 - F.try_divide(left, F.col("yy") - F.col("sy") ** 2 / F.col("n"))).alias("r2"), "n")


def cluster_agreement(labels: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(nmi, ari, purity) in closed form from the contingency counts."""
    c = labels.groupBy(truth, pred).agg(F.count("*").cast("double").alias("n"))
    n = F.sum("n").over(Window.partitionBy())
    c = c.withColumns({"all": n, "a": F.sum("n").over(Window.partitionBy(truth)), "b": F.sum("n").over(Window.partitionBy(pred)), "top": F.max("n").over(Window.partitionBy(pred))})

    def two(x: Column) -> Column:
        return x * (x - 1) / 2

    p = F.col("n") / F.col("all")
    s = c.agg(
        F.sum(p * F.log(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))).alias("mi"),
        F.sum(-p * F.log(F.col("a") / F.col("all"))).alias("ha"),
        F.sum(-p * F.log(F.col("b") / F.col("all"))).alias("hb"),
        F.sum(two(F.col("n"))).alias("ij"),
        F.sum(two(F.col("a")) * F.col("n") / F.col("a")).alias("i"),
        F.sum(two(F.col("b")) * F.col("n") / F.col("b")).alias("j"),
        F.sum(F.col("top") * F.col("n") / F.col("b")).alias("pure"),
        F.max("all").alias("all"),
    )
    expected = F.try_divide(F.col("i") * F.col("j"), two(F.col("all")))
    ari = F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected)
    nmi = F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2)
    return s.select(F.coalesce(nmi, F.lit(1.0)).alias("nmi"), F.coalesce(ari, F.lit(1.0)).alias("ari"), (F.col("pure") / F.col("all")).alias("purity"))


def edge_scores(pred: DataFrame, truth: DataFrame, n: int, threshold: float = 0.0) -> DataFrame:
    """Counts and scores of predicted edges (i < j) over all pairs of n nodes."""
    d = pred.where(F.col("w") > threshold).select("i", "j", F.lit(1).alias("p")).join(truth.where("w > 0").select("i", "j", F.lit(1).alias("t")), ["i", "j"], "full").fillna(0)
    d = d.agg(*(F.coalesce(F.sum(e.cast("long")), F.lit(0)).alias(k) for k, e in {"tp": F.col("p") * F.col("t"), "fp": F.col("p") * (1 - F.col("t")), "fn": (1 - F.col("p")) * F.col("t")}.items()))
    d = d.withColumn("tn", F.lit(n * (n - 1) // 2) - F.col("tp") - F.col("fp") - F.col("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return d.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def hurst(series: DataFrame, longest: int, by: str = "i") -> DataFrame:
    """Twice the slope of log deviation root against log lag, lags 2 to ``longest`` - 1."""
    w = Window.partitionBy(by).orderBy("t")
    lags = {f"d{k}": F.col("f") - F.lag("f", k).over(w) for k in range(2, longest)}
    wide = series.withColumns(lags).groupBy(by).agg(*(F.sqrt(F.stddev_pop(k)).alias(k) for k in lags))
    long = wide.unpivot([by], list(lags), "lag", "tau").withColumn("lag", F.expr("int(substring(lag, 2))")).where("tau > 0")
    return long.groupBy(by).agg((2 * F.regr_slope(F.log("tau"), F.log("lag"))).alias("hurst"))


def bounded_nodes(series: DataFrame, most: int) -> None:
    """Raises where a matrix of one row a node would not fit the driver."""
    n = series.select("i").distinct().limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} nodes; choose a universe first or raise the bound")


def granger(series: DataFrame, pairs: DataFrame, lags: int = 1) -> DataFrame:
    """(i, j, f_stat, p): whether the past of i helps to predict j, for the pairs asked for."""
    return granger_lags(series, pairs, [lags]).drop("lag")


def granger_lags(series: DataFrame, pairs: DataFrame, lags: list[int]) -> DataFrame:
    """(i, j, lag, f_stat, p) for the pairs asked for at each number of lags.  A pair's two series,
    one row a time, meet in one group, which serves all lags; the groups are spread over the cluster."""
    a = pairs.join(series.select("t", "i", F.col("f").alias("x")), "i").join(series.select("t", F.col("i").alias("j"), F.col("f").alias("y")), ["t", "j"])

    def test(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("t")
        x, y, out = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), []
        for lag in lags:
            n = len(y) - lag
            stat, p = float("nan"), float("nan")
            if n > 2 * lag + 1:
                own = np.column_stack([np.ones(n), *(y[lag - k : len(y) - k] for k in range(1, lag + 1))])
                full = np.column_stack([own, *(x[lag - k : len(x) - k] for k in range(1, lag + 1))])
                rss = [float(((y[lag:] - m @ np.linalg.lstsq(m, y[lag:], rcond=None)[0]) ** 2).sum()) for m in (own, full)]
                free = n - full.shape[1]
                if rss[1] > 0:
                    stat = (rss[0] - rss[1]) / lag / (rss[1] / free)
                    p = f_p(stat, lag, free)
            out.append((*key, lag, stat, p))
        return pd.DataFrame(out, columns=["i", "j", "lag", "f_stat", "p"])

    kind = series.schema["i"].dataType.simpleString()
    return a.groupBy("i", "j").applyInPandas(test, f"i {kind}, j {kind}, lag int, f_stat double, p double")


def granger_graph(series: DataFrame, pairs: DataFrame, longest: int = 5, alpha: float = 0.05) -> DataFrame:
    """Directed edges (i, j, w) where the past of i helps to predict j at some lag up to
    ``longest``: the least p of the lags is below ``alpha``, and the weight is 1 - p."""
    tests = granger_lags(series, pairs, list(range(1, longest + 1)))
    least = tests.where("not isnan(p)").groupBy("i", "j").agg(F.min("p").alias("p"))
    return least.where(F.col("p") < alpha).select("i", "j", (1 - F.col("p")).alias("w"))


def dickey_fuller(series: DataFrame, by: str = "i", lags: int = 1) -> DataFrame:
    """(i, adf, p): t statistic of the lagged level with intercept and lagged differences; below
    about -2.86 the unit root is rejected at 5 %.  p by ``dickey_fuller_p``."""

    def test(key, pdf):
        import numpy as np
        import pandas as pd

        f = pdf.sort_values("t")["f"].to_numpy(float)
        d = np.diff(f)
        n, out = len(d) - lags, float("nan")
        if n > lags + 3:
            m = np.column_stack([np.ones(n), f[lags : len(f) - 1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1))])
            beta = np.linalg.lstsq(m, d[lags:], rcond=None)[0]
            rest = d[lags:] - m @ beta
            cov = np.linalg.pinv(m.T @ m) * (rest @ rest) / (n - m.shape[1])
            out = float(beta[1] / math.sqrt(cov[1, 1])) if cov[1, 1] > 0 else float("nan")
        return pd.DataFrame({by: [key[0]], "adf": [out], "p": [dickey_fuller_p(out)]})

    return series.select("t", by, "f").groupBy(by).applyInPandas(test, f"{by} {series.schema[by].dataType.simpleString()}, adf double, p double")
