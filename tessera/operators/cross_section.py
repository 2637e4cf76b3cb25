"""Cross-sections and universes: winsorised z-scores, demeaning, masks, top-n, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winsor_zscore(df: DataFrame, features: list[str], by: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Each feature cut at its group's linear quantiles, then standardised; 0 where the deviation
    is 0 or missing, NULL stays.  Quantiles are exact, one aggregation for all features, joined
    back on the group."""
    bounds = df.groupBy(*by).agg(*(F.percentile(f, F.array(F.lit(low), F.lit(high))).alias(f"_q_{f}") for f in features))
    d = df.join(bounds, by)
    d = d.withColumns({f: F.when(F.col(f).isNotNull(), F.least(F.greatest(F.col(f), F.col(f"_q_{f}")[0]), F.col(f"_q_{f}")[1])) for f in features})
    return zscore(d.drop(*(f"_q_{f}" for f in features)), features, by)


def winsorize(df: DataFrame, features: list[str], by: list[str], low: float | None = 0.01, high: float | None = 0.99) -> DataFrame:
    """Cut at one or both quantiles of the group."""
    bounds = df.groupBy(*by).agg(*(F.percentile(f, F.array(F.lit(low or 0.0), F.lit(1.0 if high is None else high))).alias(f"_q_{f}") for f in features))
    d = df.join(bounds, by)
    cut = {f: F.when(F.col(f).isNotNull(), F.least(F.greatest(F.col(f), F.col(f"_q_{f}")[0]), F.col(f"_q_{f}")[1])) for f in features}
    return d.withColumns(cut).drop(*(f"_q_{f}" for f in features))


def zscore(df: DataFrame, features: list[str], by: list[str], eps: float = 0.0) -> DataFrame:
    w = Window.partitionBy(*by)

    def score(f: str) -> Column:
        sd = F.stddev_samp(f).over(w)
        z = (F.col(f) - F.avg(f).over(w)) / (sd + eps)
        return F.when(F.coalesce(sd, F.lit(0.0)) + eps > 0, z).otherwise(F.col(f) * 0)

    return df.withColumns({f: score(f) for f in features})


def demean(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumns({f: F.col(f) - F.avg(f).over(w) for f in features})


def fit_scaler(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature over all rows, in one pass."""
    row = df.agg(*(e for f in features for e in (F.avg(f), F.stddev_pop(f)))).first()
    return {f: (row[2 * i] or 0.0, row[2 * i + 1] or 0.0) for i, f in enumerate(features)}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]], eps: float = 1e-6, bound: float | None = 5.0) -> DataFrame:
    def one(f: str, mean: float, sd: float) -> Column:
        z = (F.col(f) - mean) / (sd + eps)
        return z if bound is None else F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-bound)), F.lit(bound)))

    return df.withColumns({f: one(f, *m) for f, m in fitted.items()})


def universe_mask(df: DataFrame, universe: DataFrame, values: list[str], date: str = "date", entity: str = "ticker", flag: str = "in_univ") -> DataFrame:
    """Values kept where the entity is in the universe on that date, else NULL, on dates that both
    have; unchanged if they share no date."""
    days = universe.select(date).distinct()
    if df.join(days, date, "left_semi").isEmpty():
        return df
    inside = universe.where(F.col(flag) == 1).select(date, entity).distinct().withColumn("_in", F.lit(True))
    d = df.join(days, date, "left_semi").join(inside, [date, entity], "left")
    return d.withColumns({v: F.when(F.col("_in"), F.col(v)) for v in values}).drop("_in")


def universe_members(bars: DataFrame, universe: DataFrame, date: str = "date", entity: str = "ticker", flag: str = "in_univ") -> DataFrame:
    """Rows of the day's members; a day that the universe lacks keeps all its rows."""
    known = universe.select(date).distinct().withColumn("_known", F.lit(True))
    inside = universe.where(F.col(flag) == 1).select(date, entity).distinct().withColumn("_in", F.lit(True))
    d = bars.join(known, date, "left").join(inside, [date, entity], "left")
    return d.where("_known is null or _in").drop("_known", "_in")


def top_n(df: DataFrame, entity: str, size: Column, n: int, at: tuple[str, object] | None = None) -> DataFrame:
    """The n entities of largest summed size (on one date if ``at`` is given), ties by entity."""
    d = df if at is None else df.where(F.col(at[0]) == F.lit(at[1]))
    totals = d.withColumn("_s", size).where("_s is not null").groupBy(entity).agg(F.sum("_s").alias("size"))
    return totals.orderBy(F.col("size").desc(), entity).limit(n)


def in_universe(df: DataFrame, members: DataFrame, entity: str) -> DataFrame:
    return df.join(members.select(entity), entity, "left_semi")


def useful_features(df: DataFrame, features: list[str], most_missing: float = 0.3, least_sd: float = 1e-6) -> list[str]:
    """Features not too sparse nor constant (missing as 0), from one aggregation."""
    parts = [e for f in features for e in (F.avg(F.col(f).isNull().cast("double")), F.stddev_samp(F.coalesce(F.col(f).cast("double"), F.lit(0.0))))]
    row = df.agg(*parts).first()
    return [f for i, f in enumerate(features) if row[2 * i] is not None and row[2 * i] < most_missing and (row[2 * i + 1] or 0.0) > least_sd]


def tradable(df: DataFrame, price: str = "close", date: str = "date", entity: str = "ticker") -> DataFrame:
    """(date, entity) of every entity with a positive price on that date."""
    return df.where(F.col(price) > 0).select(date, entity).distinct()


def _shuffled(entity: Column, seed: int) -> Column:
    """An order by chance that a lost task finds again."""
    return F.md5(F.concat_ws("-", entity.cast("string"), F.lit(seed).cast("string")))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by chance (all, if fewer), the same ones at every run; ``key`` is unique."""
    return df.orderBy(_shuffled(F.col(key), seed), key).limit(n)


def monthly_batches(df: DataFrame, size: int, key: str, time: str = "date", seed: int = 42) -> DataFrame:
    """Rows of each month dealt by chance to batches of ``size``, the last one shorter: columns
    month and batch (from 0).  ``key`` is unique inside a month."""
    month = F.trunc(time, "MM")
    w = Window.partitionBy("month").orderBy(_shuffled(F.col(key), seed), key)
    return df.withColumn("month", month).withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
