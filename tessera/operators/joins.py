"""Point-in-time joins: as-of, validity interval, event window, densify."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, tolerance_days: int | None = None, suffix: str = "_r", tie: list[str] | None = None, bucket_days: int | None = None) -> DataFrame:
    """Every left row with the latest right row of its key at or before its time, not older than
    the tolerance.  Of right rows at one time the last by ``tie`` (else by all columns) counts.
    Rows with a null key or time match nothing; right columns that clash get ``suffix``.

    Both sides are stacked and sorted once by key and time; the last right row is carried
    forward inside the key.  One exchange, no fan-out, and a long history costs only its own rows.
    Where one key holds a large part of all rows, ``bucket_days`` (with a tolerance) splits keys by
    time as well: a right row then goes to its own bucket and those that the tolerance reaches.
    """
    if bucket_days is not None and tolerance_days is None:
        raise ValueError("buckets need a tolerance")
    payload = [c for c in right.columns if c not in on]
    names = {c: c + suffix if c in left.columns else c for c in payload}
    order = tie or sorted(payload)
    r = right.where(F.col(right_time).isNotNull()).select(*on, F.col(right_time).alias("_t"), F.struct(*payload).alias("_p"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    lcols = F.struct(*(F.col(c) for c in left.columns))
    l = left.select(*on, F.col(left_time).alias("_t"), lcols.alias("_l"), F.lit(1).alias("_s"))  # noqa: E741
    split = list(on)
    if bucket_days is not None:
        days = F.datediff("_t", F.lit("1970-01-01").cast("date"))
        first, last = F.floor(days / bucket_days), F.floor((days + tolerance_days) / bucket_days)
        l, r, split = l.withColumn("_b", first), r.withColumn("_b", F.explode(F.sequence(first, last))), [*on, "_b"]  # noqa: E741
    both = l.unionByName(r.withColumn("_s", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*split).orderBy("_t", "_s", *(f"_o{i}" for i in range(len(order)))).rowsBetween(Window.unboundedPreceding, 0)
    keyed: Column = reduce(Column.__and__, (F.col(k).isNotNull() for k in on), F.col("_t").isNotNull())
    both = both.withColumn("_p", F.when(keyed, F.last("_p", ignorenulls=True).over(w))).where("_s = 1")
    if tolerance_days is not None:
        fresh = F.datediff("_t", F.col(f"_p.{right_time}")) <= tolerance_days
        both = both.withColumn("_p", F.when(fresh, F.col("_p")))
    return both.select("_l.*", *(F.col(f"_p.{c}").alias(n) for c, n in names.items()))


def align_sources(sources: list[DataFrame], on: list[str], time: str, tolerance_days: int | None = 365) -> DataFrame:
    """The first source is the backbone; each later one is attached as of its time."""
    return reduce(lambda a, b: asof_join(a, b.drop(*(c for c in b.columns if c in a.columns and c not in (*on, time))), on, time, time, tolerance_days).drop(f"{time}_r"), sources)


def interval_join(left: DataFrame, link: DataFrame, left_key: str | Column, link_key: str | Column, at: str, start: str, end: str, how: str = "inner", respect_end: bool = True) -> DataFrame:
    """Rows whose key and date fall into a validity interval, ends included; an open end never
    ends.  The key is the join's equality, so the range is a filter inside it.
    ``respect_end=False`` ignores ends, as one of the loaders did."""
    lk = F.col(left_key) if isinstance(left_key, str) else left_key
    rk = F.col(link_key) if isinstance(link_key, str) else link_key
    left, link = left.withColumn("_lk", lk), link.withColumn("_rk", rk)
    inside = F.col(at) >= F.col(start)
    if respect_end:
        inside = inside & (F.col(end).isNull() | (F.col(at) <= F.col(end)))
    return left.join(link, (F.col("_lk") == F.col("_rk")) & inside, how).drop("_lk", "_rk")


def band_join(left: DataFrame, right: DataFrame, on: str, left_date: str, right_date: str, low: int, high: int, how: str = "inner") -> DataFrame:
    """low <= left_date - right_date <= high in days, inside the key."""
    r = right.withColumnRenamed(on, "_k")
    days = F.datediff(left_date, right_date)
    return left.join(r, (F.col(on) == F.col("_k")) & days.between(low, high), how).drop("_k")


def months_join(left: DataFrame, right: DataFrame, on: str, left_date: str, right_date: str, first: int, past: int, how: str = "left") -> DataFrame:
    """left_date in the months from first to past - 1 after right_date's month."""
    r = right.withColumnRenamed(on, "_k")
    month = F.trunc(F.col(right_date), "MM")
    inside = (F.col(left_date) >= F.add_months(month, first)) & (F.col(left_date) < F.add_months(month, past))
    return left.join(r, (F.col(on) == F.col("_k")) & inside, how).drop("_k")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given, which should leave no ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def densify(df: DataFrame, entity: str, time: str, fill: dict[str, object] | None = None) -> DataFrame:
    """A row for every entity and time that occur; missing ones filled or null.

    The grid is the result itself, so it is as large as asked for; the times, one row a period,
    go to every task as an array, and each entity unfolds it.
    """
    times = df.select(time).distinct().groupBy().agg(F.sort_array(F.collect_set(time)).alias("_ts"))
    grid = df.select(entity).distinct().join(F.broadcast(times)).select(entity, F.explode("_ts").alias(time))
    out = grid.join(df, [entity, time], "left")
    return out.fillna(fill) if fill else out


def union_missing(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def without_overlap(right: DataFrame, left: DataFrame, keep: list[str]) -> DataFrame:
    """Right without columns that the left has, but for the keys."""
    return right.drop(*(c for c in right.columns if c in left.columns and c not in keep))
