"""Calendar arithmetic: next trading day, cut-offs, month and weekday offsets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_trading_day(df: DataFrame, calendar: DataFrame, date: str, out: str = "next_td", day: str = "date") -> DataFrame:
    """First calendar day strictly after ``date``; NULL past the last; one day later if the
    calendar is empty.  The calendar is turned into a lookup by day, its gaps filled, so that the
    join is an equality; it has one row a day at most."""
    days = calendar.select(F.col(day).cast("date").alias("d")).where("d is not null").distinct()
    if days.isEmpty():
        return df.withColumn(out, F.date_add(F.col(date).cast("date"), 1))
    following = days.withColumn("n", F.lead("d").over(Window.orderBy("d"))).where("n is not null")
    lookup = following.select(F.explode(F.expr("sequence(d, date_sub(n, 1))")).alias("_d"), F.col("n").alias(out))
    first = days.agg(F.min("d")).first()[0]
    found = df.withColumn("_day", F.col(date).cast("date")).join(F.broadcast(lookup), F.col("_day") == F.col("_d"), "left")
    return found.withColumn(out, F.when(F.col("_day") < F.lit(first), F.lit(first)).otherwise(F.col(out))).drop("_d", "_day")


def completeness_cutoffs(today: dt.date) -> dict[str, dt.date]:
    """Last day of the last full year, quarter and month before ``today``."""
    day = dt.timedelta(days=1)
    quarter = today.replace(month=3 * ((today.month - 1) // 3) + 1, day=1)
    return {"year": today.replace(month=1, day=1) - day, "quarter": quarter - day, "month": today.replace(day=1) - day}


def month_shift(date: Column, n: int, align: str = "beginning") -> Column:
    """First (or last, with ``end``) day of the month n months on."""
    moved = F.add_months(F.trunc(date, "MM"), n)
    return F.last_day(moved) if align == "end" else moved


def add_weekdays(date: Column, n: int) -> Column:
    """n weekdays on, or back if negative; a weekend counts as the Friday before it."""
    k = F.weekday(date)
    friday, at = F.date_sub(date, F.greatest(k - 4, F.lit(0))), F.least(k, F.lit(4))
    return F.date_add(friday, (F.floor((at + n) / 5) * 2 + n).cast("int"))


def week_end(date: Column) -> Column:
    """Saturday of the week that starts on Sunday."""
    return F.date_add(date, (7 - F.dayofweek(date)).cast("int"))


def available_annual(datadate: str = "datadate", filed: str = "filedate", days: int = 90) -> Column:
    return F.coalesce(F.col(filed), F.date_add(datadate, days))


def available_quarterly(datadate: str = "datadate", reported: str = "rdq", days: int = 45) -> Column:
    return F.coalesce(F.col(reported), F.date_add(datadate, days))


def split_date(start: dt.date, end: dt.date, share: float) -> dt.date:
    """Day that splits a range of days by a share."""
    return start + dt.timedelta(days=int((end - start).days * share))
