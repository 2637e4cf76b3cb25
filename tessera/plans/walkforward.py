"""Walk-forward evaluation, grids and best-of selection."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def month_windows(panel: DataFrame, lookback: int, time: str = "date") -> DataFrame:
    """(month, train_start, train_end) for each month with a full lookback; one row a month."""
    months = panel.select(F.trunc(time, "MM").alias("month")).distinct()
    first = months.agg(F.min("month")).first()[0]
    d = months.withColumns({"train_start": F.add_months("month", -lookback), "train_end": F.add_months("month", -1)})
    return d.where(F.col("train_start") >= F.lit(first))


def training_rows(panel: DataFrame, windows: DataFrame, time: str = "date") -> DataFrame:
    """Panel rows with each month they train for: each row unfolds into its own few windows, so
    all windows are one job and no range join is needed."""
    w = windows.select("month").distinct()
    lookback = F.expr("sequence(1, n)")
    n = windows.select(F.max(F.months_between("month", "train_start")).cast("int")).first()[0] or 0
    d = panel.withColumn("n", F.lit(n)).withColumn("_k", F.explode(lookback) if n else F.lit(None))
    d = d.withColumn("month", F.expr(f"cast(add_months(trunc({time}, 'MM'), _k) as date)")).drop("n", "_k")
    return d.join(w, "month", "left_semi")


def year_windows(first: int, last: int, train: int, test: int) -> list[tuple[int, int, int, int]]:
    """(train from, train to, test from, test to), sliding by the test length."""
    return [(y, y + train - 1, y + train, min(y + train + test - 1, last)) for y in range(first, last - train + 1, test)]


def day_windows(total: int, train: int, test: int) -> list[tuple[int, int, int, int]]:
    return [(a, a + train, a + train, min(a + train + test, total)) for a in range(0, total - train, test)]


def grid(options: Mapping[str, Iterable]) -> list[dict]:
    return [dict(zip(options, values)) for values in itertools.product(*options.values())]


def run_grid(points: list[dict], experiment: Callable[[dict], DataFrame]) -> DataFrame:
    """One row of measures for each point, tagged with its parameters; a single plan."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (experiment(p).withColumns({k: F.lit(v) for k, v in p.items()}) for p in points))


def best_by(results: DataFrame, by: list[str], measure: str) -> DataFrame:
    """The row of the largest measure of each group; ties by all other columns."""
    rest = [c for c in results.columns if c not in (*by, measure)]
    w = Window.partitionBy(*by).orderBy(F.col(measure).desc_nulls_last(), *rest)
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stitch(tests: list[DataFrame], keys: list[str]) -> DataFrame:
    """Test slices as one out-of-sample run; where slices overlap the later one counts."""
    d = reduce(DataFrame.unionByName, (t.withColumn("_s", F.lit(i)) for i, t in enumerate(tests)))
    w = Window.partitionBy(*keys).orderBy(F.col("_s").desc())
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_s")
