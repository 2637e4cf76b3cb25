"""Sources and sinks: warehouse pulls, partitioned panels, wide files, incremental caches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.columns import clean_frame


class Source(Protocol):
    """Anything that gives a long panel for a range of dates, optionally for some entities."""

    def load(self, spark: SparkSession, start: dt.date, end: dt.date, universe: DataFrame | None = None) -> DataFrame: ...


class PartitionedSource:
    """A panel stored by year (and month); a buffer of earlier years is read for warm-up.

    The range filters the partition columns, so only its folders are listed and read."""

    def __init__(self, path: str, entity: str = "permno", time: str = "date", buffer_years: int = 0, monthly: bool = False):
        self.path, self.entity, self.time, self.buffer_years, self.monthly = path, entity, time, buffer_years, monthly

    def load(self, spark: SparkSession, start: dt.date, end: dt.date, universe: DataFrame | None = None) -> DataFrame:
        first = start.replace(year=start.year - self.buffer_years, day=min(start.day, 28))
        df = spark.read.option("mergeSchema", "true").parquet(self.path).where(F.col("year").between(first.year, end.year))
        if self.monthly:
            months = F.col("year") * 12 + F.col("month")
            df = df.where(months.between(first.year * 12 + first.month, end.year * 12 + end.month))
        df = clean_frame(df.where(F.col(self.time).between(F.lit(first), F.lit(end))))
        return df if universe is None else df.join(universe.select(self.entity).distinct(), self.entity, "left_semi")


def key_ranges(low: int, high: int, size: int, width: int = 0) -> list[tuple[str, str]]:
    """Closed key ranges of ``size`` keys, zero-padded to ``width`` for keys kept as text."""
    return [(str(a).zfill(width), str(min(a + size - 1, high)).zfill(width)) for a in range(low, high + 1, size)]


def pull_predicates(date_col: str, start: dt.date, end: dt.date, key_col: str, ranges: Sequence[tuple[str, str]], text_key: bool = False) -> list[str]:
    """One predicate for each month and key range: a partitioned warehouse read."""
    out, at = [], start
    while at <= end:
        following = (at.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
        last = min(end, following - dt.timedelta(days=1))
        for a, b in ranges:
            a, b = (f"'{a}'", f"'{b}'") if text_key else (a, b)
            out.append(f"{date_col} BETWEEN DATE '{at}' AND DATE '{last}' AND {key_col} BETWEEN {a} AND {b}")
        at = following
    return out


def statement_query(table: str, columns: Iterable[str], company: str | None = None, filters: dict[str, str] | None = None) -> str:
    """Projection with equality filters and an optional left join of the company table."""
    names = ", ".join(f"a.{c}" for c in columns)
    join = f" LEFT JOIN {company} b ON a.gvkey = b.gvkey" if company else ""
    extra = ", b.sic, b.naics" if company else ""
    where = " AND ".join(f"a.{k} = '{v}'" for k, v in (filters or {}).items())
    return f"SELECT {names}{extra} FROM {table} a{join}" + (f" WHERE {where}" if where else "")


def pull(spark: SparkSession, url: str, query: str, predicates: list[str] | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """A warehouse query over JDBC, one task for each predicate."""
    if predicates:
        return spark.read.jdbc(url, f"({query}) q", predicates=predicates, properties=properties or {})
    return spark.read.jdbc(url, f"({query}) q", properties=properties or {})


def write_panel(df: DataFrame, path: str, time: str = "date", monthly: bool = False, mode: str = "overwrite") -> None:
    """By year (and month).  Rows are dealt by the partition and a spread of the entity-free row
    hash is left to adaptive execution, so one year is not one task."""
    d = df.withColumn("year", F.year(time))
    keys = ["year"]
    if monthly:
        d, keys = d.withColumn("month", F.month(time)), ["year", "month"]
    d.hint("rebalance", *keys).write.partitionBy(*keys).mode(mode).option("partitionOverwriteMode", "dynamic").parquet(path)


def existing_years(spark: SparkSession, path: str) -> set[int]:
    """Years that a partitioned panel has, from its folders alone; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return set()
    names = (s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    return {int(n[5:]) for n in names if n.startswith("year=")}


def cached_years(spark: SparkSession, path: str, years: Sequence[int], build, time: str = "date", buffer_years: int = 2) -> DataFrame:
    """A year-level cache: builds the missing years only (``build(first, last)`` gets them with
    their buffer), writes them, and reads the range back."""
    missing = sorted(set(years) - existing_years(spark, path))
    if missing:
        made = build(missing[0] - buffer_years, missing[-1]).where(F.year(time).isin(missing))
        write_panel(made, path, time)
    return spark.read.parquet(path).where(F.col("year").between(min(years), max(years)))


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file that may be missing: then an empty frame of its schema."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def list_variables(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def read_wide(spark: SparkSession, path: str, value: str, date: str = "date", entity: str = "ticker", tickers: list[str] | None = None) -> DataFrame:
    """Wide files (a column for each ticker, which may differ from file to file) as a long panel."""
    wide = spark.read.option("mergeSchema", "true").parquet(path)
    names = [c for c in (tickers or wide.columns) if c != date and c in wide.columns]
    return wide.unpivot([date], names, entity, value)


def write_wide(df: DataFrame, path: str, value: str, tickers: list[str], date: str = "date", entity: str = "ticker") -> None:
    """The one place where a panel becomes wide."""
    df.groupBy(date).pivot(entity, tickers).agg(F.first(value)).write.mode("overwrite").parquet(path)


def with_file_year(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder, with the first four-digit year of their name."""
    d = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return d.withColumn("file_year", F.regexp_extract(name, r"((?:19|20)\d{2})", 1).try_cast("int"))


def read_calendar(spark: SparkSession, path: str, column: str = "date") -> DataFrame:
    """Sorted distinct days from a Parquet or CSV file."""
    d = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    return d.select(F.col(column).try_cast("date").alias("date")).where("date is not null").distinct().orderBy("date")


def describe(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.min(time).alias("first"), F.max(time).alias("last"))


def write_results(df: DataFrame, path: str) -> None:
    """A small result (metrics, a grid, a PnL curve) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown_table(df: DataFrame, rows: int = 100, digits: int = 4) -> str:
    """The first rows of a small result as a Markdown table; a report, not an export."""

    def cell(v) -> str:
        return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = [df.columns, ["-"] * len(df.columns), *([cell(v) for v in r] for r in df.take(rows))]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)


def derive_missing(df: DataFrame, wanted: Sequence[str], unknown: float | None = 0.0) -> DataFrame:
    """Quarterly inputs that a source lacks, from those it has.  Any other, or one whose rule lacks
    an input as well, becomes ``unknown``: 0 by the specification, or None to keep it missing."""
    from pyspark.errors import AnalysisException

    rules = {"niq": "ibq", "dlttq": "ltq - lctq", "oiadpq": "saleq - cogsq - xsgaq", "piq": "ibq + txtq", "epspxq": "ibq / nullif(cshoq, 0)", "dpq": "0.0e0"}
    none = F.lit(unknown).cast("double")
    for name in wanted:
        if name not in df.columns:
            try:
                df = df.withColumn(name, F.expr(rules[name]).cast("double") if name in rules else none)
            except AnalysisException:  # an input of the rule is missing too
                df = df.withColumn(name, none)
    return df


def random_walks(spark: SparkSession, entities: int, steps: int, clusters: int = 1, seed: int = 42, shock: tuple[int, int, int, float] | None = None) -> DataFrame:
    """Synthetic prices: a random walk a cluster plus noise; ``shock`` adds (entity, from, to, size)."""
    from pyspark.sql import Window

    walk = spark.range(clusters * steps).select((F.col("id") % clusters).alias("cluster"), F.floor(F.col("id") / clusters).alias("t"))
    walk = walk.withColumn("x", F.randn(seed)).withColumn("x", 100 + F.sum("x").over(Window.partitionBy("cluster").orderBy("t")))
    each = spark.range(entities).select(F.col("id").alias("entity"), (F.col("id") % clusters).alias("cluster"))
    d = each.join(walk, "cluster").withColumn("price", F.col("x") + 0.5 * F.randn(seed + 1)).drop("x")
    if shock:
        hit = (F.col("entity") == shock[0]) & F.col("t").between(shock[1], shock[2])
        d = d.withColumn("price", F.col("price") + F.when(hit, shock[3]).otherwise(0.0))
    return d


def cointegrated_prices(spark: SparkSession, clusters: int, each: int, steps: int, speed: float = 0.1, spread: float = 0.5, shock: tuple[int, int, int, float] | None = None, seed: int = 42) -> DataFrame:
    """(entity, cluster, t, price): members of a cluster follow one random walk, each with a spread
    that reverts to it at ``speed`` a step, so any two of them are cointegrated.  ``shock`` adds (entity,
    from, to, size).  Each entity's path comes from its own seed, however rows are dealt."""

    def paths(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for entity in frame["id"]:
                cluster = int(entity) % clusters
                walk = 100 + np.cumsum(np.random.default_rng([seed, 0, cluster]).normal(size=steps))
                noise, gap = np.random.default_rng([seed, 1, int(entity)]).normal(scale=spread, size=steps), np.zeros(steps)
                for t in range(1, steps):
                    gap[t] = (1 - speed) * gap[t - 1] + noise[t]
                price = walk + gap
                if shock and shock[0] == entity:
                    price[shock[1] : shock[2] + 1] += shock[3]
                yield pd.DataFrame({"entity": int(entity), "cluster": cluster, "t": np.arange(steps), "price": price})

    return spark.range(clusters * each).mapInPandas(paths, "entity long, cluster int, t int, price double")
