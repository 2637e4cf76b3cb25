"""Registered queries through sources and sinks: panels are written to the shared folder in the
layouts of the library and read back through its sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cross_section
from tessera.plans.panels import DAY, MONTH
from tessera.plans.queries import r6, register
from tessera.sources import panels as sources
from tessera.sources.shared import Rounds

_MONTHS = f"(SELECT permno, date, prc, vol FROM {MONTH.source()})"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{Rounds(spark).root}/{name}"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MONTH.frame(spark, sf_dir).select("permno", "date", "prc", "vol")


@register(f"SELECT permno, date, round(prc, 7) AS prc, round(vol, 2) AS vol FROM {_MONTHS} WHERE date BETWEEN DATE '1994-03-01' AND DATE '1996-06-30'")
def panel_by_year(spark, sf_dir):
    """A panel partitioned by year, loaded for a range of dates with a year of warm-up before it."""
    path = _folder(spark, "years")
    sources.write_panel(_months(spark, sf_dir), path)
    d = sources.PartitionedSource(path, buffer_years=1).load(spark, dt.date(1995, 3, 1), dt.date(1996, 6, 30))
    return d.select("permno", "date", r6("prc", 7), r6("vol", 2))


@register(f"""SELECT permno, date, round(prc, 7) AS prc FROM {_MONTHS} WHERE date BETWEEN DATE '1995-02-01' AND DATE '1995-04-30'
    AND permno IN (SELECT permno FROM {_MONTHS} GROUP BY permno ORDER BY sum(prc * vol) DESC, permno LIMIT 5)""")
def panel_by_month(spark, sf_dir):
    """A panel partitioned by month, loaded for some months and a universe."""
    path, p = _folder(spark, "months"), _months(spark, sf_dir)
    sources.write_panel(p, path, monthly=True)
    universe = cross_section.top_n(p, "permno", F.col("prc") * F.col("vol"), 5)
    d = sources.PartitionedSource(path, monthly=True).load(spark, dt.date(1995, 2, 1), dt.date(1995, 4, 30), universe)
    return d.select("permno", "date", r6("prc", 7))


@register(f"SELECT year(date) AS year, count(*) AS n, round(sum(vol), 2) AS vol FROM {_MONTHS} WHERE year(date) BETWEEN 1993 AND 1996 GROUP BY 1")
def yearly_cache(spark, sf_dir):
    """A year-level cache that has some of the years asked for: only the missing ones are built."""
    path, p = _folder(spark, "cache"), _months(spark, sf_dir)
    sources.write_panel(p.where("year(date) = 1994"), path)
    d = sources.cached_years(spark, path, range(1993, 1997), lambda first, last: p.where(F.year("date").between(first, last)))
    return d.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("vol"), 2).alias("vol"))


@register(f"""SELECT date, CAST(permno AS VARCHAR) AS ticker, round(prc, 7) AS close FROM {_MONTHS} WHERE permno <= 3
    UNION ALL SELECT date, CAST(permno AS VARCHAR), NULL FROM (SELECT DISTINCT date FROM {_MONTHS} WHERE permno <= 3), (SELECT DISTINCT permno FROM {_MONTHS} WHERE permno <= 3)
      WHERE (date, permno) NOT IN (SELECT (date, permno) FROM {_MONTHS})""")
def wide_files(spark, sf_dir):
    """A variable as a wide file, a column for each ticker, read back as a long panel."""
    path = _folder(spark, "wide/close")
    long = _months(spark, sf_dir).where("permno <= 3").select("date", F.col("permno").cast("string").alias("ticker"), F.col("prc").alias("close"))
    tickers = [r.ticker for r in long.select("ticker").distinct().orderBy("ticker").collect()]  # three at most
    sources.write_wide(long, path, "close", tickers)
    return sources.read_wide(spark, path, "close").select("date", "ticker", r6("close", 7))


@register(f"SELECT CAST(year(date) AS INT) AS year, CAST(count(*) AS INT) AS n, round(avg(prc), 4) AS prc FROM {_MONTHS} GROUP BY 1")
def csv_results(spark, sf_dir):
    """A small result written as CSV and read with its types."""
    path = _folder(spark, "results")
    d = _months(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.round(F.avg("prc"), 4).alias("prc"))
    sources.write_results(d, path)
    return spark.read.csv(path, header=True, schema="year int, n int, prc double")


@register(f"SELECT DISTINCT date FROM {DAY.source()} ORDER BY date")
def trading_calendar(spark, sf_dir):
    path = _folder(spark, "calendar")
    DAY.frame(spark, sf_dir).select(F.col("date").cast("string").alias("date")).write.parquet(path)
    return sources.read_calendar(spark, path)


@register(f"SELECT count(*) AS n_rows, min(date) AS first, max(date) AS last FROM {_MONTHS}")
def described_panel(spark, sf_dir):
    return sources.describe(_months(spark, sf_dir), "date")


@register(f"SELECT CAST(year(date) AS INT) AS file_year, count(*) AS n FROM {_MONTHS} WHERE year(date) BETWEEN 1994 AND 1996 GROUP BY 1")
def files_by_year(spark, sf_dir):
    """Files of a folder told apart by the year in their names."""
    path, p = _folder(spark, "files"), _months(spark, sf_dir)
    for year in (1994, 1995, 1996):
        p.where(F.year("date") == year).coalesce(1).write.parquet(f"{path}/panel_{year}")
    d = spark.read.parquet(*(f"{path}/panel_{y}" for y in (1994, 1995, 1996)))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return d.groupBy(F.regexp_extract(name, r"((?:19|20)\d{2})", 1).cast("int").alias("file_year")).agg(F.count("*").alias("n"))
