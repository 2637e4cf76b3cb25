"""The panels that the registered queries run on, as SQL over the test tables.

Tables are written ``{events}``; Spark binds them to frames, another engine to its views.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.exprs import Expr, Layers, Panel, text
from tessera.operators.firm_factors import ANNUAL_INPUTS, QUARTERLY_INPUTS


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


@dataclass(frozen=True)
class Base:
    sql: str
    columns: tuple[str, ...]
    layers: Layers = field(default_factory=Layers)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.layers.apply(run(spark, sf_dir, self.sql))

    def source(self, more: Layers | None = None) -> str:
        return (self.layers + (more or Layers())).sql(f"({plain(self.sql)})", self.columns)


@dataclass(frozen=True)
class Query:
    """A base panel, layers on it, and the columns to return; one description, two engines."""

    base: Base
    layers: Layers
    keys: tuple[str, ...]
    out: Mapping[str, Expr]
    where: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        d = self.layers.apply(self.base.frame(spark, sf_dir))
        if self.where:
            d = d.where(self.where)
        return d.selectExpr(*self.keys, *(f"{text(e, 'spark')} AS {n}" for n, e in self.out.items()))

    def sql(self) -> str:
        cols = [*self.keys, *(f"{text(e, 'duckdb')} AS {n}" for n, e in self.out.items())]
        return f"SELECT {', '.join(cols)} FROM {self.base.source(self.layers)}" + (f" WHERE {self.where}" if self.where else "")


def _names(text: str) -> tuple[str, ...]:
    return tuple(text.split())


_DAY = Panel("permno", "date")
DAY = Base(
    """SELECT user_id AS permno, CAST(ts AS DATE) AS date, min_by(value, event_id) AS openprc, max_by(value, event_id) AS prc,
         max(value) AS askhi, min(value) AS bidlo, CAST(count(*) AS DOUBLE) AS vol
       FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    _names("permno date openprc prc askhi bidlo vol"),
    Layers(
        {
            "shrout": "1000.0e0 + permno % 97",
            "numtrd": "vol",
            "cfacpr": "CASE WHEN permno % 10 = 3 THEN 2.0e0 WHEN permno % 50 = 7 THEN 0.0e0 ELSE 1.0e0 END",
            "cfacshr": "CASE WHEN permno % 10 = 3 THEN 2.0e0 ELSE 1.0e0 END",
            "ret": f"prc / nullif({_DAY.lag('prc')}, 0) - 1",
        },
        {"retx": "ret - CASE WHEN permno % 5 = 0 THEN 0.001e0 ELSE 0.0e0 END", "cluster": "CAST(permno % 5 AS INT)"},
    ),
)

_MONTH = Panel("permno", "date")
MONTH = Base(
    """SELECT l_suppkey AS permno, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_extendedprice) AS prc, sum(l_quantity) AS vol
       FROM {lineitem} GROUP BY l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE)""",
    _names("permno date prc vol"),
    Layers({"shrout": "5000.37719e0 + permno * 1.00713e0", "ret": f"prc / nullif({_MONTH.lag('prc')}, 0) - 1"}),
)


def _measures(names: Iterable[str], key: str, step: str) -> dict[str, str]:
    """Deterministic statement items around sales: some missing, some zero, some negative."""
    out = {}
    for i, n in enumerate(names, 1):
        scale = f"(CAST((gvkey * {i % 7 + 2} + {step} * {i % 11 + 3}) % 17 AS DOUBLE) - {i % 3}.5e0) / {8 + i % 13}.0e0"
        out[n] = f"CASE WHEN (gvkey * 7 + {step} * 3 + {i}) % 13 = 0 THEN NULL WHEN (gvkey + {step} + {i}) % 19 = 0 THEN 0.0e0 ELSE base_ * {scale} + {i}.1372e0 END"
    return out


YEAR = Base(
    """SELECT o_custkey AS gvkey, CAST(year(o_orderdate) AS INT) AS fyear, sum(o_totalprice) / 1013.7719e0 AS base_,
         CAST(2070 + min(c_nationkey) * 13 % 150 AS STRING) AS sic, CASE WHEN o_custkey % 9 = 0 THEN '7132' ELSE '1111' END AS naics
       FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY o_custkey, CAST(year(o_orderdate) AS INT)""",
    _names("gvkey fyear base_ sic naics"),
    Layers({"datadate": "CAST(concat(CAST(fyear AS STRING), '-12-31') AS DATE)"} | _measures(ANNUAL_INPUTS, "gvkey", "fyear")),
)

QUARTER = Base(
    """SELECT o_custkey AS gvkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS datadate, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS INT) AS q_,
         sum(o_totalprice) / 1013.7719e0 AS base_
       FROM {orders} GROUP BY o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE), CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS INT)""",
    _names("gvkey datadate q_ base_"),
    Layers(_measures(QUARTERLY_INPUTS, "gvkey", "q_")),
)

#: Monthly order values of the nations: the nodes of the graph queries.
NATION = Base(
    """SELECT t, i, f FROM (SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS t, c_nationkey AS i, ln(sum(o_totalprice)) AS f
       FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2)""",
    _names("t i f"),
)

EMBEDDED = Base("SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM {embeddings}", _names("id v label"))
