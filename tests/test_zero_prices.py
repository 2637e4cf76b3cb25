"""Prices of zero and ties in rounding: the registered queries against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.plans import queries


def plain(v):
    return "" if v is None else "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v) + 0.0) if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Events of three users on two days; a price is zero inside, and at the beginning, of one's day."""
    folder = str(tmp_path_factory.mktemp("zeros"))
    rows = []
    for user in (1, 2, 3):
        for k in range(24):
            value = 0.0 if (user, k) in ((2, 11), (2, 9), (3, 0)) else 50.0 + (k * 7 + user * 3) % 11 + k / 8
            rows.append((len(rows) + 1, f"TIMESTAMP '2024-01-{1 + k // 4:02d} 10:{k:02d}:00'", user, value))
    values = ", ".join(f"({i}, {ts}, {u}, 'a', {v}e0, '{{}}')" for i, ts, u, v in rows)
    duckdb.connect().execute(f"COPY (SELECT CAST(a AS BIGINT) AS event_id, b AS ts, CAST(c AS BIGINT) AS user_id, d AS event_type, e AS value, f AS props FROM (VALUES {values}) t(a, b, c, d, e, f)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


def against_sql(spark, folder, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    df = queries.QUERIES[name](spark, folder)
    cursor = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    got = [r.asDict() for r in df.collect()]
    order = sorted(names)
    assert sorted(tuple(plain(r[c]) for c in order) for r in got) == sorted(tuple(plain(r[c]) for c in order) for r in want)
    return got


def test_intraday_features_of_zero_prices(spark, zeros):
    got = {r["user_id"]: r for r in against_sql(spark, zeros, "intraday_features")}
    assert math.isnan(got[2]["parkinson_vol"]) and got[3]["intraday_mom"] == math.inf and got[1]["parkinson_vol"] > 0


def test_rounding_of_ties(spark):
    xs = [60.84124999999999, 60.84125, 0.00015, 1.00005, -2.00025, 1e300, math.inf, -math.inf, math.nan, None]
    xs += [k / 1e5 for k in range(-3000, 3000, 5)]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", C.rounded(F.col("x"), 4).alias("x")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 4)", [x]).fetchall()[0][0] for x in xs]
    assert [plain(x) for x in got] == [plain(x) for x in want]


def test_monthly_from_daily_of_zero_prices(spark, zeros):
    got = {r["permno"]: r for r in against_sql(spark, zeros, "monthly_from_daily")}
    assert got[2]["ill"] == math.inf and math.isnan(got[2]["std_dolvol"])
    assert math.isfinite(got[1]["ill"]) and math.isfinite(got[1]["std_dolvol"])
