"""Ratios to a price of 0 (beyond 1e10), against the registered SQL to the last bit."""

import datetime as dt
import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketloom.plans.catalog import six_digits


def candles(folder, hours, zero):
    """Events of twenty an hour, of which those hours that ``zero`` picks end at 0."""
    rng, rows = random.Random(3), []
    for hour in range(hours):
        start = dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)
        values = [round(rng.expovariate(0.02), 2) + 0.01 for _ in range(20)]
        if zero(hour):
            values[-1] = 0.0
        rows += [(start + dt.timedelta(seconds=100 * i + 7), v) for i, v in enumerate(values)]
    n, ts, values = len(rows), pa.array([r[0] for r in rows], pa.timestamp("us")), [r[1] for r in rows]
    pq.write_table(pa.table({"event_id": range(n), "ts": ts, "event_type": ["view"] * n, "value": values, "props": ['{"k": 1}'] * n}), folder / "events.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), connection


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Two hundred hours, a tenth of which close at 0."""
    return candles(tmp_path_factory.mktemp("zeros"), 200, lambda hour: hour % 10 == 4)


@pytest.fixture(scope="module")
def rare(tmp_path_factory):
    """Nine hundred hours; every sixtieth closes at 0, so no frame before one holds another."""
    return candles(tmp_path_factory.mktemp("rare"), 900, lambda hour: hour % 60 == 59)


def test_features_after_a_price_of_zero(spark, zeros):
    folder, connection = zeros
    made = entry.queries()["ohlcv_features"](spark, folder)
    names = [c for c in made.columns if c != "price_impact_vol"]  # a logarithm, whose last bit differs between libraries
    wanted = connection.sql(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()['ohlcv_features']}) ORDER BY open_time").fetchall()
    got = [tuple(r) for r in made.select(names).orderBy("open_time").collect()]
    assert max(r[names.index("high_rel_prev")] or 0 for r in got) > 1e14
    assert got == wanted


def test_zscores_after_a_price_of_zero(spark, rare):
    """Equal below 1e9; beyond, sums of doubles in another order move the last bits of the SQL's value."""
    folder, connection = rare
    made = entry.queries()["ohlcv_zscores"](spark, folder)
    wanted = connection.sql(f"SELECT {', '.join(made.columns)} FROM ({entry.oracle_sql()['ohlcv_zscores']}) ORDER BY open_time").fetchall()
    pairs = [(x, y) for a, b in zip(made.orderBy("open_time").collect(), wanted, strict=True) for x, y in zip(a, b, strict=True)]
    assert sum(abs(y) > 1e10 for _, y in pairs) >= 50
    assert [(x, y) for x, y in pairs if x != y and (abs(y) < 1e9 or abs(x - y) > 1e-13 * abs(y))] == []


def test_zscores_are_rounded_as_the_sql_rounds(spark, rare):
    sql = entry.oracle_sql()["ohlcv_zscores"]
    exact = re.sub(r"round\((\w+), 6\) \+ 0.0 AS", r"\1 AS", sql[sql.rindex(") SELECT open_time, round("):])
    values = lambda q: [x for r in rare[1].sql(f"FROM ({q}) ORDER BY open_time").fetchall() for x in r[1:]]
    wanted, given = values(sql), values(sql[: sql.rindex(") SELECT open_time, round(")] + exact)
    got = spark.createDataFrame(list(enumerate(given)), "i int, x double").select("i", six_digits(F.col("x"))).orderBy("i").collect()
    assert given != wanted
    assert [r[1] for r in got] == wanted


def test_rounding_as_the_sql_rounds(spark):
    rng = random.Random(4)
    values = [rng.choice((-1, 1)) * 10 ** rng.uniform(-8, 17) for _ in range(20_000)]
    values += [rng.randrange(10**9) / 128 for _ in range(5_000)] + [1e300, -1e305, 0.0, -0.0, 5e-7, -5e-7, float("inf"), None]
    wanted = duckdb.connect().execute("SELECT round(x, 6) + 0.0 FROM (SELECT unnest($1::DOUBLE[]) AS x)", [values]).fetchall()
    got = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", six_digits(F.col("x"))).orderBy("i").collect()
    assert [r[1] for r in got] == [r[0] for r in wanted]
