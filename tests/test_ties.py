"""Candles of events that share a millisecond or have no value, against the registered SQL."""

import datetime as dt
import json
import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketloom.plans import views


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Sixty hours whose first and last milliseconds hold three events each, some without a value."""
    rng, rows = random.Random(5), []
    for hour in range(60):
        start = dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)
        inside = sorted(rng.randrange(10_000, 3_590_000_000) for _ in range(24))
        for i, us in enumerate([1001, 1002, 1003, *inside, 3_599_000_001, 3_599_000_002, 3_599_000_003]):
            value = None if hour % 7 == 3 and i in (0, 29) else round(rng.uniform(1, 300), 2)
            rows.append((len(rows), start + dt.timedelta(microseconds=us), rng.choice(["view", "purchase", "click"]), value, json.dumps({"k": rng.randrange(100)})))
    folder = tmp_path_factory.mktemp("tied")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def differing(spark, folder, name):
    """Rows of one side alone, floats rounded to nine digits."""
    made = entry.queries()[name](spark, folder)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    wanted = connection.sql(f"SELECT {', '.join(made.columns)} FROM ({entry.oracle_sql()[name]})")
    plain = lambda rows: sorted((tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in rows), key=str)
    a, b = plain(made.collect()), plain(wanted.fetchall())
    assert len(a) >= 60
    return [(x, y) for x, y in zip(a, b, strict=True) if x != y]


@pytest.mark.parametrize("name", ["combined", "csv_round_trip", "ohlcv_features", "ohlcv_zscores"])
def test_ties_at_a_millisecond(spark, tied, name):
    assert differing(spark, tied, name) == []


@pytest.fixture(scope="module")
def reordered(spark, tied, tmp_path_factory):
    """The same events stored in another order than their ids, which fall as time grows."""
    folder = tmp_path_factory.mktemp("reordered")
    events = spark.read.parquet(f"{tied}/events.parquet").withColumn("event_id", 10_000 - F.col("event_id"))
    events.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["csv_round_trip", "combined", "ohlcv_features", "ohlcv_zscores"])
def test_ties_go_to_the_event_stored_first(spark, reordered, name):
    assert differing(spark, reordered, name) == []


def test_ties_across_files_go_to_the_first_file_by_name(spark, tmp_path):
    os.makedirs(tmp_path / "events.parquet")
    at = [dt.datetime(2024, 1, 1, 5, 0, 0, 300), dt.datetime(2024, 1, 1, 5, 59, 0, 700)]
    for name, ids, values in (("b", [1, 2], [10.0, 20.0]), ("a", [3, 4], [30.0, 40.0]), ("c", [0, 5], [50.0, 60.0])):
        part = pa.table({"event_id": ids, "ts": pa.array(at, pa.timestamp("us")), "event_type": ["view"] * 2, "value": values, "props": ['{"k": 1}'] * 2})
        pq.write_table(part, tmp_path / "events.parquet" / f"{name}.parquet")
    row = views.klines(spark, str(tmp_path)).collect()
    assert [(r["open"], r["close"], r["cnt"]) for r in row] == [(30.0, 40.0, 6)]
