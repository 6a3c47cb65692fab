"""Market tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, HALF_HOUR, FOUR_HOURS = 3_600_000, 1_800_000, 14_400_000


def base(spark: SparkSession, sf_dir: str, places: bool = False) -> DataFrame:
    """The events; with ``places`` also where each is stored: ``file`` and ``row`` within it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if places else []
    return events.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "event_id", "event_type", "value", k.alias("k"), *place)


def _bucket(step: int):
    return F.expr(f"(t div {step}) * {step}")


def klines(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """Hourly candles; events without a value have no part in open and close, ties at a millisecond go to the event stored first."""
    keys = ["open_time", *(["event_type"] if by_type else [])]
    b = base(spark, sf_dir, places=True).withColumn("open_time", _bucket(HOUR))
    valued = F.col("t").isNotNull() & F.col("value").isNotNull()
    first = F.when(valued, F.struct("t", "file", "row"))
    last = F.when(valued, F.struct((-F.col("t")).alias("before"), "file", "row"))
    return b.groupBy(*keys).agg(F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.min_by("value", last).alias("close"), F.round(F.sum("value"), 6).alias("volume"), F.count(F.lit(1)).alias("cnt"))


def book_depth(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    b = base(spark, sf_dir).withColumn("timestamp", _bucket(HALF_HOUR))
    band = (F.col("event_id") % 10).cast("int")
    b = b.withColumn("percentage", F.when(band < 5, band - 5).otherwise(band - 4))
    return b.groupBy("timestamp", "percentage", *(["event_type"] if by_type else [])).agg(F.round(F.sum("value"), 6).alias("depth"), F.round(F.sum(F.col("value") * F.col("k")), 6).alias("notional"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind, x: F.nullif(F.sum(F.when(F.col("event_type") == kind, x).otherwise(0.0)), F.lit(0.0))
    some = lambda kind, x: F.sum(F.when(F.col("event_type") == kind, x).otherwise(0.0))
    b = base(spark, sf_dir)
    return b.groupBy(F.expr(f"t div {FOUR_HOURS}").alias("g")).agg(
        F.min("t").alias("create_time"), F.sum("k").alias("oi"), F.round(F.sum(F.col("value") * F.col("k")), 6).alias("oi_value"),
        F.round(some("purchase", F.lit(1.0)) / of("view", F.lit(1.0)), 6).alias("r1"), F.round(some("purchase", F.col("value")) / of("view", F.col("value")), 6).alias("r2")).drop("g")


def typed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    held = F.round(F.sum(F.col("value") * F.col("k")), 6)
    return b.groupBy("event_type", F.expr(f"t div {FOUR_HOURS}").alias("g")).agg(F.min("t").alias("create_time"), F.sum("k").alias("oi"), held.alias("oi_value")).drop("g")


#: The same tables in DuckDB SQL, as the start of a WITH clause.
SQL = """
b AS (SELECT epoch_us(ts) // 1000 AS t, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
klines AS (SELECT (t // 3600000) * 3600000 AS open_time, arg_min(value, t) AS open, max(value) AS high, min(value) AS low, arg_max(value, t) AS close, round(sum(value), 6) AS volume, count(*) AS cnt FROM b GROUP BY 1),
typed AS (SELECT (t // 3600000) * 3600000 AS open_time, event_type, arg_max(value, t) AS close FROM b GROUP BY 1, 2),
book AS (SELECT (t // 1800000) * 1800000 AS ts, CASE WHEN event_id % 10 < 5 THEN CAST(event_id % 10 AS INT) - 5 ELSE CAST(event_id % 10 AS INT) - 4 END AS p, round(sum(value), 6) AS depth, round(sum(value * k), 6) AS notional FROM b GROUP BY 1, 2),
metrics AS (SELECT min(t) AS create_time, sum(k) AS oi, round(sum(value * k), 6) AS oi_value,
  round(sum(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END)::DOUBLE, 0), 6) AS r1,
  round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) / nullif(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 0), 6) AS r2 FROM b GROUP BY t // 14400000)
"""
