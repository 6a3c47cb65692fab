"""Schemas, archives, type conversion and Parquet parts of market data."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.validate import ValidationError
from marketloom.sources import archives

#: Columns and types of the raw tables, in file order: fixed values of the data format.
SCHEMAS: dict[str, dict[str, str]] = {
    "klines": {"open_time": "bigint", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "close_time": "bigint", "quote_volume": "double", "count": "bigint", "taker_buy_volume": "double", "taker_buy_quote_volume": "double", "ignore": "bigint"},
    "bookDepth": {"timestamp": "bigint", "percentage": "bigint", "depth": "double", "notional": "double"},
    "metrics": {"create_time": "bigint", "symbol": "string", "sum_open_interest": "bigint", "sum_open_interest_value": "double", "count_toptrader_long_short_ratio": "double", "sum_toptrader_long_short_ratio": "double", "count_long_short_ratio": "double", "sum_taker_long_short_vol_ratio": "double"},
}
#: Columns that hold either epoch milliseconds or a UTC time as text.
TIMES = {"bookDepth": "timestamp", "metrics": "create_time"}
#: Rows of a part of each table.
ROWS_PER_PART = {"klines": 250_000, "bookDepth": 1_000_000, "metrics": 1_000_000}


def schema_of(kind: str) -> dict[str, str]:
    if kind not in SCHEMAS:
        raise ValueError(f"unknown data type: {kind}")
    return SCHEMAS[kind]


@dataclass(frozen=True)
class Archive:
    """One daily archive of a symbol: its file name and its place below a base address."""

    symbol: str
    endpoint: str
    day: dt.date
    interval: str | None = None

    @property
    def name(self) -> str:
        middle = self.interval if self.endpoint == "klines" else self.endpoint
        return f"{self.symbol}-{middle}-{self.day.isoformat()}.zip"

    def address(self, base: str) -> str:
        folder = f"{self.endpoint}/{self.symbol}" + (f"/{self.interval}" if self.endpoint == "klines" else "")
        return f"{base.rstrip('/')}/{folder}/{self.name}"


def plan_archives(spark: SparkSession, symbol: str, endpoint: str, start: dt.date, end: dt.date, base: str, interval: str | None = None) -> DataFrame:
    """(day, name, address) of every day from ``start`` to ``end``, both included."""
    if start > end:
        raise ValueError("start must not be after end")
    middle = interval if endpoint == "klines" else endpoint
    folder = f"{base.rstrip('/')}/{endpoint}/{symbol}/" + (f"{interval}/" if endpoint == "klines" else "")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("day"))
    name = F.format_string(f"{symbol}-{middle}-%s.zip", F.date_format("day", "yyyy-MM-dd"))
    return days.select("day", name.alias("name"), F.concat(F.lit(folder), name).alias("address"))


def read_archives(spark: SparkSession, folder: str, symbol: str, kind: str) -> DataFrame:
    """All rows of a symbol's zip archives as text columns, with ``archive_day``; only its archives are opened."""
    archives.register(spark)
    rows = spark.read.format("market_archives").option("kind", kind).load(folder)
    return rows.filter(F.col("archive_symbol") == symbol).select(*schema_of(kind), "archive_day")


def epoch_ms(text: Column) -> Column:
    """Milliseconds from a UTC time as text, or from digits, row by row; NULL for others."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))), text.try_cast("bigint"))


def typed(raw: DataFrame, kind: str) -> DataFrame:
    """Text rows as typed rows: header rows dropped, bad integers 0, bad or non-finite numbers NULL."""
    columns = schema_of(kind)
    first = next(iter(columns))
    out = []
    for name, type_ in columns.items():
        c = F.col(name).cast("string")
        if name == TIMES.get(kind):
            value = epoch_ms(c)
        elif type_ == "bigint":
            value = F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
        elif type_ == "double":
            number = c.try_cast("double")
            value = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
        else:
            value = c
        out.append(value.alias(name))
    return raw.filter(F.col(first).isNull() | (F.col(first).cast("string") != first)).select(*out)


def require_schema(df: DataFrame, kind: str) -> DataFrame:
    found = dict(df.dtypes)
    wrong = {n: (t, found.get(n)) for n, t in schema_of(kind).items() if found.get(n) != t}
    if wrong:
        raise ValidationError(f"columns with wrong types (wanted, found): {wrong}")
    return df


def save_parts(df: DataFrame, folder: str, rows_per_part: int, mode: str = "overwrite") -> None:
    """Snappy Parquet files of at most ``rows_per_part`` rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_part).option("compression", "snappy").parquet(folder)


def load_parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def ingest(spark: SparkSession, folder_of_archives: str, store: str, symbol: str, kind: str) -> DataFrame:
    """The typed rows of a symbol: from Parquet parts if there are any, else from its archives, which become parts."""
    from pyspark.errors import AnalysisException

    folder = f"{store}/type={kind}/symbol={symbol}"
    try:
        return spark.read.parquet(folder)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    rows = require_schema(typed(read_archives(spark, folder_of_archives, symbol, kind), kind), kind)
    if rows.isEmpty():
        raise FileNotFoundError(f"no data of {symbol} {kind}")
    save_parts(rows, folder, ROWS_PER_PART[kind])
    return spark.read.parquet(folder)


def part_sizes(df: DataFrame) -> DataFrame:
    """(file, bytes, rows) of the files behind a frame."""
    meta = df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return meta.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"))


def part_totals(df: DataFrame) -> DataFrame:
    """(parts, rows, bytes, mean_rows, mean_bytes) over the files behind a frame."""
    return part_sizes(df).agg(
        F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.avg("rows").alias("mean_rows"), F.avg("bytes").alias("mean_bytes"))


def save_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def seconds(timeframe: str) -> int:
    """Seconds of a timeframe such as 1m, 4h, 1d, 1w, 1M (30 days)."""
    m = re.fullmatch(r"(\d+)([mhdwM])", timeframe)
    if not m:
        raise ValueError(f"bad timeframe: {timeframe}")
    return int(m.group(1)) * {"m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2592000}[m.group(2)]


def compact(df: DataFrame) -> DataFrame:
    """Doubles as floats: half the size, seven digits."""
    return df.select(*[F.col(n).cast("float").alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])
