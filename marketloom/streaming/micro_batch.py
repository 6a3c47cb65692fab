"""Features of a stream, batch by batch, with a warm-up tail kept between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class WarmScorer:
    """A ``foreachBatch`` function: scores a batch with the last rows of each series before it.

    The tail is a small table, ``rows`` a series, written anew for each batch under the
    batch's number, so that a repeated batch reads what it read before.
    """

    def __init__(self, transform: Callable[[DataFrame, DataFrame | None], DataFrame], ts: str, series: list[str], rows: int, state: str, sink: str) -> None:
        self.transform, self.ts, self.series, self.rows, self.state, self.sink = transform, ts, series, rows, state, sink

    def _tail(self, spark: SparkSession, batch: int) -> DataFrame | None:
        if batch == 0:
            return None
        try:
            return spark.read.parquet(f"{self.state}/{batch - 1}")
        except AnalysisException:
            return None

    def __call__(self, df: DataFrame, batch: int) -> None:
        tail = self._tail(df.sparkSession, batch)
        self.transform(df, tail).write.mode("overwrite").parquet(f"{self.sink}/batch={batch}")
        recent = df if tail is None else df.unionByName(tail)
        rank = F.row_number().over(Window.partitionBy(*self.series).orderBy(F.desc(self.ts)))
        recent.withColumn("__r", rank).filter(F.col("__r") <= self.rows).drop("__r").write.mode("overwrite").parquet(f"{self.state}/{batch}")


def bars(events: DataFrame, ts: str, value: str, every: str, late: str) -> DataFrame:
    """Candles of an event stream: one row a window, closed once ``late`` has passed."""
    at = F.col(ts)
    windowed = events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"))
    out = windowed.agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.sum(value).alias("volume"), F.count(F.lit(1)).alias("cnt"))
    return out.select(F.unix_millis("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "cnt")
