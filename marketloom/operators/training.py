"""From raw market tables to model inputs: load, check, normalize, add the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import preparation, reshape, validate
from marketloom.operators.preparation import Custom, Expression, FeaturePipeline
from marketloom.sources import ingest


def default_pipeline(ts: str = "timestamp", series: list[str] | None = None, keys: list[str] | None = None) -> FeaturePipeline:
    """Order book, candles without lags and derivatives metrics, and the nearness of the last metrics."""
    order = {"ts": ts, "series": series or []}
    near = Expression("distance", "if(distance is null, null, greatest(least(1 - distance / 4, 1), 0))")
    parts = [Custom("order_book"), Custom("candles", {"lags": [], **order}), Custom("metrics", order), near]
    return FeaturePipeline(parts, keys=keys if keys is not None else [*(series or []), ts])


def future_features(df: DataFrame, ts: str) -> DataFrame:
    """The time and what the calendar says of it, known ahead of time."""
    made = preparation.time_features(df.select(ts), ts)
    names = {"month": "month", "dow": "day", "hour": "hour", "minute": "minute"}
    return made.select(ts, *[F.col(f"{a}_{f}").alias(f"{f}_{b}") for a, b in names.items() for f in ("sin", "cos")])


class TrainingData:
    """The steps between stored market data and a model, with one feature pipeline."""

    def __init__(self, pipeline: FeaturePipeline | None = None, ts: str = "timestamp"):
        self.pipeline, self.ts = pipeline or default_pipeline(ts), ts

    @classmethod
    def build(cls, config: str, ts: str = "timestamp") -> TrainingData:
        """From the JSON of a pipeline, fitted or not."""
        return cls(FeaturePipeline.from_json(config), ts)

    def check(self, df: DataFrame, step: int) -> DataFrame:
        """``df`` if its times are ``step`` apart, each once, and no cell is missing; else ValidationError."""
        return validate.validate(df, step, self.ts)

    def load(self, spark: SparkSession, archives: str, store: str, symbol: str, timeframe: str = "1m") -> DataFrame:
        """Book, candles and metrics of a symbol on one checked grid, in order of time."""
        step = ingest.seconds(timeframe) * 1000
        book, klines, metrics = (ingest.ingest(spark, archives, store, symbol, kind) for kind in ("bookDepth", "klines", "metrics"))
        return reshape.sort_by_time(self.check(reshape.combine(book, klines, metrics, step), step), self.ts)

    def process(self, df: DataFrame, train: bool = False, step: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(past, future) features of combined rows; ``train`` fits the pipeline to them first.

        With ``step`` the rows are checked before.  Reading ``past`` fails at a value that
        is missing or not finite.
        """
        if step is not None:
            self.check(df, step)
        if train:
            self.pipeline.fit(df)
        past = validate.require_finite(self.pipeline.transform(df), self.pipeline.feature_names())
        return past, future_features(df, self.ts)
