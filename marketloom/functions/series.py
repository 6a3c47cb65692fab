"""Window functions over ordered series.

A missing value is NULL; NaN and infinities never enter (``clean``).  Every function
takes the window that orders a series, so nothing relies on physical row order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.functions import blocks


def order(series: list[str], ts: str) -> WindowSpec:
    return Window.partitionBy(*series).orderBy(ts)


def clean(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clip(x: Column, low, high) -> Column:
    """NULL stays NULL; a NULL bound does not bind."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def diff(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return x - F.lag(x, n).over(w)


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def padded_lag(x: Column, w: WindowSpec) -> Column:
    """The last known value before the row."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def log_return(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return F.ln(x) - F.ln(F.lag(x, n).over(w))


def rolling(stat: Callable[[Column], Column], x: Column, w: WindowSpec, size: int, least: int | None = None, skip_current: bool = False) -> Column:
    """``stat`` over the last ``size`` rows, NULL with fewer than ``least`` values (default ``size``)."""
    frame = w.rowsBetween(-size, -1) if skip_current else w.rowsBetween(-(size - 1), 0)
    return F.when(F.count(x).over(frame) >= (size if least is None else least), stat(x).over(frame))


def zscore(x: Column, w: WindowSpec, size: int, least: int, eps: float, skip_current: bool = False, null_flat: bool = False) -> Column:
    """Distance from the rolling mean in rolling sample deviations."""
    mean, sd = (rolling(f, x, w, size, least, skip_current) for f in (F.avg, F.stddev_samp))
    return ratio(x - mean, (F.nullif(sd, F.lit(0.0)) if null_flat else sd) + eps)


def median(x: Column) -> Column:
    return F.percentile(x, 0.5)


def average_rank(x: Column, partition: list[str]) -> Column:
    """Rank with ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, x)) - 1) / 2.0


def row_index(df: DataFrame, series: list[str], ts: str, span: int, out: str) -> DataFrame:
    """``df`` with the position of each row in its series, from 0.

    Rows are numbered inside time blocks of ``span``; block sizes, few rows a series,
    give the blocks' first positions.  No task sorts a whole series.
    """
    blocked = df.withColumn("__b", F.floor(F.col(ts) / span))
    sizes = blocked.groupBy(*series, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*series).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(*series, "__b", before.alias("__first"))
    within = F.row_number().over(Window.partitionBy(*series, "__b").orderBy(ts)) - 1
    return blocked.withColumn("__r", within).join(firsts, [*series, "__b"]).withColumn(out, F.col("__first") + F.col("__r")).drop("__b", "__r", "__first")


def in_time_blocks(df: DataFrame, ts: str, step: int, lookback: int, transform: Callable[[DataFrame, list[str]], DataFrame], series: list[str], rows_per_block: int = 20_000, lookahead: int = 0) -> DataFrame:
    """``transform(frame, series + ["__block"])`` of a series on a regular grid, block by block.

    A block also gets the ``lookback`` rows before it and the ``lookahead`` rows after
    it, and keeps its own rows, so a long series is spread over tasks and frames that
    reach no further give the same result as over the whole series.
    """
    span = step * rows_per_block
    if lookback > rows_per_block or lookahead > rows_per_block:
        raise ValueError("a block must be at least as long as the reach of its frames")
    own = F.floor(F.col(ts) / span)
    at = F.pmod(F.col(ts), F.lit(span))
    copies = F.array_compact(F.array(own, F.when(at >= span - lookback * step, own + 1), F.when(at < lookahead * step, own - 1)))
    spread = df.withColumn("__block", F.explode(copies))
    return transform(spread, [*series, "__block"]).filter(F.col("__block") == own).drop("__block")


def ewma(df: DataFrame, x: Column, alpha: float, series: list[str], ts: str, out: str, mean_start: int | None = None, least: int = 1, skip: int = 0, span: int = blocks.SPAN) -> DataFrame:
    """One recursive mean (``blocks.Mean``) over time blocks of ``span``."""
    return blocks.recursive_means(df, [blocks.Mean(x, alpha, out, mean_start, least, skip)], series, ts, span=span)
