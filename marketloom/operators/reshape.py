"""Densifying, pivoting, interpolating and joining market tables on one time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import blocks
from marketloom.functions import series as S
from marketloom.operators.validate import ValidationError

BANDS = (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)


def pivot_book(book: DataFrame, ts: str = "timestamp", bands: tuple[int, ...] = BANDS, check: bool = True, series: list[str] | None = None) -> DataFrame:
    """One row a timestamp (of a series) with depth_{band} and notional_{band}; a repeated (ts, band) raises."""
    keys = [*(series or []), ts]
    if check and not book.groupBy(*keys, "percentage").count().filter("count > 1").isEmpty():
        raise ValidationError("a timestamp has a band twice")
    wide = book.groupBy(*keys)
    pick = lambda c, b: F.max(F.when(F.col("percentage") == b, F.col(c))).alias(f"{c}_{b}")
    return wide.agg(*[pick(c, b) for c in ("depth", "notional") for b in bands])


def round_half_up(ts: Column, step: int) -> Column:
    return F.floor((ts + step // 2) / step) * step


def extend_metrics(metrics: DataFrame, step: int, ts: str = "create_time", series: list[str] | None = None) -> DataFrame:
    """Rows on the grid of ``step``: the last non-null value of each column at each rounded time, NULL in gaps."""
    series = series or []
    values = [c for c in metrics.columns if c not in (ts, *series)]
    rounded = metrics.withColumn("__g", round_half_up(F.col(ts), step))
    # the latest non-null value of each column, without a sort of the group
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in values]
    points = rounded.groupBy(*series, F.col("__g").alias(ts)).agg(*last)
    return densify(points, ts, step, series)


def densify(df: DataFrame, ts: str, step: int, series: list[str] | None = None) -> DataFrame:
    """``df`` with a row of NULLs for each missing grid time between the first and last of each series.

    Pieces of the grids, 100,000 times each, are made in parallel and joined by series and time, so a
    long series is spread over tasks.  A null series is one of its own.
    """
    series = series or []
    ends = df.groupBy(*series).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi")).filter("__lo is not null")
    chunk = step * 100_000
    starts = ends.select(*series, F.explode(F.sequence("__lo", "__hi", F.lit(chunk))).alias("__a"), "__hi")
    grid = starts.select(*series, F.explode(F.sequence("__a", F.least(F.col("__a") + chunk - step, F.col("__hi")), F.lit(step))).alias(ts))
    return _beside(grid, df.withColumnRenamed(ts, "__t"), ts, "__t", series).drop("__t").select(*df.columns)


def _beside(left: DataFrame, right: DataFrame, ts: str, right_ts: str, series: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` at the same time of the same series; null series meet."""
    named = right.withColumnsRenamed({c: f"__s{i}" for i, c in enumerate(series)})
    same = left[ts] == named[right_ts]
    for i, c in enumerate(series):
        same = same & left[c].eqNullSafe(named[f"__s{i}"])
    return left.join(named, same, "left").drop(*[f"__s{i}" for i in range(len(series))])


def carry_forward(df: DataFrame, ts: str = "create_time", series: list[str] | None = None, span: int = blocks.SPAN) -> DataFrame:
    """Every value filled forward, and ``distance``: rows since the last row with any value.

    Time blocks are summed up by their rows, last known values and last row with a value,
    which are carried to the blocks after them.
    """
    series = series or []
    values = [c for c in df.columns if c not in (ts, *series)]
    inside = Window.partitionBy(*series, "__b").orderBy(ts)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    any_value = F.coalesce(*[F.when(F.col(c).isNotNull(), 1) for c in values]) == 1
    rows = blocks.with_block(df, ts, span).withColumn("__r", F.row_number().over(inside))
    rows = rows.withColumn("__held", F.max(F.when(any_value, F.col("__r"))).over(so_far))
    at = F.col(ts)
    sums = rows.groupBy(*series, "__b").agg(
        F.max("__r").alias("__n"), F.max("__held").alias("__h"), *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"__l{i}") for i, c in enumerate(values)])
    over = blocks._series_window(series, "__b").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("__n").over(over), F.lit(0))
    sums = sums.withColumn("__first", first).withColumn("__at", F.col("__first") + F.col("__h"))
    carried = sums.select(*series, "__b", "__first", F.last("__at", ignorenulls=True).over(over).alias("__before"), *[F.last(f"__l{i}", ignorenulls=True).over(over).alias(f"__c{i}") for i in range(len(values))])
    held = F.coalesce(F.col("__first") + F.col("__held"), F.col("__before"))
    filled = [F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"__c{i}")).alias(c) for i, c in enumerate(values)]
    met = blocks.meet_blocks(rows, carried, series)
    return met.select(*series, ts, *filled, (F.col("__first") + F.col("__r") - held).cast("double").alias("distance"))


def interpolate_to_grid(df: DataFrame, ts: str, step: int, series: list[str] | None = None, span: int = blocks.SPAN) -> DataFrame:
    """Rows at each grid time from ceil(min) to floor(max): linear in time between the nearest
    known values, the nearest value at the edges."""
    series = series or []
    return blocks.interpolated(df, [c for c in df.columns if c not in (ts, *series)], series, ts, step, span)


def align_by_time(df: DataFrame, main: DataFrame, ts: str, main_ts: str, series: list[str] | None = None) -> DataFrame:
    """Rows not before the first row of ``main``, of the same series if ``series`` names its columns.

    Rows of a series that ``main`` lacks go, as all rows do where ``main`` is empty.
    """
    first = main.groupBy(*(series or [])).agg(F.min(main_ts).alias("__first"))
    if not series:
        return df.join(F.broadcast(first), F.col(ts) >= F.col("__first")).drop("__first")  # one row
    first = first.withColumnsRenamed({c: f"__s{i}" for i, c in enumerate(series)})
    same = F.col(ts) >= F.col("__first")
    for i, c in enumerate(series):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    return df.join(first, same, "left_semi")


def sort_by_time(df: DataFrame, ts: str, ascending: bool = True, ties: list[str] | None = None) -> DataFrame:
    """``df`` in order of time, equal times by the columns ``ties``; raises if empty or without the column."""
    if ts not in df.columns:
        raise ValidationError(f"no column {ts}")
    if df.isEmpty():
        raise ValidationError("nothing to sort")
    return df.orderBy(*[F.col(c).asc() if ascending else F.col(c).desc() for c in (ts, *(ties or []))])


def asof_backward(left: DataFrame, right: DataFrame, ts: str, values: list[str], series: list[str] | None = None) -> DataFrame:
    """Each left row with the latest known right values at or before its time."""
    series = series or []
    tagged = left.withColumn("__left", F.lit(1)).unionByName(right.select(*series, ts, *values).withColumn("__left", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*series).orderBy(ts, "__left")
    return tagged.withColumns({c: S.ffill(F.col(c), w) for c in values}).filter("__left = 1").drop("__left")


def combine(
    book_long: DataFrame, klines: DataFrame, metrics: DataFrame, step: int, metrics_step: int | None = None,
    bands: tuple[int, ...] = BANDS, check: bool = True, series: list[str] | None = None,
) -> DataFrame:
    """Order book, candles and metrics on one grid: two left joins on the times of the book.

    ``series`` names columns that all three tables hold, such as the symbol: each series gets its own
    grid, and all are worked on together.  Without it the tables are those of one symbol.  Times
    before the book's first one meet nothing.  A repeated (series, time, band) of the book raises;
    ``check=False`` spares that pass.
    """
    series = series or []
    slim = metrics if "symbol" in series else metrics.drop("symbol")
    dense = carry_forward(extend_metrics(slim, metrics_step or step, series=series), series=series)
    book = interpolate_to_grid(pivot_book(book_long, bands=bands, check=check, series=series), "timestamp", step, series)
    both = _beside(book, klines.drop("ignore"), "timestamp", "open_time", series)
    return _beside(both, dense, "timestamp", "create_time", series)


def common_times(a: DataFrame, b: DataFrame, ts: str) -> DataFrame:
    """Inner join on time; clashing columns of ``b`` get the suffix _b."""
    renamed = b.select(*[F.col(c).alias(c if c == ts or c not in a.columns else f"{c}_b") for c in b.columns])
    return a.join(renamed, ts)


def stack_sum(df: DataFrame, ts: str, columns: list[str], out: str) -> DataFrame:
    """Sum of the non-null columns of each row, NULL if all are."""
    known = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return df.select(ts, F.when(known, total).alias(out))


def slice_from_end(df: DataFrame, ts: str, count: int, offset: int) -> DataFrame:
    """The ``count`` rows before the last ``offset`` rows, by time (a top-k sort, then a filter)."""
    r = F.row_number().over(Window.orderBy(F.desc(ts)))
    return df.orderBy(F.desc(ts)).limit(count + offset).withColumn("__r", r).filter(F.col("__r") > offset).drop("__r")
