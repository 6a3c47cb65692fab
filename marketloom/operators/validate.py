"""Data validation: continuity, missing values, duplicates, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Strings that count as missing.
TOKENS = ("", "None", "nan", "NaN", "NULL", "null")


class ValidationError(ValueError):
    """Data does not meet a requirement; the message says which."""


def time_gaps(df: DataFrame, step: int, ts: str, series: list[str] | None = None) -> DataFrame:
    """Rows (kind, prev, cur, diff, missing_rows) where neighbours are not one step apart."""
    if df.schema[ts].dataType.simpleString() not in ("int", "bigint"):
        raise ValidationError(f"{ts} must be an integer column")
    series = series or []
    prev = F.lag(ts).over(Window.partitionBy(*series).orderBy(ts))
    gaps = df.select(*series, prev.alias("prev"), F.col(ts).alias("cur")).withColumn("diff", F.col("cur") - F.col("prev"))
    kind = F.when(F.col("diff") > step, "missing").when(F.col("diff") == 0, "duplicate").when(F.col("diff") < step, "too_close")
    missing = F.when(F.col("diff") > step, F.expr(f"diff div {step} - 1")).otherwise(F.lit(0)).cast("long")
    return gaps.withColumns({"kind": kind, "missing_rows": missing}).filter("kind is not null")


def missing_cells(df: DataFrame, key: list[str], infinite: bool = False) -> DataFrame:
    """(key, column) of every missing cell: NULL, NaN or a missing token; infinities too if asked."""
    rest = [c for c in df.columns if c not in key]
    text = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in rest]
    cells = df.select(*key, F.explode(F.array(*text)).alias("cell")).select(*key, "cell.column", "cell.value")
    bad = F.col("value").isNull() | F.col("value").isin(*TOKENS)
    if infinite:
        bad = bad | F.col("value").isin("Infinity", "-Infinity")
    return cells.filter(bad).select(*key, "column")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """All members of the groups with equal columns."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"g.{c}")) for c in columns]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.alias("a").join(groups.alias("g"), condition, "left_semi")


def shared_times(a: DataFrame, b: DataFrame, ts: str) -> DataFrame:
    return a.select(ts).join(b.select(ts), ts, "left_semi").distinct()


def has_future_leakage(a: DataFrame, b: DataFrame, ts: str) -> bool:
    return not shared_times(a, b, ts).isEmpty()


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def require_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, whose reading fails at a NULL, NaN or infinite cell."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    guard = F.coalesce(F.assert_true(ok, F.lit("a value is missing or not finite")).isNull(), F.lit(True))
    return df.filter(guard)


def validate(df: DataFrame, step: int, ts: str) -> DataFrame:
    """``df`` if it has no duplicate times, missing cells or gaps; else ValidationError."""
    for name, found in (("duplicates", duplicates(df, [ts])), ("missing values", missing_cells(df, [ts])), ("gaps", time_gaps(df, step, ts))):
        if not found.isEmpty():
            raise ValidationError(f"{name} found")
    return df


def require_split_sizes(train: float, val: float, test: float) -> None:
    if not all(0 <= x <= 1 for x in (train, val, test)) or train == 0 or abs(train + val + test - 1) > 1e-9:
        raise ValidationError("sizes must lie in [0, 1], train above 0, and add up to 1")
