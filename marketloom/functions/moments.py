"""Co-moments of lagged columns, block by block.

A series is cut into blocks of rows, each with the rows before it that its lags reach.  A
block gives the number, the means and the centred products of its complete rows; these merge
by the pairwise update of means, first inside each task, then across tasks.  Nothing is summed
uncentred, so a series far from zero loses no digits, and all wanted numbers of lags come from
one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import blocks
from marketloom.functions import series as S

ROWS = 20_000


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    products: np.ndarray  # centred

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def regress(self, target: int, on: list[int]) -> tuple[np.ndarray, float]:
        """Intercept and slopes of the regression of one column on others, and its residual sum of squares."""
        width = np.sqrt(np.maximum(np.diag(self.products)[on], 1e-300))
        scaled = self.products[np.ix_(on, on)] / np.outer(width, width)
        slopes = np.linalg.lstsq(scaled, self.products[on, target] / width, rcond=None)[0] / width if on else np.zeros(0)
        rss = float(self.products[target, target] - slopes @ self.products[on, target])
        return np.concatenate([[self.mean[target] - slopes @ self.mean[on]], slopes]), rss


def _of(x: np.ndarray) -> Moments:
    n = len(x)
    mean = x.mean(axis=0) if n else np.zeros(x.shape[1])
    away = x - mean
    return Moments(n, mean, away.T @ away)


def _in_row_blocks(df: DataFrame, values: dict[str, Column], ts: str, lags: int, run: Callable, schema: str, series: list[str], span: int) -> DataFrame:
    """``run(arrays, first)`` of each block: the columns with the rows before it, and where its own rows begin."""
    rows = max(ROWS, lags)
    indexed = S.row_index(df.select(*series, ts, *[v.cast("double").alias(n) for n, v in values.items()]), series, ts, span, "__i")
    own = F.floor(F.col("__i") / rows)
    copies = F.array_compact(F.array(own, F.when(F.pmod(F.col("__i"), F.lit(rows)) >= rows - lags, own + 1) if lags else F.lit(None).cast("long")))
    names = list(values)

    def of_block(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        at = table.column("__i").to_numpy()
        first = int(np.searchsorted(at, key[-1].as_py() * rows))
        arrays = []
        for name in names:
            x, known = blocks._floats(table.column(name))
            x[~known] = np.nan
            arrays.append(x)
        return run(arrays, first)

    return indexed.withColumn("__b", F.explode(copies)).groupBy(*series, "__b").applyInArrow(of_block, schema)


_SCHEMA = "lags int, n long, mean array<double>, products array<double>"


def _table(found: dict[int, Moments]) -> pa.RecordBatch:
    floats = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([
        pa.array(list(found), pa.int32()), pa.array([m.n for m in found.values()], pa.int64()),
        pa.array([m.mean for m in found.values()], floats), pa.array([m.products.ravel() for m in found.values()], floats)], names=["lags", "n", "mean", "products"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Moments] = {}
    for batch in batches:
        for row in batch.to_pylist():
            d = len(row["mean"])
            m = Moments(row["n"], np.array(row["mean"]), np.array(row["products"]).reshape(d, d))
            found[row["lags"]] = found[row["lags"]].merged(m) if row["lags"] in found else m
    if found:
        yield _table(found)


def lagged_moments(df: DataFrame, columns: dict[str, Column], ts: str, lag_counts: list[int], span: int = blocks.SPAN) -> dict[int, Moments]:
    """For each number of lags the moments of the columns, then of all at lag 1, and so on, over rows in which all of these are known."""
    wanted, d = sorted(set(lag_counts)), len(columns)

    def run(arrays: list[np.ndarray], first: int) -> pa.Table:
        n = len(arrays[0])
        wide = np.full((n - first, d * (wanted[-1] + 1)), np.nan)
        for k in range(wanted[-1] + 1):
            begin = max(first, k)
            for j, x in enumerate(arrays):
                wide[begin - first :, d * k + j] = x[begin - k : n - k]
        return pa.Table.from_batches([_table({k: _of(part[~np.isnan(part).any(axis=1)]) for k in wanted for part in (wide[:, : d * (k + 1)],)})])

    parts = _in_row_blocks(df, columns, ts, wanted[-1], run, _SCHEMA, [], span)
    rows = parts.mapInArrow(_merged, _SCHEMA).repartition("lags").mapInArrow(_merged, _SCHEMA).collect()  # one row for each number of lags
    out = {r["lags"]: Moments(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(len(r["mean"]), -1)) for r in rows}
    return {k: out.get(k, Moments(0, np.zeros(d * (k + 1)), np.zeros((d * (k + 1),) * 2))) for k in wanted}


def lagged_products(df: DataFrame, x: Column, ts: str, lags: int, centre: float, series: list[str] | None = None, span: int = blocks.SPAN) -> np.ndarray:
    """Sums of (x_t - centre) (x_{t-k} - centre) for k from 0 to ``lags`` over pairs of known values."""

    def run(arrays: list[np.ndarray], first: int) -> pa.Table:
        away = np.nan_to_num(arrays[0] - centre, nan=0.0)
        sums = [float(away[max(first, k) :] @ away[max(first, k) - k : len(away) - k]) for k in range(lags + 1)]
        return pa.table({"lag": pa.array(range(lags + 1), pa.int32()), "s": pa.array(sums, pa.float64())})

    parts = _in_row_blocks(df, {"__x": x}, ts, lags, run, "lag int, s double", series or [], span)
    found = {r["lag"]: r["s"] for r in parts.groupBy("lag").agg(F.sum("s").alias("s")).collect()}
    return np.array([found.get(k, 0.0) for k in range(lags + 1)])


def lagged_pairs(df: DataFrame, x: Column, ts: str, lags: tuple[int, ...], span: int = blocks.SPAN) -> dict[int, Moments]:
    """For each lag the moments of (x_t, x_{t-k}) over pairs of known values."""

    def run(arrays: list[np.ndarray], first: int) -> pa.Table:
        found = {}
        for k in lags:
            pair = np.column_stack([arrays[0][max(first, k) :], arrays[0][max(first, k) - k : len(arrays[0]) - k]])
            found[k] = _of(pair[~np.isnan(pair).any(axis=1)])
        return pa.Table.from_batches([_table(found)])

    parts = _in_row_blocks(df, {"__x": x}, ts, max(lags), run, _SCHEMA, [], span)
    rows = parts.mapInArrow(_merged, _SCHEMA).repartition("lags").mapInArrow(_merged, _SCHEMA).collect()
    out = {r["lags"]: Moments(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(2, 2)) for r in rows}
    return {k: out.get(k, Moments(0, np.zeros(2), np.zeros((2, 2)))) for k in lags}
