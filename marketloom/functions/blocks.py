"""Scans over long series, block by block.

A block is the rows of a series whose ``position`` (a time, or a row number) falls into one
span.  A scan makes two passes over blocks, each block one group of bounded size: the first
reduces a block to a summary, the summaries of a series, few rows, are carried on in order,
and the second pass starts every block from what was carried to it.  Both passes read one
shuffle of the rows.  So a single series of any length is spread over all tasks.

Null keys of series form a series of their own.  Rows of one position keep the order of the
time column.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.functions.stage import staged

#: 20,000 bars of a minute in milliseconds.
SPAN = 20_000 * 60_000


def with_block(df: DataFrame, position: str, span: int, out: str = "__b") -> DataFrame:
    return df.withColumn(out, F.floor(F.col(position) / span).cast("long"))


def _floats(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where unknown) and which of them are known."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    known = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    return column.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float), known


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _keyed(keys: list[str], values: tuple, n: int, schema: pa.Schema) -> dict[str, pa.Array]:
    """Columns that repeat a group's keys."""
    return {k: pa.array([v.as_py()] * n, schema.field(k).type) for k, v in zip(keys, values, strict=True)}


# recursive means ------------------------------------------------------------------------


def affine_scan(x: np.ndarray, alpha: float, y: float) -> np.ndarray:
    """y_i = (1-alpha) y_{i-1} + alpha x_i, begun at ``y``: runs by scaled sums, then one affine step a run."""
    keep = 1.0 - alpha
    if not len(x) or keep <= 0:
        return x.astype(float)
    k = min(len(x), max(1, int(np.log(1e3) / -np.log(keep)))) if keep < 1 else len(x)  # scales stay within 1e3
    power = keep ** np.arange(1, k + 1)
    runs = np.pad(x, (0, -len(x) % k)).reshape(-1, k)
    local = np.cumsum(runs * alpha / power, axis=1) * power
    carried = np.empty(len(runs))
    for i, last in enumerate(local[:, -1].tolist()):
        carried[i] = y
        y = power[-1] * y + last
    return (local + carried[:, None] * power).ravel()[: len(x)]


@dataclass(frozen=True)
class Mean:
    """The recursive mean y_i = (1-alpha) y_{i-1} + alpha x_i, y_0 = x_0, of the known values of ``x``.

    The first ``skip`` known values count for nothing.  With ``mean_start`` = n the recursion
    starts at the mean of the first n values; results before the ``least``-th known value,
    and of unknown values, are NULL.
    """

    x: Column
    alpha: float
    out: str
    mean_start: int | None = None
    least: int = 1
    skip: int = 0

    @property
    def first(self) -> int:
        return self.mean_start or 1

    def begin(self) -> tuple[int, float, float]:
        """Known values so far, the sum of those that the start averages, the mean."""
        return 0, 0.0, 0.0

    def advance(self, state: tuple[int, float, float], x: np.ndarray) -> tuple[np.ndarray, tuple[int, float, float]]:
        """Means at the next known values and the state after them."""
        known, total, y = state
        begin, seeded = (min(max(0, n - known), len(x)) for n in (self.skip, self.skip + self.first))
        out = np.full(len(x), np.nan)
        if seeded > begin:
            totals = total + np.cumsum(x[begin:seeded])
            out[begin:seeded] = totals / (known + np.arange(begin, seeded) - self.skip + 1)
            total, y = float(totals[-1]), float(out[seeded - 1])
        if len(x) > seeded:
            out[seeded:] = affine_scan(x[seeded:], self.alpha, y)
            y = float(out[-1])
        return out, (known + len(x), total, y)

    def over(self, state: tuple[int, float, float], n: int, end: float, head: np.ndarray) -> tuple[int, float, float]:
        """The state after a block of ``n`` known values, known by its first ones and the end of its scan from 0."""
        used = min(max(0, self.skip + self.first - state[0]), n)
        _, (known, total, y) = self.advance(state, head[:used])
        if n > used:
            kept = (1.0 - self.alpha) ** (n - used)
            local = affine_scan(head[:used], self.alpha, 0.0)[-1] if used else 0.0
            y = kept * y + end - kept * local
        return known + n - used, total, y


_SUMMARY = "n array<long>, ends array<double>, heads array<array<double>>"
_STARTS = "known array<long>, totals array<double>, ys array<double>"


def recursive_means(df: DataFrame, means: list[Mean], series: list[str], ts: str, position: str | None = None, span: int = SPAN) -> DataFrame:
    """``df`` with the column ``out`` of each mean.

    A block is summed up by the number of its known values, which gives the factor
    (1-alpha)^n, the end of its scan from 0, and the few first values that a start averages.
    """
    placed = with_block(df, position or ts, span).withColumns({f"__x{i}": m.x.cast("double") for i, m in enumerate(means)})
    keys = [*series, "__b"]
    key_schema = _key_schema(placed, keys)
    plain = [(m.alpha, m.out, m.mean_start, m.least, m.skip) for m in means]  # no columns of the driver in tasks

    def remade() -> list[Mean]:
        return [Mean(None, *p) for p in plain]  # type: ignore[arg-type]

    def summarise(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(ts)
        n, ends, heads = [], [], []
        for i, m in enumerate(remade()):
            x, known = _floats(table.column(f"__x{i}"))
            x = x[known]
            n.append(len(x))
            ends.append(float(affine_scan(x, m.alpha, 0.0)[-1]) if len(x) else 0.0)
            heads.append(x[: m.skip + m.first].tolist())
        floats = pa.list_(pa.float64())
        cells = {"n": pa.array([n], pa.list_(pa.int64())), "ends": pa.array([ends], floats), "heads": pa.array([heads], pa.list_(floats))}
        return pa.table({**_keyed(keys, key, 1, table.schema), **cells})

    def carry(key: tuple, table: pa.Table) -> pa.Table:
        states, rows = [m.begin() for m in remade()], []
        table = table.sort_by("__b")
        for row in table.to_pylist():
            rows.append([list(s) for s in states])
            states = [m.over(s, *v) for m, s, v in zip(remade(), states, zip(row["n"], row["ends"], map(np.array, row["heads"]), strict=True), strict=True)]
        kinds = {"known": pa.int64(), "totals": pa.float64(), "ys": pa.float64()}
        columns = {name: pa.array([[s[j] for s in r] for r in rows], pa.list_(kind)) for j, (name, kind) in enumerate(kinds.items())}
        return pa.table({**{k: table.column(k) for k in keys}, **columns})

    def apply(key: tuple, table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by(ts)
        begun = start.to_pylist()[0]
        for i, m in enumerate(remade()):
            x, known = _floats(table.column(f"__x{i}"))
            state = (begun["known"][i], begun["totals"][i], begun["ys"][i])
            out, shown = np.zeros(len(x)), known.copy()
            out[known], _ = m.advance(state, x[known])
            shown[known] = state[0] + np.arange(1, int(known.sum()) + 1) >= m.skip + max(m.first, m.least)
            table = table.append_column(m.out, pa.array(out, pa.float64(), mask=~shown))
        return table.select(names)

    names = [*df.columns, *(m.out for m in means)]
    schema = type(df.schema)(df.schema.fields[:])
    for m in means:
        schema = schema.add(m.out, "double")
    sums = placed.groupBy(*keys).applyInArrow(summarise, f"{key_schema}, {_SUMMARY}")
    starts = sums.groupBy(*series).applyInArrow(carry, f"{key_schema}, {_STARTS}")
    return placed.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInArrow(apply, schema)


# state machines -------------------------------------------------------------------------


def _stretches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The pieces of sorted batches with equal keys, and whether each begins a new group."""
    import pyarrow.compute as pc

    before: list | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changed = np.zeros(n, dtype=bool)
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k))
            a, b = column.slice(1), column.slice(0, n - 1)
            other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
            changed[1:] |= np.asarray(other.to_numpy(zero_copy_only=False), dtype=bool)
        ends = [[batch.column(batch.schema.get_field_index(k))[i].as_py() for k in keys] for i in (0, n - 1)]
        changed[0] = ends[0] != before
        before = ends[1]
        cuts = np.flatnonzero(changed[1:]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
            yield bool(changed[a]), batch.slice(a, b - a)


#: A state machine: the state before any row is None; a step gives a value and the next state.
Step = Callable[[list | None, tuple], tuple[float | None, list]]


def state_scan(df: DataFrame, step: Step, inputs: list[str], series: list[str], ts: str, out: str, position: str | None = None, span: int = SPAN) -> DataFrame:
    """``df`` with the values of a state machine over the rows of each series in order.

    Blocks are run as if nothing came before them, which gives each a guess of its last
    state; then every block is run from its predecessor's guess.  A machine that forgets
    ends a block in the same state from either start.  Where it did not, the next block is
    joined to this one and both are run in turn, until every start has been confirmed: the
    values are those of one run over the whole series.  A series on which the machine never
    forgets ends up as one run, which streams through a task.

    States are lists of numbers and None; the input columns are read as doubles.
    """
    doubles = [F.col(c).cast("double").alias(f"__i{i}") for i, c in enumerate(inputs)]
    names = [f"__i{i}" for i in range(len(inputs))]
    rows = staged(with_block(df, position or ts, span).select(*series, "__b", F.col(ts).alias("__t"), *doubles), "state-scan")
    keys = [*series, "__g"]

    def placed(frame: DataFrame, plan: DataFrame, order: str) -> DataFrame:
        right = plan.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*series, "__b"])], "__g", "__start")
        same = F.lit(True)
        for i, c in enumerate([*series, "__b"]):
            same = same & frame[c].eqNullSafe(F.col(f"__k{i}"))
        met = frame.join(right, same).drop(*[f"__k{i}" for i in range(len(series) + 1)])
        return met.repartition(*keys).sortWithinPartitions(*keys, order)

    def values_of(part: pa.RecordBatch) -> list[tuple]:
        columns = [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]
        return list(zip(*columns, strict=True))

    def begun(part: pa.RecordBatch) -> list | None:
        return part.column(part.schema.get_field_index("__start"))[0].as_py()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, done = None, None, []
        for new, part in _stretches(batches, keys):
            if new:
                if last is not None:
                    done.append((*last, state))
                state, last = begun(part), tuple(part.column(part.schema.get_field_index(k))[0].as_py() for k in keys)
            for row in values_of(part):
                state = step(state, row)[1]
        if last is not None:
            done.append((*last, state))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(end_types)], names=[*keys, "end"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for new, part in _stretches(batches, keys):
            if new:
                state = begun(part)
            made = []
            for row in values_of(part):
                value, state = step(state, row)
                made.append(value)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in columns), pa.array(made, pa.float64())], names=[*columns, out])

    from pyspark.sql.pandas.types import to_arrow_type

    end_types = [*(to_arrow_type(df.schema[c].dataType) for c in series), pa.int64(), pa.list_(pa.float64())]
    end_schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in series), "__g long", "end array<double>"])
    columns, over = df.columns, _series_window(series, "__b")
    plan = staged(rows.select(*series, "__b").distinct().withColumns({"__g": F.col("__b"), "__start": F.lit(None).cast("array<double>")}), "plan")
    guess = None
    while True:
        found = placed(rows, plan, "__t").mapInArrow(ends, end_schema)
        # the end of a run of blocks belongs to its last block
        last = plan.select(*series, "__b", "__g", F.lead("__g").over(over).alias("next"))
        right = found.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "end")
        same = F.lit(True)
        for i, c in enumerate(keys):
            same = same & last[c].eqNullSafe(F.col(f"__k{i}"))
        own = F.when(F.col("next").isNull() | (F.col("next") != F.col("__g")), F.col("end"))
        state = last.join(right, same).select(*series, "__b", "__g", own.alias("end"))
        if guess is not None:
            old = guess.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*series, "__b"])], F.col("end").alias("was"))
            same = F.lit(True)
            for i, c in enumerate([*series, "__b"]):
                same = same & state[c].eqNullSafe(F.col(f"__k{i}"))
            state = state.join(old, same).select(*series, "__b", "__g", "end", (F.col("end").isNotNull() & ~F.col("end").eqNullSafe(F.col("was"))).alias("moved"))
        else:
            state = state.withColumn("moved", F.lit(False))
        state = staged(state, "ends")
        # a block goes on with the run before it if that ended otherwise than had been guessed
        joins = F.coalesce(F.lag("moved").over(over), F.lit(False))
        begins = F.when((F.col("__g") == F.col("__b")) & ~joins, F.col("__b"))
        following = state.withColumns({"__n": F.last(begins, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)), "__start": F.lag("end").over(over)})
        following = staged(following, "plan")
        stop = guess is not None and following.agg(F.count_if("moved") == 0).first()[0]
        # starts of later blocks of a run are not used
        plan = following.select(*series, "__b", F.col("__n").alias("__g"), F.when(F.col("__n") == F.col("__b"), F.col("__start")).alias("__start"))
        first_of = F.first("__start").over(Window.partitionBy(*series, "__g").orderBy("__b"))
        plan = plan.withColumn("__start", first_of)
        guess = following.select(*series, "__b", "end")
        if stop:
            break
    full = with_block(df, position or ts, span)
    for i, d in enumerate(doubles):
        full = full.withColumn(f"__i{i}", F.col(inputs[i]).cast("double"))
    return placed(full, plan, ts).mapInArrow(apply, type(df.schema)(df.schema.fields[:]).add(out, "double"))


# rolling medians ------------------------------------------------------------------------


class SortedWindow:
    """A sorted collection in short runs: insert, delete and select by rank cost a search and one short move."""

    LOAD = 256

    def __init__(self) -> None:
        self.runs: list[list[float]] = []
        self.tops: list[float] = []  # the largest value of each run
        self.size = 0

    def insert(self, value: float) -> None:
        self.size += 1
        if not self.runs:
            self.runs.append([value])
            self.tops.append(value)
            return
        at = min(bisect_left(self.tops, value), len(self.tops) - 1)
        run = self.runs[at]
        insort(run, value)
        self.tops[at] = run[-1]
        if len(run) > 2 * self.LOAD:
            self.runs[at : at + 1] = [run[: self.LOAD], run[self.LOAD :]]
            self.tops[at : at + 1] = [run[self.LOAD - 1], run[-1]]

    def delete(self, value: float) -> None:
        at = bisect_left(self.tops, value)
        run = self.runs[at]
        del run[bisect_left(run, value)]
        self.size -= 1
        if run:
            self.tops[at] = run[-1]
        else:
            del self.runs[at], self.tops[at]

    def select(self, rank: int) -> float:
        for run in self.runs:
            if rank < len(run):
                return run[rank]
            rank -= len(run)
        raise IndexError(rank)

    def median(self) -> float:
        half = self.size // 2
        return self.select(half) if self.size % 2 else 0.5 * self.select(half - 1) + 0.5 * self.select(half)


def medians_before(x: np.ndarray, known: np.ndarray, size: int, least: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the known values in the ``size`` rows before each row from ``first`` on, and which there are."""
    window, out, ok = SortedWindow(), np.zeros(len(x) - first), np.zeros(len(x) - first, dtype=bool)
    values, flags = x.tolist(), known.tolist()
    for i in range(max(0, first - size), len(values)):
        if i >= first and window.size >= max(1, least):
            out[i - first], ok[i - first] = window.median(), True
        if i - size >= max(0, first - size) and flags[i - size]:
            window.delete(values[i - size])
        if flags[i]:
            window.insert(values[i])
    return out, ok


def rolling_medians(df: DataFrame, wanted: dict[str, tuple[Column, int, int]], series: list[str], index: str, rows: int = 20_000) -> DataFrame:
    """``df`` with, for each output name, the median of (values, size, least): the known values of the ``size`` rows before.

    ``index`` numbers the rows of each series from 0 without gaps; a block of ``rows`` rows
    also gets the rows before it that its first windows reach.
    """
    reach = max(size for _, size, _ in wanted.values())
    rows = max(rows, reach)
    marked = df.withColumns({f"__x{i}": x.cast("double") for i, (x, _, _) in enumerate(wanted.values())})
    own = F.floor(F.col(index) / rows)
    copies = F.array_compact(F.array(own, F.when(F.pmod(F.col(index), F.lit(rows)) >= rows - reach, own + 1)))
    spread = marked.withColumn("__b", F.explode(copies))
    schema, names = type(df.schema)(df.schema.fields[:]), [*df.columns, *wanted]
    for name in wanted:
        schema = schema.add(name, "double")
    sizes = [(name, size, least) for name, (_, size, least) in wanted.items()]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(index)
        first = int(np.searchsorted(table.column(index).to_numpy(), key[-1].as_py() * rows))
        kept = table.slice(first)
        for i, (name, size, least) in enumerate(sizes):
            values, ok = medians_before(*_floats(table.column(f"__x{i}")), size, least, first)
            kept = kept.append_column(name, pa.array(values, pa.float64(), mask=~ok))
        return kept.select(names)

    return spread.groupBy(*series, "__b").applyInArrow(run, schema)


# fills and running sums -----------------------------------------------------------------


def _series_window(series: list[str], by: str) -> WindowSpec:
    """A window over the blocks of a series: a few rows, also where there is one series only."""
    return Window.partitionBy(*(series or [F.lit(0)])).orderBy(by)


def meet_blocks(rows: DataFrame, carried: DataFrame, series: list[str]) -> DataFrame:
    """``rows`` with what was carried to their block; null keys meet."""
    keys = [*series, "__b"]
    right = carried.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], *[c for c in carried.columns if c not in keys])
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & rows[c].eqNullSafe(F.col(f"__k{i}"))
    return rows.join(right, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def filled_forward(df: DataFrame, columns: list[str], series: list[str], ts: str, position: str | None = None, span: int = SPAN) -> DataFrame:
    """``df`` with the last known value in place of each NULL of ``columns``."""
    rows = with_block(df, position or ts, span)
    last = rows.groupBy(*series, "__b").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"__l{i}") for i, c in enumerate(columns)])
    before = _series_window(series, "__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*series, "__b", *[F.last(f"__l{i}", ignorenulls=True).over(before).alias(f"__c{i}") for i in range(len(columns))])
    inside = Window.partitionBy(*series, "__b").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    made = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__c{i}")) for i, c in enumerate(columns)}
    return meet_blocks(rows, carried, series).withColumns(made).select(*df.columns)


def running_sums(df: DataFrame, wanted: dict[str, Column], series: list[str], ts: str, position: str | None = None, span: int = SPAN) -> DataFrame:
    """``df`` with the sum of each expression over the rows up to and including each row; NULLs add nothing."""
    rows = with_block(df, position or ts, span).withColumns({f"__s{i}": x for i, x in enumerate(wanted.values())})
    totals = rows.groupBy(*series, "__b").agg(*[F.sum(f"__s{i}").alias(f"__t{i}") for i in range(len(wanted))])
    before = _series_window(series, "__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*series, "__b", *[F.sum(f"__t{i}").over(before).alias(f"__c{i}") for i in range(len(wanted))])
    inside = Window.partitionBy(*series, "__b").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    sums = {}
    for i, name in enumerate(wanted):
        own = F.sum(f"__s{i}").over(inside)
        sums[name] = F.when(own.isNotNull() | F.col(f"__c{i}").isNotNull(), F.coalesce(F.col(f"__c{i}"), F.lit(0)) + F.coalesce(own, F.lit(0)))
    return meet_blocks(rows, carried, series).withColumns(sums).select(*df.columns, *wanted)


# interpolation --------------------------------------------------------------------------


def interpolated(df: DataFrame, values: list[str], series: list[str], ts: str, step: int, span: int = SPAN) -> DataFrame:
    """Rows at the multiples of ``step`` from the first to the last time of each series.

    Values are linear in time between the nearest known ones, beyond these the nearest one;
    a column that is never known stays NULL.  Of known values at one time the largest counts.
    A block is summed up by its first and last known time and value of each column, which
    are carried to the blocks after and before it; blocks without rows are made.
    """
    span = max(step, span - span % step)
    rows = with_block(df.select(*series, F.col(ts).cast("long").alias(ts), *[F.col(c).cast("double").alias(c) for c in values]), ts, span)
    keys = [*series, "__b"]
    key_schema = _key_schema(rows, keys)

    def merged(table: pa.Table, column: str, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct times of the known values in order, and the largest value at each."""
        x, known = _floats(table.column(column))
        t, x = times[known], x[known]
        if not len(t):
            return t, x
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        return t[first], np.maximum.reduceat(x, first)

    def summarise(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(ts)
        times = table.column(ts).to_numpy()
        known = [merged(table, c, times) for c in values]
        cells = {name: [[(float(a[at]) if len(a) else None) for a in (k[i] for k in known)]] for name, i, at in (("t0", 0, 0), ("v0", 1, 0), ("t1", 0, -1), ("v1", 1, -1))}
        cells |= {n: pa.array([[None if v is None else int(v) for v in cells[n][0]]], pa.list_(pa.int64())) for n in ("t0", "t1")}
        cells |= {n: pa.array(cells[n], pa.list_(pa.float64())) for n in ("v0", "v1")}
        return pa.table({**_keyed(keys, key, 1, table.schema), "low": [int(times[0])], "high": [int(times[-1])], **cells})

    def carry(key: tuple, table: pa.Table) -> pa.Table:
        found = {r["__b"]: r for r in table.to_pylist()}
        low, high = min(r["low"] for r in found.values()), max(r["high"] for r in found.values())
        every = list(range(min(found), max(found) + 1))
        out = []
        past = [[None] * len(values)] * 2
        for b in every:
            out.append({"__b": b, "low": low, "high": high, "t0": past[0], "v0": past[1]})
            if b in found:
                past = [[n if n is not None else o for n, o in zip(found[b][name], old, strict=True)] for name, old in zip(("t1", "v1"), past, strict=True)]
        ahead = [[None] * len(values)] * 2
        for row in reversed(out):
            row |= {"t1": ahead[0], "v1": ahead[1]}
            if row["__b"] in found:
                ahead = [[n if n is not None else o for n, o in zip(found[row["__b"]][name], old, strict=True)] for name, old in zip(("t0", "v0"), ahead, strict=True)]
        kinds = {"__b": pa.int64(), "low": pa.int64(), "high": pa.int64(), "t0": pa.list_(pa.int64()), "v0": pa.list_(pa.float64()), "t1": pa.list_(pa.int64()), "v1": pa.list_(pa.float64())}
        return pa.table({**_keyed(series, key, len(out), table.schema), **{n: pa.array([r[n] for r in out], kind) for n, kind in kinds.items()}})

    def fill(key: tuple, table: pa.Table, start: pa.Table) -> pa.Table:
        table, edge = table.sort_by(ts), start.to_pylist()[0]
        b = key[-1].as_py()
        first, last = max(-(-edge["low"] // step) * step, b * span), min(edge["high"] // step * step, (b + 1) * span - step)
        grid = np.arange(first, last + 1, step, dtype=np.int64)
        times = table.column(ts).to_numpy()
        out = {**_keyed(series, key[:-1], len(grid), start.schema), ts: pa.array(grid)}
        for i, c in enumerate(values):
            t, x = merged(table, c, times)
            if edge["t0"][i] is not None:
                t, x = np.append(edge["t0"][i], t), np.append(edge["v0"][i], x)
            if edge["t1"][i] is not None:
                t, x = np.append(t, edge["t1"][i]), np.append(x, edge["v1"][i])
            # times from the first one on, so that doubles hold them exactly
            out[c] = pa.array(np.interp(grid - t[0], t - t[0], x) if len(t) else np.zeros(len(grid)), pa.float64(), mask=None if len(t) else np.ones(len(grid), bool))
        return pa.table(out)

    pairs = "t0 array<long>, v0 array<double>, t1 array<long>, v1 array<double>"
    sums = rows.groupBy(*keys).applyInArrow(summarise, f"{key_schema}, low long, high long, {pairs}")
    edges = sums.groupBy(*series).applyInArrow(carry, f"{key_schema}, low long, high long, {pairs}")
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in series), f"`{ts}` long", *(f"`{c}` double" for c in values)])
    return rows.groupBy(*keys).cogroup(edges.groupBy(*keys)).applyInArrow(fill, schema)
