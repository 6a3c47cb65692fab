"""Exact quantiles in bounded memory.

A sketch gives a narrow bracket round each wanted rank; one pass counts what lies below and
inside it; brackets that still hold more than ``LIMIT`` values are narrowed by a sketch of
their own; then the few values inside, with their counts, finish the selection.  So no task
and not the driver ever holds more than a sketch or ``LIMIT`` values a bracket, however many
distinct values a column has, and ties beyond all bounds are one value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.stage import staged

LIMIT = 50_000
ACCURACY = 10_000


@dataclass
class _Rank:
    """A wanted rank (from 0) of a column, and the bracket of values that holds it."""

    column: int
    rank: int
    low: float
    high: float
    below: int = 0
    inside: int = 0
    value: float | None = None


def _sketches(values: list[Column], wanted: list[tuple[int, Column | None, list[float]]], df: DataFrame) -> list[list[float]]:
    aggs = []
    for i, (column, inside, shares) in enumerate(wanted):
        x = values[column] if inside is None else F.when(inside, values[column])
        aggs.append(F.percentile_approx(x, F.array(*[F.lit(min(1.0, max(0.0, p))) for p in shares]), F.lit(ACCURACY)).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    return [list(row[f"s{i}"]) for i in range(len(wanted))]


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: tuple[float, ...]) -> dict[str, list[float | None]]:
    """For each column the values at ``shares`` of the way through its sorted known values, linear between neighbours.

    NaN counts as missing; a column without known values gives None.
    """
    names = list(columns)
    known = [F.when(~F.isnan(c.cast("double")), c.cast("double")) for c in columns.values()]
    df = staged(df.select(*[k.alias(f"v{i}") for i, k in enumerate(known)]), "quantiles")  # read by every pass
    values = [F.col(f"v{i}") for i in range(len(names))]
    edge = 4.0 / ACCURACY
    around = [x for p in shares for x in (p - edge, p + edge)]
    row = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(values)], *[F.min(v).alias(f"a{i}") for i, v in enumerate(values)], *[F.max(v).alias(f"b{i}") for i, v in enumerate(values)],
                 *[F.percentile_approx(v, F.array(*[F.lit(min(1.0, max(0.0, p))) for p in around]), F.lit(ACCURACY)).alias(f"s{i}") for i, v in enumerate(values)]).first()
    counts = [row[f"n{i}"] for i in range(len(names))]
    ranks: dict[tuple[int, int], _Rank] = {}
    for i, n in enumerate(counts):
        for j, p in enumerate(shares):
            if n:
                low, high = row[f"s{i}"][2 * j], row[f"s{i}"][2 * j + 1]
                for r in {int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1)}:
                    ranks[i, r] = _Rank(i, r, row[f"a{i}"] if p <= edge else low, row[f"b{i}"] if p >= 1 - edge else high)
    open_ones = list(ranks.values())
    while open_ones:
        test = lambda t: (values[t.column] >= t.low) & (values[t.column] <= t.high)
        found = df.agg(*[F.count_if(values[t.column] < t.low).alias(f"l{k}") for k, t in enumerate(open_ones)], *[F.count_if(test(t)).alias(f"i{k}") for k, t in enumerate(open_ones)]).first()
        for k, t in enumerate(open_ones):
            t.below, t.inside = found[f"l{k}"], found[f"i{k}"]
            if not t.below <= t.rank < t.below + t.inside:  # a sketch may be off by more than it promises: begin with all values
                t.low, t.high, t.below, t.inside = row[f"a{t.column}"], row[f"b{t.column}"], 0, counts[t.column]
            if t.low == t.high:
                t.value = t.low
        _finish(df, values, [t for t in open_ones if t.value is None and t.inside <= LIMIT])
        open_ones = [t for t in open_ones if t.value is None]
        if open_ones:
            wanted = [(t.column, test(t), [(t.rank - t.below) / t.inside + d for d in (-edge, edge)]) for t in open_ones]
            for t, (low, high) in zip(open_ones, _sketches(values, wanted, df), strict=True):
                # a bracket that does not shrink is cut in two
                middle = t.low + (t.high - t.low) / 2
                if (low, high) == (t.low, t.high):
                    at_most = df.agg(F.count_if(values[t.column] <= middle)).first()[0]
                    low, high = (t.low, middle) if t.rank < at_most else (middle, t.high)
                t.low, t.high = low, high
    out: dict[str, list[float | None]] = {}
    for i, name in enumerate(names):
        out[name] = []
        for p in shares:
            if not counts[i]:
                out[name].append(None)
                continue
            place = p * (counts[i] - 1)
            r = int(place)
            a, b = ranks[i, r].value, ranks[i, min(counts[i] - 1, r + 1)].value
            out[name].append(a if a == b else (1 - (place - r)) * a + (place - r) * b)
    return out


def _finish(df: DataFrame, values: list[Column], small: list[_Rank]) -> None:
    """The wanted values of brackets with few rows, from one sort of what lies inside."""
    if not small:
        return
    cells = [F.when((values[t.column] >= t.low) & (values[t.column] <= t.high), F.struct(F.lit(k).alias("k"), values[t.column].alias("x"))) for k, t in enumerate(small)]
    inside = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.k", "c.x").agg(F.count(F.lit(1)).alias("n"))
    passed = dict.fromkeys(range(len(small)), 0)
    for k, x, n in inside.orderBy("k", "x").collect():
        t = small[k]
        if t.value is None and t.rank - t.below < passed[k] + n:
            t.value = x
        passed[k] += n
