"""Scans over blocks against plain runs over the whole series, with blocks of many lengths."""

import random
import statistics as st

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import blocks
from marketloom.operators import indicators, reshape


def series_rows(n=400, seed=3, gaps=0.15):
    rng = random.Random(seed)
    out = []
    for s in ("a", "b", None):
        t = 0
        for _ in range(n if s != "b" else 7):
            t += rng.choice([1, 1, 1, 2, 90])
            out.append((s, t, None if rng.random() < gaps else rng.uniform(-5, 5)))
    return out


@pytest.mark.parametrize("span", [1, 37, 100_000])
def test_recursive_means_over_blocks(spark, span):
    rows = series_rows()
    df = spark.createDataFrame(rows, "s string, t long, x double")
    cases = [(0.3, None, 1, 0), (0.01, 20, 5, 0), (0.5, 3, 9, 4), (1.0, None, 1, 0), (0.1, 50, 1, 30)]
    means = [blocks.Mean(F.col("x"), alpha, f"y{i}", start, least, skip) for i, (alpha, start, least, skip) in enumerate(cases)]
    made = blocks.recursive_means(df, means, ["s"], "t", span=span)
    assert made.columns == ["s", "t", "x", "y0", "y1", "y2", "y3", "y4"]
    got = {(r.s, r.t): r for r in made.collect()}
    assert len(got) == len(rows)
    for i, (alpha, start, least, skip) in enumerate(cases):
        state = {}
        for s, t, x in rows:
            known, total, y = state.get(s, (0, 0.0, 0.0))
            want, first = None, start or 1
            if x is not None:
                known += 1
                if known > skip:
                    total, y = (total + x, (total + x) / (known - skip)) if known <= skip + first else (total, (1 - alpha) * y + alpha * x)
                want = y if known >= skip + max(first, least) else None
                state[s] = (known, total, y)
            assert got[s, t][f"y{i}"] == (None if want is None else pytest.approx(want, abs=1e-9)), (i, s, t)


def test_one_series_is_spread_over_tasks(spark):
    df = spark.range(3000).select(F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = blocks.recursive_means(df, [blocks.Mean(F.col("x"), 0.1, "y")], [], "t", span=100)
        assert made.select(F.spark_partition_id()).distinct().count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert blocks.recursive_means(df.limit(0), [blocks.Mean(F.col("x"), 0.1, "y")], [], "t").count() == 0


def bars(spark, kind, n=300):
    rng = np.random.default_rng(7)
    out = []
    for s in ("a", "b"):
        steps = {"walk": rng.normal(0, 1, n), "up": np.full(n, 0.5), "down": np.full(n, -0.5), "flat": np.zeros(n), "late": np.concatenate([np.full(n // 2, 0.5), rng.normal(0, 1, n - n // 2)])}[kind]
        close = 500 + np.cumsum(steps)
        out += [(s, i, float(c + abs(rng.normal(0, 0.3 * (kind == "walk"))) + 0.1), float(c - 0.1)) for i, c in enumerate(close)]
    return spark.createDataFrame(out, "s string, t long, high double, low double")


@pytest.mark.parametrize("kind", ["walk", "up", "down", "flat", "late"])
@pytest.mark.parametrize("span", [11, 64])
def test_stop_and_reverse_over_blocks(spark, kind, span):
    """The same stops as one run over the series: where it turns often, never, and from the middle on."""
    df = bars(spark, kind)
    got = indicators.add(df, [("sar", {"acceleration": 0.02, "maximum": 0.2})], "t", ["s"], span=span).orderBy("s", "t").toPandas()
    assert len(got) == 600
    for _, g in got.groupby("s"):
        want = list(indicators.sar_values(iter(zip(g.high, g.low)), 0.02, 0.2))
        assert np.isnan(g.sar.iloc[0]) and g.sar.tolist()[1:] == want[1:]


@pytest.mark.parametrize("span", [1, 40, 100_000])
def test_fills_and_running_sums_over_blocks(spark, span):
    rows = series_rows(gaps=0.6)
    df = spark.createDataFrame(rows, "s string, t long, x double")
    filled = {(r.s, r.t): r.x for r in blocks.filled_forward(df, ["x"], ["s"], "t", span=span).collect()}
    sums = {(r.s, r.t): r.y for r in blocks.running_sums(df, {"y": F.col("x")}, ["s"], "t", span=span).collect()}
    carried = {(r.s, r.t): (r.x, r.distance) for r in reshape.carry_forward(df, "t", ["s"], span=span).collect()}
    last, total, age = {}, {}, {}
    assert len(filled) == len(sums) == len(carried) == len(rows)
    for s, t, x in rows:
        if x is not None:
            last[s], total[s], age[s] = x, total.get(s, 0.0) + x, 0.0
        elif s in age:
            age[s] += 1
        assert filled[s, t] == last.get(s)
        assert sums[s, t] == (pytest.approx(total[s], abs=1e-9) if s in total else None)
        assert carried[s, t] == (last.get(s), age.get(s))


@pytest.mark.parametrize("span", [10, 55, 100_000])
def test_interpolation_over_blocks(spark, span):
    """Blocks without rows, columns that are known rarely or never, repeated times."""
    rng = random.Random(9)
    rows = []
    for s in ("a", None):
        t = 1000
        for _ in range(80):
            t += rng.choice([0, 1, 3, 7, 150])
            rows.append((s, t, rng.uniform(0, 9) if rng.random() < 0.7 else None, rng.uniform(0, 9) if rng.random() < 0.05 else None, None))
    df = spark.createDataFrame(rows, "s string, t long, x double, y double, z double")
    got = {(r.s, r.t): r for r in reshape.interpolate_to_grid(df, "t", 10, ["s"], span=span).collect()}
    for s in ("a", None):
        own = [r for r in rows if r[0] == s]
        grid = range(-(-own[0][1] // 10) * 10, own[-1][1] // 10 * 10 + 1, 10)
        assert sorted(t for k, t in got if k == s) == list(grid)
        for i, name in ((2, "x"), (3, "y"), (4, "z")):
            known = {}
            for r in own:
                if r[i] is not None:
                    known[r[1]] = max(known.get(r[1], r[i]), r[i])
            for t in grid:
                want = None if not known else float(np.interp(t, sorted(known), [known[k] for k in sorted(known)]))
                assert got[s, t][name] == (None if want is None else pytest.approx(want, abs=1e-9)), (s, t, name)


def test_sorted_window(monkeypatch):
    monkeypatch.setattr(blocks.SortedWindow, "LOAD", 4)
    rng = random.Random(1)
    window, plain = blocks.SortedWindow(), []
    for _ in range(3000):
        if plain and rng.random() < (0.3 if len(plain) < 60 else 0.6):
            x = plain.pop(rng.randrange(len(plain)))
            window.delete(x)
        else:
            x = rng.choice([1.0, 2.0, float(rng.randrange(40))])
            plain.append(x)
            window.insert(x)
        assert window.size == len(plain)
        if plain:
            assert window.median() == st.median(plain) and window.select(0) == min(plain) and window.select(len(plain) - 1) == max(plain)


@pytest.mark.parametrize("rows", [30, 1000])
def test_rolling_medians_over_blocks(spark, rows):
    data = [(s, i, None if i % 7 == 3 else float((i * 37) % 101)) for s in ("a", "b") for i in range(260 if s == "a" else 5)]
    df = spark.createDataFrame(data, "s string, i long, x double")
    made = blocks.rolling_medians(df, {"m": (F.col("x"), 30, 10), "n": (F.col("x"), 4, 1)}, ["s"], "i", rows)
    got = {(r.s, r.i): (r.m, r.n) for r in made.collect()}
    assert len(got) == len(data)
    for s, i, _ in data:
        for size, least, value in ((30, 10, got[s, i][0]), (4, 1, got[s, i][1])):
            before = [x for q, j, x in data if q == s and i - size <= j < i and x is not None]
            assert value == (pytest.approx(st.median(before)) if len(before) >= least else None), (s, i, size)


def test_only_summaries_meet_in_one_partition(spark):
    df = spark.createDataFrame([(0, 1.0)], "create_time long, x double")
    plan = reshape.carry_forward(df)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = [i for i, line in enumerate(plan) if "SinglePartition" in line]
    assert len(at) == 1 and "HashAggregate(keys=[__b" in plan[at[0] + 1]
