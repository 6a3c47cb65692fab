"""Exact quantiles, moments of lags, windows, unit roots, normality, evaluation and tuning against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import moments, quantiles
from marketloom.operators import losses, preparation, statistics
from marketloom.operators.labels import LabelGenerator

SHARES = (0.0, 0.01, 0.25, 1 / 3, 0.5, 0.999, 1.0)


@pytest.mark.parametrize("limit", [3, 50_000])
def test_exact_quantiles(spark, monkeypatch, limit):
    """Ties beyond the limit, outliers, few and no values; with a small limit brackets are narrowed again and again."""
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    rng = random.Random(4)
    rows = [(float(i % 7), rng.gauss(0, 1), 5.0 if i % 3 else rng.uniform(0, 9), None if i else 2.5, None, float("nan") if i % 2 else 1e300 * rng.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in df.columns}, SHARES)
    for i, c in enumerate(df.columns):
        known = [r[i] for r in rows if r[i] is not None and not math.isnan(r[i])]
        want = [float(np.quantile(known, p)) for p in SHARES] if known else [None] * len(SHARES)
        assert got[c] == pytest.approx(want, rel=1e-12, abs=1e-12) if known else got[c] == want, c


def lag_rows(values, lags):
    x = np.array(values)
    return np.array([np.concatenate([x[t - k] for k in range(lags + 1)]) for t in range(lags, len(x))])


@pytest.mark.parametrize("rows", [60, 20_000])
def test_moments_of_many_lags_far_from_zero(spark, monkeypatch, rows):
    monkeypatch.setattr(moments, "ROWS", rows)
    rng = np.random.default_rng(6)
    data = 1e6 + np.cumsum(rng.normal(size=(500, 2)), axis=0)
    data[100, 0] = np.nan
    df = spark.createDataFrame([(i, None if math.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(data)], "t long, a double, b double")
    found = moments.lagged_moments(df, {"a": F.col("a"), "b": F.col("b")}, "t", [1, 5, 30], span=70)
    for lags, m in found.items():
        wide = lag_rows(data, lags)
        wide = wide[~np.isnan(wide).any(axis=1)]
        away = wide - wide.mean(axis=0)
        assert m.n == len(wide)
        assert np.allclose(m.mean, wide.mean(axis=0), rtol=1e-12) and np.allclose(m.products, away.T @ away, rtol=1e-8)
        on = list(range(2, 2 * lags + 2))
        coef, rss = m.regress(0, on)
        want = np.linalg.lstsq(away[:, on], away[:, 0], rcond=None)[0]
        assert np.allclose(coef[1:], want, atol=1e-6) and rss == pytest.approx(float(((away[:, 0] - away[:, on] @ want) ** 2).sum()), rel=1e-6)
    centre = float(np.nanmean(data[:, 0]))
    d = np.nan_to_num(data[:, 0] - centre)
    assert np.allclose(moments.lagged_products(df, F.col("a"), "t", 4, centre, span=70), [d[k:] @ d[: len(d) - k] for k in range(5)])
    granger = statistics.granger(df.filter("a is not null"), "a", "b", "t", 30)
    assert granger.count() == 60


@pytest.mark.parametrize("rows", [1, 4096])
def test_windows_are_whole(spark, rows):
    data = [(s, i, float(i), None if i == 9 else float(-i), i * 10.0) for s, n in (("a", 50), ("b", 7), ("c", 12)) for i in range(n)]
    df = spark.createDataFrame(data, "s string, t long, x double, y double, z double")
    made = preparation.windows(df, "t", ["x", "y"], ["z"], ["x"], "z", 8, (1, 3), stride=2, series=["s"], rows=rows, span=13).collect()
    assert sorted((r.s, r.start) for r in made) == [("a", i) for i in range(0, 40, 2)] + [("c", 0)]
    for r in made:
        i = r.start
        assert [tuple(p) for p in r.past] == [(float(k), None if k == 9 else float(-k)) for k in range(i, i + 8)]
        assert [tuple(p) for p in r.future] == [(k * 10.0,) for k in range(i + 8, i + 11)]
        assert list(r.static) == [float(i)] and list(r.targets) == [(i + 8) * 10.0, (i + 10) * 10.0]
    none = preparation.windows(df, "t", ["x"], [], [], "z", 8, (3,), series=["s"], rows=rows)
    assert [list(map(list, r.future)) for r in none.filter("s = 'c'").collect()] == [[[], [], []]] * 2
    parts = {r.part: r.n for r in preparation.split_windows(spark.createDataFrame(made), 0.5, 0.25).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert parts == {"train": 10, "val": 5, "test": 6}


def test_shapiro_of_a_published_example(spark):
    """Weights of eleven men (Shapiro and Wilk 1965): W = 0.79."""
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    r = statistics.shapiro(spark.createDataFrame([(i, float(x)) for i, x in enumerate(men)] + [(99, None)], "t long, x double"), "x", "t").first()
    assert r.n == 11 and r.w == pytest.approx(0.78881, abs=2e-4) and r.p == pytest.approx(0.0067, abs=2e-4)
    flat = statistics.shapiro(spark.createDataFrame([(i, 1.0) for i in range(9)], "t long, x double"), "x", "t").first()
    assert flat.w is None
    weights = statistics.shapiro_weights(50)
    assert weights @ weights == pytest.approx(1.0) and np.allclose(weights, -weights[::-1])
    bell = statistics.shapiro(spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.random.default_rng(1).normal(size=6000))], "t long, x double"), "x", "t").first()
    assert bell.n == 5000 and bell.p > 0.01


def test_unit_root_p_values(spark):
    """The published critical values have their p-values; a walk keeps its unit root, noise has none."""
    for level, (value, _, _) in statistics.ADF_CRITICAL.items():
        assert statistics.adf_p(value) == pytest.approx(level / 100, abs=0.002)
    assert statistics.adf_p(-30) == 0 and statistics.adf_p(3) == 1
    for level, value in statistics.KPSS_CRITICAL.items():
        assert statistics.kpss_p(value) == pytest.approx(level / 100)
    rng = np.random.default_rng(2)
    noise = rng.normal(size=600)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(noise, np.cumsum(noise)))], "t long, noise double, walk double")
    assert statistics.adf(df, "noise", "t").first().p < 0.01 and statistics.adf(df, "walk", "t").first().p > 0.05
    assert statistics.kpss(df, "noise", "t").first().p > 0.05 and statistics.kpss(df, "walk", "t").first().p < 0.05


def test_evaluation_counts_each_horizon(spark):
    rows = [([[1.0, -1.0], [1.0, 1.0]], [1, 0]), ([[-1.0, -1.0], [1.0, -1.0]], [1, None]), (None, [1, 1])]
    got = {r.horizon: r for r in losses.evaluate(spark.createDataFrame(rows, "z array<array<double>>, y array<int>"), "z", "y").collect()}
    assert (got[0].n, got[0].accuracy, got[1].n, got[1].accuracy, got[None].n, got[None].accuracy) == (2, 0.5, 1, 0.0, 3, pytest.approx(1 / 3))
    soft = lambda z: max(z, 0) + math.log1p(math.exp(-abs(z)))
    assert got[0].loss == pytest.approx(((soft(-1) + soft(-1)) / 2 + (soft(1) + soft(-1)) / 2) / 2)


def test_calibration_matches_the_grid_point_by_point(spark):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    rows = [(i * 60_000, float(c), *map(float, rng.uniform(1, 9, 10))) for i, c in enumerate(close)]
    names = [f"depth_{b}" for b in (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, ["open_time", "close", *names])
    gen = LabelGenerator(horizons=(1, 3), span=20, roll_liq=20, scale_window=30, scale_least=5)
    target = {-2: 0.1, -1: 0.2, 0: 0.4, 1: 0.2, 2: 0.1}
    alphas, gammas = (0.4, 1.0, 2.2), (0.8, 1.5)
    got = {(round(r.alpha, 6), r.gamma): r.error for r in gen.calibrate(df, target, alphas, gammas).collect()}
    assert len(got) == 6
    base = gen.base(df).persist()
    for a in alphas:
        for g in gammas:
            full = LabelGenerator(**{**gen.__dict__, "alpha": a, "gamma": g})
            made = full.thresholds(base)
            error = 0.0
            for h in gen.horizons:
                counts = {r[0]: r[1] for r in made.select(full.label(h).alias("c")).filter("c is not null").groupBy("c").count().collect()}
                error += sum(abs(counts.get(c, 0) / sum(counts.values()) - target[c]) for c in target)
            assert got[a, g] == pytest.approx(error, abs=1e-12)
    base.unpersist()
