"""Distribution, dependence and causality statistics of series.

Spark reduces the data to moments, counts or cross-products, a handful of numbers; only
those reach the driver, where small matrices are solved with numpy.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import blocks
from marketloom.functions import distributions as D
from marketloom.functions import series as S
from marketloom.functions.moments import Moments, lagged_moments, lagged_pairs, lagged_products
from marketloom.functions.quantiles import exact_quantiles
from marketloom.functions.stage import staged


def returns(df: DataFrame, ts: str, price: str = "close", series: list[str] | None = None, out: str = "ret") -> DataFrame:
    """Log returns of positive prices, rows without one left out."""
    positive = df.filter(F.col(price) > 0)
    return positive.withColumn(out, S.log_return(F.col(price), S.order(series or [], ts))).filter(F.col(out).isNotNull())


def _one_row(df: DataFrame, **values) -> DataFrame:
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in values.items())
    return df.sparkSession.createDataFrame([tuple(values.values())], schema)


def derived_columns(df: DataFrame, ts: str, series: list[str] | None = None) -> DataFrame:
    """Rows with a log return, the change within the bar and its spread in percent, and the calendar, all finite."""
    at = F.timestamp_millis(ts)
    out = {
        "returns": S.log_return(F.col("close"), S.order(series or [], ts)),
        "price_change_pct": S.ratio(F.col("close") - F.col("open"), F.col("open")) * 100,
        "high_low_spread": S.ratio(F.col("high") - F.col("low"), F.col("low")) * 100,
        "hour": F.hour(at), "day_of_week": F.weekday(at), "is_weekend": F.weekday(at).isin(5, 6)}
    full = df.withColumns(out)
    known = ["returns", "price_change_pct", "high_low_spread"]
    return full.withColumns({c: S.clean(F.col(c)) for c in known}).dropna(subset=known)


def flag_outliers(df: DataFrame, x: str, z: float = 3.0, top: float = 0.01) -> DataFrame:
    """``df`` with ``by_z`` (over ``z`` deviations), ``by_iqr`` and ``extreme`` (the largest ``top`` share of |x|)."""
    limits = df.agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))  # one row
    cuts = exact_quantiles(df, {"x": F.col(x)}, (0.25, 0.75))["x"]
    above = exact_quantiles(df, {"x": F.abs(F.col(x))}, (1 - top,))["x"][0]
    low, high = (F.lit(c).cast("double") for c in cuts)
    reach = 1.5 * (high - low)
    flags = {
        "by_z": F.abs(F.col(x) - F.col("__m")) > z * F.col("__s"),
        "by_iqr": (F.col(x) < low - reach) | (F.col(x) > high + reach),
        "extreme": F.abs(x) > F.lit(above).cast("double")}
    flagged = {n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}
    return df.crossJoin(F.broadcast(limits)).withColumns(flagged).drop("__m", "__s")


def outlier_breakdown(df: DataFrame, x: str) -> DataFrame:
    """(rule, n, pct, up, down): how many rows each rule of ``flag_outliers`` marks, and to which side."""
    rules = ("by_z", "by_iqr", "extreme")
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("hit")) for r in rules])
    long = flag_outliers(df, x).select(F.col(x).alias("x"), F.explode(cells).alias("c")).select("x", "c.*")
    return long.groupBy("rule").agg(
        F.count_if("hit").alias("n"), (F.count_if("hit") / F.count(F.lit(1)) * 100).alias("pct"),
        F.count_if(F.col("hit") & (F.col("x") > 0)).alias("up"), F.count_if(F.col("hit") & (F.col("x") < 0)).alias("down"))


def normality(df: DataFrame, x: str) -> DataFrame:
    """Jarque-Bera and D'Agostino K2 with p-values, from moments."""
    m = df.agg(F.count(x).alias("n"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k")).first()
    n, s, k = float(m.n), m.s or 0.0, m.k or 0.0
    jb = n / 6 * (s * s + k * k / 4)
    y = s * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    z1 = 1 / math.sqrt(0.5 * math.log(w2)) * math.asinh(y / math.sqrt(2 / (w2 - 1)))
    mean, var = -6 / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x_ = (k - mean) / math.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    base = (1 - 2 / a) / (1 + x_ * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(base) ** (1 / 3), base)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return _one_row(df, n=int(n), jarque_bera=jb, jarque_bera_p=D.chi2_sf(jb, 2), dagostino=k2, dagostino_p=D.chi2_sf(k2, 2))


#: Royston's polynomials (1995) for the two outer weights, and for the mean and deviation of the
#: transformed statistic from 4 to 11 and from 12 values on: fixed values, powers rising.
SHAPIRO_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SHAPIRO_BEFORE = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SHAPIRO_SMALL = ((0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322))
SHAPIRO_LARGE = ((-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302))


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def shapiro_weights(n: int) -> np.ndarray:
    """Weights of the sorted values, from expected normal order statistics."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    square, u = float(m @ m), 1 / math.sqrt(n)
    outer = [_poly(SHAPIRO_LAST, u) + m[-1] / math.sqrt(square)]
    if n > 5:
        outer.append(_poly(SHAPIRO_BEFORE, u) + m[-2] / math.sqrt(square))
    k = len(outer)
    left = (square - 2 * sum(m[-1 - i] ** 2 for i in range(k))) / (1 - 2 * sum(a * a for a in outer))
    weights = m / math.sqrt(left)
    for i, a in enumerate(outer):
        weights[-1 - i], weights[i] = a, -a
    return weights


def shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n < 12:
        bound = -2.273 + 0.459 * n
        if math.log(1 - w) >= bound:
            return 0.0
        y, (mean, spread), u = -math.log(bound - math.log(1 - w)), SHAPIRO_SMALL, float(n)
    else:
        y, (mean, spread), u = math.log(1 - w), SHAPIRO_LARGE, math.log(n)
    return D.normal_sf((y - _poly(mean, u)) / math.exp(_poly(spread, u)))


def shapiro(df: DataFrame, x: str, ts: str, most: int = 5000) -> DataFrame:
    """(n, w, p) of the Shapiro-Wilk test on the first ``most`` known values by time, all that the test is made for."""
    values = np.sort([r[0] for r in df.filter(F.col(x).isNotNull()).orderBy(ts).limit(most).select(F.col(x).cast("double")).collect()])
    n = len(values)
    if n < 3 or values[0] == values[-1]:
        return df.sparkSession.createDataFrame([(n, None, None)], "n long, w double, p double")
    away = values - values.mean()
    w = min(1.0, float(shapiro_weights(n) @ away) ** 2 / float(away @ away))
    return _one_row(df, n=n, w=w, p=shapiro_p(w, n))


def acf(df: DataFrame, x: str, ts: str, lags: int, series: list[str] | None = None) -> DataFrame:
    """(lag, acf) with the full mean and n in every denominator; lag 0 is 1."""
    mean = df.agg(F.avg(x)).first()[0]
    sums = lagged_products(df, F.col(x), ts, lags, float(mean or 0.0), series)
    rows = [(k, float(sums[k] / sums[0]) if sums[0] else (None if k else 1.0)) for k in range(lags + 1)]
    return df.sparkSession.createDataFrame(rows, "lag int, acf double")


def pacf(df: DataFrame, x: str, ts: str, lags: int) -> DataFrame:
    """(lag, pacf) by the Durbin-Levinson recursion on the autocorrelations."""
    r = [row.acf for row in acf(df, x, ts, lags).orderBy("lag").collect()]
    phi, out = np.zeros(0), [1.0]
    for k in range(1, lags + 1):
        tail = np.array(r[1:k])
        value = (r[k] - phi @ tail[::-1]) / (1 - phi @ tail) if k > 1 else r[1]
        phi = np.append(phi - value * phi[::-1], value)
        out.append(float(value))
    return df.sparkSession.createDataFrame(list(enumerate(out)), "lag int, pacf double")


def ljung_box(df: DataFrame, x: str, ts: str, lags: tuple[int, ...]) -> DataFrame:
    """(lag, q, p) of the portmanteau test."""
    n = df.agg(F.count(x)).first()[0]
    r = {row.lag: row.acf for row in acf(df, x, ts, max(lags)).collect()}
    rows = []
    for m in lags:
        q = n * (n + 2) * sum(r[k] ** 2 / (n - k) for k in range(1, m + 1))
        rows.append((m, q, D.chi2_sf(q, m)))
    return df.sparkSession.createDataFrame(rows, "lag int, q double, p double")


def autocorrelation(df: DataFrame, x: str, ts: str, lags: tuple[int, ...]) -> DataFrame:
    """(lag, r): Pearson correlation with the lagged series."""
    found = lagged_pairs(df, F.col(x), ts, lags)
    rows = []
    for k in lags:
        m = found[k].products
        rows.append((k, float(m[0, 1] / math.sqrt(m[0, 0] * m[1, 1])) if m[0, 0] * m[1, 1] > 0 else None))
    return df.sparkSession.createDataFrame(rows, "lag int, r double")


def t_test(df: DataFrame, x: str, flag: Column) -> DataFrame:
    """Student's test with pooled variance between rows where ``flag`` holds and the others."""
    g = {r.f: r for r in df.groupBy(flag.alias("f")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).collect()}
    a, b = g[True], g[False]
    free = a.n + b.n - 2
    pooled = ((a.n - 1) * a.v + (b.n - 1) * b.v) / free
    t = (a.m - b.m) / math.sqrt(pooled * (1 / a.n + 1 / b.n))
    return _one_row(df, t=t, dof=int(free), p=D.t_sf2(t, free))


def levels_below(levels: DataFrame, x: str, n: str, parts: int = 64) -> DataFrame:
    """``levels`` (a row a distinct value of ``x``, ``n`` rows each) with ``below``: rows of smaller values.

    Values are dealt to ``parts`` ranges by a sketch; each range is summed up, and starts from
    the sum of the ranges before it.  Where a cut falls changes nothing but the load.
    """
    levels = staged(levels, "levels")
    cuts = levels.agg(F.percentile_approx(x, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(1000))).first()[0] or []
    dealt = levels.withColumn("__p", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: F.col(x) > c)) if cuts else F.lit(0))
    sums = {r["__p"]: r["s"] for r in dealt.groupBy("__p").agg(F.sum(n).alias("s")).collect()}  # a number a range
    first, total = [], 0
    for p in range(parts):
        first.append(F.lit(total).cast("long"))
        total += sums.get(p, 0)
    inside = Window.partitionBy("__p").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("below", F.array(*first)[F.col("__p")] + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("__p")


def mann_whitney(df: DataFrame, x: str, flag: Column) -> DataFrame:
    """U of the flagged rows, its normal approximation with tie correction and continuity."""
    levels = df.groupBy(x).agg(F.count(F.lit(1)).alias("c"), F.count_if(flag).alias("p"))
    r = levels_below(levels.filter(F.col(x).isNotNull()), x, "c").select("c", "p", (F.col("below") + (F.col("c") + 1) / 2).alias("rank")).agg(F.sum(F.col("p") * F.col("rank")).alias("s"), F.sum("p").alias("p"), F.sum("c").alias("n"), F.sum(F.pow("c", 3) - F.col("c")).alias("ties")).first()
    n1, n2 = r.p, r.n - r.p
    u = r.s - n1 * (n1 + 1) / 2
    sd = math.sqrt(n1 * n2 / 12 * (r.n + 1 - r.ties / (r.n * (r.n - 1))))
    z = max(0.0, abs(u - n1 * n2 / 2) - 0.5) / sd
    return _one_row(df, u=float(u), z=z, p=min(1.0, 2 * D.normal_sf(z)))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b.

    Discordant pairs are counted by merging sorted halves level by level: for every bit
    of the rank of ``b``, rows of a block are counted on either side of its middle, as
    running sums in the order of ``a``, so n log n rows are made and no pair is.
    """
    both = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    spark = df.sparkSession
    ra = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    rb = both.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(Window.orderBy("b")) - 1)
    tied = lambda t: F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0))
    n = both.count()
    bits = max(1, (rb.count() - 1).bit_length())
    ta, tb = ra.agg(tied(ra)).first()[0], rb.agg(tied(rb)).first()[0]
    tab = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).agg(tied(both)).first()[0]
    ranked = both.join(rb.select("b", "r"), "b")
    levels = ranked.select("a", "r", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    levels = levels.withColumns({"block": F.expr("shiftright(r, bit + 1)"), "high": F.expr("shiftright(r, bit) & 1 = 1")})
    w = Window.partitionBy("bit", "block").orderBy("a").rangeBetween(Window.unboundedPreceding, -1)
    numbered = levels.withColumn("a", F.dense_rank().over(Window.partitionBy("bit", "block").orderBy("a")))
    worse = numbered.withColumn("seen", F.count_if("high").over(w)).filter(~F.col("high")).agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    total = n * (n - 1) / 2
    con = total - ta - tb + tab - worse
    below = math.sqrt((total - ta) * (total - tb))
    return spark.createDataFrame([((con - worse) / below if below else None,)], "tau double")


def chow(df: DataFrame, x: str, y: str, ts: str) -> DataFrame:
    """Chow's test of y ~ x for a break at the middle row."""
    n = df.count()
    numbered = S.row_index(df, [], ts, blocks.SPAN, "__i")
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(known, F.col(c).cast("double")) for c in (x, y))
    # centred sums: the aggregates update means pair by pair
    sums = [F.count(a).alias("n"), F.avg(a).alias("x"), F.avg(b).alias("y"), F.var_pop(a).alias("xx"), F.covar_pop(a, b).alias("xy"), F.var_pop(b).alias("yy")]
    halves = [Moments(r.n, np.array([r.x, r.y]), r.n * np.array([[r.xx, r.xy], [r.xy, r.yy]])) for r in numbered.groupBy((F.col("__i") < n // 2).alias("first")).agg(*sums).collect()]
    whole = halves[0]
    for half in halves[1:]:
        whole = whole.merged(half)
    one, parts, k = whole.regress(1, [0])[1], sum(h.regress(1, [0])[1] for h in halves), 2
    f = ((one - parts) / k) / (parts / (n - 2 * k))
    return _one_row(df, f=f, p=D.f_sf(f, k, n - 2 * k))


def _moments(df: DataFrame, columns: list[str], ts: str, lag_counts: list[int]) -> dict[int, Moments]:
    return lagged_moments(df, {c: F.col(c) for c in columns}, ts, lag_counts)


def granger(df: DataFrame, cause: str, effect: str, ts: str, lags: int) -> DataFrame:
    """(cause, effect, lag, f, p, chi2, p_chi2, lr, p_lr, n) in both directions for each number of lags.

    Does the past of ``cause`` help to explain ``effect``?  F, chi-squared and
    likelihood-ratio tests of the regressions with and without it, all from one job.
    """
    rows = []
    for lag, m in _moments(df, [effect, cause], ts, list(range(1, lags + 1))).items():
        past = {effect: [2 * k for k in range(1, lag + 1)], cause: [2 * k + 1 for k in range(1, lag + 1)]}
        for target, (x, y) in enumerate(((cause, effect), (effect, cause))):
            full = past[y] + past[x]
            small, large = m.regress(target, past[y])[1], m.regress(target, full)[1]
            free = m.n - len(full) - 1
            f = ((small - large) / lag) / (large / free)
            chi2, lr = float(m.n * (small - large) / large), float(m.n * np.log(small / large))
            rows.append((x, y, lag, float(f), D.f_sf(f, lag, free), chi2, D.chi2_sf(chi2, lag), lr, D.chi2_sf(lr, lag), m.n))
    return df.sparkSession.createDataFrame(rows, "cause string, effect string, lag int, f double, p double, chi2 double, p_chi2 double, lr double, p_lr double, n long")


def var_model(df: DataFrame, columns: list[str], ts: str, lags: int) -> dict[str, np.ndarray]:
    """Intercept, lag matrices and residual covariance of a vector autoregression."""
    m, d = _moments(df, columns, ts, [lags])[lags], len(columns)
    on, y = list(range(d, d * (lags + 1))), list(range(d))
    coef = np.stack([m.regress(i, on)[0] for i in y])
    residual = m.products[np.ix_(y, y)] - coef[:, 1:] @ m.products[np.ix_(on, y)]
    return {"intercept": coef[:, 0], "lags": coef[:, 1:].reshape(d, lags, d).transpose(1, 0, 2), "sigma": residual / (m.n - len(on) - 1), "sigma_ml": residual / m.n, "n": np.array(m.n)}


def impulse_responses(model: dict[str, np.ndarray], steps: int) -> np.ndarray:
    """[step, response, impulse] of orthogonal impulses; step 0 is the Cholesky factor."""
    lags, d = model["lags"], len(model["sigma"])
    psi = [np.eye(d)]
    for s in range(1, steps + 1):
        psi.append(sum((psi[s - k - 1] @ lags[k] for k in range(min(s, len(lags)))), np.zeros((d, d))))
    return np.stack(psi) @ np.linalg.cholesky(model["sigma"])


def variance_decomposition(model: dict[str, np.ndarray], steps: int) -> np.ndarray:
    """[step, variable, source]: shares of the forecast error variance, steps 1..``steps``."""
    power = np.cumsum(impulse_responses(model, steps - 1) ** 2, axis=0)
    return power / power.sum(axis=2, keepdims=True)


def var_responses(df: DataFrame, columns: list[str], ts: str, lags: int = 5, steps: int = 10) -> DataFrame:
    """(step, response, impulse, irf, fevd) of a vector autoregression; ``fevd`` starts at step 1."""
    model = var_model(df, columns, ts, lags)
    irf, fevd = impulse_responses(model, steps), variance_decomposition(model, steps)
    rows = [
        (s, a, b, float(irf[s, i, j]), float(fevd[s - 1, i, j]) if s else None)
        for s in range(steps + 1) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "step int, response string, impulse string, irf double, fevd double")


def var_order(df: DataFrame, columns: list[str], ts: str, most: int) -> DataFrame:
    """(lag, aic, bic, hqic) of vector autoregressions on the same rows."""
    m, d, rows = _moments(df, columns, ts, [most])[most], len(columns), []
    n, y = m.n, list(range(d))
    for lag in range(1, most + 1):
        on = list(range(d, d * (lag + 1)))
        coef = np.stack([m.regress(i, on)[0][1:] for i in y])
        logdet = float(np.linalg.slogdet((m.products[np.ix_(y, y)] - coef @ m.products[np.ix_(on, y)]) / n)[1])
        k = d * (len(on) + 1)
        rows.append((lag, logdet + 2 * k / n, logdet + math.log(n) * k / n, logdet + 2 * math.log(math.log(n)) * k / n))
    return df.sparkSession.createDataFrame(rows, "lag int, aic double, bic double, hqic double")


#: MacKinnon's critical values of the Dickey-Fuller test with a constant: fixed values (1, 5, 10 %).
ADF_CRITICAL = {1: (-3.43035, -6.5393, -16.786), 5: (-2.86154, -2.8903, -4.234), 10: (-2.56677, -1.5384, -2.809)}
#: Response surface of the p-values of the same test (one series, constant): fixed values.  Powers of
#: the statistic rise; the first polynomial holds up to ADF_TURN, p is 0 and 1 beyond ADF_ENDS.
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_TURN, ADF_ENDS = -1.61, (-18.83, 2.74)
#: Critical values of the KPSS test with a constant, by percent: fixed values.
KPSS_CRITICAL = {10: 0.347, 5: 0.463, 2.5: 0.574, 1: 0.739}


def adf_p(stat: float) -> float:
    """P-value of the Dickey-Fuller statistic with a constant."""
    if stat <= ADF_ENDS[0] or stat >= ADF_ENDS[1]:
        return float(stat >= ADF_ENDS[1])
    surface = ADF_SMALL if stat <= ADF_TURN else ADF_LARGE
    return D.normal_sf(-sum(c * stat**i for i, c in enumerate(surface)))


def kpss_p(stat: float) -> float:
    """P-value of the KPSS statistic, linear between the critical values and no further."""
    return float(np.interp(stat, list(KPSS_CRITICAL.values()), [p / 100 for p in KPSS_CRITICAL]))


def adf(df: DataFrame, x: str, ts: str, lags: int | None = None, most: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller statistic with a constant, its p-value, lags, rows and critical values.

    Without ``lags`` the number up to ``most`` (12 (n / 100)^(1/4), rounded up, by default) of the
    smallest AIC is taken, all models compared on the rows of the longest.  One job gives the
    moments of all models.
    """
    w = S.order([], ts)
    base = df.select(ts, F.lag(x).over(w).alias("level"), (F.col(x) - F.lag(x).over(w)).alias("step"))
    if lags is None and most is None:
        n = df.agg(F.count(x)).first()[0]
        most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    counts = [lags] if lags is not None else list(range(most + 1))
    found = _moments(base, ["step", "level"], ts, counts)
    on = lambda k: [1] + [2 * i for i in range(1, k + 1)]
    if lags is None:
        long = found[most]
        aic = {k: long.n * math.log(long.regress(0, on(k))[1] / long.n) + 2 * (k + 2) for k in counts}
        lags = min(counts, key=lambda k: (aic[k], k))
    m = found[lags]
    coef, rss = m.regress(0, on(lags))
    inverse = np.linalg.inv(m.products[np.ix_(on(lags), on(lags))])
    stat = float(coef[1] / math.sqrt(rss / (m.n - lags - 2) * inverse[0, 0]))
    crit = {f"crit_{p}": c[0] + c[1] / m.n + c[2] / m.n**2 for p, c in ADF_CRITICAL.items()}
    return _one_row(df, stat=stat, p=adf_p(stat), lags=int(lags), n=m.n, **crit)


def kpss(df: DataFrame, x: str, ts: str, lags: int | None = None) -> DataFrame:
    """KPSS statistic of level stationarity with Bartlett weights, its p-value, lags and critical values.

    Without ``lags`` their number follows from the autocovariances up to n^(2/9).
    """
    mean, n = df.agg(F.avg(x), F.count(x)).first()
    centred = df.filter(F.col(x).isNotNull()).select(ts, (F.col(x) - F.lit(mean)).alias("e"))
    pilot = int(n ** (2 / 9)) if lags is None else 0
    sums = lagged_products(centred, F.col("e"), ts, max(pilot, lags or 0), 0.0)
    if lags is None:
        weights = [2 * s / n for s in sums[1 : pilot + 1]]
        base, slope = sums[0] / n + sum(weights), sum(k * s for k, s in enumerate(weights, 1))
        lags = min(int(1.1447 * ((slope / base) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
        sums = lagged_products(centred, F.col("e"), ts, lags, 0.0)
    partial = blocks.running_sums(centred, {"s": F.col("e")}, [], ts)
    total = partial.agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    long_run = (sums[0] + 2 * sum((1 - k / (lags + 1)) * sums[k] for k in range(1, lags + 1))) / n
    stat = float(total / (n * n * long_run))
    return _one_row(df, stat=stat, p=kpss_p(stat), lags=int(lags), n=int(n), **{f"crit_{str(p).replace('.', '_')}": c for p, c in KPSS_CRITICAL.items()})


def johansen(df: DataFrame, columns: list[str], ts: str, lags: int = 1) -> DataFrame:
    """(rank, eigenvalue, trace, max_eigen) of the cointegration test with a constant."""
    w = S.order([], ts)
    level = [F.lag(c).over(w).alias(f"{c}_l") for c in columns]
    steps = [(F.col(c) - F.lag(c).over(w)).alias(f"{c}_d") for c in columns]
    names = [f"{c}_d" for c in columns] + [f"{c}_l" for c in columns]
    m, d = _moments(df.select(ts, *steps, *level), names, ts, [lags])[lags], len(columns)
    y, z = list(range(d)), list(range(d, 2 * d))
    on = [2 * d * k + i for k in range(1, lags + 1) for i in range(d)]
    inverse = np.linalg.pinv(m.products[np.ix_(on, on)])
    s = lambda a, b: (m.products[np.ix_(a, b)] - m.products[np.ix_(a, on)] @ inverse @ m.products[np.ix_(on, b)]) / m.n
    eig = np.sort(np.linalg.eigvals(np.linalg.solve(s(z, z), s(z, y)) @ np.linalg.solve(s(y, y), s(y, z))).real)[::-1]
    rows = [(r, float(eig[r]), float(-m.n * np.log(1 - eig[r:]).sum()), float(-m.n * math.log(1 - eig[r]))) for r in range(d)]
    return df.sparkSession.createDataFrame(rows, "rank int, eigenvalue double, trace double, max_eigen double")


def change_points(df: DataFrame, x: str, ts: str, breaks: int, min_size: int = 2) -> DataFrame:
    """(step, position, gain): binary segmentation of the mean, the best split first.

    Prefix sums are made once; each step finds the best split of all segments in one
    aggregation.
    """
    mean = df.agg(F.avg(x)).first()[0] or 0.0  # sums of what lies round zero lose no digits
    indexed = S.row_index(df.select(ts, (F.col(x).cast("double") - F.lit(mean)).alias("x")), [], ts, blocks.SPAN, "i")
    sums = staged(blocks.running_sums(indexed, {"s": F.col("x")}, [], "i", span=20_000).select((F.col("i") + 1).alias("k"), "s"), "prefix-sums")
    n, total = sums.agg(F.max("k"), F.max_by("s", "k")).first()
    segments, rows = [(0, n, 0.0, total)], []
    for step in range(1, breaks + 1):
        parts = F.broadcast(df.sparkSession.createDataFrame(segments, "a long, b long, sa double, sb double"))
        k, s, a, b, sa, sb = (F.col(c) for c in ("k", "s", "a", "b", "sa", "sb"))
        gain = (s - sa) * (s - sa) / (k - a) + (sb - s) * (sb - s) / (b - k) - (sb - sa) * (sb - sa) / (b - a)
        inside = sums.join(parts, (k >= a + min_size) & (k <= b - min_size))
        best = inside.withColumn("gain", gain).agg(F.max(F.struct("gain", (-k).alias("m"), "s", "a", "b", "sa", "sb")).alias("x")).first().x
        if best is None:
            break
        at = -best.m
        rows.append((step, at, best.gain))
        segments = [g for g in segments if g[0] != best.a] + [(best.a, at, best.sa, best.s), (at, best.b, best.s, best.sb)]
    return df.sparkSession.createDataFrame(rows, "step int, position long, gain double")


def wavelet_coherence(df: DataFrame, a: str, b: str, ts: str, last: int = 200, scales: int = 24) -> DataFrame:
    """(scale, coherence): mean Morlet coherence of the last rows (at most a few hundred)."""
    rows = df.orderBy(F.desc(ts)).limit(last).select(ts, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(ts)
        x, y = (pdf[c].to_numpy() - pdf[c].mean() for c in ("a", "b"))
        freq, out = 2 * np.pi * np.fft.fftfreq(len(x)), []
        for scale in 2 * 2 ** (np.arange(scales) / 6):
            wave = np.pi**-0.25 * np.sqrt(2 * np.pi * scale) * np.exp(-0.5 * (scale * freq - 6) ** 2) * (freq > 0)
            u, v = (np.fft.ifft(np.fft.fft(z) * wave) for z in (x, y))
            smooth = np.exp(-0.5 * (scale * freq) ** 2)
            over = lambda z, smooth=smooth: np.fft.ifft(np.fft.fft(z) * smooth)
            coherence = np.abs(over(u * np.conj(v))) ** 2 / (over(np.abs(u) ** 2).real * over(np.abs(v) ** 2).real + 1e-300)
            out.append((float(scale), float(np.clip(coherence, 0, 1).mean())))
        return pd.DataFrame(out, columns=["scale", "coherence"])

    return rows.groupBy().applyInPandas(run, "scale double, coherence double")


def persistence(df: DataFrame, x: str, ts: str) -> DataFrame:
    """How often the direction of neighbouring rows is the same."""
    up, before = F.col(x) > 0, F.lag(x).over(S.order([], ts)) > 0
    pairs = df.select(up.alias("u"), before.alias("b")).filter("b is not null")
    return pairs.agg(F.count_if(F.col("u") & F.col("b")).alias("up_up"), F.count_if(~F.col("u") & ~F.col("b")).alias("down_down"), F.count_if(F.col("u") & ~F.col("b")).alias("down_up"), F.count_if(~F.col("u") & F.col("b")).alias("up_down"))


def empirical_cdf(df: DataFrame, x: str) -> DataFrame:
    """(x, cdf): position over size, from 0, in sorted order, ties numbered one by one."""
    levels = levels_below(df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("__c")), x, "__c")
    n = levels.agg(F.sum("__c").alias("__n"))  # one row
    each = levels.crossJoin(F.broadcast(n)).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1)))
    return each.select(x, ((F.col("below") + F.col("__k")) / F.col("__n")).alias("cdf"))


def volatility_regimes(df: DataFrame, x: str, ts: str, window: int, shift: float = 2.0) -> DataFrame:
    """(ts, vol, level, is_shift): rolling deviation, its tercile, and jumps beyond ``shift`` deviations."""
    w = S.order([], ts)
    vol = df.withColumn("vol", S.rolling(F.stddev_samp, F.col(x), w, window)).filter("vol is not null")
    vol = vol.withColumn("step", S.diff(F.col("vol"), w))
    low, high = (F.lit(c).cast("double") for c in exact_quantiles(vol, {"vol": F.col("vol")}, (1 / 3, 2 / 3))["vol"])
    fit = vol.agg(F.stddev_samp("step").alias("sd"))  # one row
    level = F.when(F.col("vol") <= low, "low").when(F.col("vol") <= high, "mid").otherwise("high")
    return vol.crossJoin(F.broadcast(fit)).select(ts, "vol", level.alias("level"), F.coalesce(F.abs("step") > shift * F.col("sd"), F.lit(False)).alias("is_shift"))
