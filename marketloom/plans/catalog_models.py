"""Queries on models and their inputs: unit roots, cointegration, responses, breaks, windows, evaluation, stored tables.

``catalog`` imports this module at its end, when its helpers are there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import series as S
from marketloom.functions.stage import staged_path
from marketloom.operators import feature_quality, losses, preparation, reshape, statistics
from marketloom.operators.normalizers import OHLCVNormalizer, orderbook_features
from marketloom.plans import views
from marketloom.plans.catalog import (
    _ACF30, _ANALYZE, _BANDS, _COMBINED, _GEN, _LABELS, _LAG, _NUM, _OB_NAMES, _PAIR_RETURNS, _RAW, _RET, _SCORED, _SQUARED, _chi2_tail, _combined, _label_input, _name, _ob_sql, _pair, _pair_returns, _plain, _returns, register)
from marketloom.sources import ingest

# regressions --------------------------------------------------------------------------


def orthogonal(name: str, source: str, kept: list[str], out: list[str]) -> str:
    """CTEs {name}_0, {name}_1, ...: columns centred, then ``out`` taken out of the others one after another."""
    steps = [f"{name}_0 AS (SELECT {', '.join(f'{c} - avg({c}) OVER () AS {c}' for c in kept + out)} FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in kept + out)})"]
    for i, c in enumerate(out):
        rest = ", ".join(f"{o} - {c} * (sum({o} * {c}) OVER () / sum({c} * {c}) OVER ()) AS {o}" for o in kept + out[i + 1 :])
        steps.append(f"{name}_{i + 1} AS (SELECT {rest} FROM {name}_{i})")
    return ", ".join(steps)


_MOST = 4
_STEPS = f"""st AS (SELECT open_time, lag(close) OVER w AS level, close - lag(close) OVER w AS step FROM klines WINDOW w AS (ORDER BY open_time)),
sl AS (SELECT *, {', '.join(f'lag(step, {k}) OVER (ORDER BY open_time) AS d{k}' for k in range(1, _MOST + 1))} FROM st)"""
_NESTED = orthogonal("nested", "sl", ["step"], ["level", *(f"d{k}" for k in range(1, _MOST + 1))])
_OWN = ", ".join(orthogonal(f"own{k}", "sl", ["step", "level"], [f"d{i}" for i in range(1, k + 1)]) for k in range(_MOST + 1))
_AIC = "aic AS (" + " UNION ALL ".join(f"SELECT {k} AS lags, count(*) * ln(sum(step * step) / count(*)) + 2 * {k + 2} AS aic FROM nested_{k + 1}" for k in range(_MOST + 1)) + ")"
_T = "tv AS (" + " UNION ALL ".join(
    f"SELECT {k} AS lags, count(*) AS n, sum(step * level) / sum(level * level) / sqrt((sum(step * step) - sum(step * level) ** 2 / sum(level * level)) / (count(*) - {k + 2}) / sum(level * level)) AS stat FROM own{k}_{k}" for k in range(_MOST + 1)) + ")"
_Z = "(CASE WHEN stat <= -1.61 THEN 2.1659 + 1.4412 * stat + 0.038269 * stat ** 2 ELSE 1.7339 + 0.93202 * stat - 0.12745 * stat ** 2 - 0.010368 * stat ** 3 END)"
_ADF = f"""adf AS (SELECT 'adf' AS test, lags, n, stat, CASE WHEN z < 0 THEN half ELSE 1 - half END AS p FROM (SELECT *, 0.5 * ({_chi2_tail('(z * z)', '1')}) AS half FROM
(SELECT *, {_Z} AS z FROM tv WHERE lags = (SELECT lags FROM aic ORDER BY aic, lags LIMIT 1))))"""
_KPSS_LAGS = 40
_KPSS = f"""ce AS (SELECT open_time, close - avg(close) OVER () AS e FROM klines), cu AS (SELECT *, sum(e) OVER (ORDER BY open_time) AS s FROM ce),
cov AS ({' UNION ALL '.join(f'SELECT {k} AS k, sum(e * f) AS s FROM (SELECT e, lag(e, {k}) OVER (ORDER BY open_time) AS f FROM ce)' for k in range(_KPSS_LAGS + 1))}),
kn AS (SELECT count(*) AS n, CAST(floor(count(*) ** (2.0 / 9)) AS INT) AS pilot FROM ce),
kb AS (SELECT n, sum(CASE WHEN k = 0 THEN s / n ELSE 2 * s / n END) AS base, sum(k * 2 * s / n) AS slope FROM cov, kn WHERE k <= pilot GROUP BY n),
kl AS (SELECT n, least(CAST(floor(1.1447 * ((slope / base) ** 2) ** (1.0 / 3) * n ** (1.0 / 3)) AS INT), n - 1) AS lags FROM kb),
ks AS (SELECT lags, n, (SELECT sum(s * s) FROM cu) / (n * n * (SELECT sum(CASE WHEN k = 0 THEN s ELSE 2 * (1 - k / (lags + 1.0)) * s END) FROM cov WHERE k <= lags) / n) AS stat FROM kl),
kpss AS (SELECT 'kpss' AS test, lags, n, stat, CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - 0.05 * (stat - 0.347) / 0.116 WHEN stat <= 0.574 THEN 0.05 - 0.025 * (stat - 0.463) / 0.111
  WHEN stat <= 0.739 THEN 0.025 - 0.015 * (stat - 0.574) / 0.165 ELSE 0.01 END AS p FROM ks)"""


@register("unit_root", "SELECT test, CAST(lags AS BIGINT) AS lags, CAST(n AS BIGINT) AS n, stat, p FROM adf UNION ALL SELECT test, CAST(lags AS BIGINT), CAST(n AS BIGINT), stat, p FROM kpss", "test lags n", "stat p", ", ".join([_STEPS, _NESTED, _OWN, _AIC, _T, _ADF, _KPSS]))
def unit_root(spark, sf_dir):
    k = views.klines(spark, sf_dir)
    found = [(name, f(k)) for name, f in (("adf", lambda d: statistics.adf(d, "close", "open_time", most=_MOST)), ("kpss", lambda d: statistics.kpss(d, "close", "open_time")))]
    rows = [d.select(F.lit(name).alias("test"), "lags", "n", "stat", "p") for name, d in found]
    return rows[0].unionByName(rows[1])


_PAIR_STEPS = """pc AS (SELECT a.open_time, a.close AS a, b.close AS b FROM typed a JOIN typed b ON a.open_time = b.open_time AND a.event_type = 'view' AND b.event_type = 'purchase'),
pd AS (SELECT open_time, lag(a) OVER w AS la, lag(b) OVER w AS lb, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM pc WINDOW w AS (ORDER BY open_time)),
pe AS (SELECT *, lag(da) OVER w AS ea, lag(db) OVER w AS eb FROM pd WINDOW w AS (ORDER BY open_time))"""
_JOHANSEN = f"""{_PAIR_STEPS}, {orthogonal('jo', 'pe', ['da', 'db', 'la', 'lb'], ['ea', 'eb'])},
jm AS (SELECT count(*) AS n, {', '.join(f'sum({a} * {b}) AS {a}_{b}' for a in ('da', 'db', 'la', 'lb') for b in ('da', 'db', 'la', 'lb'))} FROM jo_2),
jp AS (SELECT *, da_da * db_db - da_db ** 2 AS dy, la_la * lb_lb - la_lb ** 2 AS dz FROM jm),
jq AS (SELECT n, (lb_lb * la_da - la_lb * lb_da) / dz AS p11, (lb_lb * la_db - la_lb * lb_db) / dz AS p12, (la_la * lb_da - la_lb * la_da) / dz AS p21, (la_la * lb_db - la_lb * la_db) / dz AS p22,
  (db_db * da_la - da_db * db_la) / dy AS q11, (db_db * da_lb - da_db * db_lb) / dy AS q12, (da_da * db_la - da_db * da_la) / dy AS q21, (da_da * db_lb - da_db * da_lb) / dy AS q22 FROM jp),
jt AS (SELECT n, p11 * q11 + p12 * q21 + p21 * q12 + p22 * q22 AS tr, (p11 * p22 - p12 * p21) * (q11 * q22 - q12 * q21) AS det FROM jq),
je AS (SELECT n, (tr + sqrt(tr * tr - 4 * det)) / 2 AS e0, (tr - sqrt(tr * tr - 4 * det)) / 2 AS e1 FROM jt)"""


@register(
    "johansen", "SELECT 0::INT AS rank, e0 AS eigenvalue, -n * (ln(1 - e0) + ln(1 - e1)) AS trace, -n * ln(1 - e0) AS max_eigen FROM je UNION ALL SELECT 1::INT, e1, -n * ln(1 - e1), -n * ln(1 - e1) FROM je",
    "rank", "eigenvalue trace max_eigen", _JOHANSEN)
def johansen(spark, sf_dir):
    return statistics.johansen(_pair(spark, sf_dir), ["close", "close_b"], "open_time", 1)


_PAST = ["1.0", *(f"{c}{k}" for k in range(1, 6) for c in ("x", "y"))]
_ALL = [*_PAST, "x", "y"]
_VAR = f"""{_PAIR_RETURNS}, vl AS (SELECT x, y, {', '.join(f'lag({c}, {k}) OVER (ORDER BY open_time) AS {c}{k}' for k in range(1, 6) for c in ('x', 'y'))} FROM pr),
vm AS (SELECT count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, [{', '.join('[' + ', '.join(f'sum({a} * {b})' for b in _ALL) + ']' for a in _PAST)}] AS a FROM vl WHERE y5 IS NOT NULL),
vs(k, a) AS (SELECT 0, a FROM vm UNION ALL
  SELECT k + 1, [[CASE WHEN i = k + 1 THEN a[k + 1][j] / a[k + 1][k + 1] ELSE a[i][j] - a[i][k + 1] * a[k + 1][j] / a[k + 1][k + 1] END for j in range(1, 14)] for i in range(1, 12)] FROM vs WHERE k < 11),
vc AS (SELECT n, [r[12] for r in vs.a] AS cx, [r[13] for r in vs.a] AS cy, xx - list_sum([vs.a[i][12] * vm.a[i][12] for i in range(1, 12)]) AS sxx, xy - list_sum([vs.a[i][12] * vm.a[i][13] for i in range(1, 12)]) AS sxy,
  yy - list_sum([vs.a[i][13] * vm.a[i][13] for i in range(1, 12)]) AS syy FROM vs, vm WHERE k = 11),
vh AS (SELECT cx, cy, sqrt(sxx / (n - 11)) AS l11, sxy / (n - 11) / sqrt(sxx / (n - 11)) AS l21, sqrt(syy / (n - 11) - (sxy / (n - 11)) ** 2 / (sxx / (n - 11))) AS l22 FROM vc),
psi(s, ps) AS (SELECT 0, [[1.0::DOUBLE, 0, 0, 1]] UNION ALL SELECT s + 1, list_append(ps, [
  list_sum([ps[s + 2 - k][1] * cx[2 * k] + ps[s + 2 - k][2] * cy[2 * k] for k in range(1, least(s + 1, 5) + 1)]), list_sum([ps[s + 2 - k][1] * cx[2 * k + 1] + ps[s + 2 - k][2] * cy[2 * k + 1] for k in range(1, least(s + 1, 5) + 1)]),
  list_sum([ps[s + 2 - k][3] * cx[2 * k] + ps[s + 2 - k][4] * cy[2 * k] for k in range(1, least(s + 1, 5) + 1)]), list_sum([ps[s + 2 - k][3] * cx[2 * k + 1] + ps[s + 2 - k][4] * cy[2 * k + 1] for k in range(1, least(s + 1, 5) + 1)])])
  FROM psi, vh WHERE s < 10),
ir AS (SELECT s, ps[s + 1] AS p, l11, l21, l22 FROM psi, vh),
im AS (SELECT s, 'x' AS response, 'x' AS impulse, p[1] * l11 + p[2] * l21 AS irf FROM ir UNION ALL SELECT s, 'x', 'y', p[2] * l22 FROM ir UNION ALL SELECT s, 'y', 'x', p[3] * l11 + p[4] * l21 FROM ir UNION ALL SELECT s, 'y', 'y', p[4] * l22 FROM ir),
fv AS (SELECT *, sum(irf * irf) OVER (PARTITION BY response, impulse ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM im)"""


@register("impulse_responses", "SELECT CAST(s AS INT) AS step, response, impulse, irf, part / sum(part) OVER (PARTITION BY s, response) AS fevd FROM fv", "step response impulse", "irf fevd", _VAR)
def impulse_responses(spark, sf_dir):
    return statistics.var_responses(_pair_returns(spark, sf_dir), ["x", "y"], "open_time")


def _breaks(count: int) -> str:
    """CTEs bs{i}: the best split of all segments between the breaks found so far."""
    steps = ["""pf AS (SELECT row_number() OVER (ORDER BY open_time) AS k, sum(close) OVER (ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS s FROM klines),
br0 AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS s UNION ALL SELECT max(k), arg_max(s, k) FROM pf)"""]
    for i in range(1, count + 1):
        steps.append(f"""mk{i} AS (SELECT pf.k, pf.s, br{i - 1}.k AS brk FROM pf LEFT JOIN br{i - 1} USING (k)),
sg{i} AS (SELECT *, coalesce(max(brk) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, min(brk) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM mk{i}),
bs{i} AS (SELECT p.k, p.s, (p.s - l.s) ** 2 / (p.k - a) + (h.s - p.s) ** 2 / (b - p.k) - (h.s - l.s) ** 2 / (b - a) AS gain FROM sg{i} p JOIN br{i - 1} l ON l.k = a JOIN br{i - 1} h ON h.k = b WHERE p.k >= a + 2 AND p.k <= b - 2 ORDER BY gain DESC, p.k LIMIT 1),
br{i} AS (SELECT k, s FROM br{i - 1} UNION ALL SELECT k, s FROM bs{i})""")
    return ", ".join(steps)


@register("change_points", " UNION ALL ".join(f"SELECT {i}::INT AS step, CAST(k AS BIGINT) AS position, gain FROM bs{i}" for i in (1, 2, 3)), "step position", "gain", _breaks(3))
def change_points(spark, sf_dir):
    return statistics.change_points(views.klines(spark, sf_dir), "close", "open_time", 3)


# normality ----------------------------------------------------------------------------

_K2 = """mo AS (SELECT count(r)::DOUBLE AS n, avg((r - m) ** 3) / avg((r - m) ** 2) ** 1.5 AS s, avg((r - m) ** 4) / avg((r - m) ** 2) ** 2 - 3 AS k FROM rets, (SELECT avg(r) AS m FROM rets)),
m1 AS (SELECT *, s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2 FROM mo),
m2 AS (SELECT *, -1 + sqrt(2 * (b2 - 1)) AS w2, (k + 6 / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM m1),
m3 AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) * asinh(y / sqrt(2 / (w2 - 1))) AS z1, 6 + 8 / root * (2 / root + sqrt(1 + 4 / root ** 2)) AS a FROM m2),
m4 AS (SELECT *, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM m3),
m5 AS (SELECT CAST(n AS BIGINT) AS n, n / 6 * (s * s + k * k / 4) AS jarque_bera, z1 * z1 + z2 * z2 AS dagostino FROM m4)"""


@register(
    "normality", f"SELECT *, {_chi2_tail('jarque_bera', '2')} AS jarque_bera_p, {_chi2_tail('dagostino', '2')} AS dagostino_p FROM m5",
    "n", "jarque_bera jarque_bera_p dagostino dagostino_p", f"{_RET}, {_K2}")
def normality(spark, sf_dir):
    return statistics.normality(_returns(spark, sf_dir), "r")


@register("shapiro")
def shapiro(spark, sf_dir):
    return statistics.shapiro(_returns(spark, sf_dir), "r", "open_time")


@register(
    "ljung_box_squared", f"SELECT *, {_chi2_tail('q', 'lag')} AS p FROM (SELECT m AS lag, (SELECT count(*) FROM sr) * ((SELECT count(*) FROM sr) + 2) * (SELECT sum(acf ** 2 / ((SELECT count(*) FROM sr) - ac.lag)) FROM ac WHERE ac.lag > 0 AND ac.lag <= m) AS q FROM (SELECT unnest([10, 20, 30]) AS m))",
    "lag", "q p", f"{_SQUARED}, ac AS ({_ACF30})")
def ljung_box_squared(spark, sf_dir):
    squared = _returns(spark, sf_dir).withColumn("r2", F.col("r") * F.col("r"))
    return statistics.ljung_box(squared, "r2", "open_time", (10, 20, 30))


# windows and splits -------------------------------------------------------------------

_WINDOWS = """kw AS (SELECT *, row_number() OVER (ORDER BY open_time) - 1 AS i, count(*) OVER () AS n FROM klines), ws AS (SELECT open_time AS start, i FROM kw WHERE i % 3 = 0 AND i + 29 <= n)"""


def _samples(spark, sf_dir):
    return preparation.windows(views.klines(spark, sf_dir), "open_time", ["close", "volume"], ["high", "low"], ["open"], "close", 24, (1, 5), stride=3)


@register(
    "training_window_rows", "SELECT start, CASE WHEN kw.i < ws.i + 24 THEN 'past' ELSE 'future' END AS part, CAST(CASE WHEN kw.i < ws.i + 24 THEN kw.i - ws.i ELSE kw.i - ws.i - 24 END AS INT) AS step, CAST(CAST(CASE WHEN kw.i < ws.i + 24 THEN close ELSE high END AS FLOAT) AS DOUBLE) AS a, CAST(CAST(CASE WHEN kw.i < ws.i + 24 THEN volume ELSE low END AS FLOAT) AS DOUBLE) AS b FROM ws JOIN kw ON kw.i BETWEEN ws.i AND ws.i + 28",
    "start part step", "a b", _WINDOWS)
def training_window_rows(spark, sf_dir):
    """Every cell of the past and future arrays of the samples."""
    made = _samples(spark, sf_dir)
    parts = [made.select("start", F.lit(p).alias("part"), F.posexplode(p).alias("step", "x")) for p in ("past", "future")]
    return parts[0].union(parts[1]).select("start", "part", "step", F.col("x")[0].cast("double").alias("a"), F.col("x")[1].cast("double").alias("b"))


@register(
    "window_split", "SELECT start, CASE WHEN r < a THEN 'train' WHEN r < a + v THEN 'val' ELSE 'test' END AS part FROM (SELECT start, row_number() OVER (ORDER BY start) - 1 AS r, CAST(floor(count(*) OVER () * 0.75) AS BIGINT) AS a, CAST(floor(count(*) OVER () * 0.125) AS BIGINT) AS v FROM ws)",
    "start part", "", _WINDOWS)
def window_split(spark, sf_dir):
    return preparation.split_windows(_samples(spark, sf_dir), 0.75, 0.125).select("start", "part")


@register("random_split", "SELECT unnest(['train', 'val', 'test']) AS part, unnest([CAST(floor(n * 0.7) AS BIGINT), CAST(floor(n * 0.2) AS BIGINT), n - CAST(floor(n * 0.7) AS BIGINT) - CAST(floor(n * 0.2) AS BIGINT)]) AS n FROM (SELECT count(*) AS n FROM events)", "part n")
def random_split(spark, sf_dir):
    """Sizes of the parts; which rows they hold follows from a hash."""
    parts = preparation.split_at_random(views.base(spark, sf_dir), "event_id", 0.7, 0.2)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# evaluation ---------------------------------------------------------------------------

_LOGIT = "greatest({z}, 0) + ln(1 + exp(-abs({z})))"


@register(
    "evaluation", """SELECT h AS horizon, count(*) AS n, avg((passed = y)::INT) AS accuracy, avg(loss) AS loss FROM ev GROUP BY h
UNION ALL SELECT NULL, count(*), avg((passed = y)::INT), avg(loss) FROM ev""", "horizon n", "accuracy loss",
    f"""eh AS (SELECT CAST(h AS INT) AS h, [embedding[4 * h + q]::DOUBLE for q in range(1, 5)] AS z, (label + h) % 5 AS y FROM embeddings, range(0, 16) AS r(h)),
ev AS (SELECT h, y, len([x for x in z if x > 0]) AS passed, list_sum([CASE WHEN y > q - 1 THEN {_LOGIT.format(z='(-z[q])')} ELSE {_LOGIT.format(z='z[q]')} END for q in range(1, 5)]) / 4 AS loss FROM eh)""")
def evaluation(spark, sf_dir):
    """Sixteen horizons of four logits each from the 64 components."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    z = F.col("embedding").cast("array<double>")
    table = e.select(F.array(*[F.slice(z, 4 * h + 1, 4) for h in range(16)]).alias("logits"), F.array(*[F.pmod(F.col("label") + h, F.lit(5)).cast("int") for h in range(16)]).alias("target"))
    return losses.evaluate(table, "logits", "target")


_TOP = "(SELECT max(v) FROM (SELECT unnest(z) AS v))"


@register(
    "losses", f"""SELECT avg(list_sum([CASE WHEN y > q - 1 THEN {_LOGIT.format(z='(-z[q])')} ELSE {_LOGIT.format(z='z[q]')} END for q in range(1, 65)]) / 64) AS ordinal,
avg(-1 * pow(1 - exp(logp), 2) * logp) AS focal, avg(list_sum([greatest((q - 0.5) / 64 * (y - z[q]), ((q - 0.5) / 64 - 1) * (y - z[q])) for q in range(1, 65)]) / 64) AS quantile, avg((len([x for x in z if x > 0]) = y)::INT) AS accuracy
FROM (SELECT *, z[y + 1] - top - ln(list_sum([exp(x - top) for x in z])) AS logp FROM (SELECT *, list_max(z) AS top FROM (SELECT embedding::DOUBLE[] AS z, label AS y FROM embeddings)))""", "", "ordinal focal quantile accuracy")
def loss_values(spark, sf_dir):
    """All 64 components as logits, and as predictions of 64 quantiles."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("z"), F.col("label").alias("y"), F.col("label").cast("int").alias("c"))
    found = (losses.ordinal_loss("z", "y").alias("ordinal"), losses.focal_loss("z", "c").alias("focal"), losses.quantile_loss("z", "y", tuple((i + 0.5) / 64 for i in range(64))).alias("quantile"))
    return e.agg(*found, F.avg((losses.ordinal_class("z") == F.col("y")).cast("double")).alias("accuracy"))


@register(
    "positional_encoding", "SELECT event_id, " + ", ".join(f"{'sin' if i % 2 == 0 else 'cos'}(event_id / pow(10000.0, {2 * (i // 2)} / 8.0)) AS e{i}" for i in range(8)) + " FROM events", "event_id", " ".join(f"e{i}" for i in range(8)))
def positional_encoding(spark, sf_dir):
    made = losses.positional_encoding(views.base(spark, sf_dir), "event_id", 8)
    return made.select("event_id", *[F.col("encoding")[i].alias(f"e{i}") for i in range(8)])


# labels -------------------------------------------------------------------------------

_SETS = [(a, g) for a in (0.4, 0.8) for g in (1.5, 2.0)]
_SET_VIEWS = views.SQL.strip() + ", "


def _tuned_sql() -> str:
    def of(i: int, a: float, g: float) -> str:
        ctes = _ANALYZE.replace("sigma * 0.5 *", f"sigma * {a!r} *").replace(") * 2 AS t2_", f") * {g!r} AS t2_")
        return f"SELECT {i} AS config, horizon, quality_score FROM (WITH RECURSIVE {_SET_VIEWS}{ctes} SELECT horizon, quality_score FROM ({_SCORED}))"

    return "SELECT *, avg(quality_score) OVER (PARTITION BY config) AS avg_quality_score FROM (" + " UNION ALL ".join(of(i, a, g) for i, (a, g) in enumerate(_SETS)) + ")"


@register("label_tuning", _tuned_sql(), "config horizon quality_score", "avg_quality_score")
def label_tuning(spark, sf_dir):
    return _GEN.tune(_label_input(spark, sf_dir), [{"alpha": a, "gamma": g} for a, g in _SETS]).select("config", "horizon", "quality_score", "avg_quality_score")


# features -----------------------------------------------------------------------------


@register("stacked_depth", f"SELECT ts AS timestamp, CASE WHEN coalesce({', '.join(f'depth_{_name(b)}' for b in _BANDS)}) IS NOT NULL THEN {' + '.join(f'coalesce(depth_{_name(b)}, 0)' for b in _BANDS)} END AS depth FROM wide", "timestamp", "depth", f"wide AS (SELECT ts, {', '.join(f'max(CASE WHEN p = {b} THEN depth END) AS depth_{_name(b)}' for b in _BANDS)} FROM book GROUP BY ts)")
def stacked_depth(spark, sf_dir):
    wide = reshape.pivot_book(views.book_depth(spark, sf_dir))
    return reshape.stack_sum(wide, "timestamp", [f"depth_{b}" for b in _BANDS], "depth")


_FOUR = ["open", "high", "low", "close", "volume"]


@register(
    "top_correlations", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM klines" for i, a in enumerate(_FOUR) for b in _FOUR[i + 1 :]) + ") ORDER BY abs(r) DESC, a, b LIMIT 4", "a b", "r")
def top_correlations(spark, sf_dir):
    return feature_quality.top_correlations(views.klines(spark, sf_dir), _FOUR, 4)


@register(
    "clipped_book", "SELECT timestamp, " + ", ".join(f"least(greatest({n.replace('_-', '_m')}, -1), 1) AS {n.replace('_-', '_m')}" for n in _OB_NAMES if n.endswith("_n")) + f" FROM ({_ob_sql()})",
    "timestamp", " ".join(n.replace("_-", "_m") for n in _OB_NAMES if n.endswith("_n")), _COMBINED)
def clipped_book(spark, sf_dir):
    """Depth and notional of each band within -1 and 1."""
    made = orderbook_features(_combined(spark, sf_dir).filter("close is not null"), limit=1.0)
    return _plain(made.select("timestamp", *[F.col(f"`{n}`") for n in _OB_NAMES if n.endswith("_n")]))


@register(
    "warm_tail", "SELECT * FROM (SELECT open_time, coalesce(CASE WHEN count(ret_1) OVER f >= 10 THEN (ret_1 - avg(ret_1) OVER f) / (nullif(stddev_samp(ret_1) OVER f, 0) + 1e-12) END, 0) AS ret_1_z, row_number() OVER (ORDER BY open_time DESC) AS back FROM "
    f"({_RAW}) WINDOW f AS (ORDER BY open_time ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)) WHERE back <= 100", "open_time", "ret_1_z", _LAG)
def warm_tail(spark, sf_dir):
    """The last hundred rows, made with the rows before them as warm-up only."""
    k = views.klines(spark, sf_dir)
    tail = reshape.slice_from_end(k, "open_time", 100, 0)
    before = k.join(tail.agg(F.min("open_time").alias("__first")).hint("broadcast"), F.col("open_time") < F.col("__first")).drop("__first")
    made = OHLCVNormalizer(lags=(), window=48, clip=None).transform(tail, context=reshape.slice_from_end(before, "open_time", 60, 0))
    return made.select("open_time", "ret_1_z")


# stored tables ------------------------------------------------------------------------


@register("stored_parts", "SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS least_parts, count(*) AS rows, CAST(least(100, count(*)) AS BIGINT) AS largest FROM klines", "least_parts rows largest")
def stored_parts(spark, sf_dir):
    """Candles written in parts of at most a hundred rows, read again and counted file by file."""
    path = staged_path(spark, "parts")
    ingest.save_parts(views.klines(spark, sf_dir).coalesce(1), path, 100)
    sizes = ingest.part_sizes(ingest.load_parts(spark, path))
    return sizes.agg(F.count(F.lit(1)).alias("least_parts"), F.sum("rows").alias("rows"), F.max("rows").alias("largest"))


@register("csv_round_trip", "SELECT open_time, open, close, cnt FROM klines", "open_time cnt", "open close")
def csv_round_trip(spark, sf_dir):
    path = staged_path(spark, "csv")
    k = views.klines(spark, sf_dir).select("open_time", "open", "close", "cnt")
    ingest.save_csv(k, path)
    return spark.read.schema(k.schema).option("header", True).csv(path)


@register("narrowed", "SELECT open_time, CAST(CAST(close AS FLOAT) AS DOUBLE) AS close FROM klines", "open_time", "close")
def narrowed(spark, sf_dir):
    made = ingest.compact(views.klines(spark, sf_dir).select("open_time", "close"))
    return made.select("open_time", F.col("close").cast("double").alias("close"))


@register(
    "archive_plan", "SELECT CAST(d AS DATE) AS day, 'AB-1m-' || strftime(d, '%Y-%m-%d') || '.zip' AS name, 'http://x/klines/AB/1m/AB-1m-' || strftime(d, '%Y-%m-%d') || '.zip' AS address FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events))",
    "day name address")
def archive_plan(spark, sf_dir):
    """The archives of all days that the events cover."""
    days = views.base(spark, sf_dir).select(F.to_date(F.timestamp_millis("t")).alias("day"))
    first, last = days.agg(F.min("day"), F.max("day")).first()
    return ingest.plan_archives(spark, "AB", "klines", first, last, "http://x", "1m")
