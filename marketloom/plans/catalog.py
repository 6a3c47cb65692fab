"""Every registered query with its DuckDB equivalent.

Window sizes fit the test series (at most 720 bars); the operators' own defaults are
those of production.  Floats are rounded to six digits on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import series as S
from marketloom.operators import feature_quality, indicators, label_quality, losses, preparation, reshape, statistics, training, validate
from marketloom.operators.labels import LabelGenerator
from marketloom.operators.normalizers import MetricsNormalizer, OHLCVNormalizer, orderbook_features
from marketloom.plans import views
from marketloom.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def six_digits(x: Column) -> Column:
    """``x`` rounded as the SQL's round(x, 6) does it, whose scaling moves the last bit of ratios beyond 1e10."""
    return F.when(F.abs(x) < 1e300, F.round(x * 1e6) / 1e6).otherwise(x) + 0.0


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[six_digits(F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def register(name: str, sql: str | None = None, keys: str = "", floats: str = "", ctes: str = ""):
    """Register a query; ``sql`` is the FROM part whose keys and rounded floats are selected."""

    def wrap(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
        if sql:
            chosen = [k for k in keys.split()] + [f"round({f}, 6) + 0.0 AS {f}" for f in floats.split()]
            tables = re.sub(r"(\w+) AS \(SELECT (?!i, CAST)", r"\1 AS MATERIALIZED (SELECT ", f"{views.SQL}{', ' + ctes if ctes else ''}")  # recursion reads them again and again
            ORACLES[name] = f"WITH RECURSIVE {tables} SELECT {', '.join(chosen)} FROM ({sql})"
        return query

    return wrap


def recursive(name: str, source: str, alpha: float, start: str = "x", first: int = 1) -> str:
    """A CTE (i, y): the recursive mean of ``source`` (i, x) from row ``first`` on."""
    return f"{name} AS (SELECT i, CAST({start} AS DOUBLE) AS y FROM {source} WHERE i = {first} UNION ALL SELECT s.i, (1 - {alpha!r}) * r.y + {alpha!r} * s.x FROM {name} r JOIN {source} s ON s.i = r.i + 1)"


def seeded(name: str, source: str, alpha: float, n: int) -> str:
    """The same, started at the mean of the first ``n`` values."""
    return recursive(name, source, alpha, f"(SELECT avg(x) FROM {source} WHERE i <= {n})", n)


# candles ------------------------------------------------------------------------------


@register(
    "ohlcv_ret_and_z",
    "SELECT open_time, ln(close / lag(close) OVER w) AS ret, CASE WHEN count(close) OVER f >= 10 THEN (close - avg(close) OVER f) / (nullif(stddev_samp(close) OVER f, 0) + 1e-12) END AS close_z FROM klines WINDOW w AS (ORDER BY open_time), f AS (ORDER BY open_time ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)",
    "open_time", "ret close_z")
def ohlcv_ret_and_z(spark, sf_dir):
    k, w = views.klines(spark, sf_dir), S.order([], "open_time")
    return k.select("open_time", S.log_return(F.col("close"), w).alias("ret"), S.zscore(F.col("close"), w, 48, 10, 1e-12, skip_current=True, null_flat=True).alias("close_z"))


_LAG = "p AS (SELECT *, lag(close) OVER w AS c1, lag(volume) OVER w AS v1 FROM klines WINDOW w AS (ORDER BY open_time))"
_RAW = """SELECT *, open / (abs(c1) + 1e-12) - 1 AS open_rel_prev, high / (abs(c1) + 1e-12) - 1 AS high_rel_prev, low / (abs(c1) + 1e-12) - 1 AS low_rel_prev, close / (abs(c1) + 1e-12) - 1 AS close_rel_prev,
(close - open) / (abs(open) + 1e-12) AS body_rel_open, (high - greatest(open, close)) / (abs(open) + 1e-12) AS wick_top_rel_open, (least(open, close) - low) / (abs(open) + 1e-12) AS wick_bot_rel_open, (high - low) / (abs(open) + 1e-12) AS hl_range_rel,
CASE WHEN c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) / (abs(c1) + 1e-12) END AS true_range_rel, ln((close + 1e-12) / (c1 + 1e-12)) AS ret_1, open / (c1 + 1e-12) - 1 AS gap_open,
ln(1 + greatest(volume, 0)) AS volume_log, volume / v1 - 1 AS volume_pct, ln(1 + greatest(volume * close, 0)) AS dollar_volume_log, (high - low) / (abs(open) + 1e-12) * ln(1 + greatest(volume, 0)) AS price_impact_vol FROM p"""
_RAW_NAMES = "open_rel_prev high_rel_prev low_rel_prev close_rel_prev body_rel_open wick_top_rel_open wick_bot_rel_open hl_range_rel true_range_rel ret_1 gap_open volume_log volume_pct dollar_volume_log price_impact_vol"
_LAGGED = "SELECT *, " + ", ".join(f"lag({n}, {k}) OVER w AS {n}_lag{k}" for k in (2, 5) for n in OHLCVNormalizer.SNAPSHOT) + ", " + ", ".join(
    f"ln((close + 1e-12) / (lag(close, {k}) OVER w + 1e-12)) AS ret_{k}, open / (lag(close, {k}) OVER w + 1e-12) - 1 AS gap_open_{k}, " + ", ".join(f"({n} - lag({n}, {k}) OVER w) / (abs(lag(close, {k}) OVER w) + 1e-12) AS d{n}_{k}" for n in ("close", "open", "high", "low"))
    for k in (2, 5)) + f" FROM ({_RAW}) WINDOW w AS (ORDER BY open_time)"
_OHLCV = OHLCVNormalizer(lags=(5, 2, 2, 0), window=48, clip=None)
_ALL_NAMES = " ".join(_OHLCV.feature_names())


@register("ohlcv_features", _LAGGED, "open_time", _ALL_NAMES, _LAG)
def ohlcv_features(spark, sf_dir):
    return _OHLCV.features(views.klines(spark, sf_dir)).select("open_time", *_OHLCV.feature_names())


_Z = "SELECT open_time, " + ", ".join(f"coalesce(CASE WHEN count({n}) OVER f >= 10 THEN ({n} - avg({n}) OVER f) / (nullif(stddev_samp({n}) OVER f, 0) + 1e-12) END, 0) AS {n}_z" for n in _RAW_NAMES.split()) + f" FROM ({_RAW}) WINDOW f AS (ORDER BY open_time ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)"


@register("ohlcv_zscores", _Z, "open_time", " ".join(f"{n}_z" for n in _RAW_NAMES.split()), _LAG)
def ohlcv_zscores(spark, sf_dir):
    n = OHLCVNormalizer(lags=(), window=48, clip=None)
    return n.transform(views.klines(spark, sf_dir))


@register("ohlcv_zscores_in_time_blocks", _Z.replace("AS (ORDER", "AS (ORDER"), "open_time", "close_rel_prev_z ret_1_z volume_log_z", _LAG)
def ohlcv_zscores_in_time_blocks(spark, sf_dir):
    """The same through halo blocks; time blocks need a regular grid, so gaps are looked back over by row."""
    k = views.klines(spark, sf_dir)
    n = OHLCVNormalizer(lags=(), window=48, clip=None)
    return n.transform(k, step=views.HOUR).select("open_time", "close_rel_prev_z", "ret_1_z", "volume_log_z")


_CLIPPED = ["ret_1_z", "volume_log_z"]


@register(
    "ohlcv_clipped",
    "SELECT open_time, " + ", ".join(f"coalesce(CASE WHEN {n} IS NOT NULL THEN least(greatest({n}, (SELECT quantile_cont({n}, 0.01) FROM z)), (SELECT quantile_cont({n}, 0.99) FROM z)) END, 0) AS {n}" for n in _CLIPPED) + " FROM z",
    "open_time", " ".join(_CLIPPED),
    _LAG + ", z AS (SELECT open_time, " + ", ".join(f"CASE WHEN count({n}) OVER f >= 10 THEN ({n} - avg({n}) OVER f) / (nullif(stddev_samp({n}) OVER f, 0) + 1e-12) END AS {n}_z" for n in ("ret_1", "volume_log")) + f" FROM ({_RAW}) WINDOW f AS (ORDER BY open_time ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING))")
def ohlcv_clipped(spark, sf_dir):
    k = views.klines(spark, sf_dir)
    return OHLCVNormalizer(lags=(), window=48).fit(k).transform(k).select("open_time", *_CLIPPED)


# order book and metrics ---------------------------------------------------------------

_BANDS = reshape.BANDS
_name = lambda b: str(b).replace("-", "m")  # noqa: E731  column names without a sign, for SQL


def _pivot_sql(cols=("depth", "notional")) -> str:
    return "SELECT ts, " + ", ".join(f"max({c}) FILTER (WHERE p = {b}) AS {c}_{_name(b)}" for c in cols for b in _BANDS) + " FROM book GROUP BY ts"


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c.replace("_-", "_m")) for c in df.columns])


_BOOK_NAMES = " ".join(f"{c}_{_name(b)}" for c in ("depth", "notional") for b in _BANDS)


@register("book_pivot", f"SELECT ts AS timestamp, * EXCLUDE (ts) FROM ({_pivot_sql()})", "timestamp", _BOOK_NAMES)
def book_pivot(spark, sf_dir):
    return _plain(reshape.pivot_book(views.book_depth(spark, sf_dir)))


def _interpolated_sql() -> str:
    """Neighbouring known points by last_value over the grid united with the raw times."""
    cols = _BOOK_NAMES.split()
    near, value = _between_sql(cols)
    return f"""wide AS ({_pivot_sql()}), grid AS (SELECT unnest(range((SELECT min(ts) FROM wide), (SELECT max(ts) FROM wide) + 1, 1800000)) AS ts),
near AS (SELECT ts, {near} FROM grid LEFT JOIN wide USING (ts) WINDOW a AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (ORDER BY ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
filled AS (SELECT ts AS timestamp, {value} FROM near)"""


def _between_sql(cols: list[str]) -> tuple[str, str]:
    """The known points around each time, and the value between them."""
    near = ", ".join(f"last_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS pt_{c}, last_value({c} IGNORE NULLS) OVER a AS pv_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER d AS nt_{c}, last_value({c} IGNORE NULLS) OVER d AS nv_{c}" for c in cols)
    value = ", ".join(f"CASE WHEN pt_{c} IS NULL THEN nv_{c} WHEN nt_{c} IS NULL OR nt_{c} = pt_{c} THEN pv_{c} ELSE pv_{c} + (nv_{c} - pv_{c}) * (ts - pt_{c}) / (nt_{c} - pt_{c}) END AS {c}" for c in cols)
    return near, value


@register("book_interpolated", "SELECT * FROM filled", "timestamp", _BOOK_NAMES, _interpolated_sql())
def book_interpolated(spark, sf_dir):
    return _plain(reshape.interpolate_to_grid(reshape.pivot_book(views.book_depth(spark, sf_dir)), "timestamp", views.HALF_HOUR))


_M = ("oi", "oi_value", "r1", "r2")
_EXTENDED = "pts AS (SELECT ((create_time + 7200000) // 14400000) * 14400000 AS g, " + ", ".join(f"arg_max({c}, create_time) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _M) + " FROM metrics GROUP BY 1), dense AS (SELECT t AS create_time, " + ", ".join(_M) + " FROM (SELECT unnest(range((SELECT min(g) FROM pts), (SELECT max(g) FROM pts) + 1, 14400000)) AS t) LEFT JOIN pts ON g = t)"


@register("metrics_extended", "SELECT * FROM dense", "create_time oi", "oi_value r1 r2", _EXTENDED)
def metrics_extended(spark, sf_dir):
    return reshape.extend_metrics(views.metrics(spark, sf_dir), views.FOUR_HOURS)


_CARRIED = "SELECT create_time, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER f AS {c}" for c in _M) + ", CAST(row_number() OVER w - max(CASE WHEN coalesce(oi, oi_value, r1, r2) IS NOT NULL THEN rn END) OVER f AS DOUBLE) AS distance FROM (SELECT *, row_number() OVER (ORDER BY create_time) AS rn FROM dense) WINDOW w AS (ORDER BY create_time), f AS (ORDER BY create_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@register("metrics_carried", _CARRIED, "create_time oi", "oi_value r1 r2 distance", _EXTENDED)
def metrics_carried(spark, sf_dir):
    return reshape.carry_forward(reshape.extend_metrics(views.metrics(spark, sf_dir), views.FOUR_HOURS))


def _combined(spark, sf_dir) -> DataFrame:
    return reshape.combine(views.book_depth(spark, sf_dir), views.klines(spark, sf_dir), views.metrics(spark, sf_dir), views.HALF_HOUR, views.FOUR_HOURS)


_COMBINED = f"{_interpolated_sql()}, {_EXTENDED}, carried AS ({_CARRIED}), combined AS (SELECT * FROM filled LEFT JOIN klines ON timestamp = open_time LEFT JOIN carried ON timestamp = create_time)"


@register("combined", "SELECT * FROM combined", "timestamp open_time create_time cnt oi", "depth_m1 depth_1 notional_m5 notional_5 open high low close volume oi_value r1 r2 distance", _COMBINED)
def combined(spark, sf_dir):
    c = _plain(_combined(spark, sf_dir))
    return c.select("timestamp", "open_time", "create_time", "cnt", "oi", "depth_m1", "depth_1", "notional_m5", "notional_5", "open", "high", "low", "close", "volume", "oi_value", "r1", "r2", "distance")


def _combined_by_type_sql() -> str:
    near, value = _between_sql(_BOOK_NAMES.split())
    wide = _pivot_sql().replace("SELECT ts, ", "SELECT event_type, ts, ").replace("FROM book GROUP BY ts", "FROM tbook GROUP BY event_type, ts")
    up_to = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""tbook AS (SELECT event_type, (t // 1800000) * 1800000 AS ts,
  CASE WHEN event_id % 10 < 5 THEN CAST(event_id % 10 AS INT) - 5 ELSE CAST(event_id % 10 AS INT) - 4 END AS p, round(sum(value), 6) AS depth, round(sum(value * k), 6) AS notional FROM b GROUP BY 1, 2, 3),
twide AS ({wide}), tends AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM twide GROUP BY 1),
tgrid AS (SELECT event_type, unnest(range(lo, hi + 1, 1800000)) AS ts FROM tends),
tnear AS (SELECT event_type, ts, {near} FROM tgrid LEFT JOIN twide USING (event_type, ts)
  WINDOW a AS (PARTITION BY event_type ORDER BY ts {up_to}), d AS (PARTITION BY event_type ORDER BY ts DESC {up_to})),
tfilled AS (SELECT event_type, ts AS timestamp, {value} FROM tnear),
tklines AS (SELECT event_type, (t // 3600000) * 3600000 AS open_time, max(value) AS high, min(value) AS low, round(sum(value), 6) AS volume, count(*) AS cnt FROM b GROUP BY 1, 2),
tpts AS (SELECT event_type, ((create_time + 7200000) // 14400000) * 14400000 AS g, arg_max(oi, create_time) FILTER (WHERE oi IS NOT NULL) AS oi,
  arg_max(oi_value, create_time) FILTER (WHERE oi_value IS NOT NULL) AS oi_value
  FROM (SELECT event_type, min(t) AS create_time, sum(k) AS oi, round(sum(value * k), 6) AS oi_value FROM b GROUP BY event_type, t // 14400000) GROUP BY 1, 2),
tspan AS (SELECT event_type, min(g) AS lo, max(g) AS hi FROM tpts GROUP BY 1),
tdense AS (SELECT event_type, g AS create_time, oi, oi_value FROM (SELECT event_type, unnest(range(lo, hi + 1, 14400000)) AS g FROM tspan) LEFT JOIN tpts USING (event_type, g)),
tcarried AS (SELECT event_type, create_time, last_value(oi IGNORE NULLS) OVER f AS oi, last_value(oi_value IGNORE NULLS) OVER f AS oi_value,
  CAST(rn - max(CASE WHEN coalesce(oi, oi_value) IS NOT NULL THEN rn END) OVER f AS DOUBLE) AS distance
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY create_time) AS rn FROM tdense) WINDOW f AS (PARTITION BY event_type ORDER BY create_time {up_to})),
typed_rows AS (SELECT * FROM tfilled f LEFT JOIN tklines k ON k.event_type = f.event_type AND timestamp = open_time LEFT JOIN tcarried c ON c.event_type = f.event_type AND timestamp = create_time)"""


@register(
    "combined_by_type", "SELECT * FROM typed_rows", "event_type timestamp open_time create_time cnt oi", "depth_m1 depth_5 notional_m5 notional_5 high low volume oi_value distance", _combined_by_type_sql())
def combined_by_type(spark, sf_dir):
    """All event types as series of their own, on their own grids, in one pass."""
    klines = views.klines(spark, sf_dir, by_type=True)
    book = views.book_depth(spark, sf_dir, by_type=True)
    c = _plain(reshape.combine(book, klines, views.typed_metrics(spark, sf_dir), views.HALF_HOUR, views.FOUR_HOURS, series=["event_type"]))
    return c.select(*"event_type timestamp open_time create_time cnt oi depth_m1 depth_5 notional_m5 notional_5 high low volume oi_value distance".split())


def _ob_sql() -> str:
    sq = lambda e: f"sign({e}) * ln(1 + abs({e}))"
    cols = [f"{sq(f'(depth_{_name(b)} / (close + 2e-8))')} AS depth_{_name(b)}_n, {sq(f'(notional_{_name(b)} / ((close + 2e-8) * (close + 2e-8)))')} AS notional_{_name(b)}_n" for b in _BANDS]
    tot = []
    for kind, s in (("depth", "(close + 1e-8)"), ("notional", "((close + 1e-8) * (close + 1e-8))")):
        for side, keep in (("bid", lambda b: b < 0), ("ask", lambda b: b > 0)):
            tot.append(f"ln(1 + ({' + '.join(f'coalesce({kind}_{_name(b)}, 0)' for b in _BANDS if keep(b))}) / {s}) AS total_{kind}_{side}")
    more = ", ".join(f"total_{k}_bid + total_{k}_ask AS total_{k}, total_{k}_bid / (total_{k}_ask + 1e-8) AS {k}_imbalance_ratio, (total_{k}_bid - total_{k}_ask) / (total_{k}_bid + total_{k}_ask + 1e-8) AS {k}_imbalance_signed" for k in ("depth", "notional"))
    return f"SELECT *, {more} FROM (SELECT timestamp, {', '.join(cols + tot)} FROM combined WHERE close IS NOT NULL)"


_OB_NAMES = [f"{c}_{b}_n" for b in _BANDS for c in ("depth", "notional")] + [f"total_{k}{s}" for k in ("depth", "notional") for s in ("_bid", "_ask", "")] + [f"{k}_imbalance_{s}" for k in ("depth", "notional") for s in ("ratio", "signed")]


@register("orderbook_features", _ob_sql(), "timestamp", " ".join(_OB_NAMES).replace("_-", "_m"), _COMBINED)
def order_book(spark, sf_dir):
    c = _combined(spark, sf_dir).filter("close is not null")
    return _plain(orderbook_features(c).select("timestamp", *[F.col(f"`{n}`") for n in _OB_NAMES]))


def _market_metrics_columns() -> list:
    r = MetricsNormalizer.RATIOS
    return [F.col("oi").alias("count"), F.col("oi_value").alias("taker_buy_volume"), F.col("oi").alias("sum_open_interest"), (F.col("oi_value") * 2).alias("sum_open_interest_value"), F.col("r1").alias(r[0]), F.col("r2").alias(r[1]), (F.col("r1") + 1).alias(r[2]), (F.col("r2") * 2).alias(r[3])]


def _market_metrics(spark, sf_dir) -> DataFrame:
    return views.metrics(spark, sf_dir).select("create_time", *_market_metrics_columns())


def _metrics_parts() -> list[str]:
    """The outputs of the metrics normalizer over a window f of its rows so far, not clipped."""
    clipped = lambda e: f"CASE WHEN {e} IS NOT NULL THEN least(greatest({e}, -3.0), 3.0) END"
    pct = lambda x: f"({x} / lag({x}) OVER w - 1)"
    z = lambda e: f"CASE WHEN count({e}) OVER f >= 10 THEN ({e} - avg({e}) OVER f) / (stddev_samp({e}) OVER f + 1e-9) END"
    parts = [clipped(pct("(oi_value + 1e-9)")), clipped(pct("CAST(oi AS DOUBLE)")) + " * 1000", clipped(pct("(oi_value * 2)")) + " * 1000"]
    parts += [z(e) for e in ("oi_value", "oi", "(oi_value * 2)", "(oi_value * 2 / (oi + 1e-9))", "oi", "(oi_value / (oi + 1e-9))")]
    for e in ("r1", "r2", "r1 + 1", "r2 * 2"):
        parts.append(f"(({e}) - (SELECT quantile_cont({e}, 0.5) FROM metrics)) / (SELECT quantile_cont({e}, 0.99) - quantile_cont({e}, 0.01) FROM metrics)")
    return parts


def _metrics_sql() -> str:
    made = ", ".join(f"coalesce({e}, 0) AS {n}" for n, e in zip(MetricsNormalizer.OUTPUT, _metrics_parts()))
    return f"SELECT create_time, {made} FROM metrics WINDOW w AS (ORDER BY create_time), f AS (ORDER BY create_time ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)"


@register("metrics_features", _metrics_sql(), "create_time", " ".join(MetricsNormalizer.OUTPUT))
def metrics_features(spark, sf_dir):
    m = _market_metrics(spark, sf_dir)
    return MetricsNormalizer(window=48, clip=None).fit(m).transform(m)


# validation ---------------------------------------------------------------------------


@register("time_gaps", "SELECT CASE WHEN d > 3600000 THEN 'missing' WHEN d = 0 THEN 'duplicate' ELSE 'too_close' END AS kind, prev, cur, d AS diff, CASE WHEN d > 3600000 THEN d // 3600000 - 1 ELSE 0 END AS missing_rows FROM (SELECT lag(open_time) OVER (ORDER BY open_time) AS prev, open_time AS cur, open_time - lag(open_time) OVER (ORDER BY open_time) AS d FROM klines) WHERE d <> 3600000", "kind prev cur diff missing_rows")
def time_gaps(spark, sf_dir):
    return validate.time_gaps(views.klines(spark, sf_dir), views.HOUR, "open_time")


@register("missing_cells", " UNION ALL ".join(f"SELECT ts AS timestamp, 'depth_{_name(b)}' AS \"column\" FROM wide WHERE depth_{_name(b)} IS NULL" for b in _BANDS), 'timestamp "column"', "", f"wide AS ({_pivot_sql(('depth',))})")
def missing_cells(spark, sf_dir):
    wide = _plain(reshape.pivot_book(views.book_depth(spark, sf_dir)))
    return validate.missing_cells(wide.select("timestamp", *[c for c in wide.columns if c.startswith("depth_")]), ["timestamp"])


@register("duplicate_lines", "SELECT l_orderkey, l_linenumber, n, count(*) AS copies FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1 GROUP BY 1, 2, 3", "l_orderkey l_linenumber copies")
def duplicate_lines(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return validate.duplicates(l, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))


@register("shared_times", "SELECT DISTINCT a.open_time FROM (SELECT * FROM typed WHERE event_type = 'view') a JOIN (SELECT * FROM typed WHERE event_type = 'purchase') b USING (open_time)", "open_time")
def shared_times(spark, sf_dir):
    k = views.klines(spark, sf_dir, by_type=True)
    return validate.shared_times(k.filter("event_type = 'view'"), k.filter("event_type = 'purchase'"), "open_time")


@register(
    "typed_rows",
    "SELECT coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR) END AS BIGINT), 0) AS percentage, coalesce(epoch_us(date_trunc('second', ts)) // 1000, 0) AS timestamp, CASE WHEN event_id % 5 <> 0 THEN value END AS depth, value AS notional FROM events",
    "timestamp percentage", "depth notional")
def typed_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.col("event_id").cast("string")).alias("percentage"), F.when(F.col("event_id") % 5 == 0, "nan").otherwise(F.col("value").cast("string")).alias("depth"), F.col("value").cast("string").alias("notional"))
    header = spark.createDataFrame([("timestamp", "percentage", "depth", "notional")], text.schema)
    return ingest.require_schema(ingest.typed(text.union(header), "bookDepth"), "bookDepth")


# joins --------------------------------------------------------------------------------


@register("asof_backward", "SELECT k.open_time, k.close, m.r1, m.oi_value FROM klines k ASOF LEFT JOIN metrics m ON k.open_time >= m.create_time", "open_time", "close r1 oi_value")
def asof_backward(spark, sf_dir):
    m = views.metrics(spark, sf_dir).filter("r1 is not null").withColumnRenamed("create_time", "open_time")
    return reshape.asof_backward(views.klines(spark, sf_dir).select("open_time", "close"), m, "open_time", ["r1", "oi_value"])


ORACLES["asof_backward"] = ORACLES["asof_backward"].replace("JOIN metrics m", "JOIN (SELECT * FROM metrics WHERE r1 IS NOT NULL) m")


@register("pair_on_time", "SELECT a.open_time, a.close, b.close AS close_b FROM typed a JOIN typed b ON a.open_time = b.open_time AND a.event_type = 'view' AND b.event_type = 'purchase'", "open_time", "close close_b")
def pair_on_time(spark, sf_dir):
    return _pair(spark, sf_dir)


def _pair(spark, sf_dir) -> DataFrame:
    k = views.klines(spark, sf_dir, by_type=True).select("open_time", "event_type", "close")
    return reshape.common_times(k.filter("event_type = 'view'").drop("event_type"), k.filter("event_type = 'purchase'").drop("event_type"), "open_time")


@register("aligned", "SELECT * FROM metrics WHERE create_time >= (SELECT min(open_time) + 86400000 FROM klines)", "create_time oi", "oi_value")
def aligned(spark, sf_dir):
    later = views.klines(spark, sf_dir).select((F.col("open_time") + 86_400_000).alias("open_time"))
    return reshape.align_by_time(views.metrics(spark, sf_dir), later, "create_time", "open_time").select("create_time", "oi", "oi_value")


@register("last_rows", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY open_time DESC) AS r FROM klines) WHERE r > 50 AND r <= 150", "open_time", "close")
def last_rows(spark, sf_dir):
    return reshape.slice_from_end(views.klines(spark, sf_dir), "open_time", 100, 50).select("open_time", "close")


# calendar and preparation -------------------------------------------------------------

_TIME = ", ".join(f"{f}(2 * pi() * {e} / {p}) AS {n}_{f}" for n, e, p in (("month", "month(d)", 12), ("dow", "(isodow(d) - 1)", 7), ("hour", "hour(d)", 24), ("minute", "minute(d)", 60)) for f in ("sin", "cos"))


@register("time_features", f"SELECT timestamp, {_TIME} FROM (SELECT DISTINCT ts AS timestamp, make_timestamp(ts * 1000) AS d FROM book)", "timestamp", " ".join(f"{n}_{f}" for n in ("month", "dow", "hour", "minute") for f in ("sin", "cos")))
def time_features(spark, sf_dir):
    return preparation.time_features(views.book_depth(spark, sf_dir).select("timestamp").distinct(), "timestamp")


@register(
    "scaled",
    "SELECT create_time, (oi - avg(oi) OVER ()) / stddev_pop(oi) OVER () AS oi, (coalesce(r1, (SELECT median(r1) FROM metrics)) - (SELECT quantile_cont(coalesce(r1, (SELECT median(r1) FROM metrics)), 0.5) FROM metrics)) / (SELECT quantile_cont(coalesce(r1, (SELECT median(r1) FROM metrics)), 0.75) - quantile_cont(coalesce(r1, (SELECT median(r1) FROM metrics)), 0.25) FROM metrics) AS r1, (oi_value - min(oi_value) OVER ()) / (max(oi_value) OVER () - min(oi_value) OVER ()) AS oi_value FROM metrics",
    "create_time", "oi r1 oi_value")
def scaled(spark, sf_dir):
    m = views.metrics(spark, sf_dir)
    parts = [preparation.Numeric(["oi"], scale="standard"), preparation.Numeric(["r1"], impute="median", scale="robust"), preparation.Numeric(["oi_value"], scale="minmax")]
    made = preparation.FeaturePipeline(parts, remainder="passthrough").fit(m).transform(m)
    return made.select("create_time", "oi", "r1", "oi_value")


@register("one_hot", "SELECT event_id, CAST(event_type = 'click' AS DOUBLE) AS event_type_click, CAST(event_type = 'view' AS DOUBLE) AS event_type_view, CAST(value > 50 AS DOUBLE) AS big_true, greatest(least(1 - value / 4, 1), 0) AS near FROM events", "event_id", "event_type_click event_type_view big_true near")
def one_hot(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("big", F.col("value") > 50)
    parts = [preparation.OneHot(["event_type"]), preparation.OneHot(["big"], binary=True), preparation.Expression("near", "greatest(least(1 - value / 4, 1), 0)")]
    return preparation.FeaturePipeline(parts, remainder="passthrough").fit(e).transform(e).select("event_id", "event_type_click", "event_type_view", "big_true", "near")


@register("split_by_time", "SELECT CASE WHEN i < a THEN 'train' WHEN i < a + v THEN 'val' ELSE 'test' END AS part, count(*) AS n, min(open_time) AS first, max(open_time) AS last FROM (SELECT open_time, row_number() OVER (ORDER BY open_time) - 1 AS i, CAST(floor(count(*) OVER () * 0.75) AS BIGINT) AS a, CAST(floor(count(*) OVER () * 0.125) AS BIGINT) AS v FROM klines) GROUP BY 1", "part n first last")
def split_by_time(spark, sf_dir):
    parts = preparation.split_by_time(views.klines(spark, sf_dir), "open_time", 0.75, 0.125)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("open_time").alias("first"), F.max("open_time").alias("last"))


@register(
    "training_windows",
    "SELECT open_time AS start, sum(close) OVER (ORDER BY open_time ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS past_close, sum(volume) OVER (ORDER BY open_time ROWS BETWEEN 24 FOLLOWING AND 28 FOLLOWING) AS future_volume, lead(close, 24) OVER (ORDER BY open_time) AS t1, lead(close, 28) OVER (ORDER BY open_time) AS t5, row_number() OVER (ORDER BY open_time) - 1 AS i, lead(1, 28) OVER (ORDER BY open_time) AS ok FROM klines QUALIFY ok = 1 AND i % 3 = 0",
    "start", "t1 t5")
def training_windows(spark, sf_dir):
    w = preparation.windows(views.klines(spark, sf_dir), "open_time", ["close"], ["volume"], ["open"], "close", 24, (1, 5), stride=3)
    return w.filter((F.size("past") == 24) & (F.size("future") == 5)).select("start", F.col("targets")[0].alias("t1"), F.col("targets")[1].alias("t5"))


@register("quintiles", "SELECT CAST((volume > e[1])::INT + (volume > e[2])::INT + (volume > e[3])::INT + (volume > e[4])::INT AS INT) AS \"group\", count(*) AS n, avg(close) AS mean, stddev_samp(close) AS std FROM klines, (SELECT quantile_cont(volume, [0.2, 0.4, 0.6, 0.8]) AS e FROM klines) GROUP BY 1", '"group" n', "mean std")
def quintiles(spark, sf_dir):
    g = preparation.quantile_groups(views.klines(spark, sf_dir), "volume", 5)
    return g.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"))


_RET = "ret AS (SELECT open_time, close, volume, high, low, ln(close) - ln(lag(close) OVER (ORDER BY open_time)) AS r FROM klines), rets AS (SELECT * FROM ret WHERE r IS NOT NULL)"


def _returns(spark, sf_dir) -> DataFrame:
    return statistics.returns(views.klines(spark, sf_dir), "open_time", out="r")


@register("hourly_profile", "SELECT hour(make_timestamp(open_time * 1000)) AS hour, avg(r) AS mean, stddev_samp(r) AS std, count(r) AS n, avg(volume) AS volume FROM rets GROUP BY 1", "hour n", "mean std volume", _RET)
def hourly_profile(spark, sf_dir):
    r = _returns(spark, sf_dir).withColumn("hour", F.hour(F.timestamp_millis("open_time")).cast("long"))
    return r.groupBy("hour").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count("r").alias("n"), F.avg("volume").alias("volume"))


@register("weekday_profile", "SELECT isodow(make_timestamp(open_time * 1000)) - 1 AS dow, isodow(make_timestamp(open_time * 1000)) > 5 AS weekend, avg(r) AS mean, stddev_samp(r) AS std, count(*) FILTER (WHERE abs(r) > 0.5) AS extreme FROM rets GROUP BY 1, 2", "dow weekend extreme", "mean std", _RET)
def weekday_profile(spark, sf_dir):
    dow = F.weekday(F.timestamp_millis("open_time")).cast("long")
    r = _returns(spark, sf_dir).withColumns({"dow": dow, "weekend": dow.isin(5, 6)})
    return r.groupBy("dow", "weekend").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count_if(F.abs("r") > 0.5).alias("extreme"))


@register("largest_moves", "SELECT open_time, r FROM rets ORDER BY r DESC, open_time LIMIT 5", "open_time", "r", _RET)
def largest_moves(spark, sf_dir):
    return _returns(spark, sf_dir).orderBy(F.desc("r"), "open_time").limit(5).select("open_time", "r")


# indicators ---------------------------------------------------------------------------

_P = "p AS (SELECT *, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, (high + low + close) / 3 AS tp, lag((high + low + close) / 3) OVER w AS tp1, row_number() OVER w AS i FROM klines WINDOW w AS (ORDER BY open_time))"


def _f(expr: str, n: int, x: str | None = None) -> str:
    frame = f"(ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN i >= {n} THEN {expr} OVER {frame} END"


def _fn(expr: str, x: str, n: int) -> str:
    """Over the last n rows if all n have a value of x."""
    frame = f"(ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {expr} OVER {frame} END"


_SIMPLE = [("sma", {"window": 10}), ("bbands", {"window": 20, "num_std": 2.0}), ("momentum", {"period": 10}), ("ichimoku", {"conversion": 9, "base": 26, "span": 52}), ("stoch", {"window": 14, "smooth": 3}), ("obv", {}), ("vwap", {"period": 14}), ("cmf", {"window": 20}), ("williams_r", {"lookback": 14}), ("ao", {"short": 5, "long": 34}), ("fibonacci", {})]
_SIMPLE_NAMES = "sma_10 bb_upper bb_middle bb_lower momentum ichimoku_conversion ichimoku_base ichimoku_a ichimoku_b stoch_main stoch_side obv vwap cmf wr ao ao_prev frl_l1 frl_l2 frl_l3 frl_l4 frl_l5"
_mid = lambda n: f"({_f('max(high)', n)} + {_f('min(low)', n)}) / 2"
_Q1 = f"""SELECT *, {_f('avg(close)', 10)} AS sma_10, {_f('avg(close)', 20)} AS bb_middle, {_f('stddev_pop(close)', 20)} AS sd, close - lag(close, 10) OVER (ORDER BY open_time) AS momentum, {_mid(9)} AS ichimoku_conversion, {_mid(26)} AS ichimoku_base, {_mid(52)} AS ichimoku_b,
100 * (close - {_f('min(low)', 14)}) / nullif({_f('max(high)', 14)} - {_f('min(low)', 14)}, 0) AS stoch_main, sum(coalesce(sign(close - c1), 1) * volume) OVER (ORDER BY open_time) AS obv, {_f('sum(tp * volume)', 14)} / {_f('sum(volume)', 14)} AS vwap,
{_f('sum(coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume)', 20)} / {_f('sum(volume)', 20)} AS cmf, -100 * ({_f('max(high)', 14)} - close) / nullif({_f('max(high)', 14)} - {_f('min(low)', 14)}, 0) AS wr, {_f('avg((high + low) / 2)', 5)} - {_f('avg((high + low) / 2)', 34)} AS ao FROM p"""
_Q2 = f"SELECT *, bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower, (ichimoku_conversion + ichimoku_base) / 2 AS ichimoku_a, {_fn('avg(stoch_main)', 'stoch_main', 3)} AS stoch_side, lag(ao) OVER (ORDER BY open_time) AS ao_prev, low + 0.236 * (high - low) AS frl_l1, low + 0.382 * (high - low) AS frl_l2, low + 0.5 * (high - low) AS frl_l3, low + 0.618 * (high - low) AS frl_l4, high AS frl_l5 FROM ({_Q1})"


@register("indicators_windows", _Q2, "open_time", _SIMPLE_NAMES, _P)
def indicators_windows(spark, sf_dir):
    return indicators.add(views.klines(spark, sf_dir), _SIMPLE).select("open_time", *_SIMPLE_NAMES.split())


_FLOW = f"""SELECT open_time, (tp - {_f('avg(tp)', 20)}) / nullif(0.015 * (SELECT avg(abs(q.tp - m.m)) FROM p q, (SELECT avg(tp) AS m FROM p z WHERE z.i BETWEEN p.i - 19 AND p.i) m WHERE q.i BETWEEN p.i - 19 AND p.i), 0) AS cci,
100 * {_fn('sum(CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END)', 'tp1', 14)} / nullif({_fn('sum(CASE WHEN tp <> tp1 THEN tp * volume ELSE 0 END)', 'tp1', 14)}, 0) AS mfi,
100 * (4 * {_fn('sum(close - least(low, c1))', 'c1', 7)} / nullif({_fn('sum(greatest(high, c1) - least(low, c1))', 'c1', 7)}, 0) + 2 * {_fn('sum(close - least(low, c1))', 'c1', 14)} / nullif({_fn('sum(greatest(high, c1) - least(low, c1))', 'c1', 14)}, 0) + {_fn('sum(close - least(low, c1))', 'c1', 28)} / nullif({_fn('sum(greatest(high, c1) - least(low, c1))', 'c1', 28)}, 0)) / 7 AS uo FROM p"""


@register("indicators_flows", _FLOW, "open_time", "cci mfi uo", _P)
def indicators_flows(spark, sf_dir):
    made = indicators.add(views.klines(spark, sf_dir), [("cci", {"window": 20}), ("mfi", {"window": 14}), ("uo", {"short": 7, "medium": 14, "long": 28})])
    return made.select("open_time", "cci", "mfi", "uo")


_RSI = "up AS (SELECT i - 1 AS i, greatest(close - c1, 0) AS x FROM p WHERE i > 1), dn AS (SELECT i - 1 AS i, greatest(c1 - close, 0) AS x FROM p WHERE i > 1), "
_EMA = f"{_P}, cl AS (SELECT i, close AS x FROM p), {recursive('e', 'cl', 2 / 13)}, {_RSI}{recursive('au', 'up', 1 / 14)}, {recursive('ad', 'dn', 1 / 14)}"


@register(
    "indicators_exponential",
    "SELECT open_time, CASE WHEN p.i >= 12 THEN e.y END AS ema_12, CASE WHEN p.i >= 12 THEN high - e.y END AS bull_power, CASE WHEN p.i >= 12 THEN low - e.y END AS bear_power, CASE WHEN p.i >= 12 THEN high + low - 2 * e.y END AS bull_bear_power, CASE WHEN p.i > 14 THEN coalesce(100 * au.y / nullif(au.y + ad.y, 0), 100) END AS rsi FROM p JOIN e ON e.i = p.i LEFT JOIN au ON au.i = p.i - 1 LEFT JOIN ad ON ad.i = p.i - 1",
    "open_time", "ema_12 bull_power bear_power bull_bear_power rsi", _EMA)
def indicators_exponential(spark, sf_dir):
    made = indicators.add(views.klines(spark, sf_dir), [(" EMA ", {"window": 12}), ("bbp", {"ema_period": 12}), ("rsi", {"window": 14}), ("no such indicator", {})])
    return made.select("open_time", "ema_12", "bull_power", "bear_power", "bull_bear_power", "rsi")


_TR = "greatest(high - low, abs(high - c1), abs(low - c1))"
_WILDER = f"""{_P}, tr AS (SELECT i - 1 AS i, {_TR} AS x FROM p WHERE i > 1), {seeded('str', 'tr', 1 / 14, 14)},
pu AS (SELECT i - 1 AS i, CASE WHEN high - h1 > l1 - low AND high > h1 THEN high - h1 ELSE 0 END AS x FROM p WHERE i > 1), pd AS (SELECT i - 1 AS i, CASE WHEN l1 - low > high - h1 AND l1 > low THEN l1 - low ELSE 0 END AS x FROM p WHERE i > 1),
{seeded('su', 'pu', 1 / 14, 14)}, {seeded('sd', 'pd', 1 / 14, 14)}, di AS (SELECT str.i, 100 * su.y / str.y AS pos, 100 * sd.y / str.y AS neg FROM str JOIN su USING (i) JOIN sd USING (i)),
dx AS (SELECT row_number() OVER (ORDER BY i) AS i, i AS at, 100 * abs(pos - neg) / (pos + neg) AS x FROM di WHERE pos + neg <> 0), {seeded('ax', 'dx', 1 / 14, 14)}"""


@register("indicators_wilder", "SELECT open_time, str.y AS ATR, pos AS adx_pos, neg AS adx_neg, ax.y AS adx FROM p LEFT JOIN str ON str.i = p.i - 1 LEFT JOIN di ON di.i = p.i - 1 LEFT JOIN dx ON dx.at = p.i - 1 LEFT JOIN ax ON ax.i = dx.i", "open_time", "ATR adx_pos adx_neg adx", _WILDER)
def indicators_wilder(spark, sf_dir):
    made = indicators.add(views.klines(spark, sf_dir), [("atr", {"window": 14}), ("adx", {"adx_window": 14, "di_window": 14})])
    return made.select("open_time", "ATR", "adx_pos", "adx_neg", "adx")


_MACD = f"{_P}, cl AS (SELECT i, close AS x FROM p), {recursive('ef', 'cl', 2 / 13, '(SELECT avg(x) FROM cl WHERE i BETWEEN 15 AND 26)', 26)}, {seeded('es', 'cl', 2 / 27, 26)}, mc AS (SELECT row_number() OVER (ORDER BY ef.i) AS i, ef.i AS at, ef.y - es.y AS x FROM ef JOIN es ON ef.i = es.i), {seeded('sg', 'mc', 2 / 10, 9)}"


@register("indicators_macd", "SELECT open_time, CASE WHEN sg.y IS NOT NULL THEN mc.x END AS macd, sg.y AS macd_signal, mc.x - sg.y AS macd_hist FROM p LEFT JOIN mc ON mc.at = p.i LEFT JOIN sg ON sg.i = mc.i", "open_time", "macd macd_signal macd_hist", _MACD)
def indicators_macd(spark, sf_dir):
    return indicators.add(views.klines(spark, sf_dir), [("macd", {"fast": 12, "slow": 26, "signal": 9})]).select("open_time", "macd", "macd_signal", "macd_hist")


_SRSI = f"{_P}, {_RSI}{recursive('au', 'up', 1 / 14)}, {recursive('ad', 'dn', 1 / 14)}, {seeded('bu', 'up', 1 / 14, 14)}, {seeded('bd', 'dn', 1 / 14, 14)}, q AS (SELECT p.*, CASE WHEN p.i > 14 THEN coalesce(100 * au.y / nullif(au.y + ad.y, 0), 100) END AS rsi, coalesce(100 * bu.y / nullif(bu.y + bd.y, 0), CASE WHEN bu.y IS NOT NULL THEN 0 END) AS rsi2 FROM p LEFT JOIN au ON au.i = p.i - 1 LEFT JOIN ad ON ad.i = p.i - 1 LEFT JOIN bu ON bu.i = p.i - 1 LEFT JOIN bd ON bd.i = p.i - 1), s1 AS (SELECT *, 100 * (rsi - {_fn('min(rsi)', 'rsi', 14)}) / nullif({_fn('max(rsi)', 'rsi', 14)} - {_fn('min(rsi)', 'rsi', 14)}, 0) AS stoch_rsi FROM q), s2 AS (SELECT *, {_fn('avg(stoch_rsi)', 'stoch_rsi', 3)} AS stoch_k FROM s1)"


@register("indicators_rsi_based", f"SELECT open_time, stoch_rsi, stoch_k, {_fn('avg(stoch_k)', 'stoch_k', 3)} AS stoch_d, (((rsi2 - 20) / 20 + volume / {_f('avg(volume)', 20)} - 1) / 2 + 1) * 20 AS fgi FROM s2", "open_time", "stoch_rsi stoch_k stoch_d fgi", _SRSI)
def indicators_rsi_based(spark, sf_dir):
    made = indicators.add(views.klines(spark, sf_dir), [("stochrsi", {"rsi_window": 14, "smooth1": 3, "smooth2": 3}), ("fgi", {"rsi_period": 14, "volume_ma_period": 20})])
    return made.select("open_time", "stoch_rsi", "stoch_k", "stoch_d", "fgi")


# state after each bar: direction, the next bar's stop, extreme point, acceleration, and the value shown
_SAR = """bars AS (SELECT open_time, row_number() OVER w AS n, high, low, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
  lead(high) OVER w AS nh, lead(low) OVER w AS nl FROM klines WINDOW w AS (ORDER BY open_time)),
z(n, up, stop, ext, af, shown) AS (
  SELECT n, up, CASE WHEN up THEN low ELSE high END, CASE WHEN up THEN nh ELSE nl END, 0.02::DOUBLE, NULL::DOUBLE
  FROM (SELECT *, NOT (low - nl > nh - high AND low - nl > 0) AS up FROM bars WHERE n = 1)
  UNION ALL
  SELECT n, up, CASE WHEN up THEN least(shown + af * (ext - shown), low, pl) ELSE greatest(shown + af * (ext - shown), high, ph) END, ext, af, shown
  FROM (SELECT *, was <> turned AS up,
      CASE WHEN NOT turned THEN stop WHEN was THEN greatest(ext0, high, ph) ELSE least(ext0, low, pl) END AS shown,
      CASE WHEN turned THEN CASE WHEN was THEN low ELSE high END WHEN was THEN greatest(ext0, high) ELSE least(ext0, low) END AS ext,
      CASE WHEN turned THEN 0.02::DOUBLE WHEN CASE WHEN was THEN high > ext0 ELSE low < ext0 END THEN least(af0 + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af0 END AS af
    FROM (SELECT bars.*, z.up AS was, z.stop, z.ext AS ext0, z.af AS af0, CASE WHEN z.up THEN bars.low <= z.stop ELSE bars.high >= z.stop END AS turned
      FROM z JOIN bars ON bars.n = z.n + 1)))"""


@register("indicator_sar", "SELECT open_time, shown AS sar FROM bars JOIN z USING (n)", "open_time", "sar", _SAR)
def indicator_sar(spark, sf_dir):
    return indicators.add(views.klines(spark, sf_dir), [("sar", {"acceleration": 0.02, "maximum": 0.2})]).select("open_time", "sar")


# labels -------------------------------------------------------------------------------

_GEN = LabelGenerator(horizons=(1, 3), span=24, roll_liq=48, scale_window=48, scale_least=10, alpha=0.5, ts="timestamp")


def _label_input(spark, sf_dir) -> DataFrame:
    return _combined(spark, sf_dir).filter("close is not null").select("timestamp", "close", *[F.col(f"`depth_{b}`") for b in _BANDS])


def _label_sql() -> str:
    sums = {s: " + ".join(f"coalesce(depth_{s}{b}, 0)" for b in range(1, 6)) for s in ("m", "")}
    weighted = {s: " + ".join(f"coalesce(depth_{s}{b}, 0) * {100.0 / b!r}" for b in range(1, 6)) for s in ("m", "")}
    before = lambda x, n, least: f"CASE WHEN count({x}) OVER (ORDER BY timestamp ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {least} THEN quantile_cont({x}, 0.5) OVER (ORDER BY timestamp ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
    t = []
    for h in (1, 3):
        for side, sign in (("up", "-"), ("down", "+")):
            e = f"CASE WHEN sigma IS NOT NULL AND liquidity IS NOT NULL THEN greatest(greatest(sigma * 0.5 * sqrt({h}), 2e-4) * (1 {sign} 0.3 * imbalance) * (1 - 0.2 * (liquidity - 1) / 2), 2e-4) END"
            t.append(f"{e} AS t1_{side}_{h}, ({e}) * 2 AS t2_{side}_{h}")
    labels = ", ".join(f"CASE WHEN ret_{h} IS NOT NULL THEN CASE WHEN ret_{h} >= t2_up_{h} THEN 2 WHEN ret_{h} >= t1_up_{h} THEN 1 WHEN ret_{h} <= -t2_down_{h} THEN -2 WHEN ret_{h} <= -t1_down_{h} THEN -1 ELSE 0 END END AS label_{h}" for h in (1, 3))
    return f"""{_COMBINED}, l0 AS (SELECT *, row_number() OVER (ORDER BY timestamp) AS i, ln(close) - ln(lag(close) OVER (ORDER BY timestamp)) AS d, ln(lead(close, 1) OVER (ORDER BY timestamp)) - ln(close) AS ret_1, ln(lead(close, 3) OVER (ORDER BY timestamp)) - ln(close) AS ret_3, {sums['m']} AS bs, {sums['']} AS asks, {weighted['m']} AS bid, {weighted['']} AS ask FROM combined WHERE close IS NOT NULL),
sq AS (SELECT i, coalesce(d * d, 0) AS x FROM l0), {recursive('ew', 'sq', 2 / 25)},
l1 AS (SELECT l0.*, sqrt(ew.y) AS sigma, coalesce(({before('bs', 48, 10)}) / nullif({before('asks', 48, 10)}, 0), 1) AS ask_scale FROM l0 JOIN ew USING (i)),
l2 AS (SELECT *, bid + ask * ask_scale AS depth_total, coalesce(least(greatest((bid - ask * ask_scale) / nullif(bid + ask * ask_scale, 0), -1), 1), 0) AS imbalance, (bid + ask * ask_scale) / 5 AS density FROM l1),
l3 AS (SELECT *, density / nullif({before('density', 48, 1)}, 0) AS q, density / nullif({before('density', 200, 1)}, 0) AS q200 FROM l2),
l4 AS (SELECT *, CASE WHEN q IS NOT NULL THEN least(greatest(q, 0.25), 4) END AS liquidity FROM l3), l5 AS (SELECT *, {', '.join(t)} FROM l4), l6 AS (SELECT *, {labels} FROM l5),
l7 AS (SELECT *, greatest(coalesce((label_1 <> 0)::INT, 0) + coalesce((label_3 <> 0)::INT, 0), 1) AS concurrency FROM l6)"""


_LABELS = _label_sql()
_T_NAMES = " ".join(f"t{k}_{s}_{h}" for h in (1, 3) for s in ("up", "down") for k in (1, 2))


@register("labels", "SELECT *, coalesce(least(greatest(1 / (concurrency * greatest(sigma, 1e-4)) * CASE WHEN q200 IS NOT NULL THEN least(greatest(q200, 0.5), 2) END, 0.01), 50), 0.01) AS weight0, CASE WHEN q200 IS NULL THEN 0.01 ELSE weight0 END AS weight FROM l7", "timestamp label_1 label_3 concurrency", f"ret_1 ret_3 sigma ask_scale depth_total imbalance density liquidity {_T_NAMES} weight", _LABELS)
def labels(spark, sf_dir):
    full = _GEN.build(_label_input(spark, sf_dir))
    return full.select("timestamp", "label_1", "label_3", "concurrency", "ret_1", "ret_3", "sigma", "ask_scale", "depth_total", "imbalance", "density", "liquidity", *_T_NAMES.split(), "weight")


def _soft_sql() -> str:
    r = "ret_1"
    logits = [f"(-{r} - t2_down_1) / 0.6", f"(-{r} - t1_down_1) / 0.6", f"-(abs({r}) / least(t1_up_1, t1_down_1)) / 0.6", f"({r} - t1_up_1) / 0.6", f"({r} - t2_up_1) / 0.6"]
    ls = ", ".join(f"coalesce({e}, -1e9) AS g{i}" for i, e in enumerate(logits))
    top = "greatest(g0, g1, g2, g3, g4)"
    total = " + ".join(f"exp(g{i} - {top})" for i in range(5))
    return f"SELECT timestamp, " + ", ".join(f"exp(g{i} - {top}) / ({total}) AS p{i}" for i in range(5)) + f" FROM (SELECT *, {ls} FROM l7 WHERE ret_1 IS NOT NULL)"


@register("label_probabilities", _soft_sql(), "timestamp", "p0 p1 p2 p3 p4", _LABELS)
def label_probabilities(spark, sf_dir):
    full = _GEN.build(_label_input(spark, sf_dir)).filter("ret_1 is not null")
    return full.select("timestamp", *[F.col("probs_1")[i].alias(f"p{i}") for i in range(5)])


_WEIGHED = """SELECT timestamp, label_1 + 2 AS horizon_1, label_3 + 2 AS horizon_3, CASE WHEN q200 IS NULL THEN 0.01 ELSE coalesce(least(greatest(1 / (concurrency * greatest(sigma, 1e-4)) * least(greatest(q200, 0.5), 2), 0.01), 50), 0.01) END AS sample_weight
 FROM l7 WHERE ret_3 IS NOT NULL"""


@register("label_table", _WEIGHED, "timestamp horizon_1 horizon_3", "sample_weight", _LABELS)
def label_table(spark, sf_dir):
    return _GEN.label_data(_label_input(spark, sf_dir))


def _grid_sql() -> str:
    t = lambda side, sign: f"greatest(greatest(sigma * a * 1, 2e-4) * (1 {sign} 0.3 * imbalance) * (1 - 0.2 * (liquidity - 1) / 2), 2e-4)"
    cls = f"CASE WHEN liquidity IS NULL THEN 0 WHEN ret_1 >= {t('up', '-')} * g THEN 2 WHEN ret_1 >= {t('up', '-')} THEN 1 WHEN ret_1 <= -{t('dn', '+')} * g THEN -2 WHEN ret_1 <= -{t('dn', '+')} THEN -1 ELSE 0 END"
    goal = {-2: 0.1, -1: 0.2, 0: 0.4, 1: 0.2, 2: 0.1}
    err = " + ".join(f"abs(count(*) FILTER (WHERE c = {k}) / count(*)::DOUBLE - {v})" for k, v in goal.items())
    return f"SELECT a AS alpha, g AS gamma, {err} AS error FROM (SELECT a, g, {cls} AS c FROM l4, (SELECT 0.4::DOUBLE + 0.2::DOUBLE * unnest(range(0, 9)) AS a), (SELECT 1.4::DOUBLE + 0.2::DOUBLE * unnest(range(0, 7)) AS g) WHERE ret_1 IS NOT NULL) GROUP BY a, g"


@register("label_calibration", _grid_sql(), "", "alpha gamma error", _LABELS)
def label_calibration(spark, sf_dir):
    gen = LabelGenerator(horizons=(1,), span=24, roll_liq=48, scale_window=48, scale_least=10, ts="timestamp")
    return gen.calibrate(_label_input(spark, sf_dir), {-2: 0.1, -1: 0.2, 0: 0.4, 1: 0.2, 2: 0.1})


_LONG = _LABELS + ", long AS (SELECT 1 AS horizon, ret_1 AS r, label_1 AS label, t1_up_1 AS up, t1_down_1 AS down FROM l7 WHERE ret_1 IS NOT NULL UNION ALL SELECT 3, ret_3, label_3, t1_up_3, t1_down_3 FROM l7 WHERE ret_3 IS NOT NULL), cs AS (SELECT horizon, label, avg(r) AS mean, stddev_samp(r) AS std, count(*) AS n, quantile_cont(r, 0.01) AS q01, quantile_cont(r, 0.99) AS q99 FROM long GROUP BY 1, 2)"


@register("label_class_stats", "SELECT *, n / sum(n) OVER (PARTITION BY horizon)::DOUBLE AS share FROM cs", "horizon label n", "mean std q01 q99 share", _LONG)
def label_class_stats(spark, sf_dir):
    return label_quality.class_stats(label_quality.long_form(_GEN.build(_label_input(spark, sf_dir)), [1, 3]))


_ANALYZE = _LONG + """, ends AS (SELECT *, max(label) OVER (PARTITION BY horizon) AS top, min(label) OVER (PARTITION BY horizon) AS bottom, quantile_cont(r, 0.01) OVER (PARTITION BY horizon) AS t01, quantile_cont(r, 0.99) OVER (PARTITION BY horizon) AS t99, quantile_cont(up, 0.5) OVER (PARTITION BY horizon) AS med FROM long),
a1 AS (SELECT horizon, avg(CASE WHEN label = top THEN (r >= up)::INT END) AS purity_up, avg(CASE WHEN label = bottom THEN (r <= -down)::INT END) AS purity_down, stddev_samp(CASE WHEN label = 0 THEN r END) / stddev_samp(r) AS noise_ratio, 1.4826 * quantile_cont(abs(up - med), 0.5) / abs(min(med)) AS threshold_cv,
 count(*) FILTER (WHERE label = top AND r >= t99) / nullif(count(*) FILTER (WHERE label = top), 0)::DOUBLE AS precision_up, count(*) FILTER (WHERE label = top AND r >= t99) / count(*) FILTER (WHERE r >= t99)::DOUBLE AS recall_up, count(*) AS n FROM ends GROUP BY 1),
a2 AS (SELECT horizon, (arg_max(mean, label) - arg_min(mean, label)) / sqrt(sum((n - 1) * std * std) / sum(CASE WHEN std IS NOT NULL THEN n - 1 END)) AS separation, count(*) AS classes FROM cs GROUP BY 1),
a3 AS (SELECT horizon, bool_and(mean > prev) AS monotonic, avg((mean - prev) / sqrt((std * std + pstd * pstd) / 2)) AS mean_cohens_d FROM (SELECT *, lag(mean) OVER (PARTITION BY horizon ORDER BY label) AS prev, lag(std) OVER (PARTITION BY horizon ORDER BY label) AS pstd FROM cs) WHERE prev IS NOT NULL GROUP BY 1),
a4 AS (SELECT horizon, avg(p) AS overlap FROM (SELECT l.horizon, l.label, c.label AS other, avg((l.r BETWEEN c.q01 AND c.q99)::INT) AS p FROM long l JOIN cs c ON l.horizon = c.horizon AND l.label <> c.label GROUP BY 1, 2, 3) GROUP BY 1)"""


_SCORED = """SELECT *, CASE WHEN separation > 2 THEN 20 ELSE 0 END + CASE WHEN purity_up > 0.8 THEN 15 ELSE 0 END + CASE WHEN purity_down > 0.8 THEN 15 ELSE 0 END + CASE WHEN overlap < 0.3 THEN 20 ELSE 0 END
 + CASE WHEN monotonic THEN 15 ELSE 0 END + CASE WHEN threshold_cv < 0.5 THEN 15 ELSE 0 END AS quality_score FROM a1 JOIN a2 USING (horizon) LEFT JOIN a3 USING (horizon) LEFT JOIN a4 USING (horizon)"""


@register("label_quality", _SCORED, "horizon n classes monotonic quality_score", "purity_up purity_down noise_ratio threshold_cv precision_up recall_up separation mean_cohens_d overlap", _ANALYZE)
def label_quality_query(spark, sf_dir):
    out = label_quality.analyze(_GEN.build(_label_input(spark, sf_dir)), [1, 3])
    return out.select("horizon", "n", "classes", "monotonic", "quality_score", "purity_up", "purity_down", "noise_ratio", "threshold_cv", "precision_up", "recall_up", "separation", "mean_cohens_d", "overlap")


# data and feature quality -------------------------------------------------------------

_NUM = ("value", "k")
_DESC = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50, quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c})::DOUBLE AS max, skewness({c}) AS skew, kurtosis({c}) AS kurt, count(DISTINCT {c}) AS distinct_n, count(*) - count({c}) AS missing FROM b" for c in _NUM)


@register("describe", _DESC, "feature n distinct_n missing", "mean std min q25 q50 q75 max skew kurt")
def describe(spark, sf_dir):
    d = feature_quality.describe(views.base(spark, sf_dir), list(_NUM))
    return d.select("feature", "n", F.col("distinct").alias("distinct_n"), "missing", "mean", "std", "min", "q25", "q50", "q75", "max", "skew", "kurt")


@register("missing_table", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, 100.0 * (count(*) - count({c})) / count(*) AS pct FROM wide" for c in ["depth_m5", "depth_1", "depth_5"]), "feature missing", "pct", f"wide AS ({_pivot_sql(('depth',))})")
def missing_table(spark, sf_dir):
    wide = _plain(reshape.pivot_book(views.book_depth(spark, sf_dir)))
    return feature_quality.missing_table(wide.select("depth_m5", "depth_1", "depth_5"))


@register("value_counts", "SELECT event_type AS value, count(*) AS count, 100.0 * count(*) / (SELECT count(*) FROM events) AS pct FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", "value count", "pct")
def value_counts(spark, sf_dir):
    return feature_quality.value_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", 3)


_CORR = ("open", "close", "volume")
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]
_RANKS = "rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _CORR) + " FROM klines)"


@register("correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM klines" for a, b in _PAIRS), "a b", "r")
def correlations(spark, sf_dir):
    return feature_quality.correlations(views.klines(spark, sf_dir), list(_CORR))


@register("rank_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM rk" for a, b in _PAIRS), "a b", "r", _RANKS)
def rank_correlations(spark, sf_dir):
    return feature_quality.correlations(views.klines(spark, sf_dir), list(_CORR), "spearman")


@register("kendall", "SELECT sum(sign(x.close - y.close) * sign(x.cnt - y.cnt)) / sqrt(sum((x.close <> y.close)::INT)::DOUBLE * sum((x.cnt <> y.cnt)::INT)) AS tau FROM klines x JOIN klines y ON x.open_time < y.open_time", "", "tau")
def kendall(spark, sf_dir):
    return statistics.kendall(views.klines(spark, sf_dir), "close", "cnt")


_CLS = _LABELS + ", cl AS (SELECT label_1 + 2 AS y, x, feature FROM (SELECT label_1, unnest(['imbalance', 'sigma']) AS feature, unnest([imbalance, sigma]) AS x FROM l7 WHERE label_1 IS NOT NULL)), st AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM cl GROUP BY 1, 2), gr AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g, sum(1.0::DOUBLE / n) OVER (PARTITION BY feature) AS inv FROM st), c1 AS (SELECT feature, sum(pow(m - g, 2) / inv) / sum(n * (v + pow(m - g, 2))) AS balanced_ratio FROM gr GROUP BY 1), c2 AS (SELECT feature, abs(avg(x) FILTER (WHERE y <> 2) - avg(x) FILTER (WHERE y = 2)) / sqrt((var_pop(x) FILTER (WHERE y <> 2) + var_pop(x) FILTER (WHERE y = 2)) / 2) AS class_separation FROM cl GROUP BY 1), c3 AS (SELECT a.feature, avg(abs(a.m - b.m) / nullif(sqrt((a.v + b.v) / 2), 0)) AS pairwise_separation FROM st a JOIN st b ON a.feature = b.feature AND a.y < b.y GROUP BY 1), c4 AS (SELECT feature, (sum(CASE WHEN y IN (0, 4) THEN rk END) - count(*) FILTER (WHERE y IN (0, 4)) * (count(*) FILTER (WHERE y IN (0, 4)) + 1) / 2.0) / (count(*) FILTER (WHERE y IN (0, 4))::DOUBLE * count(*) FILTER (WHERE y NOT IN (0, 4))) AS extreme_auc FROM (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM cl) GROUP BY 1)"


_TIERS = """SELECT *, CASE WHEN pairwise_separation > 0.45 THEN 'strong' WHEN pairwise_separation >= 0.25 THEN 'good' WHEN pairwise_separation >= 0.1 THEN 'weak' ELSE 'noise' END AS tier,
 extreme_auc > 0.7 AND class_separation > 0.3 AS extreme_specialist FROM c1 JOIN c2 USING (feature) JOIN c3 USING (feature) JOIN c4 USING (feature)"""


@register("class_scores", _TIERS, "feature tier extreme_specialist", "balanced_ratio class_separation pairwise_separation extreme_auc", _CLS)
def class_scores(spark, sf_dir):
    full = _GEN.build(_label_input(spark, sf_dir)).withColumn("y", F.col("label_1") + 2)
    return feature_quality.tiers(feature_quality.class_scores(full, ["imbalance", "sigma"], "y"))


@register("outliers", "SELECT 'r' AS feature, b.lo AS low, b.hi AS high, count(*) FILTER (WHERE r < b.lo) AS n_low, count(*) FILTER (WHERE r > b.hi) AS n_high, 100.0 * count(*) FILTER (WHERE r < b.lo OR r > b.hi) / count(*) AS pct, min(r) AS min, max(r) AS max FROM rets, (SELECT quantile_cont(r, 0.25) - 1.5 * (quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) AS lo, quantile_cont(r, 0.75) + 1.5 * (quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) AS hi FROM rets) b GROUP BY b.lo, b.hi", "feature n_low n_high", "low high pct min max", _RET)
def outliers(spark, sf_dir):
    return feature_quality.outliers(_returns(spark, sf_dir), ["r"])


@register("histogram", "SELECT CAST(least(floor((r - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) AS n FROM rets, (SELECT min(r) AS lo, max(r) AS hi FROM rets) GROUP BY 1", "bin n", "", _RET)
def histogram(spark, sf_dir):
    return feature_quality.histogram(_returns(spark, sf_dir), "r", 20).select("bin", "n")


@register("class_distribution", "SELECT c AS class, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT count(*) FROM labels)::DOUBLE AS share FROM (SELECT unnest([0, 1, 2]) AS c) LEFT JOIN (SELECT quality, count(*) AS n FROM labels GROUP BY 1) ON c = quality", "class n", "share")
def class_distribution(spark, sf_dir):
    return feature_quality.class_distribution(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", (0, 1, 2))


# statistics ---------------------------------------------------------------------------


def _simpson(body: str, end: str, steps: int = 4000) -> str:
    """The integral of ``body`` over t from 0 to ``end``."""
    t = f"(({end}) * i / {steps})"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT sum({weight} * ({body.replace('@', t)})) * ({end}) / {3 * steps} FROM range(0, {steps + 1}) AS s(i))"


def _chi2_tail(x: str, df: str) -> str:
    density = _simpson(f"pow(@, {df} - 1.0) * exp(-@ * @)", f"sqrt({x} / 2)")
    return f"1 - 2 / exp(lgamma({df} / 2.0)) * {density}"


def _f_tail(f: str, df1: str, df2: str) -> str:
    """The incomplete beta integral, with the squared sine as variable."""
    area = _simpson(f"pow(sin(@), {df2} - 1.0) * pow(cos(@), {df1} - 1.0)", f"asin(sqrt({df2} / ({df2} + {df1} * {f})))")
    return f"2 * exp(lgamma(({df1} + {df2}) / 2.0) - lgamma({df1} / 2.0) - lgamma({df2} / 2.0)) * {area}"


_D = _RET + ", dv AS (SELECT open_time, r, r - (SELECT avg(r) FROM rets) AS d FROM rets)"
_ACF = " UNION ALL ".join(f"SELECT {k} AS lag, sum(d * e) / (SELECT sum(d * d) FROM dv) AS acf FROM (SELECT d, lag(d, {k}) OVER (ORDER BY open_time) AS e FROM dv)" for k in range(0, 6))


@register("acf", _ACF, "lag", "acf", _D)
def acf(spark, sf_dir):
    return statistics.acf(_returns(spark, sf_dir), "r", "open_time", 5)


@register(
    "ljung_box",
    f"SELECT *, {_chi2_tail('q', '5')} AS p FROM (SELECT 5 AS lag, n * (n + 2) * (SELECT sum(acf ** 2 / (n - lag)) FROM ac WHERE lag > 0) AS q FROM (SELECT count(*) AS n FROM rets))",
    "lag", "q p", f"{_D}, ac AS ({_ACF})")
def ljung_box(spark, sf_dir):
    return statistics.ljung_box(_returns(spark, sf_dir), "r", "open_time", (5,))


@register("autocorrelation", " UNION ALL ".join(f"SELECT {k} AS lag, corr(r, e) AS r FROM (SELECT r, lag(r, {k}) OVER (ORDER BY open_time) AS e FROM rets)" for k in (1, 5, 10)), "lag", "r", _RET)
def autocorrelation(spark, sf_dir):
    return statistics.autocorrelation(_returns(spark, sf_dir), "r", "open_time", (1, 5, 10))


@register(
    "t_test",
    f"SELECT *, {_f_tail('t * t', '1', 'dof')} AS p FROM (SELECT (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS t, n1 + n0 - 2 AS dof FROM (SELECT avg(r) FILTER (WHERE w) AS m1, avg(r) FILTER (WHERE NOT w) AS m0, var_samp(r) FILTER (WHERE w) AS v1, var_samp(r) FILTER (WHERE NOT w) AS v0, count(*) FILTER (WHERE w) AS n1, count(*) FILTER (WHERE NOT w) AS n0 FROM (SELECT r, isodow(make_timestamp(open_time * 1000)) > 5 AS w FROM rets)))",
    "dof", "t p", _RET)
def t_test(spark, sf_dir):
    return statistics.t_test(_returns(spark, sf_dir), "r", F.weekday(F.timestamp_millis("open_time")).isin(5, 6))


_RANKS = """, rk AS (SELECT w, c, rank() OVER (ORDER BY r) + (c - 1) / 2.0 AS rank FROM (
  SELECT r, isodow(make_timestamp(open_time * 1000)) > 5 AS w, count(*) OVER (PARTITION BY r) AS c FROM rets)),
mw AS (SELECT count(*) FILTER (WHERE w) AS n1, count(*) FILTER (WHERE NOT w) AS n0, count(*) AS n, sum(c * c - 1) AS ties, sum(CASE WHEN w THEN rank END) AS s FROM rk),
mu AS (SELECT *, s - n1 * (n1 + 1) / 2.0 AS u FROM mw),
mz AS (SELECT u, greatest(0, abs(u - n1 * n0 / 2.0) - 0.5) / sqrt(n1 * n0 / 12.0 * (n + 1 - ties / (n * (n - 1.0)))) AS z FROM mu)"""


@register("mann_whitney", f"SELECT *, {_chi2_tail('(z * z)', '1')} AS p FROM mz", "", "u z p", _RET + _RANKS)
def mann_whitney(spark, sf_dir):
    return statistics.mann_whitney(_returns(spark, sf_dir), "r", F.weekday(F.timestamp_millis("open_time")).isin(5, 6))


_SSR = lambda t: f"(SELECT regr_syy(close, open) - regr_sxy(close, open) ** 2 / regr_sxx(close, open) FROM ch WHERE {t})"


@register(
    "chow",
    f"SELECT *, {_f_tail('f', '2', '(n - 4)')} AS p FROM (SELECT (({_SSR('true')} - {_SSR('i < n // 2')} - {_SSR('i >= n // 2')}) / 2) / (({_SSR('i < n // 2')} + {_SSR('i >= n // 2')}) / (n - 4)) AS f, n FROM (SELECT max(n) AS n FROM ch))",
    "", "f p", "ch AS (SELECT open, close, row_number() OVER (ORDER BY open_time) - 1 AS i, count(*) OVER () AS n FROM klines)")
def chow(spark, sf_dir):
    return statistics.chow(views.klines(spark, sf_dir), "open", "close", "open_time")


@register("direction_persistence", "SELECT count(*) FILTER (WHERE r > 0 AND e > 0) AS up_up, count(*) FILTER (WHERE r <= 0 AND e <= 0) AS down_down, count(*) FILTER (WHERE r > 0 AND e <= 0) AS down_up, count(*) FILTER (WHERE r <= 0 AND e > 0) AS up_down FROM (SELECT r, lag(r) OVER (ORDER BY open_time) AS e FROM rets)", "up_up down_down down_up up_down", "", _RET)
def direction_persistence(spark, sf_dir):
    return statistics.persistence(_returns(spark, sf_dir), "r", "open_time")


@register("volatility_regimes", "SELECT open_time, vol, CASE WHEN vol <= q[1] THEN 'low' WHEN vol <= q[2] THEN 'mid' ELSE 'high' END AS level, coalesce(abs(step) > 2 * sd, false) AS is_shift FROM (SELECT *, vol - lag(vol) OVER (ORDER BY open_time) AS step FROM vo), (SELECT quantile_cont(vol, [1/3, 2/3]) AS q FROM vo), (SELECT stddev_samp(s) AS sd FROM (SELECT vol - lag(vol) OVER (ORDER BY open_time) AS s FROM vo))", "open_time level is_shift", "vol", _RET + ", vo AS (SELECT open_time, stddev_samp(r) OVER f AS vol FROM rets WINDOW f AS (ORDER BY open_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) QUALIFY count(r) OVER f = 24)")
def volatility_regimes(spark, sf_dir):
    return statistics.volatility_regimes(_returns(spark, sf_dir), "r", "open_time", 24)


@register("empirical_cdf", "SELECT r, (row_number() OVER (ORDER BY r) - 1) / count(*) OVER ()::DOUBLE AS cdf FROM rets", "", "r cdf", _RET)
def empirical_cdf(spark, sf_dir):
    return statistics.empirical_cdf(_returns(spark, sf_dir), "r")


def _pair_returns(spark, sf_dir) -> DataFrame:
    w = S.order([], "open_time")
    p = _pair(spark, sf_dir)
    return p.select("open_time", S.log_return(F.col("close"), w).alias("x"), S.log_return(F.col("close_b"), w).alias("y")).dropna()


_PAIR_RETURNS = """pc AS (SELECT a.open_time, a.close AS a, b.close AS b FROM typed a JOIN typed b ON a.open_time = b.open_time AND a.event_type = 'view' AND b.event_type = 'purchase'),
pr AS (SELECT * FROM (SELECT open_time, ln(a) - ln(lag(a) OVER w) AS x, ln(b) - ln(lag(b) OVER w) AS y FROM pc WINDOW w AS (ORDER BY open_time)) WHERE x IS NOT NULL AND y IS NOT NULL)"""


def _residuals(name: str, cause: str, effect: str, lag: int) -> tuple[str, str]:
    """CTEs that take the lags out of ``effect`` one after another (Gram-Schmidt), and both sums of squares."""
    past = [f"{c}{k}" for c in (effect, cause) for k in range(1, lag + 1)]
    lags = ", ".join(f"lag({c[0]}, {c[1:]}) OVER (ORDER BY open_time) AS {c}" for c in past)
    centred = ", ".join(f"{c} - avg({c}) OVER () AS {c}" for c in ("e", *past))
    steps = [f"{name}_0 AS (SELECT {centred} FROM (SELECT {effect} AS e, {lags} FROM pr) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in past)})"]
    for i, c in enumerate(past):
        left = ", ".join(f"{o} - {c} * (sum({o} * {c}) OVER () / sum({c} * {c}) OVER ()) AS {o}" for o in ("e", *past[i + 1 :]))
        steps.append(f"{name}_{i + 1} AS (SELECT {left} FROM {name}_{i})")
    sums = f"SELECT '{cause}' AS cause, '{effect}' AS effect, {lag}::INT AS lag, (SELECT sum(e * e) FROM {name}_{lag}) AS small, (SELECT sum(e * e) FROM {name}_{2 * lag}) AS large, (SELECT count(*) FROM {name}_0) AS n"
    return ", ".join(steps), sums


_GRANGER = [_residuals(f"g{c}{k}", c, e, k) for k in (1, 2, 3) for c, e in (("x", "y"), ("y", "x"))]
_GRANGER_TESTS = f"""gr AS (SELECT * FROM ({" UNION ALL ".join(sums for _, sums in _GRANGER)})),
gt AS (SELECT cause, effect, lag, n, n - 2 * lag - 1 AS free, (small - large) / lag / (large / (n - 2 * lag - 1)) AS f, n * (small - large) / large AS chi2, n * ln(small / large) AS lr FROM gr)"""


@register(
    "granger", f"SELECT *, {_f_tail('f', 'lag', 'free')} AS p, {_chi2_tail('chi2', 'lag')} AS p_chi2, {_chi2_tail('lr', 'lag')} AS p_lr FROM gt",
    "cause effect lag n", "f p chi2 p_chi2 lr p_lr", ", ".join([_PAIR_RETURNS, *(steps for steps, _ in _GRANGER), _GRANGER_TESTS]))
def granger(spark, sf_dir):
    return statistics.granger(_pair_returns(spark, sf_dir), "x", "y", "open_time", 3)


def _var_residuals(most: int) -> tuple[str, str]:
    """Both returns with the lags of both taken out one after another, and the residuals' covariance for each order."""
    past = [f"{c}{k}" for k in range(1, most + 1) for c in ("x", "y")]
    lags = ", ".join(f"lag({c[0]}, {c[1:]}) OVER (ORDER BY open_time) AS {c}" for c in past)
    centred = ", ".join(f"{c} - avg({c}) OVER () AS {c}" for c in ("x", "y", *past))
    steps = [f"v_0 AS (SELECT {centred} FROM (SELECT x, y, {lags} FROM pr) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in past)})"]
    for i, c in enumerate(past):
        left = ", ".join(f"{o} - {c} * (sum({o} * {c}) OVER () / sum({c} * {c}) OVER ()) AS {o}" for o in ("x", "y", *past[i + 1 :]))
        steps.append(f"v_{i + 1} AS (SELECT {left} FROM v_{i})")
    orders = " UNION ALL ".join(f"SELECT {k}::INT AS lag, count(*) AS n, ln((sum(x * x) * sum(y * y) - sum(x * y) ** 2) / count(*) ** 2) AS logdet, {2 * (2 * k + 1)} AS k FROM v_{2 * k}" for k in range(1, most + 1))
    return ", ".join(steps), orders


_VAR_STEPS, _VAR_ORDERS = _var_residuals(4)


@register(
    "var_order", f"SELECT lag, logdet + 2.0 * k / n AS aic, logdet + ln(n) * k / n AS bic, logdet + 2 * ln(ln(n)) * k / n AS hqic FROM ({_VAR_ORDERS})",
    "lag", "aic bic hqic", f"{_PAIR_RETURNS}, {_VAR_STEPS}")
def var_order(spark, sf_dir):
    return statistics.var_order(_pair_returns(spark, sf_dir), ["x", "y"], "open_time", 4)


@register("wavelet_coherence")
def wavelet_coherence(spark, sf_dir):
    return statistics.wavelet_coherence(_pair(spark, sf_dir), "close", "close_b", "open_time")


# coefficients of order k follow from those of order k - 1; the last one is the partial autocorrelation
_PACF = _D + f""", r AS (SELECT list(acf ORDER BY lag) AS r FROM ({_ACF}) WHERE lag > 0),
z(k, phi) AS (
  SELECT 1, [r[1]] FROM r
  UNION ALL
  SELECT k + 1, list_append([phi[j] - last * phi[k + 1 - j] for j in range(1, k + 1)], last)
  FROM (SELECT k, phi, (r[k + 1] - list_sum([phi[j] * r[k + 1 - j] for j in range(1, k + 1)])) / (1 - list_sum([phi[j] * r[j] for j in range(1, k + 1)])) AS last
    FROM z, r WHERE k < 5))"""


@register("pacf", "SELECT 0::INT AS lag, 1.0::DOUBLE AS pacf UNION ALL SELECT k::INT, phi[k] FROM z", "lag", "pacf", _PACF)
def pacf(spark, sf_dir):
    return statistics.pacf(_returns(spark, sf_dir), "r", "open_time", 5)


# derived columns and outliers ---------------------------------------------------------

_DERIVED = """SELECT *, ln(close) - ln(lag(close) OVER (ORDER BY open_time)) AS returns, (close - open) / nullif(open, 0) * 100 AS price_change_pct,
 (high - low) / nullif(low, 0) * 100 AS high_low_spread, hour(make_timestamp(open_time * 1000))::INT AS hour, (isodow(make_timestamp(open_time * 1000)) - 1)::INT AS day_of_week,
 isodow(make_timestamp(open_time * 1000)) > 5 AS is_weekend FROM klines QUALIFY returns IS NOT NULL AND price_change_pct IS NOT NULL AND high_low_spread IS NOT NULL"""


@register("derived_columns", _DERIVED, "open_time hour day_of_week is_weekend", "returns price_change_pct high_low_spread")
def derived_columns(spark, sf_dir):
    made = statistics.derived_columns(views.klines(spark, sf_dir), "open_time")
    return made.select("open_time", "hour", "day_of_week", "is_weekend", "returns", "price_change_pct", "high_low_spread")


_FLAGGED = _RET + """, lim AS (SELECT avg(r) AS m, stddev_samp(r) AS s, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3, quantile_cont(abs(r), 0.99) AS t FROM rets),
fl AS (SELECT open_time, r, abs(r - m) > 3 * s AS by_z, r < q1 - 1.5 * (q3 - q1) OR r > q3 + 1.5 * (q3 - q1) AS by_iqr, abs(r) > t AS extreme FROM rets, lim)"""
_BREAKDOWN = " UNION ALL ".join(
    f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {k}) AS n, 100.0 * count(*) FILTER (WHERE {k}) / count(*) AS pct, count(*) FILTER (WHERE {k} AND r > 0) AS up, count(*) FILTER (WHERE {k} AND r < 0) AS down FROM fl"
    for k in ("by_z", "by_iqr", "extreme"))


@register("outlier_breakdown", _BREAKDOWN, "rule n up down", "pct", _FLAGGED)
def outlier_breakdown(spark, sf_dir):
    return statistics.outlier_breakdown(_returns(spark, sf_dir), "r")


@register("extreme_moves_by_hour", "SELECT hour(make_timestamp(open_time * 1000)) AS hour, count(*) AS n FROM fl WHERE extreme GROUP BY 1", "hour n", "", _FLAGGED)
def extreme_moves_by_hour(spark, sf_dir):
    marked = statistics.flag_outliers(_returns(spark, sf_dir), "r").filter("extreme")
    return marked.groupBy(F.hour(F.timestamp_millis("open_time")).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


_SQUARED = _RET + ", sr AS (SELECT open_time, r * r AS x FROM rets), dv AS (SELECT open_time, x - (SELECT avg(x) FROM sr) AS d FROM sr)"
_ACF30 = " UNION ALL ".join(f"SELECT {k} AS lag, sum(d * e) / (SELECT sum(d * d) FROM dv) AS acf FROM (SELECT d, lag(d, {k}) OVER (ORDER BY open_time) AS e FROM dv)" for k in range(1, 31))


_BASE_TYPES = {"value": "double", "k": "int"}
_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{t}' AS dtype, count({c}) AS count, count(*) - count({c}) AS missing, coalesce(100.0 * (count(*) - count({c})) / nullif(count({c}), 0), 0) AS missing_pct, avg({c}) AS mean, stddev_samp({c}) AS std, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50, quantile_cont({c}::DOUBLE, 0.75) AS q75 FROM some_missing"
    for c, t in _BASE_TYPES.items())


@register("feature_stats", _STATS, "feature dtype count missing", "missing_pct mean std q25 q50 q75", "some_missing AS (SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS value, k FROM b)")
def feature_stats(spark, sf_dir):
    some = views.base(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return feature_quality.feature_stats(some, list(_BASE_TYPES)).drop("min", "max")


@register(
    "class_quartiles", "SELECT 'value' AS feature, event_type AS class, count(value) AS n, min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS max FROM events GROUP BY event_type",
    "feature class n", "min q25 q50 q75 max")
def class_quartiles(spark, sf_dir):
    return feature_quality.class_quartiles(spark.read.parquet(f"{sf_dir}/events.parquet"), ["value"], "event_type")


# training inputs ----------------------------------------------------------------------

_SQL_NAME = lambda n: n.replace("_-", "_m")
_CANDLES = _RAW_NAMES.split()


def _training_sql() -> str:
    """Default pipeline over the combined rows with candle and metrics, clipped to the 1st and 99th percentile."""
    z = lambda n: f"CASE WHEN count({n}) OVER f >= 10 THEN ({n} - avg({n}) OVER f) / (nullif(stddev_samp({n}) OVER f, 0) + 1e-12) END AS {n}_z"
    metrics = [e.replace("FROM metrics", "FROM market") for e in _metrics_parts()]
    return f"""{_COMBINED}, market AS (SELECT * FROM combined WHERE close IS NOT NULL AND oi IS NOT NULL AND r1 IS NOT NULL AND r2 IS NOT NULL),
p AS (SELECT *, lag(close) OVER w AS c1, lag(volume) OVER w AS v1 FROM market WINDOW w AS (ORDER BY timestamp)), raw AS ({_RAW}),
cz AS (SELECT timestamp, {', '.join(z(n) for n in _CANDLES)} FROM raw WINDOW f AS (ORDER BY timestamp ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)),
mz AS (SELECT timestamp, {', '.join(f'{e} AS {n}' for n, e in zip(MetricsNormalizer.OUTPUT, metrics))} FROM market WINDOW w AS (ORDER BY timestamp), f AS (ORDER BY timestamp ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
ob AS ({_ob_sql().replace('FROM combined', 'FROM market')})"""


_BOUNDED = [(n + "_z", "cz") for n in _CANDLES] + [(n, "mz") for n in MetricsNormalizer.OUTPUT]
_LIMITED = ", ".join(f"coalesce(CASE WHEN {n} IS NOT NULL THEN least(greatest({n}, (SELECT quantile_cont({n}, 0.01) FROM {t})), (SELECT quantile_cont({n}, 0.99) FROM {t})) END, 0) AS {n}" for n, t in _BOUNDED)
_OB_SQL_NAMES = [_SQL_NAME(n) for n in _OB_NAMES]


def _training_input(spark, sf_dir) -> DataFrame:
    c = _combined(spark, sf_dir).dropna(subset=["close", "oi", "r1", "r2"])
    named = _market_metrics_columns()
    return c.select("timestamp", "open", "high", "low", "close", "volume", "distance", *[F.col(f"{k}_{b}") for k in ("depth", "notional") for b in _BANDS], *named)


@register(
    "training_features", f"SELECT timestamp, {', '.join(_OB_SQL_NAMES)}, {_LIMITED}, greatest(least(1 - distance / 4, 1), 0) AS distance FROM cz JOIN mz USING (timestamp) JOIN ob USING (timestamp) JOIN (SELECT timestamp, distance FROM market) USING (timestamp)",
    "timestamp", " ".join([*_OB_SQL_NAMES, *(n for n, _ in _BOUNDED), "distance"]), _training_sql())
def training_features(spark, sf_dir):
    """The default pipeline, fitted, saved, loaded and applied."""
    rows = _training_input(spark, sf_dir)
    fitted = training.default_pipeline().fit(rows).to_json()
    return _plain(training.TrainingData.build(fitted).process(rows)[0])


_FUTURE = [("month", "month", 12), ("day", "isodow", 7), ("hour", "hour", 24), ("minute", "minute", 60)]
_FUTURE_SQL = ", ".join(f"{f}(2 * pi() * {'(isodow(d) - 1)' if e == 'isodow' else f'{e}(d)'} / {p}) AS {f}_{n}" for n, e, p in _FUTURE for f in ("sin", "cos"))


@register("training_calendar", f"SELECT timestamp, {_FUTURE_SQL} FROM (SELECT timestamp, make_timestamp(timestamp * 1000) AS d FROM combined WHERE close IS NOT NULL)", "timestamp", " ".join(f"{f}_{n}" for n, _, _ in _FUTURE for f in ("sin", "cos")), _COMBINED)
def training_calendar(spark, sf_dir):
    return training.future_features(_combined(spark, sf_dir).filter("close is not null"), "timestamp")


from marketloom.plans import catalog_models  # noqa: E402, F401  registers its queries
