"""Feature normalizers: candles, derivatives metrics, order book.

``fit`` learns what a normalizer needs in one aggregation and returns it as plain data;
``transform`` is a projection over windows.  Rows of ``context`` (the end of earlier
data) warm the windows up and are not returned; nothing later than a row is ever used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import series as S
from marketloom.functions.quantiles import exact_quantiles
from marketloom.operators.reshape import BANDS


def clean_lags(lags: tuple) -> tuple[int, ...]:
    """Whole lags of 1 or more, sorted, each once."""
    return tuple(sorted({int(k) for k in lags if int(k) >= 1}))


def quantile_bounds(df: DataFrame, columns: list[str], low: float, high: float) -> dict[str, tuple[float, float]]:
    """Exact (low, high) quantiles of each column that has known values."""
    if not columns:
        return {}
    found = exact_quantiles(df, {c: F.col(c) for c in columns}, (low, high))
    return {c: tuple(q) for c, q in found.items() if q[0] is not None}


def _with_context(df: DataFrame, context: DataFrame | None) -> DataFrame:
    own = df.withColumn("__own", F.lit(True))
    return own if context is None else own.unionByName(context.withColumn("__own", F.lit(False)), allowMissingColumns=True)


def _bounded(names, bounds: dict) -> list[tuple[str, Column]]:
    """Each column within its learned bounds, 0 where unknown."""
    value = lambda n: S.clip(F.col(n), *bounds[n]) if n in bounds else F.col(n)
    return [(n, F.coalesce(value(n), F.lit(0.0))) for n in names]


@dataclass
class OHLCVNormalizer:
    """Relative, lagged and rolling-z features of candles."""

    lags: tuple[int, ...] = (2, 3, 5, 10, 15)
    window: int = 240
    least: int = 10
    eps: float = 1e-12
    clip: tuple[float, float] | None = (0.01, 0.99)
    add_raw: bool = False
    ts: str = "open_time"
    series: list[str] = field(default_factory=list)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    LEARNED = ("bounds",)
    SNAPSHOT = ("open_rel_prev", "high_rel_prev", "low_rel_prev", "close_rel_prev", "body_rel_open", "wick_top_rel_open", "wick_bot_rel_open", "hl_range_rel", "true_range_rel")

    def raw_features(self, partition: list[str] | None = None) -> dict[str, Column]:
        w, eps = S.order(partition if partition is not None else self.series, self.ts), self.eps
        o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
        prev = F.lag(c, 1).over(w)
        base, d = F.abs(prev) + eps, F.abs(o) + eps
        out = {f"{n}_rel_prev": S.ratio(x, base) - 1 for n, x in (("open", o), ("high", h), ("low", l), ("close", c))}
        out |= {"body_rel_open": S.ratio(c - o, d), "wick_top_rel_open": S.ratio(h - F.greatest(o, c), d), "wick_bot_rel_open": S.ratio(F.least(o, c) - l, d), "hl_range_rel": S.ratio(h - l, d)}
        out["true_range_rel"] = F.when(prev.isNotNull(), S.ratio(F.greatest(h - l, F.abs(h - prev), F.abs(l - prev)), base))
        out["ret_1"] = F.ln(S.ratio(c + eps, prev + eps))
        out["gap_open"] = S.ratio(o, prev + eps) - 1
        padded = S.ffill(v, w)
        out["volume_log"] = F.log1p(F.greatest(v, F.lit(0.0)))
        out["volume_pct"] = S.ratio(padded, S.padded_lag(v, w)) - 1
        out["dollar_volume_log"] = F.log1p(F.greatest(v * c, F.lit(0.0)))
        out["price_impact_vol"] = out["hl_range_rel"] * out["volume_log"]
        return out

    def lagged_features(self, partition: list[str] | None = None) -> dict[str, Column]:
        """Features that reach further back; raw features must be columns already."""
        w, eps, out = S.order(partition if partition is not None else self.series, self.ts), self.eps, {}
        c, o = F.col("close"), F.col("open")
        for k in clean_lags(self.lags):
            past = F.lag("close", k).over(w)
            base = F.abs(past) + eps
            out |= {f"{n}_lag{k}": F.lag(n, k).over(w) for n in self.SNAPSHOT}
            out |= {f"ret_{k}": F.ln(S.ratio(c + eps, past + eps)), f"gap_open_{k}": S.ratio(o, past + eps) - 1}
            out |= {f"d{n}_{k}": S.ratio(F.col(n) - F.lag(n, k).over(w), base) for n in ("close", "open", "high", "low")}
        return out

    RAW = (*SNAPSHOT, "ret_1", "gap_open", "volume_log", "volume_pct", "dollar_volume_log", "price_impact_vol")

    def feature_names(self) -> list[str]:
        lagged = [n for k in clean_lags(self.lags) for n in (*(f"{s}_lag{k}" for s in self.SNAPSHOT), f"ret_{k}", f"gap_open_{k}", *(f"d{n}_{k}" for n in ("close", "open", "high", "low")))]
        return [*self.RAW, *lagged]

    def output_names(self) -> list[str]:
        names = self.feature_names()
        return (names if self.add_raw else []) + [f"{n}_z" for n in names]

    def features(self, df: DataFrame, partition: list[str] | None = None) -> DataFrame:
        """``df`` with all features and their z-scores against the rows before."""
        full = df.withColumns(self.raw_features(partition))
        full = full.withColumns(self.lagged_features(partition))
        w = S.order(partition if partition is not None else self.series, self.ts)
        return full.withColumns({f"{n}_z": S.zscore(F.col(n), w, self.window, self.least, self.eps, skip_current=True, null_flat=True) for n in self.feature_names()})

    def fit(self, df: DataFrame) -> OHLCVNormalizer:
        if self.clip:
            self.bounds = quantile_bounds(self.features(df), [f"{n}_z" for n in self.feature_names()], *self.clip)
        return self

    def outputs(self) -> list[tuple[str, Column]]:
        """(name, column) of each output over the columns of ``features``."""
        return _bounded(self.output_names(), self.bounds)

    def transform(self, df: DataFrame, context: DataFrame | None = None, step: int | None = None) -> DataFrame:
        """Series keys, time and output features, clipped, 0 where unknown.

        With ``step`` (a regular grid) long series are worked on in time blocks.
        """
        every = _with_context(df, context)
        reach = self.window + max((*clean_lags(self.lags), 1)) + 1
        full = S.in_time_blocks(every, self.ts, step, reach, self.features, self.series) if step else self.features(every)
        return full.filter("__own").select(*self.series, self.ts, *[x.alias(n) for n, x in self.outputs()])


@dataclass
class MetricsNormalizer:
    """Thirteen features of open interest, taker volume and account ratios."""

    window: int = 200
    least: int = 10
    eps: float = 1e-9
    clip: tuple[float, float] | None = (0.01, 0.99)
    ts: str = "create_time"
    series: list[str] = field(default_factory=list)
    scale: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    LEARNED = ("scale", "bounds")
    RATIOS = ("count_toptrader_long_short_ratio", "sum_toptrader_long_short_ratio", "count_long_short_ratio", "sum_taker_long_short_vol_ratio")
    REQUIRED = ("count", "taker_buy_volume", "sum_open_interest", "sum_open_interest_value", *RATIOS)
    OUTPUT = ("taker_buy_volume_rel", "sum_open_interest_rel", "sum_open_interest_value_rel", "taker_buy_volume_z", "sum_open_interest_z", "sum_open_interest_value_z", "oi_value_per_contract_z", "count_z", "avg_trade_size_z", *(f"{r}_z" for r in RATIOS))

    def fit(self, df: DataFrame) -> MetricsNormalizer:
        from marketloom.operators.validate import require_columns

        require_columns(df, list(self.REQUIRED))
        found = exact_quantiles(df, {c: F.col(c) for c in self.RATIOS}, (0.5, 0.01, 0.99))
        self.scale = {c: tuple(q) for c, q in found.items() if q[0] is not None}
        if self.clip:
            self.bounds = quantile_bounds(self.features(df), list(self.OUTPUT), *self.clip)
        return self

    def features(self, df: DataFrame) -> DataFrame:
        w, eps = S.order(self.series, self.ts), self.eps
        t, oi, value, count = (F.col(c) for c in ("taker_buy_volume", "sum_open_interest", "sum_open_interest_value", "count"))

        relative = lambda x: S.ratio(S.ffill(x, w), S.padded_lag(x, w)) - 1
        z = lambda x: S.zscore(x.cast("double"), w, self.window, self.least, eps)
        out = {"taker_buy_volume_rel": S.clip(relative(t + eps), -3.0, 3.0), "sum_open_interest_rel": S.clip(relative(oi.cast("double")), -3.0, 3.0) * 1000, "sum_open_interest_value_rel": S.clip(relative(value), -3.0, 3.0) * 1000}
        out |= {"taker_buy_volume_z": z(t), "sum_open_interest_z": z(oi), "sum_open_interest_value_z": z(value), "oi_value_per_contract_z": z(S.ratio(value, oi + eps)), "count_z": z(count), "avg_trade_size_z": z(S.ratio(t, count + eps))}
        for r in self.RATIOS:
            mid, low, high = self.scale.get(r, (0.0, 0.0, 1.0))
            out[f"{r}_z"] = (F.col(r) - mid) / ((high - low) or 1.0)
        return df.withColumns(out)

    def outputs(self) -> list[tuple[str, Column]]:
        return _bounded(self.OUTPUT, self.bounds)

    def transform(self, df: DataFrame, context: DataFrame | None = None) -> DataFrame:
        full = self.features(_with_context(df, context)).filter("__own")
        return full.select(*self.series, self.ts, *[x.alias(n) for n, x in self.outputs()])


def orderbook_features(df: DataFrame, bands: tuple[int, ...] = BANDS, eps: float = 1e-8, limit: float | None = None) -> DataFrame:
    """``df`` with signed-log depth and notional of each band, totals and imbalances."""
    close = F.col("close")
    unit = close + 2 * eps
    squash = lambda s: F.signum(s) * F.log1p(F.abs(s))
    bound = lambda x: x if limit is None else S.clip(x, -limit, limit)
    out = {f"depth_{b}_n": bound(squash(S.ratio(F.col(f"depth_{b}"), unit))) for b in bands}
    out |= {f"notional_{b}_n": bound(squash(S.ratio(F.col(f"notional_{b}"), unit * unit))) for b in bands}
    total = lambda kind, keep: sum((F.coalesce(F.col(f"{kind}_{b}"), F.lit(0.0)) for b in bands if keep(b)), F.lit(0.0))
    for kind, scale in (("depth", close + eps), ("notional", (close + eps) * (close + eps))):
        bid, ask = (F.ln(1 + S.ratio(total(kind, keep), scale)) for keep in (lambda b: b < 0, lambda b: b > 0))
        out |= {f"total_{kind}_bid": bid, f"total_{kind}_ask": ask, f"total_{kind}": bid + ask}
        out |= {f"{kind}_imbalance_ratio": S.ratio(bid, ask + eps), f"{kind}_imbalance_signed": S.ratio(bid - ask, bid + ask + eps)}
    return df.withColumns(out)


@dataclass
class OrderBookNormalizer:
    """``orderbook_features`` as a transformer; nothing is learned, the columns are checked."""

    bands: tuple[int, ...] = BANDS
    eps: float = 1e-8
    limit: float | None = None

    LEARNED = ()

    def output_names(self) -> list[str]:
        bands = [f"{kind}_{b}_n" for kind in ("depth", "notional") for b in self.bands]
        ends = ("total_{}_bid", "total_{}_ask", "total_{}", "{}_imbalance_ratio", "{}_imbalance_signed")
        return bands + [e.format(kind) for kind in ("depth", "notional") for e in ends]

    def fit(self, df: DataFrame) -> OrderBookNormalizer:
        from marketloom.operators.validate import require_columns

        require_columns(df, ["close", *(f"{kind}_{b}" for kind in ("depth", "notional") for b in self.bands)])
        return self

    def features(self, df: DataFrame) -> DataFrame:
        return orderbook_features(df, tuple(self.bands), self.eps, self.limit)

    def outputs(self) -> list[tuple[str, Column]]:
        return [(n, F.col(n)) for n in self.output_names()]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.features(df)
