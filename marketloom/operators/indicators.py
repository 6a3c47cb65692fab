"""Technical indicators.  ``add`` takes (name, parameters) pairs and appends their columns.

Windows of bounded length, and scans over time blocks (``functions.blocks``): recursive means
as affine scans, running volume, and the stop-and-reverse indicator as a state machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import blocks
from marketloom.functions import series as S
from marketloom.functions.stage import staged


class Frame:
    """A frame with the names of its series and time columns, and the span of its time blocks.

    A scan reads its input twice; ``scans`` counts those since the frame was last written, and
    the input of a second one is written first, so that plans do not double with each.
    """

    def __init__(self, df: DataFrame, ts: str, series: list[str], span: int = blocks.SPAN, scans: int = 0) -> None:
        self.df, self.ts, self.series, self.span, self.scans = df, ts, series, span, scans
        self.w = S.order(series, ts)

    def _with(self, df: DataFrame, scans: int | None = None) -> Frame:
        return Frame(df, self.ts, self.series, self.span, self.scans if scans is None else scans)

    def add(self, **columns: Column) -> Frame:
        return self._with(self.df.withColumns(columns))

    def drop(self, *names: str) -> Frame:
        return self._with(self.df.drop(*names))

    def written(self) -> Frame:
        return self._with(staged(self.df, "indicators"), 0) if self.scans else self

    def ewmas(self, *means: blocks.Mean) -> Frame:
        """Several recursive means in one scan."""
        f = self.written()
        return f._with(blocks.recursive_means(f.df, list(means), f.series, f.ts, span=f.span), 1)

    def ewma(self, x: Column, alpha: float, out: str, mean_start: int | None = None, least: int = 1, skip: int = 0) -> Frame:
        return self.ewmas(blocks.Mean(x, alpha, out, mean_start, least, skip))

    def mean(self, x: Column, n: int, least: int | None = None) -> Column:
        return S.rolling(F.avg, x, self.w, n, least)

    def total(self, x: Column, n: int, least: int | None = None) -> Column:
        return S.rolling(F.sum, x, self.w, n, least)

    def highest(self, x: Column, n: int) -> Column:
        return S.rolling(F.max, x, self.w, n)

    def lowest(self, x: Column, n: int) -> Column:
        return S.rolling(F.min, x, self.w, n)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.w)


def _ohlcv() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("open", "high", "low", "close", "volume"))


def sma(f: Frame, window: int) -> Frame:
    return f.add(**{f"sma_{window}": f.mean(F.col("close"), window)})


def ema(f: Frame, window: int) -> Frame:
    return f.ewma(F.col("close"), 2 / (window + 1), f"ema_{window}", least=window)


def _true_range(f: Frame) -> Column:
    _, h, l, c, _ = _ohlcv()
    prev = f.lag(c)
    return F.when(prev.isNotNull(), F.greatest(h - l, F.abs(h - prev), F.abs(l - prev)))


def adx(f: Frame, adx_window: int, di_window: int) -> Frame:
    """Wilder's directional movement: smoothed moves over smoothed true range."""
    _, h, l, _, _ = _ohlcv()
    up, down = h - f.lag(h), f.lag(l) - l
    g = f.add(__tr=_true_range(f), __up=F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)), __dn=F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)))
    g = g.ewmas(*[blocks.Mean(F.col(f"__{name}"), 1 / di_window, f"__s{name}", mean_start=di_window) for name in ("tr", "up", "dn")])
    g = g.add(adx_pos=100 * S.ratio(F.col("__sup"), F.col("__str")), adx_neg=100 * S.ratio(F.col("__sdn"), F.col("__str")))
    g = g.add(__dx=100 * S.ratio(F.abs(F.col("adx_pos") - F.col("adx_neg")), F.col("adx_pos") + F.col("adx_neg")))
    return g.ewma(F.col("__dx"), 1 / adx_window, "adx", mean_start=adx_window).drop("__tr", "__up", "__dn", "__str", "__sup", "__sdn", "__dx")


def macd(f: Frame, fast: int, slow: int, signal: int) -> Frame:
    """EMAs start at means; the fast one on the rows just before the slow one's first value.

    All three columns begin where the signal does.
    """
    g = f.ewmas(
        blocks.Mean(F.col("close"), 2 / (fast + 1), "__f", mean_start=fast, skip=max(0, slow - fast)),
        blocks.Mean(F.col("close"), 2 / (slow + 1), "__s", mean_start=slow))
    g = g.add(__m=F.col("__f") - F.col("__s")).ewma(F.col("__m"), 2 / (signal + 1), "macd_signal", mean_start=signal)
    shown = F.when(F.col("macd_signal").isNotNull(), F.col("__m"))
    return g.add(macd=shown, macd_hist=F.col("__m") - F.col("macd_signal")).drop("__f", "__s", "__m")


def sar_step(state: list | None, bar: tuple[float, float], acceleration: float, maximum: float) -> tuple[float | None, list]:
    """The parabolic stop of one bar (high, low), and the state after it; the first bar has none.

    The state is the bar, the next stop, the extreme of the trend, 1 for a rising one, the factor.
    """
    high, low = bar
    if state is None:
        return None, [high, low, None, None, None, None]
    last_high, last_low, stop, extreme, up, factor = state
    if stop is None:
        down = last_low - low > high - last_high and last_low - low > 0
        stop, extreme, up, factor = (last_high, low, 0.0, acceleration) if down else (last_low, high, 1.0, acceleration)
    if (low <= stop) if up else (high >= stop):  # reverse
        up = 0.0 if up else 1.0
        stop = min(extreme, low, last_low) if up else max(extreme, high, last_high)
        factor, extreme = acceleration, (high if up else low)
        shown = stop
    else:
        shown = stop
        if (high > extreme) if up else (low < extreme):
            extreme, factor = (high if up else low), min(factor + acceleration, maximum)
    following = stop + factor * (extreme - stop)
    stop = min(following, low, last_low) if up else max(following, high, last_high)
    return shown, [high, low, stop, extreme, up, factor]


def sar_values(rows: Iterator[tuple[float, float]], acceleration: float, maximum: float) -> Iterator[float | None]:
    """Stops of bars (high, low) in order."""
    state = None
    for bar in rows:
        shown, state = sar_step(state, bar, acceleration, maximum)
        yield shown


def sar(f: Frame, acceleration: float, maximum: float) -> Frame:
    """Parabolic stop-and-reverse; a reversal forgets what came before, so blocks settle by themselves."""
    g = f.written()
    step = lambda state, bar: sar_step(state, bar, acceleration, maximum)
    return g._with(blocks.state_scan(g.df, step, ["high", "low"], g.series, g.ts, "sar", span=g.span), 1)


def ichimoku(f: Frame, conversion: int, base: int, span: int) -> Frame:
    _, h, l, _, _ = _ohlcv()
    mid = lambda n: (f.highest(h, n) + f.lowest(l, n)) / 2
    g = f.add(ichimoku_conversion=mid(conversion), ichimoku_base=mid(base), ichimoku_b=mid(span))
    return g.add(ichimoku_a=(F.col("ichimoku_conversion") + F.col("ichimoku_base")) / 2)


def _rsi(f: Frame, window: int, out: str, mean_start: bool = False) -> Frame:
    change = S.diff(F.col("close"), f.w)
    g = f.add(__u=F.greatest(change, F.lit(0.0)) + change * 0, __d=F.greatest(-change, F.lit(0.0)) + change * 0)
    start = window if mean_start else None
    g = g.ewmas(*[blocks.Mean(F.col(c), 1 / window, o, mean_start=start, least=1 if start else window) for c, o in (("__u", "__au"), ("__d", "__ad"))])
    flat = F.when(F.col("__au").isNotNull(), 100.0 if not mean_start else 0.0)
    return g.add(**{out: F.coalesce(100 * S.ratio(F.col("__au"), F.col("__au") + F.col("__ad")), flat)}).drop("__u", "__d", "__au", "__ad")


def rsi(f: Frame, window: int) -> Frame:
    return _rsi(f, window, "rsi")


def stoch(f: Frame, window: int, smooth: int) -> Frame:
    _, h, l, c, _ = _ohlcv()
    low, high = f.lowest(l, window), f.highest(h, window)
    g = f.add(stoch_main=100 * S.ratio(c - low, high - low))
    return g.add(stoch_side=g.mean(F.col("stoch_main"), smooth))


def cci(f: Frame, window: int) -> Frame:
    _, h, l, c, _ = _ohlcv()
    frame = f.w.rowsBetween(-(window - 1), 0)
    g = f.add(__tp=(h + l + c) / 3)
    g = g.add(__m=g.mean(F.col("__tp"), window), __all=F.collect_list("__tp").over(frame))
    away = F.aggregate(F.transform("__all", lambda x: F.abs(x - F.col("__m"))), F.lit(0.0), lambda a, x: a + x) / F.size("__all")
    return g.add(cci=S.ratio(F.col("__tp") - F.col("__m"), 0.015 * away)).drop("__tp", "__m", "__all")


def momentum(f: Frame, period: int) -> Frame:
    return f.add(momentum=S.diff(F.col("close"), f.w, period))


def bbands(f: Frame, window: int, num_std: float) -> Frame:
    c = F.col("close")
    mid, sd = f.mean(c, window), S.rolling(F.stddev_pop, c, f.w, window)
    return f.add(bb_upper=mid + num_std * sd, bb_middle=mid, bb_lower=mid - num_std * sd)


def atr(f: Frame, window: int) -> Frame:
    return f.add(__tr=_true_range(f)).ewma(F.col("__tr"), 1 / window, "ATR", mean_start=window).drop("__tr")


def obv(f: Frame) -> Frame:
    """Running signed volume, the first volume counted."""
    change = S.diff(F.col("close"), f.w)
    g = f.add(__s=F.coalesce(F.signum(change), F.lit(1.0)) * F.col("volume")).written()
    return g._with(blocks.running_sums(g.df, {"obv": F.col("__s")}, g.series, g.ts, span=g.span), 1).drop("__s")


def vwap(f: Frame, period: int) -> Frame:
    _, h, l, c, v = _ohlcv()
    return f.add(vwap=S.ratio(f.total((h + l + c) / 3 * v, period), f.total(v, period)))


def cmf(f: Frame, window: int) -> Frame:
    _, h, l, c, v = _ohlcv()
    flow = F.coalesce(S.ratio((c - l) - (h - c), h - l), F.lit(0.0)) * v
    return f.add(cmf=S.ratio(f.total(flow, window), f.total(v, window)))


def mfi(f: Frame, window: int) -> Frame:
    _, h, l, c, v = _ohlcv()
    g = f.add(__tp=(h + l + c) / 3)
    change = S.diff(F.col("__tp"), g.w)
    flow = F.col("__tp") * v
    g = g.add(__p=F.when(change > 0, flow).when(change.isNotNull(), 0.0), __n=F.when(change < 0, flow).when(change.isNotNull(), 0.0))
    p, n = g.total(F.col("__p"), window), g.total(F.col("__n"), window)
    return g.add(mfi=100 * S.ratio(p, p + n)).drop("__tp", "__p", "__n")


def williams_r(f: Frame, lookback: int) -> Frame:
    _, h, l, c, _ = _ohlcv()
    high, low = f.highest(h, lookback), f.lowest(l, lookback)
    return f.add(wr=-100 * S.ratio(high - c, high - low))


def ao(f: Frame, short: int, long: int) -> Frame:
    mid = (F.col("high") + F.col("low")) / 2
    g = f.add(ao=f.mean(mid, short) - f.mean(mid, long))
    return g.add(ao_prev=g.lag(F.col("ao")))


def stochrsi(f: Frame, rsi_window: int, smooth1: int, smooth2: int) -> Frame:
    g = _rsi(f, rsi_window, "__rsi")
    low, high = g.lowest(F.col("__rsi"), rsi_window), g.highest(F.col("__rsi"), rsi_window)
    g = g.add(stoch_rsi=100 * S.ratio(F.col("__rsi") - low, high - low))
    g = g.add(stoch_k=g.mean(F.col("stoch_rsi"), smooth1))
    return g.add(stoch_d=g.mean(F.col("stoch_k"), smooth2)).drop("__rsi")


def uo(f: Frame, short: int, medium: int, long: int) -> Frame:
    _, h, l, c, _ = _ohlcv()
    prev = f.lag(c)
    g = f.add(__bp=F.when(prev.isNotNull(), c - F.least(l, prev)), __tr=F.when(prev.isNotNull(), F.greatest(h, prev) - F.least(l, prev)))
    part = lambda n: S.ratio(g.total(F.col("__bp"), n), g.total(F.col("__tr"), n))
    return g.add(uo=100 * (4 * part(short) + 2 * part(medium) + part(long)) / 7).drop("__bp", "__tr")


def fgi(f: Frame, rsi_period: int, volume_ma_period: int) -> Frame:
    """Mean of the relative RSI and the relative volume, shifted by 1 and scaled by the period."""
    p = volume_ma_period
    g = _rsi(f, rsi_period, "__rsi", mean_start=True)
    calm = (F.col("__rsi") - p) / p
    busy = S.ratio(F.col("volume"), g.mean(F.col("volume"), p)) - 1
    return g.add(fgi=((calm + busy) / 2 + 1) * p).drop("__rsi")


def bbp(f: Frame, ema_period: int) -> Frame:
    g = f.ewma(F.col("close"), 2 / (ema_period + 1), "__e", least=ema_period)
    g = g.add(bull_power=F.col("high") - F.col("__e"), bear_power=F.col("low") - F.col("__e"))
    return g.add(bull_bear_power=F.col("bull_power") + F.col("bear_power")).drop("__e")


def fibonacci(f: Frame, level1: float = 0.236, level2: float = 0.382, level3: float = 0.5, level4: float = 0.618) -> Frame:
    _, h, l, _, _ = _ohlcv()
    lines = {f"frl_l{i}": l + x * (h - l) for i, x in enumerate((level1, level2, level3, level4), 1)}
    return f.add(**lines, frl_l5=h)


INDICATORS: dict[str, Callable[..., Frame]] = {f.__name__: f for f in (sma, ema, adx, macd, sar, ichimoku, rsi, stoch, cci, momentum, bbands, atr, obv, vwap, cmf, mfi, williams_r, ao, stochrsi, uo, fgi, bbp, fibonacci)}


def add(df: DataFrame, wanted: list[tuple[str, dict]], ts: str = "open_time", series: list[str] | None = None, span: int = blocks.SPAN) -> DataFrame:
    """``df`` with the columns of each named indicator; unknown names are left out.

    ``span`` is the length in time of the blocks that scans work on; some 10,000 rows are a good size.
    """
    frame = Frame(df, ts, series or [], span)
    for name, parameters in wanted:
        found = INDICATORS.get(name.strip().lower())
        if found:
            frame = found(frame, **parameters)
    return frame.df
