"""Five-class multi-horizon labels with volatility- and liquidity-adjusted thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import blocks
from marketloom.functions import series as S
from marketloom.functions.stage import staged

CLASSES = (-2, -1, 0, 1, 2)


def softmax(logits: list[Column]) -> list[Column]:
    """Stable softmax; a NULL logit counts as -1e9, and if all are NULL all are equal."""
    known = [F.coalesce(x, F.lit(-1e9)) for x in logits]
    top = F.greatest(*known)
    powers = [F.exp(x - top) for x in known]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


@dataclass
class LabelGenerator:
    horizons: tuple[int, ...] = (1, 5, 15)
    alpha: float = 1.0
    k_imb: float = 0.3
    k_liq: float = 0.2
    gamma: float = 2.0
    span: int = 100
    bands: tuple[int, ...] = (1, 2, 3, 4, 5)
    weighting: str = "inv"
    floor: float = 2e-4
    roll_liq: int = 200
    scale_window: int = 1000
    scale_least: int = 100
    temperature: float = 0.6
    ts: str = "open_time"
    series: list[str] = field(default_factory=list)
    rows: int = 20_000  # of a block that scans and medians work on
    numbering: int = blocks.SPAN  # time span in which rows are numbered by one task

    def _w(self):
        return S.order(self.series, self.ts)

    def band_weight(self, band: int) -> float:
        return {"inv": 100.0 / band, "inv2": (100.0 / band) ** 2}.get(self.weighting, 1.0)

    def _total(self, sign: int, weighted: bool) -> Column:
        parts = [F.coalesce(F.col(f"depth_{sign * b}"), F.lit(0.0)) * (self.band_weight(b) if weighted else 1.0) for b in self.bands]
        return sum(parts[1:], parts[0])

    def _medians(self, df: DataFrame, **wanted: tuple[Column, int, int]) -> DataFrame:
        """Medians over the rows before each row, from a sorted window that moves along blocks of rows."""
        return blocks.rolling_medians(df, wanted, self.series, "__i", self.rows)

    def base(self, df: DataFrame) -> DataFrame:
        """Returns, EWMA sigma, imbalance, density and liquidity: all that no threshold parameter changes."""
        w = self._w()
        change = F.coalesce(S.log_return(F.col("close"), w), F.lit(0.0))
        df = S.row_index(df.withColumn("__sq", change * change), self.series, self.ts, self.numbering, "__i")
        sigma = blocks.Mean(F.col("__sq"), 2 / (self.span + 1), "sigma")
        df = blocks.recursive_means(df, [sigma], self.series, self.ts, position="__i", span=self.rows)
        df = df.withColumn("sigma", F.sqrt("sigma")).drop("__sq")
        df = df.withColumns({f"ret_{h}": F.ln(F.lead("close", h).over(w)) - F.ln("close") for h in self.horizons})
        df = df.withColumns({"__bid": self._total(-1, False), "__ask": self._total(1, False)})
        df = self._medians(df, __mbid=(F.col("__bid"), self.scale_window, self.scale_least), __mask=(F.col("__ask"), self.scale_window, self.scale_least))
        df = df.withColumn("ask_scale", F.coalesce(S.ratio(F.col("__mbid"), F.col("__mask")), F.lit(1.0)))
        bid, ask = self._total(-1, True), self._total(1, True) * F.col("ask_scale")
        df = df.withColumns({"depth_total": bid + ask, "imbalance": F.coalesce(S.clip(S.ratio(bid - ask, bid + ask), -1.0, 1.0), F.lit(0.0)), "density": (bid + ask) / len(self.bands)})
        df = self._medians(df, __mliq=(F.col("density"), self.roll_liq, 1), __mweight=(F.col("density"), 200, 1))
        df = df.withColumn("__ratio", S.ratio(F.col("density"), F.col("__mliq")))
        return df.withColumn("liquidity", S.clip(F.col("__ratio"), 0.25, 4.0)).drop("__bid", "__ask", "__ratio", "__mbid", "__mask", "__mliq", "__i")

    def _threshold(self, h: int, side: str, alpha: Column | float) -> Column:
        """The first threshold of one side; it never falls as ``alpha`` grows."""
        t = F.when(F.col("sigma").isNotNull(), F.greatest(F.col("sigma") * alpha * (h**0.5), F.lit(self.floor)))
        calm = 1 - self.k_liq * (F.col("liquidity") - 1) / 2
        t1 = t * (1 + {"up": -1, "down": 1}[side] * self.k_imb * F.col("imbalance")) * calm
        return F.when(t1.isNotNull(), F.greatest(t1, F.lit(self.floor)))

    def thresholds(self, df: DataFrame) -> DataFrame:
        """t1 and t2 up and down for each horizon; NULL while volatility or liquidity is unknown."""
        first = {f"t1_{side}_{h}": self._threshold(h, side, self.alpha) for h in self.horizons for side in ("up", "down")}
        return df.withColumns(first).withColumns({n.replace("t1", "t2"): F.col(n) * self.gamma for n in first})

    def label(self, h: int) -> Column:
        """-2..2; 0 where a threshold is unknown, NULL where the return is."""
        r = F.col(f"ret_{h}")
        t = {k: F.col(f"{k}_{h}") for k in ("t1_up", "t2_up", "t1_down", "t2_down")}
        kind = F.when(r >= t["t2_up"], 2).when(r >= t["t1_up"], 1).when(r <= -t["t2_down"], -2).when(r <= -t["t1_down"], -1).otherwise(0)
        return F.when(r.isNotNull(), kind)

    def probabilities(self, h: int) -> Column:
        """Soft probabilities of the classes -2..2."""
        r, tau = F.col(f"ret_{h}"), self.temperature
        t1u, t2u, t1d, t2d = (F.col(f"{k}_{h}") for k in ("t1_up", "t2_up", "t1_down", "t2_down"))
        logits = [(-r - t2d) / tau, (-r - t1d) / tau, -S.ratio(F.abs(r), F.least(t1u, t1d)) / tau, (r - t1u) / tau, (r - t2u) / tau]
        return F.when(r.isNotNull(), F.array(*softmax(logits)))

    def build(self, df: DataFrame) -> DataFrame:
        """``df`` with returns, thresholds, label_{h}, probs_{h}, concurrency and weight."""
        full = self.thresholds(self.base(df))
        full = full.withColumns({f"label_{h}": self.label(h) for h in self.horizons} | {f"probs_{h}": self.probabilities(h) for h in self.horizons})
        acts = [F.when(F.coalesce(F.col(f"label_{h}"), F.lit(0)) != 0, 1).otherwise(0) for h in self.horizons]
        full = full.withColumn("concurrency", F.greatest(sum(acts[1:], acts[0]), F.lit(1)))
        adjust = S.clip(S.ratio(F.col("density"), F.col("__mweight")), 0.5, 2.0)
        weight = S.clip(S.ratio(F.lit(1.0), F.col("concurrency") * F.greatest(F.col("sigma"), F.lit(1e-4))) * adjust, 0.01, 50.0)
        return full.withColumn("weight", F.coalesce(weight, F.lit(0.01))).drop("__mweight")

    def label_data(self, df: DataFrame) -> DataFrame:
        """Time, label classes 0..4 as horizon_{h}, and weight; rows without a full horizon are left out."""
        full = self.build(df)
        known = F.lit(True)
        for h in self.horizons:
            known = known & F.col(f"ret_{h}").isNotNull()
        last = F.lead("close", max(self.horizons)).over(self._w())
        full = full.withColumn("__future", last).filter(F.col("__future").isNotNull() & known)
        return full.select(*self.series, self.ts, *[(F.col(f"label_{h}") + 2).cast("int").alias(f"horizon_{h}") for h in self.horizons], F.col("weight").alias("sample_weight"))

    def calibrate(self, df: DataFrame, target: dict[int, float], alphas: tuple[float, ...] = tuple(0.4 + 0.2 * i for i in range(9)), gammas: tuple[float, ...] = tuple(1.4 + 0.2 * i for i in range(7))) -> DataFrame:
        """(alpha, gamma, error): L1 distance of the class shares from ``target``, summed over horizons.

        Thresholds never fall as alpha grows, so a return passes one for the first so many
        alphas.  A row is known by its side and these numbers, one for each gamma; rows are
        counted by them in one pass, and the grid is laid over the few counts, not the rows.
        """
        alphas = tuple(sorted(float(a) for a in alphas))
        grid_of = lambda values: F.array(*[F.lit(float(v)) for v in values])
        rows = []
        for h in self.horizons:
            r = F.col(f"ret_{h}")
            passed = lambda side, h=h: F.transform(grid_of(alphas), lambda a: self._threshold(h, side, a))
            rows.append(F.struct(F.lit(h).alias("h"), r.alias("r"), F.when(r > 0, passed("up")).otherwise(passed("down")).alias("t")))
        long = self.base(df).select(F.explode(F.array(*rows)).alias("x")).select("x.*").filter("r is not null")
        count = lambda factor: F.size(F.filter("t", lambda t: F.abs("r") >= t * factor))
        keyed = long.select("h", (F.col("r") > 0).alias("up"), count(F.lit(1.0)).alias("first"), F.transform(grid_of(gammas), count).alias("second"))
        counts = keyed.groupBy("h", "up", "first", "second").agg(F.count(F.lit(1)).alias("n"))
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(a).alias("alpha"), F.lit(float(g)).alias("gamma")) for i, a in enumerate(alphas) for j, g in enumerate(gammas)])
        laid = counts.select("h", "up", "n", "first", "second", F.explode(cells).alias("c")).select("h", "up", "n", "first", F.col("second")[F.col("c.j")].alias("second"), "c.i", "c.alpha", "c.gamma")
        sign = F.when(F.col("up"), 1).otherwise(-1)
        kind = F.when(F.col("second") > F.col("i"), 2 * sign).when(F.col("first") > F.col("i"), sign).otherwise(0)
        total = F.sum("n")
        shares = laid.groupBy("alpha", "gamma", "h").agg(*[(F.coalesce(F.sum(F.when(kind == c, F.col("n"))), F.lit(0)) / total).alias(f"s{c + 2}") for c in CLASSES])
        away = [F.abs(F.col(f"s{c + 2}") - F.lit(float(target.get(c, 0.0)))) for c in CLASSES]
        return shares.groupBy("alpha", "gamma").agg(F.sum(sum(away[1:], away[0])).alias("error"))

    @staticmethod
    def best(grid: DataFrame) -> DataFrame:
        """The grid point of the smallest error, ties to the smaller alpha, then gamma."""
        first = F.min_by(F.struct("alpha", "gamma", "error"), F.struct(F.round("error", 12).alias("e"), "alpha", "gamma"))
        return grid.agg(first.alias("b")).select("b.*")

    def tune(self, df: DataFrame, grid: list[dict]) -> DataFrame:
        """A row of quality figures for each parameter set and horizon, and its score, best first.

        Sets that share span, window, weights and bands share a base frame; all sets are
        judged together.
        """
        from marketloom.operators.label_quality import diagnose, long_form

        shared: dict[tuple, list[tuple[int, LabelGenerator]]] = {}
        for i, options in enumerate(grid):
            made = replace(self, **options)
            shared.setdefault((made.span, made.roll_liq, made.weighting, made.bands), []).append((i, made))
        parts = []
        for sets in shared.values():
            base = staged(sets[0][1].base(df), "label-base")
            for i, made in sets:
                full = made.thresholds(base)
                full = full.withColumns({f"label_{h}": made.label(h) for h in made.horizons})
                parts.append(long_form(full, list(made.horizons)).withColumn("config", F.lit(i)))
        rows = diagnose(reduce(DataFrame.unionByName, parts), ("config", "horizon"))
        return rows.withColumn("avg_quality_score", F.avg("quality_score").over(Window.partitionBy("config"))).orderBy(F.desc_nulls_last("avg_quality_score"), "config", "horizon")
