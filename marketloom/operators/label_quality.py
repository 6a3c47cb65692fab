"""Diagnostics of label quality: one row a horizon (and set of parameters), classes as rows of small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import series as S
from marketloom.functions.stage import staged

HORIZON = ("horizon",)


def long_form(df: DataFrame, horizons: list[int]) -> DataFrame:
    """(horizon, r, label, up, down) of all rows with a label."""
    rows = [F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("r"), F.col(f"label_{h}").cast("int").alias("label"), F.col(f"t1_up_{h}").alias("up"), F.col(f"t1_down_{h}").alias("down")) for h in horizons]
    return df.select(F.explode(F.array(*rows)).alias("x")).select("x.*").filter("label is not null and r is not null")


def class_stats(long: DataFrame, by: tuple[str, ...] = HORIZON) -> DataFrame:
    """(horizon, label, mean, std, n, share, q01, q99) of each class."""
    stats = long.groupBy(*by, "label").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count(F.lit(1)).alias("n"), F.percentile("r", 0.01).alias("q01"), F.percentile("r", 0.99).alias("q99"))
    return stats.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def cohens_d(mean_a: Column, std_a: Column, mean_b: Column, std_b: Column) -> Column:
    return S.ratio(mean_b - mean_a, F.nullif(F.sqrt((std_a * std_a + std_b * std_b) / 2), F.lit(0.0)))


def adjacent_effects(stats: DataFrame, by: tuple[str, ...] = HORIZON) -> DataFrame:
    """(horizon, label, next_label, cohens_d) of neighbouring classes."""
    w = Window.partitionBy(*by).orderBy("label")
    nxt = {c: F.lead(c).over(w) for c in ("label", "mean", "std")}
    full = stats.withColumns({f"next_{c}": x for c, x in nxt.items()}).filter("next_label is not null")
    return full.select(*by, "label", "next_label", cohens_d(F.col("mean"), F.col("std"), F.col("next_mean"), F.col("next_std")).alias("cohens_d"))


def overlap(long: DataFrame, stats: DataFrame, by: tuple[str, ...] = HORIZON) -> DataFrame:
    """(horizon, overlap): mean share of one class inside the 1-99 % range of another."""
    ranges = stats.select(*by, F.col("label").alias("other"), "q01", "q99")
    inside = long.join(F.broadcast(ranges), list(by)).filter("label <> other")  # a row a class
    shares = inside.groupBy(*by, "label", "other").agg(F.avg(F.col("r").between(F.col("q01"), F.col("q99")).cast("double")).alias("p"))
    return shares.groupBy(*by).agg(F.avg("p").alias("overlap"))


def threshold_cv(long: DataFrame, column: str = "up", robust: bool = True, by: tuple[str, ...] = HORIZON) -> DataFrame:
    """(horizon, threshold_cv): spread of the thresholds over their centre."""
    if not robust:
        return long.groupBy(*by).agg(S.ratio(F.stddev_samp(column), F.abs(F.avg(column))).alias("threshold_cv"))
    mid = long.groupBy(*by).agg(F.percentile(column, 0.5).alias("__m"))
    away = long.join(F.broadcast(mid), list(by)).groupBy(*by).agg(F.percentile(F.abs(F.col(column) - F.col("__m")), 0.5).alias("mad"), F.first("__m").alias("m"))
    return away.select(*by, S.ratio(1.4826 * F.col("mad"), F.abs("m")).alias("threshold_cv"))


def extremes(long: DataFrame, by: tuple[str, ...] = HORIZON) -> DataFrame:
    """Precision and recall of the extreme classes against the 1 % tails."""
    cut = long.groupBy(*by).agg(F.percentile("r", 0.01).alias("q01"), F.percentile("r", 0.99).alias("q99"), F.max("label").alias("top"), F.min("label").alias("bottom"))
    full = long.join(F.broadcast(cut), list(by))
    out = []
    for side, cls, tail in (("up", F.col("label") == F.col("top"), F.col("r") >= F.col("q99")), ("down", F.col("label") == F.col("bottom"), F.col("r") <= F.col("q01"))):
        both = F.count_if(cls & tail)
        out += [S.ratio(both, F.count_if(cls)).alias(f"precision_{side}"), S.ratio(both, F.count_if(tail)).alias(f"recall_{side}")]
    return full.groupBy(*by).agg(*out)


def analyze(df: DataFrame, horizons: list[int]) -> DataFrame:
    """All diagnostics and the quality score of each horizon."""
    return diagnose(long_form(df, horizons))


def diagnose(long: DataFrame, by: tuple[str, ...] = HORIZON) -> DataFrame:
    """The same of rows in long form, for each group of ``by``."""
    long = staged(long, "labels")  # read by every diagnostic
    stats = staged(class_stats(long, by), "classes")
    w = Window.partitionBy(*by).orderBy("label")
    rising = stats.withColumn("__up", F.col("mean") > F.lag("mean").over(w))
    spread = rising.groupBy(*by).agg(
        F.max_by("mean", "label").alias("mean_top"), F.min_by("mean", "label").alias("mean_bottom"), F.max("label").alias("top"), F.min("label").alias("bottom"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"),
        F.sqrt(F.sum((F.col("n") - 1) * F.pow("std", 2)) / F.sum(F.when(F.col("std").isNotNull(), F.col("n") - 1))).alias("pooled"),
        F.coalesce(F.bool_and("__up"), F.lit(False)).alias("monotonic"))
    spread = spread.withColumn("separation", S.ratio(F.col("mean_top") - F.col("mean_bottom"), F.col("pooled")))
    ends = long.join(F.broadcast(spread.select(*by, "top", "bottom")), list(by))
    purity = ends.groupBy(*by).agg(
        F.avg(F.when(F.col("label") == F.col("top"), (F.col("r") >= F.col("up")).cast("double"))).alias("purity_up"),
        F.avg(F.when(F.col("label") == F.col("bottom"), (F.col("r") <= -F.col("down")).cast("double"))).alias("purity_down"),
        S.ratio(F.stddev_samp(F.when(F.col("label") == 0, F.col("r"))), F.stddev_samp("r")).alias("noise_ratio"))
    effects = adjacent_effects(stats, by).groupBy(*by).agg(F.avg("cohens_d").alias("mean_cohens_d"))
    out = spread.drop("top", "bottom", "pooled", "mean_top", "mean_bottom")
    for table in (purity, effects, overlap(long, stats, by), threshold_cv(long, by=by), extremes(long, by)):
        out = out.join(F.broadcast(table), list(by), "left")  # a row a group
    points = [(F.col("separation") > 2, 20), (F.col("purity_up") > 0.8, 15), (F.col("purity_down") > 0.8, 15), (F.col("overlap") < 0.3, 20), (F.col("monotonic"), 15), (F.col("threshold_cv") < 0.5, 15)]
    score = sum((F.when(test, n).otherwise(0) for test, n in points), F.lit(0))
    return out.withColumn("quality_score", score)
