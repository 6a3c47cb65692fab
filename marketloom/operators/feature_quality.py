"""Diagnostics of features and general data quality; results are small long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import series as S
from marketloom.functions.quantiles import exact_quantiles
from marketloom.functions.series import average_rank


def unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, x) of the known cells."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*(keep or []), F.explode(cells).alias("c")).select(*(keep or []), "c.feature", "c.x").filter("x is not null")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]


def _sample_skew(n: Column, g: Column) -> Column:
    return F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


def _sample_kurtosis(n: Column, g: Column) -> Column:
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def _quartiles(df: DataFrame, columns: list[str]) -> Column:
    """The exact quartiles of ``feature``."""
    found = exact_quantiles(df, {c: F.col(c) for c in columns}, (0.25, 0.5, 0.75))
    return F.create_map(*[x for c, q in found.items() for x in (F.lit(c), F.array(*[F.lit(v).cast("double") for v in q]))])[F.col("feature")]


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, moments (skewness and kurtosis bias-corrected), exact quartiles, missing and distinct of each feature."""
    total = df.select(F.count(F.lit(1)).alias("rows"))
    stats = unpivot(df, columns).groupBy("feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.skewness("x").alias("__s"), F.kurtosis("x").alias("__k"), F.count_distinct("x").alias("distinct"), F.count_if(F.col("x") == 0).alias("zeros"), F.count_if(F.col("x") < 0).alias("negatives"))
    n = F.col("n").cast("double")
    stats = stats.withColumn("q", _quartiles(df, columns))
    full = stats.crossJoin(F.broadcast(total)).withColumns({"q25": F.col("q")[0], "q50": F.col("q")[1], "q75": F.col("q")[2], "skew": _sample_skew(n, F.col("__s")), "kurt": _sample_kurtosis(n, F.col("__k")), "missing": F.col("rows") - F.col("n")})
    return full.withColumns({"iqr": F.col("q75") - F.col("q25"), "range": F.col("max") - F.col("min"), "cv": S.ratio(F.col("std"), F.abs("mean")), "missing_pct": F.col("missing") / F.col("rows") * 100, "zero_pct": F.col("zeros") / F.col("n") * 100}).drop("q", "__s", "__k")


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, dtype, count, missing, missing_pct, ...): the missing share is of the known values, 0 without any."""
    types = dict(df.dtypes)
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])[F.col("feature")]
    pct = F.when(F.col("n") > 0, F.col("missing") / F.col("n") * 100).otherwise(0.0)
    return describe(df, columns).select(
        "feature", dtype.alias("dtype"), F.col("n").alias("count"), "missing", pct.alias("missing_pct"), "mean", "std", "min", "q25", "q50", "q75", "max")


def class_quartiles(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, class, n, min, q25, q50, q75, max): the numbers behind one box a class."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.col(target).alias("class"), F.explode(cells).alias("c")).select("class", "c.*")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = long.groupBy("feature", "class").agg(F.count("x").alias("n"), F.min("x").alias("min"), q.alias("q"), F.max("x").alias("max"))
    return found.select("feature", "class", "n", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


def missing_table(df: DataFrame) -> DataFrame:
    """(feature, missing, pct) of every column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing")) for c in df.columns])
    return counts.select("__n", F.explode(cells).alias("c")).select("c.feature", "c.missing", (F.col("c.missing") / F.col("__n") * 100).alias("pct"))


def value_counts(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    counts = df.groupBy(F.col(column).cast("string").alias("value")).count()
    return counts.withColumn("pct", F.col("count") / F.sum("count").over(Window.partitionBy()) * 100).orderBy(F.desc("count"), "value").limit(top)


def correlations(df: DataFrame, columns: list[str], method: str = "pearson", least: float = 0.0) -> DataFrame:
    """(a, b, r) of the pairs a before b with |r| >= ``least``; one aggregation for all pairs."""
    if method == "kendall":
        from marketloom.operators.statistics import kendall

        pairs = [kendall(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("tau").alias("r")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
        out = reduce(DataFrame.unionByName, pairs)
    else:
        if method == "spearman":
            df = df.dropna(subset=columns)
            for c in columns:
                df = df.withColumn(c, average_rank(F.col(c), []))
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
        wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
        out = wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")
    return out.filter(F.abs("r") >= least)


def top_correlations(df: DataFrame, columns: list[str], n: int, method: str = "pearson") -> DataFrame:
    return correlations(df, columns, method).orderBy(F.desc(F.abs("r")), "a", "b").limit(n)


def class_scores(df: DataFrame, columns: list[str], label: str, majority: int = 2, extremes: tuple[int, int] = (0, 4)) -> DataFrame:
    """Four scores of how features tell classes apart, best pairwise separation first."""
    long = unpivot(df.filter(F.col(label).isNotNull()), columns, [label]).withColumnRenamed(label, "y")
    stats = long.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    over = Window.partitionBy("feature")
    stats = stats.withColumns({"all_n": F.sum("n").over(over), "inv": F.sum(1 / F.col("n")).over(over)})
    stats = stats.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(over) / F.col("all_n"))
    dev = F.pow(F.col("m") - F.col("grand"), 2)
    ratio = stats.groupBy("feature").agg(S.ratio(F.sum(dev / F.col("inv")), F.sum(F.col("n") * (F.col("v") + dev))).alias("balanced_ratio"))
    major = F.col("y") == majority
    two = long.groupBy("feature").agg(*[f(F.when(t, F.col("x"))).alias(f"{n}{k}") for k, t in (("1", major), ("0", ~major)) for n, f in (("m", F.avg), ("v", F.var_pop))])
    split = two.select("feature", S.ratio(F.abs(F.col("m0") - F.col("m1")), F.nullif(F.sqrt((F.col("v0") + F.col("v1")) / 2), F.lit(0.0))).alias("class_separation"))
    a, b = (stats.select("feature", *[F.col(c).alias(f"{c}{k}") for c in ("y", "m", "v")]) for k in "ab")
    pairs = a.join(b, "feature").filter("ya < yb")
    apart = pairs.groupBy("feature").agg(F.avg(S.ratio(F.abs(F.col("ma") - F.col("mb")), F.nullif(F.sqrt((F.col("va") + F.col("vb")) / 2), F.lit(0.0)))).alias("pairwise_separation"))
    # ROC AUC from rank sums; ranks of tied values from counts of distinct values
    hit = F.col("y").isin(*extremes)
    levels = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("c"), F.count_if(hit).alias("p"))
    below = F.coalesce(F.sum("c").over(over.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = levels.withColumn("rank", below + (F.col("c") + 1) / 2)
    sums = ranked.groupBy("feature").agg(F.sum(F.col("p") * F.col("rank")).alias("s"), F.sum("p").alias("p"), F.sum("c").alias("c"))
    auc = sums.select("feature", S.ratio(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("c") - F.col("p"))).alias("extreme_auc"))
    out = ratio.join(split, "feature").join(apart, "feature", "left").join(auc, "feature")
    return out.orderBy(F.desc_nulls_last("pairwise_separation"), "feature")


def tiers(scores: DataFrame) -> DataFrame:
    """Tier of each feature and whether it is a specialist of the extreme classes."""
    p = F.col("pairwise_separation")
    tier = F.when(p > 0.45, "strong").when(p >= 0.25, "good").when(p >= 0.10, "weak").otherwise("noise")
    return scores.withColumns({"tier": tier, "extreme_specialist": (F.col("extreme_auc") > 0.7) & (F.col("class_separation") > 0.3)})


def outliers(df: DataFrame, columns: list[str], method: str = "iqr", k: float = 1.5) -> DataFrame:
    """(feature, low, high, n_low, n_high, pct, min, max) of values outside the bounds."""
    long = unpivot(df, columns)
    if method == "iqr":
        fit = long.select("feature").distinct().withColumn("q", _quartiles(df, columns))
        width = F.col("q")[2] - F.col("q")[0]
        fit = fit.select("feature", (F.col("q")[0] - k * width).alias("low"), (F.col("q")[2] + k * width).alias("high"))
    else:
        fit = long.groupBy("feature").agg((F.avg("x") - k * F.stddev_samp("x")).alias("low"), (F.avg("x") + k * F.stddev_samp("x")).alias("high"))
    below, above = F.count_if(F.col("x") < F.col("low")), F.count_if(F.col("x") > F.col("high"))
    found = long.join(F.broadcast(fit), "feature").groupBy("feature", "low", "high")  # a row a feature
    return found.agg(below.alias("n_low"), above.alias("n_high"), ((below + above) / F.count("x") * 100).alias("pct"), F.min("x").alias("min"), F.max("x").alias("max"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, n): equal-width bins from the minimum to the maximum, the last one closed."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.floor(S.ratio(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counted = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin"), "lo", "hi").count()
    return counted.select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("low"), F.col("count").alias("n"))


def class_distribution(df: DataFrame, label: str, classes: tuple[int, ...]) -> DataFrame:
    """(class, n, share) of all given classes, also absent ones."""
    fixed = df.sparkSession.createDataFrame([(int(c),) for c in classes], "class int")
    counts = df.groupBy(F.col(label).cast("int").alias("class")).count()
    joined = fixed.join(counts, "class", "left").select("class", F.coalesce("count", F.lit(0)).alias("n"))
    return joined.withColumn("share", S.ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))
