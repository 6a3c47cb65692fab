"""Losses and metrics of multi-horizon models over prediction tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import series as S


def _mean(values: Column, weights: Column | None) -> Column:
    return F.avg(values) if weights is None else S.ratio(F.sum(values * weights), F.sum(weights))


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def ordinal_loss(logits: str, target: str, ignore: int | None = None, pos_weight: float = 1.0, weight: str | None = None) -> Column:
    """Mean over thresholds q of the binary cross-entropy of logit q against target > q."""
    each = F.transform(logits, lambda z, q: F.when(F.col(target) > q, pos_weight * softplus(-z)).otherwise(softplus(z)))
    loss = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(logits)
    if ignore is not None:
        loss = F.when(F.col(target) != ignore, loss)
    w = None if weight is None else F.when(loss.isNotNull(), F.col(weight))
    return _mean(loss, w)


def focal_loss(logits: str, target: str, gamma: float = 2.0, alpha: float | list[float] = 1.0, ignore: int | None = None, weight: str | None = None) -> Column:
    """Mean of alpha (1 - p)^gamma times the cross-entropy of the target class; ``alpha`` may be one a class."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda z: F.exp(z - top)), F.lit(0.0), lambda a, x: a + x)
    logp = F.get(F.col(logits), F.col(target)) - top - F.ln(total)
    share = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else F.get(F.array(*[F.lit(float(a)) for a in alpha]), F.col(target))
    loss = -share * F.pow(1 - F.exp(logp), gamma) * logp
    if ignore is not None:
        loss = F.when(F.col(target) != ignore, loss)
    return _mean(loss, None if weight is None else F.when(loss.isNotNull(), F.col(weight)))


def quantile_loss(predictions: str, target: str, quantiles: tuple[float, ...], weight: str | None = None) -> Column:
    """Pinball loss, the mean over quantiles, of rows with a finite target."""
    y = S.clean(F.col(target).cast("double"))
    q = F.array(*[F.lit(float(x)) for x in quantiles])
    each = F.zip_with(predictions, q, lambda p, t: F.greatest(t * (y - p), (t - 1) * (y - p)))
    loss = F.when(y.isNotNull(), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / len(quantiles))
    return _mean(loss, None if weight is None else F.when(y.isNotNull(), F.col(weight)))


def ordinal_class(logits: str) -> Column:
    """Number of thresholds passed with probability above one half."""
    return F.size(F.filter(logits, lambda z: z > 0))


def horizon_accuracy(df: DataFrame, predicted: str, target: str) -> DataFrame:
    """(horizon, accuracy) from arrays over horizons."""
    pairs = df.select(F.posexplode(F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t"))).alias("horizon", "x"))
    return pairs.groupBy("horizon").agg(F.avg((F.col("x.p") == F.col("x.t")).cast("double")).alias("accuracy"))


def evaluate(df: DataFrame, logits: str, target: str, ignore: int | None = None) -> DataFrame:
    """(horizon, n, accuracy, loss) of a table of predictions, and a last row with a NULL horizon over all.

    ``logits`` holds an array of threshold logits a horizon, ``target`` a class a horizon;
    targets that are unknown or ``ignore`` count for nothing.  One aggregation, with partial
    sums before the shuffle.
    """
    zipped = F.arrays_zip(F.col(logits).alias("z"), F.col(target).alias("y"))
    rows = df.select(F.posexplode(zipped).alias("horizon", "x")).select("horizon", "x.z", "x.y")
    rows = rows.filter(F.col("y").isNotNull() & F.col("z").isNotNull() & (F.lit(True) if ignore is None else F.col("y") != ignore))
    hit = (ordinal_class("z") == F.col("y")).cast("double")
    found = rows.rollup("horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), ordinal_loss("z", "y").alias("loss"))
    return found.select("horizon", "n", "accuracy", "loss")


def positional_encoding(df: DataFrame, position: str, size: int) -> DataFrame:
    """``df`` with ``encoding``: sines and cosines of the position at falling frequencies."""
    angle = lambda i: F.col(position) / (10000.0 ** (2 * (i // 2) / size))
    return df.withColumn("encoding", F.array(*[F.sin(angle(i)) if i % 2 == 0 else F.cos(angle(i)) for i in range(size)]))


@dataclass
class EarlyStopping:
    """Stops after ``patience`` epochs without an improvement of ``delta``."""

    patience: int = 5
    delta: float = 0.0
    smaller_is_better: bool = True
    best: float | None = None
    waited: int = 0

    def update(self, value: float) -> bool:
        gain = 0 if self.best is None else (self.best - value if self.smaller_is_better else value - self.best)
        if self.best is None or gain > self.delta:
            self.best, self.waited = value, 0
        else:
            self.waited += 1
        return self.waited >= self.patience


@dataclass
class MetricLog:
    """Metric values by name and step, as a table when asked."""

    rows: list[tuple[str, int, float]] = field(default_factory=list)

    def add(self, step: int, **metrics: float) -> None:
        self.rows += [(name, step, float(value)) for name, value in metrics.items()]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "metric string, step int, value double")
