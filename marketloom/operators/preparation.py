"""Feature pipelines, scalers, encoders, splits and sliding windows for training."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import blocks
from marketloom.functions import series as S
from marketloom.functions.quantiles import exact_quantiles
from marketloom.operators.normalizers import MetricsNormalizer, OHLCVNormalizer, OrderBookNormalizer
from marketloom.operators.validate import ValidationError, require_split_sizes


@dataclass
class Numeric:
    """Imputation (mean, median, most_frequent, constant) and scaling (standard, minmax, robust, None)."""

    columns: list[str]
    impute: str | None = None
    fill: float = 0.0
    scale: str | None = None
    params: dict[str, list] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> None:
        """One aggregation for imputation and one for scaling; medians and quartiles by exact selection."""
        columns = {c: F.col(c) for c in self.columns}
        fill = dict.fromkeys(self.columns, self.fill)
        if self.impute == "median":
            found = {c: q[0] for c, q in exact_quantiles(df, columns, (0.5,)).items()}
        elif self.impute in ("mean", "most_frequent"):
            make = F.avg if self.impute == "mean" else lambda x: F.mode(x, True)
            found = df.agg(*[make(x).alias(c) for c, x in columns.items()]).first().asDict()
        else:
            found = {}
        fill |= {c: float(v) for c, v in found.items() if v is not None}
        value = {c: F.coalesce(x.cast("double"), F.lit(fill[c])) if self.impute else x for c, x in columns.items()}
        scales = dict.fromkeys(self.columns, (0.0, 1.0))
        if self.scale == "robust":
            scales = {c: (q[0], None if q[0] is None else q[2] - q[1]) for c, q in exact_quantiles(df, value, (0.5, 0.25, 0.75)).items()}
        elif self.scale in ("standard", "minmax"):
            of = {"standard": lambda x: (F.avg(x), F.stddev_pop(x)), "minmax": lambda x: (F.min(x).cast("double"), (F.max(x) - F.min(x)).cast("double"))}[self.scale]
            scales = df.agg(*[F.array(*of(x)).alias(c) for c, x in value.items()]).first().asDict()
        for c in self.columns:
            self.params[c] = [fill[c] if self.impute else None, scales[c][0] or 0.0, scales[c][1] or 1.0]

    def outputs(self) -> list[tuple[str, Column]]:
        out = []
        for c in self.columns:
            fill, centre, width = self.params[c]
            x = F.col(c) if fill is None else F.coalesce(F.col(c), F.lit(fill))
            out.append((c, (x - centre) / width if self.scale else x))
        return out


@dataclass
class OneHot:
    """Indicator columns of the sorted categories; ``binary`` drops the first of two."""

    columns: list[str]
    binary: bool = False
    unknown: str = "ignore"
    params: dict[str, list] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> None:
        row = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in self.columns]).first()  # categories are few by contract
        self.params = {c: list(row[c]) for c in self.columns}

    def outputs(self) -> list[tuple[str, Column]]:
        out = []
        for c in self.columns:
            known = self.params[c]
            x = F.col(c).cast("string")
            if self.unknown == "error":
                x = F.when(x.isin(known), x).otherwise(F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.coalesce(x, F.lit("null")))).cast("string"))
            out += [(f"{c}_{v}", F.coalesce(x == v, F.lit(False)).cast("double")) for v in (known[1:] if self.binary and len(known) == 2 else known)]
        return out


@dataclass
class Expression:
    """A column from an SQL expression."""

    name: str
    sql: str
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> None:
        pass

    def outputs(self) -> list[tuple[str, Column]]:
        return [(self.name, F.expr(self.sql))]


#: Transformers by name, for pipelines that are saved and loaded; ``register_transformer`` adds to them.
TRANSFORMERS: dict[str, type] = {"candles": OHLCVNormalizer, "metrics": MetricsNormalizer, "order_book": OrderBookNormalizer}


def register_transformer(name: str, kind: type) -> None:
    """Make ``kind`` available to ``Custom`` parts.

    It takes its settings and what it has learned as keywords; ``fit(df)`` returns it,
    ``features(df)`` adds columns, ``outputs()`` lists (name, column) over them, and
    ``LEARNED`` names the attributes that ``fit`` sets, plain data that JSON can hold.
    """
    TRANSFORMERS[name] = kind


@dataclass
class Custom:
    """A registered transformer as a part of a pipeline, saved with its settings and what it learned."""

    name: str
    settings: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)

    def _made(self):
        return TRANSFORMERS[self.name](**self.settings, **self.params)

    def fit(self, df: DataFrame) -> None:
        made = TRANSFORMERS[self.name](**self.settings).fit(df)
        self.params = {k: getattr(made, k) for k in made.LEARNED}

    def prepare(self, df: DataFrame) -> DataFrame:
        return self._made().features(df)

    def outputs(self) -> list[tuple[str, Column]]:
        return self._made().outputs()


PARTS = {p.__name__: p for p in (Numeric, OneHot, Expression, Custom)}


@dataclass
class FeaturePipeline:
    """Custom DataFrame functions, then parts in order; ``remainder`` keeps the other columns or drops them.

    ``keys`` (series and time, say) are handed through in front and are no features.
    """

    parts: list
    remainder: str = "drop"
    custom: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)

    def _start(self, df: DataFrame) -> DataFrame:
        for f in self.custom:
            df = f(df)
        return df

    def fit(self, df: DataFrame) -> FeaturePipeline:
        start = self._start(df).persist()  # read by each part
        try:
            for p in self.parts:
                p.fit(start)
        finally:
            start.unpersist()
        return self

    def feature_names(self) -> list[str]:
        """Names of the fitted parts' outputs, in order."""
        return [n for p in self.parts for n, _ in p.outputs()]

    def transform(self, df: DataFrame) -> DataFrame:
        start = df = self._start(df)
        for p in self.parts:
            df = p.prepare(df) if isinstance(p, Custom) else df
        made = [x for p in self.parts for x in p.outputs()]
        used = {c for p in self.parts for c in getattr(p, "columns", [])} | {n for n, _ in made} | set(self.keys)
        rest = [c for c in start.columns if c not in used] if self.remainder == "passthrough" else []
        return df.select(*self.keys, *[x.alias(n) for n, x in made], *rest)

    def to_json(self) -> str:
        """Parts with fitted parameters; custom functions are code and stay out."""
        return json.dumps({"remainder": self.remainder, "keys": self.keys, "parts": [{"type": type(p).__name__, **asdict(p)} for p in self.parts]}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> FeaturePipeline:
        data = json.loads(text)
        return cls([PARTS[p.pop("type")](**p) for p in data["parts"]], data["remainder"], keys=data.get("keys", []))


def time_features(df: DataFrame, ts: str) -> DataFrame:
    """Sine and cosine of month, day of week (Monday is 0), hour and minute of an epoch-ms column, UTC."""
    at = F.timestamp_millis(F.col(ts))
    out = {}
    for name, part, period in (("month", F.month(at), 12), ("dow", F.weekday(at), 7), ("hour", F.hour(at), 24), ("minute", F.minute(at), 60)):
        angle = 2 * F.pi() * part / period
        out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    return df.withColumns(out)


def split_by_time(df: DataFrame, ts: str, train: float, val: float, span: int = blocks.SPAN) -> DataFrame:
    """``df`` with ``part``: train, then val, then test rows by time, sizes as whole shares of the count."""
    require_split_sizes(train, val, 1 - train - val)
    n = df.count()
    if not n:
        raise ValidationError("nothing to split")
    a, b = int(n * train), int(n * train) + int(n * val)
    part = F.when(F.col("__i") < a, "train").when(F.col("__i") < b, "val").otherwise("test")
    return S.row_index(df, [], ts, span, "__i").withColumn("part", part).drop("__i")


def split_at_random(df: DataFrame, key: str, train: float, val: float, seed: int = 42) -> DataFrame:
    """``df`` with ``part`` by the order of a keyed hash; exact sizes, the same for any partitioning."""
    require_split_sizes(train, val, 1 - train - val)
    drawn = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    n = df.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    part = F.when(F.col("__i") < a, "train").when(F.col("__i") < b, "val").otherwise("test")
    indexed = S.row_index(drawn, [], "__h", 1 << 56, "__i")
    return indexed.withColumn("part", part).drop("__i", "__h")


def windows(df: DataFrame, ts: str, past: list[str], future: list[str], static: list[str], target: str, length: int, horizons: tuple[int, ...], stride: int = 1, series: list[str] | None = None, rows: int = 4096, span: int = blocks.SPAN) -> DataFrame:
    """Sliding samples: ``past`` rows of ``length``, ``future`` rows up to the largest horizon, targets at each.

    Samples begin at every ``stride``-th row of a series and are whole.  Series are cut into
    blocks of ``rows`` rows, each with the rows after it that its last samples reach; samples
    are views of a block's columns, and only those that the stride keeps are ever made.
    """
    series = series or []
    ahead = max(horizons)
    reach, used = length + ahead, list(dict.fromkeys([*past, *future, *static, target]))
    rows = max(rows, reach)
    slim = df.select(*series, F.col(ts).alias("start"), *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(used)])
    indexed = S.row_index(slim, series, "start", span, "__i")
    own = F.floor(F.col("__i") / rows)
    copies = F.array_compact(F.array(own, F.when((F.pmod(F.col("__i"), F.lit(rows)) < reach) & (own > 0), own - 1)))
    at = {c: i for i, c in enumerate(used)}
    groups, aims, offsets = [[at[c] for c in cols] for cols in (past, future, static)], at[target], list(horizons)
    kinds = [pa.list_(pa.list_(pa.float32()))] * 2 + [pa.list_(pa.float32()), pa.list_(pa.float64())]

    def nested(x: np.ndarray, known: np.ndarray, kind: pa.DataType) -> pa.Array:
        """Equally long lists (of lists) as an Arrow array."""
        values = pa.array(x.ravel(), pa.float64(), mask=~known.ravel())
        flat = values.cast(pa.float32() if x.ndim == 3 or pa.types.is_float32(kind.value_type) else pa.float64())
        for level in range(x.ndim - 1, 0, -1):
            lists = int(np.prod(x.shape[:level]))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(lists + 1, dtype=np.int32) * x.shape[level]), flat)
        return flat

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        index = table.column("__i").to_numpy()
        block = key[-1].as_py()
        starts = np.flatnonzero((index // rows == block) & (index % stride == 0) & (np.arange(len(index)) + reach <= len(index)))
        cells = [blocks._floats(table.column(f"__v{i}")) for i in range(len(used))]
        values, known = (np.stack([c[j] for c in cells], axis=1) if cells else np.zeros((len(index), 0)) for j in (0, 1))
        steps = [starts[:, None] + np.arange(length), starts[:, None] + np.arange(length, reach)]
        made = [nested(values[s][:, :, g], known[s][:, :, g], kind) for s, g, kind in zip(steps, groups, kinds, strict=False)]
        made.append(nested(values[starts][:, groups[2]], known[starts][:, groups[2]], kinds[2]))
        to = starts[:, None] + length - 1 + np.array(offsets)
        made.append(nested(values[to, aims], known[to, aims], kinds[3]))
        kept = table.take(pa.array(starts))
        return pa.table({**{c: kept.column(c) for c in [*series, "start"]}, **dict(zip(("past", "future", "static", "targets"), made, strict=True))})

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in series), f"start {df.schema[ts].dataType.simpleString()}", "past array<array<float>>, future array<array<float>>, static array<float>, targets array<double>"])
    return indexed.withColumn("__b", F.explode(copies)).groupBy(*series, "__b").applyInArrow(run, schema)


def split_windows(samples: DataFrame, train: float, val: float, span: int = blocks.SPAN) -> DataFrame:
    """Samples with ``part`` by their start: train, then val, then test; what a later part sees, an earlier one may have seen in its future rows."""
    return split_by_time(samples, "start", train, val, span)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def quantile_groups(df: DataFrame, x: str, groups: int) -> DataFrame:
    """``df`` with ``group`` 0..groups-1 by exact quantile edges, right-closed, the first one closed."""
    edges = exact_quantiles(df, {"x": F.col(x)}, tuple(i / groups for i in range(1, groups)))["x"]
    above = [F.when(F.col(x) > F.lit(e), 1).otherwise(0) for e in edges if e is not None]
    return df.withColumn("group", sum(above[1:], above[0]) if above else F.lit(0))
