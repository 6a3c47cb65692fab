"""Joins whose left side may hold hot keys.

A key with more than a thousandth of the left rows (or of ``LEAST`` rows, if that is
more) is dealt to several salts, and its right rows are copied to each of them.  There
are at most a thousand such keys, so the list of them that comes to the driver and is
broadcast has a fixed bound; the copies are at most as many as 1000 times a key's right
rows.  Rows with a null key, which meet nothing, are spread as well.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 1000
_MOST_KEYS = 1000


def _hashable(kind: T.DataType) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def _literal(value: Any, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(bytes(value) if isinstance(value, bytearray) else value).cast(kind)


def spread_join(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` (inner, left, left_semi) with the hot keys of ``left`` spread over tasks.

    ``counts`` (the keys and ``n``) spares counting the rows of ``left``.  Salts follow
    from a row's columns, so a task that runs again deals its rows alike.
    """
    keys = [keys] if isinstance(keys, str) else keys
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(*keys, "n")
    seen = Observation()
    top = counts.observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).filter(F.col("n") > LEAST).orderBy(F.desc("n")).limit(_MOST_KEYS).collect()
    bound = max(LEAST, seen.get["rows"] / _MOST_KEYS) if top else LEAST
    hot = [(*(r[k] for k in keys), -(-int(r["n"]) // int(bound))) for r in top if r["n"] > bound]
    if not hot:
        return left.join(right, keys, how)
    names = [f"__{k}" for k in keys]
    rows = [F.struct(*[_literal(v, left.schema[k].dataType).alias(n) for v, k, n in zip(r, keys, names, strict=False)], F.lit(r[-1]).alias("__copies")) for r in hot]
    table = F.broadcast(left.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*rows))))

    def counted(frame: DataFrame) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return frame.join(table, same, "left").drop(*names)

    draw = F.xxhash64(*[F.col(f"`{f.name}`") for f in left.schema if _hashable(f.dataType)])
    salted = counted(left).withColumn("__salt", F.coalesce(F.when(F.col("__copies").isNotNull(), F.pmod(draw, F.col("__copies"))), F.lit(0)).cast("int")).drop("__copies")
    copied = counted(right).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__copies") - 1, F.lit(0))))).drop("__copies")
    return salted.join(copied, [*keys, "__salt"], how).drop("__salt")
