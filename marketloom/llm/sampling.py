"""Bounded, deterministic training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(modulus)


def bounded_sample(rows: DataFrame, group: str, most: int) -> DataFrame:
    """About ``most`` rows at most for each value of ``group``, chosen by a hash of the whole row.

    The rate comes from exact counts of the groups, so no row with text is sorted or
    shuffled before it is drawn; the choice depends on the rows alone, not on partitions.
    Rows that share an id are drawn apart and equal rows count once, so the bound holds for
    repeated ids and rows as well.  Rows without a group are left out.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect() if r[0] is not None}
    if not counts:
        return rows.limit(0)
    rate = F.create_map(*[F.lit(x) for g, n in sorted(counts.items()) for x in (g, min(1.0, most / n))])
    draw = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns], F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(F.col(group).isNotNull() & (draw < rate[F.col(group)])).distinct()
