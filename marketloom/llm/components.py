"""Connected components of a link table by contraction, all in Spark.

Each round every node points at the smallest node among itself and its neighbours and
links are rewritten to those; stars collapse in one round and chains in about the
logarithm of their length.  Before the rounds every task runs union-find over its own
links, which leaves at most one link a node.  Groups of many nodes are dealt to several
tasks where their root is the key of a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.scratch import Scratch
from marketloom.llm.skew import spread_join


def union_find(pairs: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """(node, smallest node of its set) for every node that is not its set's smallest."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in parent if find(x) != x]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:  # a batch at a time: memory stays bounded
        found = union_find(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["u", "v"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node with a link; links has binary columns u and v."""
    edges = scratch.save(links.select("u", "v").mapInArrow(_forest, "u binary, v binary"), f"{name}-links-0")
    labels = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("root", F.col("node"))
    round_no, old = 0, []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        parent = scratch.save(parent, f"{name}-parent-{round_no}")
        to = lambda side: parent.select(F.col("u").alias(side), F.col("p").alias(f"{side}p"))
        ends = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        edges = spread_join(edges.join(to("u"), "u"), to("v"), "v", counts=ends).select(F.col("up").alias("u"), F.col("vp").alias("v")).filter("u <> v").distinct()
        labels = spread_join(labels, to("root"), "root", "left").select("node", F.coalesce("rootp", "root").alias("root"))
        round_no += 1
        edges = scratch.save(edges, f"{name}-links-{round_no}")
        labels = scratch.save(labels, f"{name}-labels-{round_no}")
        for table in old:
            scratch.drop(table)
        old = [f"{name}-parent-{round_no - 1}", f"{name}-links-{round_no - 1}", f"{name}-labels-{round_no}"]
        old = old[:2] + ([f"{name}-labels-{round_no - 1}"] if round_no > 1 else [])
    return labels
