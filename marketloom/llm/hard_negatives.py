"""Hard negatives by a vector-approximation file.

Every component is quantised into one of ``CELLS`` cells of its dimension, cut at quantiles,
so a row is a byte a component.  For an anchor a table holds, for each dimension and cell,
the least and the largest product that a component in that cell can give; looking up a row's
cells and summing gives a lower and an upper bound of its score.  Only rows whose bounds do
not rule them out are scored exactly:

* positives: rows of the anchor's label whose upper bound reaches the ``positives``-th largest
  lower bound of those;
* negatives: rows of other labels whose bounds touch the window of a positive, and whose upper
  bound reaches the ``negatives``-th largest lower bound of the rows certainly inside it.

Scores are whole numbers (components are scaled and floored first), and so are cell edges and
bounds: nothing is lost to rounding.

Plan: the file is written in blocks, a row a block; anchors are packed in groups; each task
holds one group and one stripe of blocks, both of bounded size, and prunes with what it has
seen; the survivors are pruned once more an anchor and then meet the exact vectors.  Anchors
are a stated query set against all rows, in blocks.

Of rows with equal vector and label the ``positives + 1`` smallest ids can be chosen, and only
those enter the file; they are limited before the shuffle, so a vector that a third of all
rows share is no hot key.

Defined results: rows with a null id, label or vector, or with a null or non-finite component,
take no part; rows with one id count once (the smallest label, then vector); vectors of other
lengths than the anchor's, and empty ones, have no score; an anchor without positives, and a
positive without negatives, give no row; ties go to the smaller id; scores must fit 53 bits
(else an error); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.scratch import Scratch
from marketloom.llm.skew import spread_join

CELLS = 256
BLOCK = 4096  # rows of a block
GROUP = 256  # anchors of a group
STRIPE = 4  # blocks of a stripe

_FOUND = "anchor long, id long, low long, high long"


def quantised(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, vector): the usable rows, their components times ``scale`` and floored."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = rows.withColumn("__label", label).filter(F.col("__label").isNotNull() & F.col(id_col).isNotNull() & F.coalesce(finite & (F.size(v) > 0), F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(scale * x.cast("double")))
    return usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.struct(F.col("__label").cast("long").alias("label"), whole.alias("vector"))).alias("s")).select("id", "s.label", "s.vector")


def cell_edges(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the smallest and largest whole number of each (dimension, cell).

    Cuts are quantiles; the ends are the true extremes, so that every component is in a cell.
    What comes to the driver is two numbers a dimension and cell.
    """
    parts = rows.select(F.size("vector").alias("size"), F.posexplode("vector").alias("dim", "x"))
    shares = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    found = parts.groupBy("size", "dim").agg(F.min("x"), F.percentile_approx("x", shares, F.lit(5000)), F.max("x")).collect()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size, dim, low, cuts, high in found:
        if size not in out:
            out[size] = np.zeros((size, CELLS), np.int64), np.zeros((size, CELLS), np.int64)
        firsts = np.array([low, *cuts], np.int64)
        out[size][0][dim], out[size][1][dim] = firsts, np.maximum(np.append(firsts[1:], high + 1) - 1, firsts)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def approximation_file(rows: DataFrame, edges: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(size, ids, labels, cells): blocks of at most ``BLOCK`` rows of one length, a byte a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for part in np.split(at, range(BLOCK, len(at), BLOCK)):
                    block = batch.take(pa.array(part))
                    x = _matrix(block.column(2))
                    # the last cell that begins at or below the component; equal cuts leave cells empty
                    cells = np.stack([np.searchsorted(edges[size][0][d, 1:], x[:, d], side="right") for d in range(size)], axis=1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([block.column(0).to_numpy()], pa.list_(pa.int64())), pa.array([block.column(1).to_numpy()], pa.list_(pa.int64())), pa.array([cells.tobytes()], pa.binary())], names=["size", "ids", "labels", "cells"])

    return rows.select("id", "label", "vector").mapInArrow(run, "size int, ids array<long>, labels array<long>, cells binary")


def _tables(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension and cell the least and the largest product with the anchor's component."""
    a, b = anchor[:, None] * low, anchor[:, None] * high
    return np.minimum(a, b), np.maximum(a, b)


def _bounds(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the looked-up products of rows of flat cell numbers."""
    return tuple(t.ravel()[cells].sum(axis=1) for t in tables)  # type: ignore[return-value]


def _top(values: np.ndarray, k: int) -> int | None:
    """The k-th largest value, None if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def _reaching(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the ``k`` best: their upper bound reaches the k-th largest lower bound."""
    least = _top(low, k)
    return np.ones(len(low), bool) if least is None else high >= least


def window(score: int, share: tuple[int, int]) -> tuple[int, int]:
    """The whole numbers x with share[0] * score <= 100 * x <= share[1] * score."""
    return -(-share[0] * score // 100), share[1] * score // 100


def _in_windows(low: np.ndarray, high: np.ndarray, scores: list[int], share: tuple[int, int], k: int) -> np.ndarray:
    """Rows that can be among the ``k`` best of a window."""
    out = np.zeros(len(low), bool)
    for a, b in {window(s, share) for s in scores}:
        touches = (high >= a) & (low <= b)
        least = _top(low[(low >= a) & (high <= b)], k)
        out |= touches if least is None else touches & (high >= least)
    return out


def _scan(blocks: DataFrame, anchors: DataFrame, edges: dict, same_label: bool, k: int, share: tuple[int, int]) -> DataFrame:
    """Candidates (anchor, id, low, high) that the bounds leave, task by task and then anchor by anchor.

    ``anchors`` has id, label, vector and scores (of the positives; unused for positives).
    """
    packed = ["id", "label", "vector", "scores"]
    sized = anchors.withColumn("size", F.size("vector"))
    totals = {r["size"]: (r["n"], 0) for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in blocks.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["size"] in totals:
            totals[r["size"]] = (totals[r["size"]][0], r["n"])
    if not totals:
        return anchors.sparkSession.createDataFrame([], _FOUND)
    counts = F.create_map(*[F.lit(x) for s, (a, b) in totals.items() for x in (s, F.array(F.lit(-(-a // GROUP)), F.lit(max(1, -(-b // STRIPE)))))])
    of = lambda i: counts[F.col("size")][i]  # noqa: E731  groups and stripes of a length
    all_below = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = sized.withColumn("group", F.pmod(F.xxhash64("id"), of(0)).cast("int")).withColumn("stripe", all_below(of(1)))
    met = blocks.filter(F.col("size").isin(list(totals))).withColumn("stripe", F.pmod(F.xxhash64("ids"), of(1)).cast("int")).withColumn("group", all_below(of(0)))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            low, high = edges[key[0].as_py()]
            offsets = np.arange(len(low)) * CELLS
            ids = right.column("ids").combine_chunks().flatten().to_numpy()
            labels = right.column("labels").combine_chunks().flatten().to_numpy()
            cells = np.concatenate([np.frombuffer(c.as_buffer(), np.uint8).reshape(-1, len(low)) for c in right.column("cells")]) + offsets
            by_label = {label: np.flatnonzero(labels == label) for label in np.unique(labels).tolist()}
            for row in left.select(packed).to_pylist():
                tables = _tables(np.array(row["vector"], np.int64), low, high)
                if same_label:
                    at = by_label.get(row["label"], np.zeros(0, np.int64))
                    at = at[ids[at] != row["id"]]
                    a, b = _bounds(cells[at], tables)
                    ok = _reaching(a, b, k)
                else:
                    a, b = _bounds(cells, tables)
                    at = np.flatnonzero(labels != row["label"])
                    a, b = a[at], b[at]
                    ok = _in_windows(a, b, row["scores"], share, k)
                found.append((np.full(int(ok.sum()), row["id"]), ids[at[ok]], a[ok], b[ok]))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4)]
        return pa.table(dict(zip(("anchor", "id", "low", "high"), columns, strict=True)))

    names = ("size", "group", "stripe")
    return asked.select(*names, *packed).groupBy(*names).cogroup(met.groupBy(*names)).applyInArrow(run, _FOUND)


def _pruned(found: DataFrame, scores: DataFrame | None, k: int, share: tuple[int, int]) -> DataFrame:
    """The candidates that all of an anchor's bounds together leave; an anchor has a few from each stripe."""
    least = lambda rows: F.get(F.sort_array(F.transform(rows, lambda x: x["low"]), asc=False), F.lit(k - 1))
    rows = found.groupBy("anchor").agg(F.collect_list(F.struct("id", "low", "high")).alias("rows"))
    if scores is None:
        kept = F.filter("rows", lambda x: x["high"] >= F.coalesce(F.col("least"), x["high"]))
        return rows.withColumn("least", least(F.col("rows"))).select("anchor", F.inline(kept)).select("anchor", "id")
    whole = lambda x: F.call_function("div", x, F.lit(100).cast("long"))  # noqa: E731  scores are not negative here
    ends = F.transform("scores", lambda s: F.struct(whole(share[0] * s + 99).alias("a"), whole(share[1] * s).alias("b")))
    with_least = F.transform(F.col("ends"), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), least(F.filter("rows", lambda x: (x["low"] >= e["a"]) & (x["high"] <= e["b"]))).alias("least")))
    kept = F.filter("rows", lambda x: F.exists("tests", lambda e: (x["high"] >= e["a"]) & (x["low"] <= e["b"]) & (x["high"] >= F.coalesce(e["least"], x["high"]))))
    joined = rows.join(scores.select(F.col("id").alias("anchor"), ends.alias("ends")), "anchor").withColumn("tests", with_least)
    return joined.select("anchor", F.inline(kept)).select("anchor", "id")


def _scored(pairs: DataFrame, rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, id, score): exact scores of candidates; a row that many anchors ask for is spread."""
    ids = spread_join(pairs, rows.select("id", F.col("vector").alias("theirs")), "id")
    both = ids.join(anchors.select(F.col("id").alias("anchor"), F.col("vector").alias("own")), "anchor")
    return both.select("anchor", "id", F.aggregate(F.zip_with("theirs", "own", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))


def _ranked(scored: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` is a condition on ``id``, ``label`` an expression over the columns of ``rows``;
    a negative's score lies between ``share`` per cent of the positive's.
    """
    scratch = Scratch(rows.sparkSession, "hard-negatives")
    usable = scratch.save(quantised(rows, id_col, vector_col, label, scale), "usable")
    widest = usable.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if widest[0] and widest[0] * widest[1] ** 2 >= 1 << 53:
        raise ValueError("scores must fit 53 bits: use a smaller scale")
    same = Window.partitionBy("vector", "label").orderBy("id")
    few = scratch.save(usable.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= positives + 1).drop("r"), "few")
    edges = cell_edges(few)
    blocks = scratch.save(approximation_file(few, edges), "file")
    anchors = scratch.save(usable.filter(is_anchor).withColumn("scores", F.array().cast("array<long>")), "anchors")
    near = scratch.save(_pruned(_scan(blocks, anchors, edges, True, positives, share), None, positives, share), "near")
    best = scratch.save(_ranked(_scored(near, few, anchors), ["anchor"], positives), "positives")
    # the window of a negative score is empty
    scores = best.filter("score >= 0").groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("scores"))
    asking = scratch.save(anchors.drop("scores").join(scores, "id"), "asking")
    far = scratch.save(_pruned(_scan(blocks, asking, edges, False, negatives, share), asking, negatives, share), "far")
    scored = scratch.save(_scored(far, few, asking), "negatives")
    inside = (share[0] * F.col("positive_score") <= 100 * F.col("score")) & (100 * F.col("score") <= share[1] * F.col("positive_score"))
    pairs = best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(scored, "anchor").filter(inside)
    out = _ranked(pairs, ["anchor", "positive_id"], negatives)
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
