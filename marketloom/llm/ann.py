"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search.

Equal vectors form one class, so copies neither crowd the lists nor form pairs; a class
remembers its ``k + 1`` smallest ids, all that a result can need.  Classes carry 8-bit
codes of their directions.

Graph: random hyperplanes deal classes into blocks of bounded size, whose best pairs
start the lists; one more deal by a hash of the id gives every class a list, however far
from all others it lies.  NN-descent then joins every class's list and a sample of the lists it
is in (``degree`` fresh and ``degree`` older entries on average, drawn anew each round)
with the codes; neighbours of a common class are compared in tasks where one of the two
entries is fresh, that is of the round before, and pairs better than a list's worst entry
are merged into it.  Rounds end when at most the share ``delta`` of all entries is fresh.

Search: a query starts at its own lists and keeps the ``beam`` best classes seen.  Each
hop joins the ``expand`` best ones not yet expanded with the graph and scores their
neighbours, until no class of its beam is left to expand.  The best ``rescore`` classes are
scored on the original vectors in double precision, and the classes' members are ranked by
(score, smaller id).  A query that has met fewer than ``k`` rows, though there are more, is
answered by scoring all rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite parts
take no part, neither as query nor as candidate; a null id takes no part; repeated rows
count once (of several vectors of one id the smallest); vectors of other lengths than the
query's are no candidates; with fewer than ``k`` candidates all are returned; an empty table
gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.scratch import Scratch
from marketloom.llm.textcore import mix64

BLOCK = 400
DEGREE = 32


def directions(vectors: np.ndarray) -> np.ndarray:
    """8-bit codes of the vectors' directions, row by row; their dot products follow the cosine."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)


def _unit(codes: np.ndarray) -> np.ndarray:
    wide = codes.astype(np.float32)
    return wide / np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-9)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of codes; the products are whole numbers, so a pair scores the same in any block (up to 1040 parts)."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    return (a @ b.T) / np.outer(np.maximum(np.linalg.norm(a, axis=1), 1), np.maximum(np.linalg.norm(b, axis=1), 1))


def _matrix(column: pa.Array) -> np.ndarray:
    """Codes of equal length as rows."""
    if not len(column):
        return np.zeros((0, 1), np.int8)
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0) & (F.size(v) > 0), F.lit(False))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(node, vector, members): one row for each distinct vector; node is its smallest id."""
    distinct = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    w = Window.partitionBy("vector").orderBy("id")
    few = distinct.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)  # limited in map tasks already
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.col("members")[0].alias("node"), "vector", "members")


def _coded(nodes: DataFrame, planes: int, trees: int, seed: int) -> DataFrame:
    """(node, code, leaves): the code, the hyperplane signs of each tree, and a leaf drawn by the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            codes: list[bytes | None] = [None] * len(vectors)
            leaves: list[list[int]] = [[]] * len(vectors)
            for size in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                code = directions(np.array([vectors[i] for i in at], dtype=np.float64))
                normal = np.random.default_rng([seed, size]).normal(size=(size, planes * trees))
                sign = (_unit(code) @ normal > 0).reshape(len(at), trees, planes)
                leaf = (sign * (1 << np.arange(planes))).sum(axis=2)
                drawn = mix64(batch.column(0).to_numpy()[at].view(np.uint64)) & np.uint64((1 << planes) - 1)
                leaf = np.column_stack([leaf, drawn.astype(np.int64)]) + size * (1 << planes)  # other lengths, other leaves
                for j, i in enumerate(at):
                    codes[i], leaves[i] = code[j].tobytes(), leaf[j].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(leaves, pa.list_(pa.int64()))], names=["node", "code", "leaves"])

    return nodes.select("node", "vector").mapInArrow(run, "node long, code binary, leaves array<long>")


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Columns of the ``most`` largest entries of each row."""
    if scores.shape[1] <= most:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(-scores, most - 1, axis=1)[:, :most]


_FOUND = "node long, other long, score float, fresh boolean"


def _start(coded: DataFrame, degree: int) -> DataFrame:
    """Pairs from the blocks: each leaf is cut into parts of about BLOCK classes."""
    leaf = coded.select("node", "code", F.posexplode("leaves").alias("tree", "leaf"))
    parts = leaf.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = leaf.join(parts, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), "parts")).drop("parts")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node, code = table.column("node").to_numpy(), _matrix(table.column("code").combine_chunks())
        score = _cosines(code, code)
        np.fill_diagonal(score, -2)
        at = _best(score, min(degree, max(1, len(node) - 1)))
        row = np.repeat(np.arange(len(node)), at.shape[1])
        col = at.ravel()
        ok = row != col
        return pa.table({"node": node[row[ok]], "other": node[col[ok]], "score": score[row[ok], col[ok]].astype(np.float32), "fresh": np.ones(int(ok.sum()), bool)})

    return dealt.groupBy("tree", "leaf", "part").applyInArrow(run, _FOUND)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal values."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut between groups of their first column, so no group is in two pieces."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0 and (not rest or rest[-1].column(0)[-1].as_py() == keys[0]):
            rest.append(batch)
            continue
        cut = 0 if rest and rest[-1].column(0)[-1].as_py() != keys[0] else int(np.searchsorted(keys, keys[0], side="right"))
        if rest:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            yield pa.Table.from_batches([batch.slice(cut, last - cut)])
        else:
            yield pa.Table.from_batches([batch.slice(0, last)])
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)


def _kept(found: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` best distinct entries of each list, with the list's worst score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            if not table.num_rows:
                continue
            node, other, score, fresh = (table.column(c).to_numpy() for c in ("node", "other", "score", "fresh"))
            order = np.lexsort((fresh, other, node))  # of equal entries, the one that the list had already
            same = np.zeros(len(node), dtype=bool)
            same[1:] = (np.diff(node[order]) == 0) & (np.diff(other[order]) == 0)
            order = order[~same]
            order = order[np.lexsort((other[order], -score[order], node[order]))]
            node, other, score, fresh = node[order], other[order], score[order], fresh[order]
            cut = _runs(node)
            rank = np.arange(len(node)) - np.repeat(cut[:-1], np.diff(cut))
            ok = rank < degree
            size = np.minimum(np.diff(cut), degree)
            worst = np.where(size == degree, score[cut[:-1] + size - 1], np.float32(-2))
            yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(other[ok]), pa.array(score[ok]), pa.array(fresh[ok]), pa.array(np.repeat(worst, size).astype(np.float32))], names=["node", "other", "score", "fresh", "worst"])

    return found.repartition("node").sortWithinPartitions("node").mapInArrow(run, f"{_FOUND}, worst float")


def _both_ways(graph: DataFrame, degree: int, round_no: int) -> DataFrame:
    """(center, node, fresh): the entries of each list and a sample, ``degree`` fresh and ``degree`` older ones on average, of the lists a class is in."""
    back = graph.groupBy(F.col("other").alias("o"), F.col("fresh").alias("f")).agg(F.count(F.lit(1)).alias("lists"))
    draw = F.shiftrightunsigned(F.xxhash64("node", "other", F.lit(round_no)), 34).cast("double") / float(1 << 30)
    sampled = graph.join(back, (F.col("other") == F.col("o")) & (F.col("fresh") == F.col("f"))).filter(draw * F.col("lists") < degree)
    both = graph.select(F.col("node").alias("center"), F.col("other").alias("node"), "fresh").union(sampled.select("other", "node", "fresh"))
    return both.groupBy("center", "node").agg(F.max("fresh").alias("fresh"))


def _round(graph: DataFrame, coded: DataFrame, degree: int, round_no: int) -> DataFrame:
    """Better entries from comparing the neighbours of each class with each other, where one of the two is fresh."""
    worst = graph.select("node", "worst").distinct()
    around = _both_ways(graph, degree, round_no).join(coded.select("node", "code"), "node").join(worst, "node").select("center", "node", "worst", "fresh", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            if not table.num_rows:
                continue
            node, worst, fresh = (table.column(c).to_numpy() for c in ("node", "worst", "fresh"))
            codes = table.column("code").combine_chunks()
            cut, out = _runs(table.column("center").to_numpy()), []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                new = np.flatnonzero(fresh[a:b])
                if not len(new):
                    continue
                own = _matrix(codes.slice(a, b - a))  # of one length around one center
                score = _cosines(own[new], own)
                score[np.arange(len(new)), new] = -2
                i, j = np.nonzero(score > worst[a + new, None])
                out.append((node[a + new[i]], node[a + j], score[i, j]))
                score[:, new] = -2  # both fresh: done above in both directions
                i, j = np.nonzero(score > worst[None, a:b])
                out.append((node[a + j], node[a + new[i]], score[i, j]))
            if out:
                found = [np.concatenate([x[c] for x in out]) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(np.ones(len(found[0]), bool))], names=["node", "other", "score", "fresh"])

    return around.repartition("center").sortWithinPartitions("center").mapInArrow(run, _FOUND)


def build_graph(coded: DataFrame, scratch: Scratch, degree: int, delta: float) -> DataFrame:
    """(node, other, score, fresh, worst): the neighbour lists, after rounds of NN-descent until at most the share ``delta`` of them is fresh."""
    graph, r = scratch.save(_kept(_start(coded, degree), degree), "graph-0"), 0
    while True:
        entries, fresh = graph.agg(F.count(F.lit(1)), F.count(F.when(F.col("fresh"), 1))).first()
        if fresh <= delta * entries:
            return graph
        r += 1
        old = graph.select("node", "other", "score", F.lit(False).alias("fresh"))
        graph = scratch.save(_kept(old.union(_round(graph, coded, degree, r)), degree), f"graph-{r}")
        scratch.drop(f"graph-{r - 1}")


_BEAM = "query long, code binary, nodes array<long>, scores array<float>, expanded array<boolean>"


def _packed(graph: DataFrame, coded: DataFrame, degree: int) -> DataFrame:
    """(center, nodes, codes): the neighbours of each class with their codes, packed in one row."""
    near = _both_ways(graph.withColumn("fresh", F.lit(False)), degree, 0).join(coded.select("node", "code"), "node").select("center", "node", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            if not table.num_rows:
                continue
            center, node, code = table.column("center").to_numpy(), table.column("node").to_numpy(), table.column("code").to_pylist()
            cut = _runs(center)
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(center[cut[:-1]]), pa.array([node[a:b] for a, b in spans], pa.list_(pa.int64())), pa.array([b"".join(code[a:b]) for a, b in spans], pa.binary())], names=["center", "nodes", "codes"])

    return near.repartition("center").sortWithinPartitions("center").mapInArrow(run, "center long, nodes array<long>, codes binary")


def search(queries: DataFrame, graph: DataFrame, coded: DataFrame, scratch: Scratch, degree: int, beam: int, expand: int) -> DataFrame:
    """(query, nodes, scores): the best classes that a greedy search from each query class meets before its beam is expanded."""
    packed = scratch.save(_packed(graph, coded, degree), "packed")
    state = queries.join(coded.select(F.col("node").alias("query"), "code"), "query").select(
        "query", "code", F.array("query").alias("nodes"), F.array(F.lit(1.0).cast("float")).alias("scores"), F.array(F.lit(False)).alias("expanded"))
    state = scratch.save(state, "beam-0")

    def frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            center, query, code, least = [], [], [], []
            for q, c, nodes, scores, done in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                todo = [n for n, d in zip(nodes, done, strict=True) if not d][:expand]  # beams are sorted
                center += todo
                query += [q] * len(todo)
                code += [c] * len(todo)
                least += [scores[-1] if len(scores) >= beam else -2.0] * len(todo)
            yield pa.RecordBatch.from_arrays([pa.array(center, pa.int64()), pa.array(query, pa.int64()), pa.array(code, pa.binary()), pa.array(least, pa.float32())], names=["center", "query", "code", "least"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, found, value = [], [], []
            for q, code, least, nodes, codes in zip(*(batch.column(i) for i in range(5)), strict=True):
                mine = np.frombuffer(code.as_buffer(), np.int8)[None]
                s = _cosines(np.frombuffer(codes.as_buffer(), np.int8).reshape(-1, mine.shape[1]), mine)[:, 0]
                ok = s > least.as_py()
                query.append(q.as_py())
                found.append(nodes.values.to_numpy()[ok])
                value.append(s[ok].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float32()))], names=["query", "found", "value"])

    def advance(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        if not old.num_rows:
            return old
        row = old.slice(0, 1).to_pylist()[0]
        first = [n for n, d in zip(row["nodes"], row["expanded"], strict=True) if not d][:expand]
        nodes = [np.array(row["nodes"], np.int64)] + [x.values.to_numpy() for x in new.column("found") if len(x)]
        scores = [np.array(row["scores"], np.float32)] + [x.values.to_numpy() for x in new.column("value") if len(x)]
        nodes, scores = np.concatenate(nodes), np.concatenate(scores)
        nodes, at = np.unique(nodes, return_index=True)
        order = np.lexsort((nodes, -scores[at]))[:beam]
        nodes, scores = nodes[order], scores[at][order]
        done = {n for n, d in zip(row["nodes"], row["expanded"], strict=True) if d} | set(first)
        out = {"query": [row["query"]], "code": [row["code"]], "nodes": [nodes.tolist()], "scores": [scores.tolist()], "expanded": [[n in done for n in nodes.tolist()]]}
        return pa.table(out, schema=old.schema)

    ended, hop = [], 0
    left = F.exists("expanded", lambda x: ~x)
    while not state.isEmpty():
        hop += 1
        asked = state.mapInArrow(frontier, "center long, query long, code binary, least float")
        met = asked.join(packed, "center").select("query", "code", "least", "nodes", "codes").mapInArrow(score, "query long, found array<long>, value array<float>")
        moved = scratch.save(state.groupBy("query").cogroup(met.groupBy("query")).applyInArrow(advance, _BEAM), f"beam-{hop}")
        ended.append(moved.filter(~left))
        state = moved.filter(left)
    return reduce(DataFrame.union, ended, state).select("query", "nodes", "scores")


def _member_lists(pairs: DataFrame, k: int) -> DataFrame:
    """(query, best): the ``k + 1`` best members (minus, id) of the classes in ``pairs`` (query, qv, vector, members), by cosine in double precision."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    value = dot("vector", "qv") / (F.sqrt(dot("vector", "vector")) * F.sqrt(dot("qv", "qv")))
    scored = pairs.filter(F.size("vector") == F.size("qv")).select("query", value.alias("score"), F.explode("members").alias("id"))
    few = scored.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    return few.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("best"))


def _with_all(short: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each of a few queries (query, qv, size) with every class of its length; the classes are dealt to salts, to which the queries are copied."""
    salts = 64
    dealt = nodes.select("vector", "members", F.size("vector").alias("size"), F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int").alias("salt"))
    return dealt.join(short.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["size", "salt"])


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, degree: int = DEGREE, delta: float = 0.05, beam: int = 400, expand: int = 200, rescore: int = 30, trees: int = 3, seed: int = 11) -> DataFrame:
    """query_id, rank, id and score of the ``k`` nearest rows of each query row."""
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull())
    asked = rows.filter(is_query).select(F.col(id_col).cast("long").alias("query_id")).distinct()
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    nodes = scratch.save(classes(rows, k), "classes")
    count = nodes.count()
    planes = max(0, int(np.ceil(np.log2(max(1, count / BLOCK)))))
    coded = scratch.save(_coded(nodes, planes, trees, seed), "coded")
    graph = build_graph(coded, scratch, degree, delta)
    by_vector = rows.join(asked, F.col("id") == F.col("query_id"), "left_semi").groupBy("id").agg(F.min("vector").alias("vector"))
    of_query = scratch.save(by_vector.join(nodes.select("node", "vector"), "vector").select(F.col("id").alias("query_id"), F.col("node").alias("query")), "asked")
    found = search(of_query.select("query").distinct(), graph, coded, scratch, degree, beam, expand)
    near = found.select("query", F.explode(F.slice("nodes", 1, rescore)).alias("node"))
    side = lambda n, v: nodes.select(F.col("node").alias(n), F.col("vector").alias(v))
    exact = near.join(nodes, "node").join(side("query", "qv"), "query")
    lists = scratch.save(_member_lists(exact, k), "lists")
    # a query's own class gives its other members; k + 1 members are enough for any query
    sizes = nodes.groupBy(F.size("vector").alias("size")).agg(F.sum(F.size("members")).alias("rows"))
    needed = of_query.select("query").distinct().join(side("query", "qv"), "query").join(sizes, F.col("size") == F.size("qv"))
    needed = needed.join(lists.select("query", F.size("best").alias("got")), "query", "left")
    short = scratch.save(needed.filter(F.coalesce("got", F.lit(0)) < F.least("rows", F.lit(k + 1))).select("query", "qv", "size"), "short")
    if not short.isEmpty():
        lists = lists.join(short, "query", "left_anti").union(_member_lists(_with_all(short, nodes), k))
    own = of_query.join(lists, "query").select("query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k).alias("best"))
    out = own.select("query_id", F.posexplode("best").alias("p", "b"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), (-F.col("b.minus")).alias("score"))
