"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. Each document gives its set of ``k``-word shingle hashes (64 bits), a 128-bit key of
   the set, and a SuperMinHash signature cut into ``bands`` of ``rows`` values.
2. Documents with equal sets collapse into one class; copies never form pairs.
3. Classes that share a band meet in a bucket.  Each bucket compares one class, the
   smallest by a hash, with all its others, so a bucket of n classes costs n pairs,
   and the pairs are confirmed on the full sets: 100 * |A & B| >= percent * |A | B|.
4. Links are grouped (union-find in tasks, then contraction).  A bucket whose other
   classes lie in one group is done.  In all others, the classes outside the largest
   group are compared with the whole bucket, block against block inside tasks, and the
   links found are grouped once more.  No bucket is capped: every two classes of a
   bucket are either compared or already in one group.

With 24 bands of 4 rows a pair at exactly 0.8 is missed with probability 3e-6.

Band keys, heads, groups and classes that many rows share are dealt to several tasks
(``skew``); the permutations of a long text are drawn a part at a time.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; fewer than k words
are one shingle; null, empty and blank texts have no shingle and are linked with
nothing; repeated rows are copies of each other; a row with a null id takes part, gets
its group's smallest known id and is kept only if the group has no id at all.
``survivors`` keeps exactly one row of each group, and every text without a shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm import textcore, workers
from marketloom.llm.components import components
from marketloom.llm.scratch import Scratch
from marketloom.llm.skew import spread_join

_U = np.uint64
_UNSET = _U((1 << 64) - 1)
_ELEMENTS = 1 << 15  # elements whose permutations are held at a time


def superminhash(elements: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures of several sets at once; values are rank << 56 | fraction.

    Step j draws for every element the j-th place of its own random permutation
    (Fisher-Yates, one swap a step) and a fraction; the place's value becomes the
    smallest j + fraction.  A set is finished when all its values are below j + 1.
    """
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out = np.full((n, size), _UNSET, dtype=_U)
    flat = out.reshape(-1)
    places = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(elements), 1))
    active = np.arange(len(elements))
    for j in range(size):
        if not len(active):
            break
        draw = textcore.mix64(elements[active] + _U((j + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
        k = j + ((textcore.mix64(draw ^ _U(0xE7037ED1A0B428DB)) >> _U(32)) * _U(size - j) >> _U(32)).astype(np.int64)
        place = places[active, k]
        places[active, k] = places[active, j]
        np.minimum.at(flat, doc[active] * size + place, (_U(j) << _U(56)) | (draw >> _U(8)))
        unfinished = (out.max(axis=1) >> _U(56)) > j
        active = active[unfinished[doc[active]]]
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes, offsets) block by block."""
    for first, end, data, offsets in textcore.blocks(column):
        hashes, word_offsets = textcore.words(data, offsets)
        value, cut = textcore.shingles(hashes, word_offsets, k)
        sets = [textcore.distinct(value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield first, end, np.concatenate(sets) if sets else value, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    out = np.empty((len(signature), bands), dtype=_U)
    for b in range(bands):
        key = np.full(len(signature), b + 1, dtype=_U)
        for r in range(rows):
            key = textcore.mix64(key * _U(0xD6E8FEB86659FD93) + signature[:, b * rows + r])
        out[:, b] = key
    return out


def _set_key(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.astype("<u8").tobytes(), digest_size=16).digest()


def _signature(elements: np.ndarray, size: int) -> np.ndarray:
    """The signature of one set, drawn a part of its elements at a time."""
    parts = [elements[i : i + _ELEMENTS] for i in range(0, len(elements), _ELEMENTS)]
    return np.minimum.reduce([superminhash(x, np.array([0, len(x)]), size) for x in parts])


def signatures(documents: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, t, n, node, bands) of each row (id, text, t); node is the key of the set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            nodes: list[bytes | None] = [None] * batch.num_rows
            keys: list[np.ndarray | None] = [None] * batch.num_rows
            for first, _, elements, offsets in shingle_sets(batch.column(1), k):
                counts[first : first + len(offsets) - 1] = np.diff(offsets)
                start = 0
                while start < len(offsets) - 1:  # few permutations at a time
                    end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _ELEMENTS, side="right")) - 1)
                    part = offsets[start : end + 1]
                    own = elements[part[0] : part[-1]]
                    values = _signature(own, bands * rows) if len(own) > _ELEMENTS else superminhash(own, part - part[0], bands * rows)
                    made = band_keys(values, bands, rows).view(np.int64)
                    for i in range(start, end):
                        if offsets[i + 1] > offsets[i]:
                            nodes[first + i] = _set_key(elements[offsets[i] : offsets[i + 1]])
                            keys[first + i] = made[i - start]
                    start = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "t", "n", "node", "bands"])

    return documents.mapInArrow(workers.tidy(run, "near_dedup"), "id long, t long, n long, node binary, bands array<long>")


_BLOOM_BITS = 27  # at most 2**27 bits: 16 MB, whatever the number of candidates


def _bloom(ids: DataFrame) -> np.ndarray:
    """A two-hash Bloom filter of the long column id as packed 64-bit words; its size is bounded."""
    bits = min(_BLOOM_BITS, max(12, int(ids.count()).bit_length() + 4))
    spots = ids.select(F.explode(F.array(*[F.shiftrightunsigned(F.xxhash64("id", F.lit(s)), 64 - bits) for s in (1, 2)])).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("b"))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    for batch in words.toArrow().to_batches():  # at most 2**21 rows
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _row_key(id_: str = "id", t: str = "t") -> Column:
    """A key of a row that is never null: its id and text."""
    return F.xxhash64(F.coalesce(F.col(id_), F.lit(-1 << 63)), F.col(t))


def candidate_sets(documents: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the classes in ``chosen`` (node, id, t): sets are made again from the texts.

    A Bloom filter of fixed size picks the documents, an exact join keeps the right
    classes, one row each; texts are never shuffled.
    """
    words = documents.sparkSession.sparkContext.broadcast(_bloom(chosen.select(_row_key().alias("id"))))
    bits = int(np.log2(len(words.value))) + 6
    spot = lambda s: F.shiftrightunsigned(F.xxhash64(_row_key(), F.lit(s)), 64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = np.ones(batch.num_rows, dtype=bool)
            for c in (2, 3):
                s = batch.column(c).to_numpy()
                maybe &= (words.value[s >> 6] >> (s & 63)) & 1 == 1
            rows = np.flatnonzero(maybe)
            rows = rows[np.unique(batch.column(1).to_numpy()[rows], return_index=True)[1]]  # equal rows give one set
            part = batch.take(pa.array(rows))
            nodes, sets = [], []
            for _, _, elements, offsets in shingle_sets(part.column(0), k):
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    if b > a:
                        nodes.append(_set_key(elements[a:b]))
                        sets.append(elements[a:b].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    made = documents.select("text", _row_key().alias("key"), spot(1).alias("s1"), spot(2).alias("s2")).mapInArrow(workers.tidy(run, "near_dedup"), "node binary, shingles binary")
    return made.join(chosen.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (a, b))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}s"))
    counts = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    joined = spread_join(pairs.join(side("v"), "v"), side("u"), "u", counts=counts).select("u", "v", "us", "vs")
    return joined.mapInArrow(workers.tidy(run, "near_dedup"), "u binary, v binary")


def _grouped(documents: DataFrame, id_col: str, text_col: str, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(id, t, n, node, first) of each row; ``first`` is the row (none, id, t, node) that its group keeps."""
    scratch = Scratch(documents.sparkSession, "near")
    slim = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    signed = scratch.save(signatures(slim, k, bands, rows), "signatures")
    known = signed.filter("node is not null")
    # one row a class: its smallest known id, its size and its number of rows
    classes = known.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("own"), F.max("n").alias("size"), F.count(F.lit(1)).alias("n"))
    classes = scratch.save(classes.select("node", "own", F.col("own.id").alias("id"), F.col("own.t").alias("t"), "size", "n"), "classes")
    # bands are the same in all rows of a class
    one = known.withColumn("key", _row_key()).join(classes.select("node", _row_key().alias("key")), ["node", "key"], "left_semi")
    banded = one.select("node", "n", F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b").select("h", "n")
    shared = scratch.save(shared, "shared")
    members = spread_join(banded, shared.select("h"), "h", "left_semi", counts=shared)
    members = scratch.save(members.select("h", "node", F.col("n").alias("size")).distinct(), "members")
    labels = None
    if not members.isEmpty():
        chosen = scratch.save(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "id", "t"), "chosen")
        sets = scratch.save(candidate_sets(slim, chosen, k), "sets")
        labels = _linked(members, shared, sets, scratch, percent)
    if labels is None:
        grouped = classes.select("node", F.struct("own.none", "own.id", "own.t", "node").alias("first"))
    else:
        rooted = classes.select("node", F.struct("own.none", "own.id", "own.t", "node").alias("own")).join(labels, "node", "left")
        rooted = scratch.save(rooted.withColumn("root", F.coalesce("root", "node")), "rooted")
        grouped = spread_join(rooted, rooted.groupBy("root").agg(F.min("own").alias("first")), "root").select("node", "first")
    nulls = signed.filter("node is null").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return spread_join(signed.select("id", "t", F.col("n").alias("shingles"), "node"), grouped, "node", "left", counts=classes.select("node", "n").union(nulls))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """id, n_shingles, component_id and kept of each row of ``documents``."""
    out = _grouped(documents, id_col, text_col, k, percent, bands, rows)
    component = F.coalesce("first.id", "id")
    return out.select(F.col("id").alias(id_col), F.col("shingles").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def survivors(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """One row of each group with all its columns: the smallest id, or any row of a group without ids.

    Texts without a shingle are in no group and stay.  Of rows with equal id and text the
    one with the smallest hash of all columns stays.
    """
    blank = ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = _grouped(documents, id_col, text_col, k, percent, bands, rows).filter("first is not null")
    kept = out.filter(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t")) & (F.col("node") == F.col("first.node")))
    kept = kept.withColumn("__id", F.coalesce("id", F.lit(-1 << 63))).groupBy("__id", F.col("t").alias("__t")).agg(F.count(F.lit(1)).alias("n"))
    texts = documents.filter(~blank).withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63)), "__t": F.xxhash64(text_col)})
    found = spread_join(texts, kept.withColumnRenamed("n", "__rows"), ["__id", "__t"], counts=kept)
    columns = [F.col(f"`{c}`") for c in documents.columns]
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString()])
    repeated = found.filter("__rows > 1").groupBy("__id", "__t").agg(F.min_by(F.struct(*columns), order).alias("__row")).select("__row.*")
    return found.filter("__rows = 1").select(*columns).unionByName(repeated).unionByName(documents.filter(blank))


def _linked(members: DataFrame, shared: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame | None:
    """(node, root) of all linked classes: one compared with its bucket, then what that leaves open."""
    turn = F.struct(F.xxhash64("node").alias("t"), F.col("node").alias("u"), F.col("size").alias("usize"))
    heads = scratch.save(members.groupBy("h").agg(F.min(turn).alias("first")).select("h", "first.u", "first.usize"), "heads")
    pairs = spread_join(members, heads, "h", counts=shared).filter("node <> u")
    near = 100 * F.least("size", "usize") >= percent * F.greatest("size", "usize")  # else the sets cannot be similar enough
    pairs = scratch.save(pairs.filter(near).select("u", F.col("node").alias("v")).distinct(), "pairs")
    found = scratch.save(confirmed(pairs, sets, percent), "found")
    labels = None if found.isEmpty() else components(found, scratch, "first")
    left = members.join(heads.select("h", F.col("u").alias("node")), ["h", "node"], "left_anti")
    left = left.withColumn("root", F.col("node")) if labels is None else left.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = scratch.save(left, "left")
    more = scratch.save(_closed(left, sets, scratch, percent), "more")
    if more.isEmpty():
        return labels
    return components(more if labels is None else found.union(more), scratch, "last")


_LEFT, _MAIN = 512, 2048  # classes of a block
_SHINGLES = 1 << 21  # and their shingles


def _closed(live: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (u, v) between different groups of the same bucket, none of them lost.

    In each bucket the largest group is the main one.  Only classes outside it have to be
    compared, with all classes of other groups.  Both sides are cut into blocks of bounded
    size, and every two blocks meet in a task, which counts common shingles through an
    inverted index and returns links alone.
    """
    by_root = live.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    shape = by_root.groupBy("h").agg(F.max(F.struct("c", "root", "s")).alias("main"), F.sum("c").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    parts = lambda c, most, s: F.ceil(F.greatest(c / most, s / _SHINGLES))
    shape = scratch.save(shape.select(
        "h", "n", F.col("main.root").alias("main"), parts(F.col("n") - F.col("main.c"), _LEFT, F.col("s") - F.col("main.s")).alias("na"),
        parts(F.col("main.c"), _MAIN, F.col("main.s")).alias("nb")), "shape")
    rows = spread_join(live, shape.drop("n"), "h", counts=shape).withColumn("apart", F.col("root") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("apart"), F.col("na")).otherwise(F.col("nb")))
    rows = rows.withColumn("own", own)
    place = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    until = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    of_apart = F.concat(F.transform(until("nb"), lambda b: place("main", F.col("own"), b)), F.transform(until("na"), lambda x: place("apart", F.least("own", x), F.greatest("own", x))))
    of_main = F.transform(until("na"), lambda a: place("main", a, F.col("own")))
    sent = rows.select("h", "node", "root", "apart", F.explode(F.when(F.col("apart"), of_apart).otherwise(of_main)).alias("p"))
    sent = sent.select("h", "node", "root", "apart", "p.kind", "p.a", "p.b").join(sets, "node")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        nodes, roots = table.column("node").to_pylist(), table.column("root").to_pylist()
        apart = table.column("apart").to_numpy()
        shingles = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
        sizes = np.array([len(x) for x in shingles])
        group = np.unique(np.array(roots, dtype=object), return_inverse=True)[1]
        unique, codes = np.unique(np.concatenate(shingles), return_inverse=True)
        owner = np.repeat(np.arange(len(nodes)), sizes)
        order = np.argsort(codes, kind="stable")
        posting, start = owner[order], np.searchsorted(codes[order], np.arange(len(unique) + 1))
        cut = np.concatenate([[0], np.cumsum(sizes)])
        parent = {i: i for i in range(len(nodes))}
        us, vs = [], []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for first in {g: i for i, g in enumerate(group.tolist())}.items():
            for i in np.flatnonzero(group == first[0]).tolist():
                parent[i] = first[1]
        for i in np.flatnonzero(apart).tolist():
            mine = codes[cut[i] : cut[i + 1]]
            n = start[mine + 1] - start[mine]
            met = posting[np.repeat(start[mine] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            common = np.bincount(met, minlength=len(nodes))
            for j in np.flatnonzero((100 * common >= percent * (sizes[i] + sizes - common)) & (group != group[i])).tolist():
                x, y = find(i), find(j)
                if x != y:  # a link within what is joined already adds nothing
                    parent[x] = y
                    us.append(nodes[i])
                    vs.append(nodes[j])
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return sent.groupBy("h", "kind", "a", "b").applyInArrow(compare, "u binary, v binary")
