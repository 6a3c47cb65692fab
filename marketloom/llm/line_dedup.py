"""Removal of lines that repeat across documents.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lowered.  A key of at least ``min_chars`` code points found in two documents or more
stays only in the document with the smallest id.

Plan: every row gives its distinct 128-bit key hashes; counts and owners are aggregated
(map-side first, so a hot line costs a row a task).  Keys held by one document alone
need no place; the others are cut into shards, and each shard becomes a minimal perfect
hash (levels of collision-free bits) over arrays of 64-bit fingerprints, counts and
owners.  A row sends one packed line of hashes to each shard it touches; these probe
the shard's fingerprints, then its counts, then its owners, so lines are never joined.
Shards that many rows probe are copied to several salts, by the counts just measured, so
a line found in a third of all documents spreads over tasks.

Defined results: a null or empty text has one empty line; rows that share an id count as
one document and each get their own result; a row with a null id counts as a document
of its own (rows with equal texts as one), which never owns a line that a known document
holds; all input columns are kept with ``keep``, and only the named columns are read
otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marketloom.llm import textcore, workers
from marketloom.llm.scratch import Scratch
from marketloom.llm.skew import spread_join

_STRIP = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 1 << 18
PROBES_PER_GROUP = 1 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, or None for a key that is too short."""
    key = line.strip(_STRIP).lower()  # bytes.lower() changes A-Z alone
    if len(key) < 4 * min_chars and (len(key) < min_chars or len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def document_keys(text: str | None, min_chars: int) -> list[bytes]:
    """Distinct key hashes of a text."""
    found = {line_key(x, min_chars) for x in (text or "").encode().split(b"\n")}
    found.discard(None)
    return sorted(found)


def _halves(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(packed, "<u8").reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: each level keeps the keys that fall alone.

    Keys that no level places are listed at the end.
    """

    LEVELS = 48

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest  # rest: rows (hi, lo)
        placed = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])]).astype(np.int64)
        self.ranks = [np.cumsum(x) - 1 + p for x, p in zip(levels, placed[:-1], strict=True)]
        self.placed = int(placed[-1])

    @staticmethod
    def _slot(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        turn = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (textcore.mix64(textcore.mix64(lo + turn) ^ hi) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        levels = []
        while len(hi) and len(levels) < cls.LEVELS:
            size = max(64, int(1.5 * len(hi)))
            slot = cls._slot(hi, lo, len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone)
            hi, lo = hi[~alone[slot]], lo[~alone[slot]]
        return cls(levels, np.stack([hi, lo], 1))

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """A member's own index below the number of keys; any index or -1 for others."""
        out = np.full(len(hi), -1, dtype=np.int64)
        left = np.arange(len(hi))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            slot = self._slot(hi[left], lo[left], level, len(bits))
            hit = bits[slot]
            out[left[hit]] = rank[slot[hit]]
            left = left[~hit]
        for i, (h, low) in enumerate(self.rest):
            out[left[(hi[left] == h) & (lo[left] == low)]] = self.placed + i
        return out

    def packed(self) -> tuple[list[bytes], list[int], bytes]:
        return [np.packbits(x).tobytes() for x in self.levels], [len(x) for x in self.levels], self.rest.tobytes()

    @classmethod
    def unpacked(cls, bits: list[bytes], sizes: list[int], rest: bytes) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(bits, sizes, strict=True)], np.frombuffer(rest, np.uint64).reshape(-1, 2))


_SHARD = "shard int, bits array<binary>, sizes array<int>, rest binary, fingerprints binary, counts binary, nameless binary, owners binary"
_COUNTED = (1 << 16) - 1  # counts beyond are held as this


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    """One shard: the perfect hash of its keys and the arrays it indexes."""
    column = {n: table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in ("hi", "lo", "n", "nameless", "owner")}
    hi, lo = (column[c].astype(np.int64).view(np.uint64) for c in ("hi", "lo"))
    function = PerfectHash.build(hi, lo)
    slot = function.index(hi, lo)
    values = {"fingerprints": hi, "counts": np.minimum(column["n"], _COUNTED).astype(np.uint16), "nameless": column["nameless"].astype(bool), "owners": column["owner"].astype(np.int64)}
    arrays = {}
    for name, value in values.items():
        array = np.zeros(len(hi), value.dtype)
        array[slot] = value
        arrays[name] = [array.tobytes()]
    bits, sizes, rest = function.packed()
    row = {"shard": [key[0].as_py()], "bits": [bits], "sizes": [sizes], "rest": [rest], **arrays}
    binary = [(name, pa.binary()) for name in arrays]
    return pa.table(row, schema=pa.schema([("shard", pa.int32()), ("bits", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("rest", pa.binary()), *binary]))


def _probe(key: tuple, probes: pa.Table, shards: pa.Table) -> pa.Table:
    """The keys that rows of one group must drop: in the arrays, counted twice, and owned by another document."""
    ids: list[int | None] = []
    texts, packed = [], []
    if probes.num_rows and shards.num_rows:
        row = shards.slice(0, 1).to_pylist()[0]
        function = PerfectHash.unpacked(row["bits"], row["sizes"], row["rest"])
        kinds = {"fingerprints": np.uint64, "counts": np.uint16, "nameless": bool, "owners": np.int64}
        array = {n: np.frombuffer(row[n], kind) for n, kind in kinds.items()}
        blobs, nameless = probes.column("keys").to_pylist(), probes.column("id").is_null().combine_chunks().to_numpy(zero_copy_only=False)
        text = probes.column("t").combine_chunks().to_numpy()
        owner = np.where(nameless, text, probes.column("id").fill_null(0).combine_chunks().to_numpy())
        of = np.repeat(np.arange(len(blobs)), [len(b) // 16 for b in blobs])
        hi, lo = _halves(b"".join(blobs))
        slot = function.index(hi, lo)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[array["fingerprints"][slot[hit]] == hi[hit]]
        hit = hit[array["counts"][slot[hit]] >= 2]
        hit = hit[(array["owners"][slot[hit]] != owner[of[hit]]) | (array["nameless"][slot[hit]] != nameless[of[hit]])]
        pairs = np.stack([hi[hit], lo[hit]], 1)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(of[hit])) + 1, [len(hit)]]) if len(hit) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i = int(of[hit[a]])
            ids.append(None if nameless[i] else int(owner[i]))
            texts.append(int(text[i]))
            packed.append(pairs[a:b].tobytes())
    return pa.table({"id": pa.array(ids, pa.int64()), "t": pa.array(texts, pa.int64()), "keys": pa.array(packed, pa.binary())})


def repeated_keys(documents: DataFrame, scratch: Scratch, min_chars: int) -> tuple[DataFrame, int]:
    """(hi, lo, n, nameless, owner) of the keys found in two documents or more, and the number of all probes.

    A document is (nameless, id), or (nameless, hash of the text) without an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = [document_keys(x, min_chars) for x in part.column(1).to_pylist()]
                hi, lo = _halves(b"".join(k for keys in found for k in keys))
                take = pa.array(np.repeat(np.arange(part.num_rows), [len(k) for k in found]))
                yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), part.column(0).take(take), part.column(2).take(take)], names=["hi", "lo", "id", "t"])

    seen = Observation()
    keys = documents.mapInArrow(workers.tidy(run, "line_dedup"), "hi long, lo long, id long, t long")
    named, text = F.col("id"), F.when(F.col("id").isNull(), F.col("t"))
    counted = keys.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min(named).alias("a"), F.max(named).alias("b"), F.min(text).alias("c"), F.max(text).alias("d"))
    counted = counted.observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("probes"))
    several = (F.col("a") < F.col("b")) | (F.col("c") < F.col("d")) | (F.col("a").isNotNull() & F.col("c").isNotNull())
    saved = counted.filter(several).select("hi", "lo", "n", F.col("a").isNull().alias("nameless"), F.coalesce("a", "c").alias("owner"))
    return scratch.save(saved, "repeated"), int(seen.get["probes"])


def dropped_keys(documents: DataFrame, scratch: Scratch, min_chars: int, keys_per_shard: int, probes_per_group: int) -> DataFrame:
    """(id, t, keys): packed hashes that each row (id, text, t) must drop."""
    repeated, probes = repeated_keys(documents, scratch, min_chars)
    shards = max(1, -(-repeated.count() // keys_per_shard))
    repeated = repeated.withColumn("shard", F.pmod(F.col("hi"), F.lit(shards)).cast("int"))
    load = F.sum("n") + F.lit(probes / shards)  # the keys that miss are spread evenly
    salted = scratch.save(repeated.groupBy("shard").agg(F.ceil(load / probes_per_group).cast("int").alias("salts")), "salts")
    salts = np.ones(shards, dtype=np.int32)
    for batch in salted.toArrow().to_batches():  # one number a shard
        salts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    known = documents.sparkSession.sparkContext.broadcast(salts)
    built = scratch.save(repeated.groupBy("shard").applyInArrow(_build_shard, _SHARD), "shards")
    built = built.join(salted, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0  # equal rows go to different salts
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                out: list[tuple[int, int, int, bytes]] = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    packed = b"".join(document_keys(text, min_chars))
                    if not packed:
                        continue
                    turn += 1
                    hi, lo = _halves(packed)
                    shard = hi.view(np.int64) % shards
                    pairs = np.stack([hi, lo], 1)
                    for s in np.unique(shard).tolist():
                        out.append((s, textcore.turned(turn, int(known.value[s])), i, pairs[shard == s].tobytes()))
                take = pa.array([x[2] for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in out], pa.int32()) for i in (0, 1)), part.column(0).take(take), part.column(2).take(take), pa.array([x[3] for x in out], pa.binary())], names=["shard", "salt", "id", "t", "keys"])

    sent = documents.mapInArrow(workers.tidy(run, "line_dedup"), "shard int, salt int, id long, t long, keys binary")
    probed = ["shard", "bits", "sizes", "rest", "fingerprints", "counts", "nameless", "owners", "salt"]
    return sent.groupBy("shard", "salt").cogroup(built.select(*probed).groupBy("shard", "salt")).applyInArrow(_probe, "id long, t long, keys binary")


def _row(id_: Column, t: Column) -> Column:
    """A row's id and text in one value, never null; equal only for rows that drop the same lines."""
    return F.struct(F.coalesce(id_, F.lit(-1)).alias("id"), id_.isNull().alias("none"), t.alias("t"))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, keep: bool = False, keys_per_shard: int = KEYS_PER_SHARD, probes_per_group: int = PROBES_PER_GROUP) -> DataFrame:
    """id, n_lines, n_dropped and kept_text of each row; with ``keep`` all input columns, the text replaced."""
    scratch = Scratch(documents.sparkSession, "lines")
    slim = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    drops = dropped_keys(slim, scratch, min_chars, keys_per_shard, probes_per_group)
    # what a row drops is bounded by its own lines; equal rows are one here
    drops = drops.groupBy(_row(F.col("id"), F.col("t")).alias("__row")).agg(F.collect_set("keys").alias("__drops"))
    columns = documents.columns if keep else [id_col]
    rows = documents.select(*[F.col(c) for c in columns], F.col(text_col).alias("__text"), _row(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("__row"))
    counts = slim.groupBy(_row(F.col("id"), F.col("t")).alias("__row")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = spread_join(rows, drops, "__row", "left", counts=counts).drop("__row")
    schema = type(documents.schema)(documents.select(*[F.col(c) for c in columns]).schema.fields[:])
    schema = schema.add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                n, lost, kept = [], [], []
                for text, drop in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    lines = (text or "").encode().split(b"\n")
                    n.append(len(lines))
                    if drop:
                        gone = {b[i : i + 16] for b in drop for i in range(0, len(b), 16)}
                        left = [x for x in lines if line_key(x, min_chars) not in gone]
                        lost.append(len(lines) - len(left))
                        text = b"\n".join(left).decode()
                    else:
                        lost.append(0)
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    done = joined.mapInArrow(workers.tidy(run, "line_dedup"), schema)
    if keep:
        done = done.withColumn(text_col, F.col("kept_text")).drop("n_lines", "n_dropped", "kept_text")
    return done
