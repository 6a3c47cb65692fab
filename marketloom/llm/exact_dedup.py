"""Exact deduplication against a persistent index of digests, with DataFrame functions only.

The index is a table of (digest, keep_id), bucketed and sorted by the SHA-256 digest of
the text, in a folder that outlives the session.  A batch of new rows is reduced to its
distinct digests before anything is shuffled, meets the index in a sort-merge anti-join
whose index side is read bucket by bucket without a shuffle, and what the index lacks is
appended to it, one file a bucket.  So a batch costs its own size and one sequential read
of the index, and no text is ever shuffled to find its copies.

Who stays: of equal texts in one batch the row with the largest id; a text that the index
holds already came with an earlier batch and stays there.  ``deduplicate`` feeds a table in
batches of falling ids, so over the whole table the largest id stays.

Hot groups: a text that makes up a third of all rows is one digest; counts and largest ids
are combined before the shuffle, and the join that brings each row its answer spreads hot
digests over tasks (``skew.spread_join``).

Defined results: null and empty texts are equal; texts are compared byte for byte and whole;
a null id is smaller than every other; of repeated rows with one id and text one stays, in
``unseen`` that whose columns hash lowest; an empty table gives an empty result and leaves
the index as it is; further columns, whatever their names, are not read by ``deduplicate``
and kept by ``unseen``; a null or missing index folder begins an empty index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.scratch import Scratch
from marketloom.llm.skew import spread_join

ROWS_PER_BUCKET = 1_000_000


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, 32 bytes; null reads as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def buckets_for(rows: int) -> int:
    """A power of two with about ``ROWS_PER_BUCKET`` rows a bucket, 16 at least."""
    n = 16
    while n * ROWS_PER_BUCKET < rows:
        n *= 2
    return n


class DigestIndex:
    """The table of digests below ``path``; opened if it is there, else begun with ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint") -> None:
        self.spark, self.path = spark, path.rstrip("/")
        about = self._about()
        self.buckets, self.id_type, self.generation = (buckets, id_type, 0) if about is None else about
        if about is None:
            self._note()
        self._register()

    def _exists(self, folder: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _about(self) -> tuple[int, str, int] | None:
        if not self._exists(f"{self.path}/about"):
            return None
        row = self.spark.read.schema("buckets int, id_type string, generation int").parquet(f"{self.path}/about").orderBy(F.desc("generation")).first()
        return row.buckets, row.id_type, row.generation

    def _note(self) -> None:
        about = self.spark.createDataFrame([(self.buckets, self.id_type, self.generation)], "buckets int, id_type string, generation int")
        about.coalesce(1).write.mode("append").parquet(f"{self.path}/about")

    def _register(self) -> None:
        """The folder as a bucketed table of this session's catalogue."""
        self.table = f"digests_{uuid.uuid4().hex}"
        folder = f"{self.path}/entries-{self.generation}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id {self.id_type}) USING parquet "
                       f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'")

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, rows: DataFrame, id_col: str) -> None:
        """Append the digests of ``rows`` (``digest``, id) that the index lacks, each with its largest id."""
        known = self.entries().select("digest").hint("merge")
        new = rows.groupBy("digest").agg(F.max(id_col).cast(self.id_type).alias("keep_id")).join(known, "digest", "left_anti")
        new.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compact(self, buckets: int | None = None) -> None:
        """Rewrite the index with one sorted file a bucket, in more or fewer buckets if asked; readers of the old files are not disturbed."""
        old = self.entries()
        self.buckets, self.generation = buckets or self.buckets, self.generation + 1
        self._register()
        old.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        self._note()  # only now do new readers find it


def _digests(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, n): the distinct pairs, which no copy makes a hot key, with their rows."""
    return documents.select(F.col(id_col), digest(F.col(text_col)).alias("digest")).groupBy(id_col, "digest").agg(F.count(F.lit(1)).alias("n"))


def unseen(documents: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` whose text the index has not seen, one a text, all columns kept; their digests are appended."""
    scratch = Scratch(documents.sparkSession, "exact-dedup")
    pairs = scratch.save(_digests(documents, id_col, text_col).withColumnRenamed(id_col, "id"), "pairs")
    known = scratch.save(index.entries(), "known")  # what it held before this batch
    index.add(pairs, "id")
    added = index.entries().join(known.select("digest"), "digest", "left_anti")
    added = scratch.save(added, "added")
    name = "digest"
    while name in documents.columns:
        name = f"_{name}"
    marked = documents.withColumn(name, digest(F.col(text_col)))
    same = (marked[name] == added["digest"]) & marked[id_col].eqNullSafe(added["keep_id"])
    kept = marked.join(added.select("digest", "keep_id"), same, "left_semi")
    if not pairs.filter("n > 1").isEmpty():
        every = [f"`{c}`" for c, kind in marked.dtypes if "map<" not in kind and "variant" not in kind]
        kept = kept.groupBy(name, id_col).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in documents.columns]), F.xxhash64(*every)).alias("row")).select("row.*")
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])


def deduplicate(documents: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """One row for each row of ``documents``: id, keep_id, group_size, kept, digest.

    The table goes through the index in ``batches`` of falling ids (cut at quantiles of the
    ids, which have to be numbers if there are several batches).
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    pairs = scratch.save(_digests(documents, id_col, text_col), "pairs")
    if index is None:
        index = DigestIndex(spark, scratch.path("index"), buckets_for(pairs.count()), dict(documents.dtypes)[id_col])
    shares = [i / batches for i in range(1, batches)]
    cuts = pairs.agg(F.percentile_approx(id_col, F.array(*map(F.lit, shares)))).first()[0] if shares else None
    upper = None
    for cut in [*sorted(set(cuts or []), reverse=True), None]:
        part = F.lit(True) if upper is None else F.coalesce(F.col(id_col) < upper, F.lit(True))
        if cut is not None:
            part = part & (F.col(id_col) >= cut)
        index.add(pairs.filter(part), id_col)
        upper = cut
    sizes = scratch.save(pairs.groupBy("digest").agg(F.sum("n").alias("n")), "sizes")
    answers = sizes.withColumnRenamed("n", "group_size").join(index.entries(), "digest")
    told = spread_join(pairs, answers, "digest", counts=sizes)
    each = told.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    kept = (F.col("copy") == 1) & F.col(id_col).eqNullSafe(F.col("keep_id"))
    return each.select(id_col, "keep_id", "group_size", kept.alias("kept"), "digest")
