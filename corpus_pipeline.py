"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``documents``.  ``run`` writes each stage's result to
the shared folder before the next one reads it.

Defined results: null and empty texts are scored like any other and stay if the classifier
keeps them, lose no line, are no near-duplicates of anything and become one piece holding
the end id; rows without an id are kept apart from each other by line dedup and join no
benchmark match of another row; of repeated rows one stays after near-dedup; ties go to the
smaller id; an empty ``documents`` gives an empty result, an empty ``labels`` a classifier
that gives every document the same score, an empty ``benchmark`` removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, line_dedup, near_dedup, packing, quality
from marketloom.llm.queries import tokenizer_path
from marketloom.llm.sampling import fold
from marketloom.llm.scratch import Scratch

#: Documents scored below are rejected.
QUALITY_THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality_model(docs, labels.filter(fold("doc_id", 5) != 0))
    return quality.score(docs, model, keep=True).filter(F.col("quality_score") >= QUALITY_THRESHOLD).drop("quality_score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, min_chars=10, keep=True)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the smallest id."""
    return near_dedup.survivors(docs, k=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]

#: The classifier cannot be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
