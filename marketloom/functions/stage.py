"""Tables between the steps of an iterative job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_written: list[str] = []


def _folder(spark) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this process on a local master, else an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="marketloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged_path(spark, name: str) -> str:
    """A new place in the shared folder; ``release`` removes what is there."""
    _written.append(f"{_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again, so that what follows does not repeat its work or its plan."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark) -> None:
    """Remove the staged tables of this process; results not yet read or written become unreadable."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
