"""Intermediate tables in the cluster's shared folder.

A written table cuts lineage, so that a lost executor costs a re-read of its
partitions and not a re-run of the job that made them. Tables go when the
driver's JVM ends, or before that at the end of a ``scope`` that made them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_MADE: ContextVar[list[str] | None] = ContextVar("scratch_paths", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and ``path`` in its terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the scratch folder that is removed when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def materialise(df: DataFrame, tag: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` once, to the scratch folder or to ``path``, and read it back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Drop the scratch tables that the block makes when it ends.

    What outlives the block must be written to a path made outside it: a frame
    that still reads the block's tables fails afterwards.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            drop(spark, path)
