"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, in spark.checkpoint.dir.

    Where that is unset and Spark runs on one machine, as in tests, a folder in the warehouse stands in for it; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_cuts").rstrip("/")


_within: ContextVar[str | None] = ContextVar("folder", default=None)
_marked: set[str] = set()


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folder(spark: SparkSession) -> str:
    """Where tables are cut to: a folder of the application, which is removed when it ends, or one of scratch() inside it."""
    home = f"{shared_dir(spark)}/cuts-{spark.sparkContext.applicationId}"
    if home not in _marked:
        files, where = _files(spark, home)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _marked.add(home)
    return _within.get() or home


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut inside the with block is removed at its end; what is built on it must have been written before."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    before = _within.set(path)
    try:
        yield
    finally:
        _within.reset(before)
        files, where = _files(spark, path)
        files.delete(where, True)


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of df, computed once and reread from a table in the shared folder, at path or a new one.

    A written table survives the loss of any executor and frees the shuffle files behind it.
    """
    spark = df.sparkSession
    path = path or f"{folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the given columns only."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")) * F.lit(2.0**-53)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, to be broadcast if it has been counted to hold at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df
