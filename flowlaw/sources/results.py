"""A table of results that grows run by run, so that an interrupted sweep goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import committed


def pending(specs: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """The specs without a result."""
    return specs if done is None else specs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The results so far; None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append(results: DataFrame, path: str, *partitions: str) -> None:
    writer = results.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def store(frame: DataFrame, path: str, *partitions: str) -> DataFrame:
    """frame as a table at path, in folders by the partitions' values; rows and columns are read again from it.

    It is written unless it is there already and was written to its end; what a run that broke off has left is replaced.
    """
    spark = frame.sparkSession
    if not committed(spark, path):
        writer = frame.write.mode("overwrite")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    there = spark.read.parquet(path)
    return there.select([F.col(f.name).cast(f.dataType) if f.name in partitions else F.col(f.name) for f in frame.schema.fields])


def settled(results: DataFrame, keys: Sequence[str], error: str = "error", run: str = "run") -> DataFrame:
    """One row a key: its first success, or else its last failure. A key that several runs have written counts once."""
    order = Window.partitionBy(*keys).orderBy(F.col(error).isNotNull(), F.when(F.col(error).isNull(), F.col(run)).otherwise(-F.col(run)))
    return results.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def resumed(specs: DataFrame, path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of all specs, one row a key, after those without a success have been worked on again.

    work gives a row for each spec, with its keys and a column error, null for a success. Each call is a run with a number of its own and writes its
    rows to a folder of that number; a folder without Spark's mark of its end is from a run that broke off, is not read, and is written anew.
    """
    spark, runs, number = specs.sparkSession, [], 0
    while committed(spark, f"{path}/run={number}"):
        runs.append(f"{path}/run={number}")
        number += 1
    done = settled(spark.read.option("basePath", path).parquet(*runs), keys) if runs else None
    left = pending(specs, done.filter("error IS NULL") if done is not None else None, keys)
    if left.isEmpty():
        return done
    work(left).write.mode("overwrite").parquet(f"{path}/run={number}")
    return settled(spark.read.option("basePath", path).parquet(*runs, f"{path}/run={number}"), keys)
