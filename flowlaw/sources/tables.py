"""Reading the tables of a data set and making trajectories of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectory_grid(events: DataFrame, series: str, hour: Column, value: Column, n: int) -> DataFrame:
    """series, j, i, u: values summed by hour; j counts periods of n hours, i the hours in one."""
    rows = events.select(F.col(series).alias("series"), F.floor(hour / n).cast("long").alias("j"), F.pmod(hour, F.lit(n)).cast("int").alias("i"), value.alias("v"))
    return rows.groupBy("series", "j", "i").agg(F.sum("v").alias("u"))


def snapshots(grid: DataFrame, n: int) -> DataFrame:
    """series, j, u: one row a period, with an array of n values; hours without any are 0."""
    rows = grid.groupBy("series", "j").agg(F.map_from_entries(F.collect_list(F.struct("i", "u"))).alias("m"))  # n entries at most
    return rows.select("series", "j", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0))).alias("u"))


def event_hour() -> Column:
    return F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def event_snapshots(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """Trajectories of the event types: hundreds of value units an hour."""
    events = table(spark, sf_dir, "events")
    return snapshots(trajectory_grid(events, "event_type", event_hour(), F.col("value") / 100, n), n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, in spark.checkpoint.dir.

    Where that is unset and Spark runs on one machine, as in tests, a folder in the warehouse stands in for it; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tables").rstrip("/")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def temporary(spark: SparkSession) -> str:
    """A path in the shared folder for a table that is removed when the application ends."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    files, where = _files(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{path}/rows"


def written(frame: DataFrame) -> DataFrame:
    """The rows of a frame, computed once and read again from a table in the shared folder."""
    path = temporary(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def removed(frame: DataFrame) -> None:
    """Takes away what written() wrote; nothing may read it any more."""
    for path in {p.rsplit("/rows/", 1)[0] for p in frame.inputFiles() if "/rows/" in p}:
        files, where = _files(frame.sparkSession, path)
        files.delete(where, True)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    files, where = _files(spark, f"{path.rstrip('/')}/_SUCCESS")
    return files.exists(where)
