"""Runs of equal values along an order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows that come sorted: a run's first row, stop, length, its number in the task, and whether it is the first or last there.

    The first column is the order, the last one tells whether two rows are alike.
    """
    part, number, held = TaskContext.get().partitionId(), 0, None

    def out(first: pa.RecordBatch, stop: pa.Array, length: np.ndarray, edge: bool = False) -> pa.RecordBatch:
        nonlocal number
        n = np.arange(number, number + len(length))
        number += len(length)
        added = {"stop": stop, "length": pa.array(length), "part": pa.array(np.full(len(n), part, np.int32)), "number": pa.array(n), "edge": pa.array((n == 0) | edge)}
        return pa.RecordBatch.from_arrays([*first.columns, *added.values()], [*first.schema.names, *added])

    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ends = np.append(begins[1:], len(code))
        first, stop, length = batch.take(pa.array(begins)), batch.column(0).take(pa.array(ends - 1)), ends - begins
        if held is not None:
            before, its_stop, its_length = held
            if before.column(before.num_columns - 1)[0].as_py() == code[0]:
                rest = first.slice(1)
                first, length = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(before.columns, rest.columns)], first.schema.names), length.copy()
                length[0] += its_length[0]
            else:
                yield out(before, its_stop, its_length)
        if len(length) > 1:
            yield out(first.slice(0, len(length) - 1), stop.slice(0, len(length) - 1), length[:-1])
        held = first.slice(len(length) - 1), stop.slice(len(length) - 1), length[-1:]
    if held is not None:
        yield out(*held, edge=True)


def plateau_runs(rows: DataFrame, keys: Sequence[str], order: str, value: Column, extra: Sequence[str] = ()) -> DataFrame:
    """keys, value, start, stop, length of the maximal runs of one value within keys.

    extra columns are those of the run's first row. Nulls equal each other. Arrays are values, too. Rows are dealt by ranges of keys and order, so a key with most of the
    rows is spread over tasks; a run that goes on in the next range is put together from its ends.
    """
    keys, tasks = list(keys), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = {f"_k{i}": F.col(k) for i, k in enumerate(keys)} | {f"_x{i}": F.col(c) for i, c in enumerate(extra)}
    alike = F.xxhash64(*[x for k in keys for x in (F.col(k), F.col(k).isNull())], "_value", F.col("_value").isNull())
    one = rows.withColumn("_value", value).select(F.col(order).alias("_start"), F.col("_value"), *[c.alias(n) for n, c in named.items()], alike.alias("_code"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema.fields)
    kind, by = one.schema["_start"].dataType.simpleString(), [f"_k{i}" for i in range(len(keys))]
    dealt = one.repartitionByRange(tasks, *by, "_start").sortWithinPartitions(*by, "_start")
    found = dealt.mapInArrow(_runs, f"{kinds}, stop {kind}, length long, part int, number long, edge boolean")
    # Only a task's first and last run may go on elsewhere: these meet by their keys, all others stay alone.
    alone = F.when(~F.col("edge"), F.struct("part", "number"))
    w = Window.partitionBy(*by, "_alone").orderBy("_start")
    marked = found.withColumn("_alone", alone)
    goes_on = F.col("_code").eqNullSafe(F.lag("_code").over(w)) & (F.lag("part").over(w) < F.col("part"))
    numbered = marked.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    first = [F.min_by("_value", "_start").alias("value"), *[F.min_by(f"_x{i}", "_start").alias(c) for i, c in enumerate(extra)]]
    runs = numbered.groupBy(*by, "_alone", "_run").agg(*first, F.min("_start").alias("start"), F.max("stop").alias("stop"), F.sum("length").alias("length"))
    return runs.select(*[F.col(k).alias(name) for k, name in zip(by, keys)], "value", "start", "stop", "length", *extra)


def first_plateau(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key the run that starts first, one with a value if there is any."""
    pick = F.struct(F.col("value").isNull(), F.col("start"))
    return runs.groupBy(*keys).agg(*[F.min_by(c, pick).alias(c) for c in ("value", "start", "stop", "length")])
