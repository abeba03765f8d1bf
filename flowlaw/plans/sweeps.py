"""Sweeps over sets of rows, and reports of how often the right terms were found."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.metrics import jaccard
from ..operators import recovery
from ..operators.summary import FAN, Summary, matrix_of, reduced


#: Rows of an axis of a grid, but the first, at most.
AXIS = 100_000


def grid(*axes: DataFrame) -> DataFrame:
    """All combinations of the axes. All but the first are small tables of distinct values, which is checked, and go to the tasks as they are."""
    out = axes[0]
    for axis in axes[1:]:
        if axis.limit(AXIS + 1).count() > AXIS:
            raise ValueError(f"an axis has over {AXIS} rows")
        out = out.crossJoin(F.broadcast(axis))
    return out


def group_factors(rows: DataFrame, keys: Sequence[str], names: Sequence[str], targets: Sequence[str] = ("y",), salt: int = FAN) -> DataFrame:
    """keys, n, factor: the triangle of [terms | targets] of each group of rows with theta and the targets.

    Tasks sort their rows by key and hold one triangle at a time; those of a group are merged in salted parts, then together, so a group may hold any share of the rows.
    """
    width, schema = len(names) + len(targets), rows.select(*keys).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    arrow = to_arrow_schema(schema)

    def runs(batch: pa.RecordBatch, place: int, counts: np.ndarray | None) -> Iterator[tuple[tuple, np.ndarray, int]]:
        """Key, rows and number of each run of equal keys in a batch."""
        block = matrix_of(batch.column(place), width)
        values = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))]))
        cuts = [0, *[i for i in range(1, len(values)) if values[i] != values[i - 1]], len(values)]
        for a, b in zip(cuts, cuts[1:]):
            yield values[a], block[a:b], b - a if counts is None else int(counts[a:b].sum())

    def reduce(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % salt
        blocks = (x for b in batches if b.num_rows for x in runs(b, len(keys) + 2 if again else len(keys), b.column(len(keys) + 1).to_numpy() if again else None))
        for key, n, factor in reduced(blocks, width):
            whole = factor if len(factor) else np.zeros((1, width))
            named = [pa.array([k] * len(whole), f.type) for k, f in zip(key, arrow)]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*named, pa.array([part] * len(whole), pa.int32()), pa.array([n] + [0] * (len(whole) - 1), pa.int64()), flat], [*keys, "_salt", "n", "row"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (x for b in batches if b.num_rows for x in runs(b, len(keys) + 2, b.column(len(keys) + 1).to_numpy()))
        for key, n, factor in reduced(blocks, width):
            whole = np.vstack([factor, np.zeros((width - len(factor), width))])
            yield pa.RecordBatch.from_arrays([*[pa.array([k], f.type) for k, f in zip(key, arrow)], pa.array([n], pa.int64()), pa.array([whole.ravel()], pa.list_(pa.float64()))], [*keys, "n", "factor"])

    parts = f"{kinds}, _salt int, n long, row array<double>"
    first = rows.select(*keys, F.concat("theta", F.array(*[F.col(t).cast("double") for t in targets])).alias("row")).sortWithinPartitions(*keys).mapInArrow(lambda b: reduce(b, False), parts)
    salted = first.repartition(*keys, "_salt").sortWithinPartitions(*keys).mapInArrow(lambda b: reduce(b, True), parts)
    return salted.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(close, f"{kinds}, n long, factor array<double>")


def of_groups(rows: DataFrame, keys: Sequence[str], names: Sequence[str], function: Callable[[Summary], Sequence[object]], schema: str, targets: Sequence[str] = ("y",), label: str | None = None, isolated: bool = False, seconds: float | None = None) -> DataFrame:
    """keys and the columns of schema: what a function makes of the Summary of each group of rows with theta and targets.

    Each target gives a row, with its name in the column label where that is given; all targets of a group share one triangle. isolated: a group for which the
    function raises an error, or takes longer than so many seconds, has nulls and its error in a column of that name, and the others go on.
    """
    factors, p = group_factors(rows, keys, names, targets), len(names)
    width = p + len(targets)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    columns = [*([label] if label else []), *(c.split()[0] for c in schema.split(", "))]

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for row in pdf.itertuples(index=False):
                factor = np.asarray(row.factor).reshape(width, width)
                s = Summary(factor[:, [*range(p), p + row.target_]], row.n, tuple(names))
                made = (*function(s),) if not isolated else _guarded(function, s, len(columns) - bool(label), seconds)
                found.append((*row[: len(keys)], *([targets[row.target_]] if label else []), *made))
            yield pd.DataFrame(found, columns=[*keys, *columns, *(["error"] if isolated else [])])

    # A group and a target are a piece of work of their own.
    each = factors.withColumn("target_", F.explode(F.array(*map(F.lit, range(len(targets))))))
    if len(targets) > 1:
        each = each.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "target_")
    return each.mapInPandas(fit, ", ".join([kinds, *([f"{label} string"] if label else []), schema, *(["error string"] if isolated else [])]))


def _guarded(function: Callable[[Summary], Sequence[object]], s: Summary, width: int, seconds: float | None) -> tuple:
    """The function's values and no error, or nulls and the error that it raised or that it was stopped with."""

    def stop(*_: object) -> None:
        raise TimeoutError(f"took longer than {seconds} seconds")

    before = signal.signal(signal.SIGALRM, stop) if seconds else None
    try:
        if seconds:
            signal.setitimer(signal.ITIMER_REAL, seconds)
        return (*function(s), None)
    except Exception as e:  # what a key does wrong is a result
        return (*[None] * width, f"{type(e).__name__}: {e}")
    finally:
        if seconds:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)


def identify_groups(rows: DataFrame, keys: Sequence[str], names: Sequence[str], method: str = "ccp", targets: Sequence[str] = ("y",), label: str | None = None, **how: object) -> DataFrame:
    """keys, label if given, and the fields of a result: the terms found for each group of rows with theta and targets."""

    def fit(s: Summary) -> tuple:
        found = recovery.identify(s, method, **how)
        return list(found.names), list(found.coefficients), found.residual

    return of_groups(rows, keys, names, fit, "names array<string>, coefficients array<double>, residual double", targets, label)


def scored(results: DataFrame, true: Sequence[str]) -> DataFrame:
    return results.withColumn("score", jaccard(F.col("names"), F.array(*map(F.lit, true))))


def success(results: DataFrame, row: str, column: str, values: Sequence[object], score: str = "score") -> DataFrame:
    """Of each row value, in a column for each value: how many results scored 1."""
    return results.groupBy(row).pivot(column, list(values)).agg(F.count_if(F.col(score) == 1.0))


def mean_time(results: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.coalesce(F.avg(seconds), F.lit(0.0)).alias("seconds"))
