"""Smoothing of periodic fields by the nearest spline."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import splines
from .summary import Summary, summarize


def design_matrix(spark: SparkSession, n: int, intervals: int, degree: int, derivative: int = 0) -> np.ndarray:
    """The splines' values at the n points of an even grid; n times degree + 1 entries come to the driver."""
    out = np.zeros((n, intervals))
    for r in splines.design(spark.range(n), "id", F.col("id") / n, intervals, degree, derivative).collect():
        out[r["row"], r["col"]] += r["val"]
    return out


def smoothed(snapshots: DataFrame, n: int, intervals: int, degree: int = 5, u: str = "u") -> DataFrame:
    """snapshots with each array of n values replaced by the spline that is nearest to it (the shortest, if many are).

    The grid is shared, so that is one small matrix for all rows.
    """
    b = design_matrix(snapshots.sparkSession, n, intervals, degree)
    hat = b @ np.linalg.pinv(b)

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        out, full = pd.Series([None] * len(values), index=values.index, dtype=object), values.dropna()
        if len(full):
            out.loc[full.index] = pd.Series(list(np.stack(full.to_numpy()) @ hat.T), index=full.index)
        return out

    return snapshots.withColumn(u, run(u))


def dense(entries: DataFrame, columns: int) -> DataFrame:
    """row and theta, the row of a design matrix as an array; a row has degree + 1 entries that are not zero."""
    held = entries.groupBy("row", "col").agg(F.sum("val").alias("val")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("m"))
    return held.select("row", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("int")), F.lit(0.0))).alias("theta"))


def matrix(spark: SparkSession, at: Sequence[float], knots: Sequence[float], degree: int, derivative: int = 0, periodic: bool = False) -> np.ndarray:
    """The dense design matrix at a few positions."""
    points = spark.createDataFrame([(i, float(x)) for i, x in enumerate(at)], "id int, x double")
    out = np.zeros((len(at), len(knots) - degree - 1 - (degree if periodic else 0)))
    for r in splines.on_knots(points, "id", F.col("x"), knots, degree, derivative, periodic=periodic).collect():
        out[r["row"], r["col"]] += r["val"]
    return out


def spline_fit(points: DataFrame, row: str, x: str, y: str, knots: Sequence[float], degree: int, periodic: bool = False, flat_at: Sequence[float] | None = None) -> np.ndarray:
    """Coefficients of the spline nearest to any number of points, the shortest if many are.

    The points are reduced to one triangle by Spark. With flat_at, what the points leave open is settled so that the derivative of order (degree + 1) / 2
    is least at these positions.
    """
    columns = len(knots) - degree - 1 - (degree if periodic else 0)
    entries = splines.on_knots(points, row, F.col(x), knots, degree, periodic=periodic)
    rows = dense(entries, columns).join(points.select(F.col(row).alias("row"), F.col(y).cast("double").alias("y")), "row")
    s: Summary = summarize(rows, [str(k) for k in range(columns)])
    found = np.linalg.lstsq(s.terms, s.target, rcond=1e-12)[0]
    if flat_at is not None:
        _, values, turned = np.linalg.svd(s.terms)
        free = splines.null_space(turned[: int((values > 1e-12 * values.max(initial=0)).sum())])
        if free is not None:
            bend = matrix(points.sparkSession, flat_at, knots, degree, (degree + 1) // 2, periodic)
            found = found - free @ np.linalg.lstsq(bend @ free, bend @ found, rcond=1e-12)[0]
    return found


def spline_values(points: DataFrame, row: str, x: str, coefficients: np.ndarray, knots: Sequence[float], degree: int, derivative: int = 0, periodic: bool = False) -> DataFrame:
    """row and value of the spline, or of its derivative, at each point; the coefficients are as many as the splines."""
    held = F.array(*[F.lit(float(c)) for c in coefficients])
    entries = splines.on_knots(points, row, F.col(x), knots, degree, derivative, periodic=periodic)
    return entries.groupBy("row").agg(F.sum(F.col("val") * F.get(held, F.col("col"))).alias("value"))
