"""Least squares with sparse matrices that are tables of row, col, val.

A matrix with any number of rows and columns is never made dense: products with it are joins and sums. The solution of least length comes from
Golub and Kahan's bidiagonalisation. Where rows are a grid of two axes and columns a product of two bases, the matrix is a product,
too, and two small factors and one table of values are all that is needed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import removed, written


def _length(vector: DataFrame, column: str) -> float:
    return float(vector.agg(F.sqrt(F.sum(F.col(column) * F.col(column))).alias("x")).first()["x"] or 0.0)


def least_squares(entries: DataFrame, target: DataFrame, rounds: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """col and x: the solution of least length of the least squares problem with the matrix entries (row, col, val) and the right side target (row, y).

    Entries of one place are added up; null ones count as zero. Rows without entries do nothing, columns without any are not in the result. A round takes two
    passes over the entries, which are kept with their row's number; what goes from task to task are a number for each row and column. Rounds end when the residual is
    orthogonal to all columns, to the tolerance, or after so many. Vectors of each round are tables in the shared folder; the last but one round's are removed.
    """
    summed = entries.groupBy("row", "col").agg(F.sum(F.coalesce("val", F.lit(0.0))).alias("val"))
    cells = written(summed.groupBy("row").agg(F.collect_list(F.struct("col", "val")).alias("cells")))  # a row's own entries, few
    flat = cells.select("row", F.explode("cells").alias("e")).select("row", "e.col", "e.val")
    size = float(flat.agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("x")).first()["x"] or 0.0)
    held: list[list[DataFrame]] = []

    def keep(frame: DataFrame) -> DataFrame:
        held[-1].append(written(frame))
        return held[-1][-1]

    held.append([])
    u = keep(cells.select("row").join(target.groupBy("row").agg(F.sum("y").alias("u")), "row", "left").select("row", F.coalesce("u", F.lit(0.0)).cast("double").alias("u")))
    beta = _length(u, "u")
    back = lambda u, scale: cells.join(u, "row").select(F.explode("cells").alias("e"), "u").groupBy(F.col("e.col").alias("col")).agg((F.sum(F.col("e.val") * F.col("u")) / scale).alias("t"))
    if not beta or not size:
        return flat.select("col").distinct().withColumn("x", F.lit(0.0))
    first = keep(back(u, beta))
    alpha = _length(first, "t")
    if alpha <= tolerance * size:
        return first.select("col", F.lit(0.0).alias("x"))
    columns = keep(first.select("col", (F.col("t") / alpha).alias("v"), (F.col("t") / alpha).alias("w"), F.lit(0.0).alias("x")))
    u_scale, phi, rho = beta, beta, alpha
    for _ in range(rounds):
        held.append([])
        forth = cells.select("row", F.explode("cells").alias("e")).select("row", F.col("e.col").alias("col"), F.col("e.val").alias("val")).join(columns.select("col", "v"), "col").groupBy("row").agg(F.sum(F.col("val") * F.col("v")).alias("t"))
        u = keep(u.join(forth, "row").select("row", (F.col("t") - alpha / u_scale * F.col("u")).alias("u")))
        beta = _length(u, "u")
        turn = float(np.hypot(rho, beta))
        cosine, sine = rho / turn, beta / turn
        step, phi = cosine * phi, sine * phi
        if beta <= 1e-14 * size:
            columns = keep(columns.select("col", (F.col("x") + step / turn * F.col("w")).alias("x")))
            break
        new = keep(columns.join(back(u, beta), "col").select("col", (F.col("t") - beta * F.col("v")).alias("t"), "w", (F.col("x") + step / turn * F.col("w")).alias("x")))
        alpha = _length(new, "t")
        over = alpha if alpha > 1e-14 * size else 1.0
        columns = keep(new.select("col", (F.col("t") / over).alias("v"), (F.col("t") / over - sine * alpha / turn * F.col("w")).alias("w"), "x"))
        rho, u_scale = -cosine * alpha, beta
        for old in held[-2]:
            removed(old)
        if abs(phi * alpha * cosine) <= tolerance * size * max(abs(phi), 1e-300) or alpha <= 1e-14 * size or abs(phi) <= 1e-14 * size:
            break
    return columns.select("col", "x")


def tensor_fit(core: DataFrame, first: np.ndarray, second: np.ndarray) -> DataFrame:
    """k, l, c: the coefficients of the surface that is nearest to values on a grid, of the products of two bases.

    core: i, j, val, the values at grid places, of which there is one for each pair; missing ones count as 0 and repeated ones are added up. first and second: the bases' values at the places of an axis (a row a
    place); both axes are small, the grid of values lies in a table. The product of the two bases, with as many rows as the grid, is never made: the values are multiplied by one axis's
    pseudo-inverse, summed, then by the other's.
    """
    spark = core.sparkSession

    def factor(basis: np.ndarray, place: str, column: str) -> DataFrame:
        inverse = np.linalg.pinv(basis, rcond=1e-12)
        rows = [(int(p), int(c), float(inverse[c, p])) for c in range(inverse.shape[0]) for p in range(inverse.shape[1]) if inverse[c, p]]
        return F.broadcast(spark.createDataFrame(rows, f"{place} int, {column} int, f double"))  # places times columns of one axis

    half = core.join(factor(second, "j", "l"), "j").groupBy("i", "l").agg(F.sum(F.col("val") * F.col("f")).alias("val"))
    return half.join(factor(first, "i", "k"), "i").groupBy("k", "l").agg(F.sum(F.col("val") * F.col("f")).alias("c"))


def surface(coefficients: DataFrame, first: np.ndarray, second: np.ndarray) -> DataFrame:
    """i, j, val: the surface of coefficients k, l, c at the places of both axes."""
    spark = coefficients.sparkSession

    def factor(basis: np.ndarray, place: str, column: str) -> DataFrame:
        rows = [(p, c, float(basis[p, c])) for p in range(basis.shape[0]) for c in range(basis.shape[1]) if basis[p, c]]
        return F.broadcast(spark.createDataFrame(rows, f"{place} int, {column} int, f double"))

    half = coefficients.join(factor(second, "j", "l"), "l").groupBy("k", "j").agg(F.sum(F.col("c") * F.col("f")).alias("c"))
    return half.join(factor(first, "i", "k"), "k").groupBy("i", "j").agg(F.sum(F.col("c") * F.col("f")).alias("val"))


def spline_solve(points: DataFrame, entries: DataFrame, row: str, y: str, bend: DataFrame | None = None, weight: float = 1e-6, **how: float) -> DataFrame:
    """col and x: the spline nearest to the points, whose matrix has entries; the shortest, or with bend the flattest one, up to weight, if many are.

    bend has the entries of a derivative at places of its own: rows that should be zero, and count with a small weight.
    """
    target = points.select(F.col(row).alias("row"), F.col(y).cast("double").alias("y"))
    if bend is not None:
        marked = lambda part, frame: frame.withColumn("row", F.struct(F.lit(part).alias("part"), F.col("row").cast("long").alias("row")))
        entries = marked(0, entries).unionByName(marked(1, bend).withColumn("val", weight * F.col("val")))
        target = marked(0, target)
    return least_squares(entries, target, **how)
