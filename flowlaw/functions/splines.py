"""B-splines as Columns and as rows of a design matrix: periodic on even knots, or on any knots."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basis(phase: Column, degree: int) -> list[Column]:
    """The degree + 1 splines that are not zero at a phase in [0, 1) between two even knots, first to last.

    Cox and de Boor's recursion on unit knots: each degree's splines are blends of two of the degree below.
    """
    if degree < 0:
        raise ValueError("degree must not be negative")
    out = [F.lit(1.0)]
    for d in range(1, degree + 1):
        raised = []
        for k in range(d + 1):
            left = out[k - 1] * (phase + (d - k)) / d if k else None
            right = out[k] * (F.lit(float(k + 1)) - phase) / d if k < d else None
            raised.append(left + right if left is not None and right is not None else left if left is not None else right)
        out = raised
    return out


def slopes(phase: Column, degree: int) -> list[Column]:
    """The first derivatives of basis(), in units of one knot interval."""
    if degree == 0:
        return [F.lit(0.0)]
    low = basis(phase, degree - 1)
    return [(low[k - 1] if k else F.lit(0.0)) - (low[k] if k < degree else F.lit(0.0)) for k in range(degree + 1)]


def design(points: DataFrame, row: str, x: Column, intervals: int, degree: int, derivative: int = 0) -> DataFrame:
    """row, col, val: the entries of the design matrix at x, a position in [0, 1) of the period.

    Positions outside are wrapped. There are as many splines as intervals; the last ones go on at the start.
    """
    if intervals <= degree:
        raise ValueError("more intervals than the degree are needed")
    if derivative not in (0, 1):
        raise ValueError("derivative must be 0 or 1")
    place = (x - F.floor(x)) * intervals
    cell = F.least(F.floor(place), F.lit(intervals - 1)).cast("int")
    shown = points.select(F.col(row).alias("row"), cell.alias("cell"), (place - cell).alias("phase"))
    values = basis(F.col("phase"), degree) if derivative == 0 else [v * intervals for v in slopes(F.col("phase"), degree)]
    entries = F.array(*[F.struct(F.pmod(F.col("cell") + k, F.lit(intervals)).alias("col"), v.cast("double").alias("val")) for k, v in enumerate(values)])
    return shown.select("row", F.explode(entries).alias("e")).select("row", "e.col", "e.val")


def checked(knots: Sequence[float], degree: int) -> list[float]:
    """The knots, if they make a basis of that degree."""
    if degree < 0:
        raise ValueError("degree must not be negative")
    if len(knots) < 2 * degree + 2:
        raise ValueError("twice as many knots as the degree, and two more, are needed")
    if any(b < a for a, b in zip(knots, knots[1:])) or not knots[degree] < knots[len(knots) - degree - 1]:
        raise ValueError("knots must be sorted and span a range")
    return [float(t) for t in knots]


def on_knots(points: DataFrame, row: str, x: Column, knots: Sequence[float], degree: int, derivative: int = 0, outside: str = "error", periodic: bool = False) -> DataFrame:
    """row, col, val: entries of the design matrix on any sorted knots, of the splines or of a derivative of theirs.

    The range is from the knot of place degree to the one as far from the end. Positions outside it raise an error, are
    wrapped into it ("wrap"), or go on with the first or last polynomial ("extrapolate"). periodic adds the last degree columns to the first ones.
    Null and NaN positions have no entries.
    """
    t, n = checked(knots, degree), len(knots) - degree - 1
    if outside not in ("error", "wrap", "extrapolate"):
        raise ValueError("outside must be error, wrap or extrapolate")
    low, high = t[degree], t[n]
    at = x.cast("double")
    known = F.when(~F.isnan(at), at)
    if outside == "wrap":
        known = low + (known - low) - F.floor((known - low) / (high - low)) * (high - low)
    elif outside == "error":
        known = F.when((known < low) | (known > high), F.raise_error(F.lit("a position is outside the knots")).cast("double")).otherwise(known)
    t_ = F.array(*map(F.lit, t))
    cell = F.least(F.lit(n - 1), F.greatest(F.lit(degree), F.size(F.filter(t_, lambda k: k <= F.col("_x"))) - 1))
    while_wide = max(i for i in range(degree, n) if t[i] < t[i + 1])  # the last place whose interval is not empty
    placed = points.select(F.col(row).alias("row"), known.alias("_x")).filter("_x IS NOT NULL").withColumn("_c", F.least(cell, F.lit(while_wide)))
    knot = lambda k: F.get(t_, F.col("_c") + k)
    over = lambda value, width: F.when(width == 0, 0.0).otherwise(value / width)
    placed = placed.withColumn("_b", F.array(F.lit(1.0)))
    for d in range(1, degree + 1):  # a column for each degree, so that nothing is written out twice
        old = lambda s, d=d: F.get("_b", F.lit(s)) if 0 <= s < d else F.lit(0.0)
        # The spline r of degree d at this interval goes from knot r - d to knot r + 1; the two below end one earlier and begin one later.
        rows = []
        for r in range(d + 1):
            first, second = knot(r) - knot(r - d), knot(r + 1) - knot(r - d + 1)
            if d > degree - derivative:
                rows.append(d * (over(old(r - 1), first) - over(old(r), second)))
            else:
                rows.append(over(old(r - 1) * (F.col("_x") - knot(r - d)), first) + over(old(r) * (knot(r + 1) - F.col("_x")), second))
        placed = placed.withColumn("_b", F.array(*rows))
    if derivative > degree:
        placed = placed.withColumn("_b", F.array(*[F.lit(0.0)] * (degree + 1)))
    columns = n - degree if periodic else n
    entries = placed.select("row", F.col("_c"), F.posexplode("_b").alias("_k", "val"))
    return entries.select("row", F.pmod(F.col("_c") - degree + F.col("_k"), F.lit(columns)).cast("int").alias("col"), "val")


def null_space(matrix: np.ndarray) -> np.ndarray | None:
    """An orthonormal basis (as columns) of what a wide matrix maps to zero; None if it has as many rows as columns."""
    rows, columns = matrix.shape
    return None if rows >= columns else np.linalg.qr(matrix.T, mode="complete")[0][:, rows:]


#: Entries of the second matrix of a product, at most.
SECOND = 100_000


def kronecker(a: DataFrame, b: DataFrame, rows_b: int, cols_b: int, on: Column | None = None) -> DataFrame:
    """Entries of the product of two matrices of rows row, col, val, or of those row pairs that satisfy on (columns a.row and b.row).

    Without on every entry of a meets every one of b; b then has SECOND entries at most and goes to the tasks as one row.
    """
    if on is None:
        if b.limit(SECOND + 1).count() > SECOND:
            raise ValueError(f"the second matrix has over {SECOND} entries")
        one = b.agg(F.collect_list(F.struct("row", "col", "val")).alias("_b"))
        joined = a.alias("a").crossJoin(F.broadcast(one)).select("a.*", F.explode("_b").alias("b"))
        joined = joined.select(F.struct("row", "col", "val").alias("a"), "b")
    else:
        joined = a.alias("a").join(b.alias("b"), on)
    return joined.select((F.col("a.row") * rows_b + F.col("b.row")).alias("row"), (F.col("a.col") * cols_b + F.col("b.col")).alias("col"), (F.col("a.val") * F.col("b.val")).alias("val"))
