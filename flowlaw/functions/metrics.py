"""Scores of found terms against true ones, and of values against each other, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(found: Column, true: Column) -> Column:
    """Common members as a share of all, of two arrays taken as sets; two empty ones score 0."""
    union = F.size(F.array_union(found, true))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(found, true)) / union)


def covers(names: Column, true: Column) -> Column:
    """Whether a dictionary has all true terms."""
    return F.size(F.array_except(true, names)) == 0


def relative_error(value: Column, true: Column) -> Column:
    """Aggregate: the distance of value from true in units of the length of true, or of 1 if that is none."""
    length = F.sqrt(F.sum(true * true))
    distance = F.sqrt(F.sum((value - true) * (value - true)))
    return distance / F.when(length < 1e-14, 1.0).otherwise(length)


def significant(coefficients: Column, share: float = 0.01) -> Column:
    """Places (from 0) of the coefficients of an array that are over a share of the largest."""
    size = F.transform(coefficients, F.abs)
    marked = F.transform(size, lambda x, i: F.when(x > share * F.array_max(size), i))
    return F.filter(marked, lambda i: i.isNotNull())


def flagged(names: Column, coefficients: Column, true: Column) -> Column:
    """term, coefficient, right (whether the term is a true one) and a printable line for each term."""
    line = lambda x: F.format_string("  %18s: %+.6f", x["n"], x["c"])
    return F.transform(F.arrays_zip(names.alias("n"), coefficients.alias("c")), lambda x: F.struct(x["n"].alias("term"), x["c"].alias("coefficient"), F.array_contains(true, x["n"]).alias("right"), line(x).alias("line")))
