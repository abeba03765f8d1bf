"""Arrays of one row, scaled as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def length(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """function of a value that is taken once; an expression inside a lambda would be taken anew for every element."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def standardised(values: Column) -> Column:
    """An array with mean 0 and standard deviation 1; a constant one becomes 0."""
    n = F.size(values)
    spread = lambda mean: F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    moved = lambda mean, by: F.transform(values, lambda x: F.when(by < 1e-14, 0.0).otherwise((x - mean) / by))
    return let(total(values) / n, lambda mean: let(spread(mean), lambda by: moved(mean, by)))


def rescaled(values: Column) -> Column:
    """An array moved to the range from 0 to 1; a constant one becomes 0."""
    moved = lambda low, span: F.transform(values, lambda x: F.when(span < 1e-14, 0.0).otherwise((x - low) / span))
    return let(F.array_min(values), lambda low: let(F.array_max(values) - low, lambda span: moved(low, span)))
