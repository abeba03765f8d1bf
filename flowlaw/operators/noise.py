"""Relative Gaussian noise that depends on a row's id only, not on how rows are dealt to tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import mark


def gauss(*ids: Column, seed: int) -> Column:
    """A standard normal number by Box and Muller's transform of two hashes."""
    a, b = mark(*ids, seed=2 * seed), mark(*ids, seed=2 * seed + 1)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)


def add_noise(rows: DataFrame, columns: Sequence[str], ids: Sequence[str], level: float = 0.01, seed: int = 0) -> DataFrame:
    """rows with level times a column's standard deviation times a normal number added to each value."""
    spread = rows.agg(*[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = rows.crossJoin(F.broadcast(spread))  # one row
    scale = lambda c: F.when(F.col(f"_s_{c}") < 1e-14, 1.0).otherwise(F.col(f"_s_{c}"))
    noisy = {c: F.col(c) + level * scale(c) * gauss(*map(F.col, ids), seed=seed + k) for k, c in enumerate(columns)}
    return joined.withColumns(noisy).drop(*[f"_s_{c}" for c in columns])


def sensor_noise(snapshots: DataFrame, keys: Sequence[str], time: str = "j", level: float = 0.01, seed: int = 0, u: str = "u") -> DataFrame:
    """snapshots with level times the standard deviation of all values of all arrays times a normal number added to each value.

    Each series' first snapshot, where it starts from, stays as it is. keys, which name a series, and time name a snapshot.
    """
    spread = snapshots.select(F.explode(u).alias("v")).agg(F.stddev_pop("v").alias("_s"))
    firsts = snapshots.groupBy(*keys).agg(F.min(time).alias("_first"))
    joined = snapshots.join(firsts, list(keys)).crossJoin(F.broadcast(spread))  # one row
    size = F.when(F.col("_s") < 1e-14, 1.0).otherwise(F.col("_s"))
    moved = F.transform(F.col(u), lambda x, i: x + level * size * gauss(*map(F.col, keys), F.col(time), i, seed=seed))
    return joined.withColumn(u, F.when(F.col(time) == F.col("_first"), F.col(u)).otherwise(moved)).select(snapshots.columns)
