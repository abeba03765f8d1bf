"""Fits by least absolute residuals, which gross outliers do not move.

A sum of absolute residuals is the limit of weighted sums of squares whose weights are one over the residuals of the round
before. A round is one pass over the rows: each task takes the residuals of its rows under the coefficients so far, weights the rows and reduces them to a
triangle, for all choices of terms that are fitted at a time, and triangles are merged as in summary.py. What weights may be at most rises round by round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recovery
from ..sources.tables import temporary
from .search import frontier
from .summary import FAN, Summary, Triangle, matrix_of, reduced, triangle

#: The share of the target's absolute sum that counts as noise.
NOISE = 0.1
#: About so many rows give the coefficients from which the rounds over all rows start, if there are more.
START = 1 << 16
SCHEMA = "fit int, part int, n long, loss double, size double, row array<double>"


@dataclass(frozen=True)
class Absolute:
    """A fit by least absolute residuals: the terms' places, their coefficients, the sum of absolute residuals, and the weighted summary of its last round."""

    support: tuple[int, ...]
    coefficients: np.ndarray
    residual: float
    summary: Summary


def flat(rows: DataFrame, p: int) -> DataFrame:
    """x0, x1 and so on, and y, of rows of theta and y; plain columns are read and handed over faster than arrays. Flat rows stay as they are."""
    if "theta" not in rows.columns:
        return rows
    term = lambda i: F.when(F.size("theta") == p, F.col("theta")[i])
    return rows.select(*[term(i).cast("double").alias(f"x{i}") for i in range(p)], F.col("y").cast("double").alias("y"))


def _block(batch: pa.RecordBatch) -> np.ndarray:
    if any(c.null_count for c in batch.columns):
        raise ValueError(f"a row is not an array of {batch.num_columns} numbers")
    block = np.column_stack([c.to_numpy() for c in batch.columns])
    if not np.isfinite(block).all():
        raise ValueError("a term or the target is not a number")
    return block


def _weighted(block: np.ndarray, support: Sequence[int], c: np.ndarray | None, least: float, width: int) -> tuple[float, np.ndarray]:
    """The absolute sum of what the coefficients leave, and the weighted rows of the support's terms and the target."""
    own, loss = np.zeros((len(block), width)), 0.0
    own[:, : len(support)], own[:, -1] = block[:, list(support)], block[:, -1]
    if c is not None:
        left = np.abs(block[:, -1] - block[:, list(support)] @ c)
        loss = float(left.sum())
        own /= np.sqrt(np.maximum(left, least))[:, None]
    return loss, own


def _small_round(block: np.ndarray, supports: Sequence[Sequence[int]], coefficients: Sequence[np.ndarray | None], least: float) -> dict[int, tuple[np.ndarray, int, float, float]]:
    """_round() of a few rows in one place."""
    width, size = max(map(len, supports)) + 1, float(np.abs(block[:, -1]).sum())
    both = [_weighted(block, x, c, least, width) for x, c in zip(supports, coefficients)]
    return {f: (triangle(own), len(block), loss, size) for f, (loss, own) in enumerate(both)} if len(block) else {}


def _round(rows: DataFrame, p: int, supports: Sequence[Sequence[int]], coefficients: Sequence[np.ndarray | None], least: float) -> dict[int, tuple[np.ndarray, int, float, float]]:
    """By fit: the weighted triangle of its terms and the target, the rows, and the absolute sums of what the coefficients left and of the target.

    Weights are one over the residual, at most one over least; without coefficients they are one.
    """
    width = max(map(len, supports)) + 1

    def out(fit: int, n: int, loss: float, size: float, factor: np.ndarray) -> pa.RecordBatch:
        whole = factor if len(factor) else np.zeros((1, width))
        k = len(whole)
        first = lambda x: [x] + [0] * (k - 1)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), width).cast(pa.list_(pa.float64()))
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.array([fit] * k, pa.int32()), pa.array([part] * k, pa.int32()), pa.array(first(n), pa.int64()), pa.array(first(loss), pa.float64()), pa.array(first(size), pa.float64()), flat], ["fit", "part", "n", "loss", "size", "row"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, size, n = [Triangle(width) for _ in supports], [0.0] * len(supports), 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            block = _block(batch)
            n += len(block)
            size += float(np.abs(block[:, -1]).sum())
            for f, (support, c) in enumerate(zip(supports, coefficients)):
                loss, own = _weighted(block, support, c, least, width)
                sums[f] += loss
                held[f].add(own, len(block))
        if n:
            for f, h in enumerate(held):
                yield out(f, n, sums[f], size, h.factor())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by fit; a fit's sums go along with its first row."""
        sums: dict[int, list[float]] = {}

        def blocks() -> Iterator[tuple[int, np.ndarray, int]]:
            for batch in batches:
                if batch.num_rows:
                    block, fits = matrix_of(batch.column(5), width), batch.column(0).to_numpy()
                    counts, loss, size = (batch.column(i).to_numpy() for i in (2, 3, 4))
                    for f in np.unique(fits).tolist():
                        own = fits == f
                        held = sums.setdefault(f, [0.0, 0.0])
                        held[0] += float(loss[own].sum())
                        held[1] += float(size[own].sum())
                        yield f, block[own], int(counts[own].sum())

        for f, n, factor in reduced(blocks(), width):
            yield out(f, n, *sums[f], factor)

    parts = flat(rows, p).mapInArrow(first, SCHEMA).withColumn("part", F.pmod("part", F.lit(FAN)))
    found = parts.repartition("part").sortWithinPartitions("fit").mapInArrow(merge, SCHEMA).toArrow()  # FAN triangles a fit, at most
    fits, block = found.column("fit").to_numpy(), matrix_of(found.column("row").combine_chunks(), width) if found.num_rows else np.zeros((0, width))
    total = lambda name, own: found.column(name).to_numpy()[own].sum()
    return {f: (triangle(block[own]), int(total("n", own)), float(total("loss", own)), float(total("size", own))) for f in range(len(supports)) if (own := fits == f).any()}


def absolute_fits(rows: DataFrame, names: Sequence[str], supports: Sequence[Sequence[int]], rounds: int = 40, shrink: float = 0.3, tolerance: float = 1e-7) -> tuple[list[Absolute], float]:
    """A fit of each choice of terms by least absolute residuals, and the absolute sum of the target.

    rows: theta and y; a null or NaN in either raises an error. All fits of a round share a pass over the rows, so rows that are costly to make should be
    written before. What a residual counts as at least starts at the mean one and shrinks each round to a millionth of the target's mean; from there on rounds go on until no sum
    falls by more than the tolerance, or for so many. If no coefficient moves any more, they end before. Where the sum is nearly flat around its least value, as with few rows, it may end a ten-thousandth above that.
    Without rows all coefficients are 0. Of more than START rows, a sample of about so many is fitted first, and the rounds over all rows, by the same rules for their end, start from its coefficients.
    """
    p, n = len(names), rows.count()
    rows, begin, least = flat(rows, p), None, 0.0
    if n > START:
        table = rows.sample(START / n, seed=29).limit(2 * START).toArrow()
        block = np.column_stack([table.column(i).to_numpy() for i in range(p + 1)])
        block = block[np.isfinite(block).all(1)]
        if len(block) >= START // 2:
            some, size = _descent(lambda c, least: _small_round(block, supports, c, least), names, supports, rounds, shrink, tolerance, None, 0.0)
            begin, floor = [f.coefficients for f in some], 1e-6 * size / len(block)
            fitted = all(np.median(np.abs(block[:, -1] - block[:, list(f.support)] @ f.coefficients)) <= floor for f in some)
            # A sample's coefficients are near those of all rows, so the first rounds, with residuals that count as large ones, are over; where most residuals are nothing, all but the last are.
            least = floor if fitted else max(floor, 0.01 * max(f.residual for f in some) / len(block))
    return _descent(lambda c, least: _round(rows, p, supports, c, least), names, supports, rounds, shrink, tolerance, begin, least)


def _descent(once: Callable[..., dict], names: Sequence[str], supports: Sequence[Sequence[int]], rounds: int, shrink: float, tolerance: float, begin: list[np.ndarray] | None, least: float) -> tuple[list[Absolute], float]:
    """The rounds of absolute_fits(), each by once(coefficients, least); from coefficients to begin with, if there are any."""
    best: list[tuple[float, np.ndarray, Summary] | None] = [None] * len(supports)
    coefficients: list[np.ndarray | None] = list(begin or [None] * len(supports))
    size, before = 0.0, None
    for number in range(2 if begin else 0, rounds + 1):
        held = once(coefficients, max(least, 1e-300))
        if not held:
            return [Absolute(tuple(x), np.zeros(len(x)), 0.0, Summary(np.zeros((len(x) + 1,) * 2), 0, tuple(names[i] for i in x))) for x in supports], 0.0
        size, n = held[0][3], held[0][1]
        for f, support in enumerate(supports):
            if coefficients[f] is not None and (best[f] is None or held[f][2] < best[f][0]):
                best[f] = (held[f][2], coefficients[f], _summary(held[f], support, names))
        losses = [held[f][2] for f in range(len(supports))]
        floor = 1e-6 * size / max(n, 1) or 1e-300
        if before is not None and least <= floor and all(b - a <= tolerance * max(size, 1e-300) for a, b in zip(losses, before)):
            break
        if number:
            before = losses
        least = max(floor, (max(losses) / n if number == 1 else least * shrink)) if number else 0.0
        moved, coefficients = coefficients, [_summary(held[f], x, names).fit(range(len(x)))[0] for f, x in enumerate(supports)]
        if number > 2 and all(np.abs(a - b).max(initial=0) <= 1e-9 * np.abs(b).max(initial=0) for a, b in zip(moved, coefficients)):
            break
        if not number:
            least = size / max(n, 1)
    return [Absolute(tuple(x), b[1], b[0], b[2]) for x, b in zip(supports, best)], size


def _summary(found: tuple[np.ndarray, int, float, float], support: Sequence[int], names: Sequence[str]) -> Summary:
    factor, n = found[0], found[1]
    return Summary(factor[:, [*range(len(support)), -1]], n, tuple(names[i] for i in support))


def best_subset(spark: SparkSession, rows: DataFrame, names: Sequence[str], most: int | None = None, steps: int = 30, threshold: float | None = None, halvings: int = 60, noise: float = NOISE, slack: float = 0.01) -> recovery.Recovery:
    """The smallest support within the least tolerance for the sum of absolute residuals that any support meets.

    The fit of all terms by least absolute residuals gives each row its weight; under these weights the best choices of each number of terms are found by branch and bound, and each is
    fitted by least absolute residuals again. Tolerances are in units of the noise floor, that share of the target's absolute sum, from 100 down to 0.01 of it.
    """
    path = temporary(spark)
    flat(rows, len(names)).write.parquet(path)  # each round is a pass over them
    rows = spark.read.parquet(path)
    everything, size = absolute_fits(rows, names, [list(range(len(names)))])
    s = everything[0].summary
    enough = (1 + slack) * s.fit(range(len(names)))[1]
    points = frontier(spark, s, len(names) if most is None else most, enough)
    fits, _ = absolute_fits(rows, names, [x for _, x, _ in points])
    measured = [(len(f.support), list(f.support), f.residual) for f in fits]
    scale = recovery.tolerances(noise * size, steps=steps)
    support, meta = recovery.stable_choice(measured, scale, halvings, max(0.5 * everything[0].residual, 1e-12 * size), longest=False)
    meta |= {"noise floor": noise * size}
    if support is None:
        support, meta = list(range(len(names))), {**meta, "warning": "no choice meets any tolerance"}
        chosen = everything[0]
    else:
        chosen = next(f for f in fits if sorted(f.support) == support)
    length = np.abs(chosen.coefficients)
    kept = [i for i, c in zip(chosen.support, length) if c > (1e-4 if threshold is None else threshold) * length.max(initial=0)] or list(chosen.support)
    if len(kept) < len(chosen.support):
        chosen = absolute_fits(rows, names, [kept])[0][0]
    return recovery.Recovery("absolute", chosen.support, tuple(names[i] for i in chosen.support), tuple(map(float, chosen.coefficients)), chosen.residual, {k: str(v) for k, v in meta.items()})
