"""What least squares needs of any number of rows: a triangular factor of [terms | targets].

Every task reduces its rows to a triangle. A triangle's rows are rows again, so triangles are merged by the same reduction:
first those that meet in a task of a shuffle, then these in a task of 64, then in one. Each task holds one triangle and one block
of rows, however many come to it. With the factor, the fit of any choice of terms costs a
few small matrix products, as often as a search wants. Sums of squares are not used for it, as they
would square the condition number of terms that differ by many orders of magnitude.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are reduced together, at least; a triangle's own rows if they are more. Tasks of the last step but one.
BLOCK, FAN = 2048, 64


@dataclass(frozen=True)
class Summary:
    """factor: upper triangle of the terms and, last, the target. n: rows. names: of the terms."""

    factor: np.ndarray
    n: int
    names: tuple[str, ...]

    @property
    def terms(self) -> np.ndarray:
        return self.factor[:, :-1]

    @property
    def target(self) -> np.ndarray:
        return self.factor[:, -1]

    @property
    def norms(self) -> np.ndarray:
        length = np.linalg.norm(self.terms, axis=0)
        return np.where(length < 1e-14, 1.0, length)

    def fit(self, chosen: Sequence[int]) -> tuple[np.ndarray, float]:
        """Coefficients of the chosen terms (of least length if they depend on each other), and the residual's length."""
        chosen = list(chosen)
        scaled = self.terms[:, chosen] / self.norms[chosen]
        found = np.linalg.lstsq(scaled, self.target, rcond=np.finfo(float).eps * max(self.n, len(chosen)))[0] if chosen else np.zeros(0)
        return found / self.norms[chosen], float(np.linalg.norm(self.target - scaled @ found))

    def gram(self) -> np.ndarray:
        return self.terms.T @ self.terms

    def only(self, chosen: Sequence[int]) -> Summary:
        """The summary of some terms."""
        return Summary(self.factor[:, [*chosen, -1]], self.n, tuple(self.names[i] for i in chosen))

    def centred(self) -> Summary:
        """All columns less their means, for which the constant term "1" must be among them; that becomes zero."""
        one = self.factor[:, self.names.index("1")]
        return Summary(self.factor - np.outer(one, one @ self.factor) / (one @ one), self.n, self.names)

    def merged(self, other: Summary) -> Summary:
        """The summary of both ones' rows."""
        return Summary(triangle(np.vstack([self.factor, other.factor])), self.n + other.n, self.names)


def triangle(block: np.ndarray) -> np.ndarray:
    """A square triangle with the same products as the block."""
    r, width = np.linalg.qr(block, mode="r"), block.shape[1]
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an Arrow column of arrays that are all of one length."""
    if column.null_count or (column.value_lengths().to_numpy(zero_copy_only=False) != width).any():
        raise ValueError(f"a row is not an array of {width} numbers")
    block = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if not np.isfinite(block).all():
        raise ValueError("a term or the target is not a number")
    return block


class Triangle:
    """Takes rows in blocks of any size and holds their factor, and few rows more."""

    def __init__(self, width: int):
        self.held, self.waiting, self.rows, self.n = np.zeros((0, width)), [], 0, 0
        self.most = max(BLOCK, width)

    def add(self, block: np.ndarray, n: int) -> None:
        for i in range(0, len(block), self.most):
            self.waiting.append(block[i : i + self.most])
            self.rows += len(self.waiting[-1])
            if self.rows >= self.most:
                self._reduce()
        self.n += n

    def _reduce(self) -> None:
        if self.waiting:
            self.held, self.waiting, self.rows = np.linalg.qr(np.vstack([self.held, *self.waiting]), mode="r"), [], 0

    def factor(self) -> np.ndarray:
        self._reduce()
        return self.held


def reduced(batches: Iterator[tuple[object, np.ndarray, int]], width: int) -> Iterator[tuple[object, int, np.ndarray]]:
    """key, n and factor of each run of equal keys in blocks of rows (key, block, number of rows that the block stands for)."""
    last, held = None, None
    for key, block, n in batches:
        if held is None or key != last:
            if held is not None:
                yield last, held.n, held.factor()
            last, held = key, Triangle(width)
        held.add(block, n)
    if held is not None:
        yield last, held.n, held.factor()


def _factor_rows(found: Iterator[tuple[object, int, np.ndarray]], width: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for _, n, factor in found:
        for i in range(0, max(len(factor), 1), 512):
            rows = factor[i : i + 512] if len(factor) else np.zeros((1, width))
            counts = np.zeros(len(rows), np.int64)
            counts[0] = n if i == 0 else 0
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(rows), part, np.int32)), "n": counts, "row": pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), width).cast(pa.list_(pa.float64()))})


def _arrays(column: Column, targets: Sequence[str]) -> Column:
    return F.concat(column, F.array(*[F.col(t).cast("double") for t in targets]))


def _factor(rows: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """The triangle of rows with an array column row, and their number."""
    schema = "part int, n long, row array<double>"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _factor_rows(reduced(((0, matrix_of(b.column(0), width), b.num_rows) for b in batches if b.num_rows), width), width)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _factor_rows(reduced(((0, matrix_of(b.column(2), width), sum(b.column(1).to_pylist())) for b in batches if b.num_rows), width), width)

    parts = rows.mapInArrow(first, schema).repartition("part").mapInArrow(merge, schema)
    if int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) > FAN:
        parts = parts.withColumn("part", F.pmod("part", F.lit(FAN))).repartition(FAN, "part").mapInArrow(merge, schema)
    found = parts.repartition(1).mapInArrow(merge, schema).toArrow()  # the rows of one triangle
    if not found.num_rows:
        return np.zeros((width, width)), 0
    block = found.column("row").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return triangle(block), sum(found.column("n").to_pylist())


def summarize(rows: DataFrame, names: Sequence[str], theta: str = "theta", target: str = "y") -> Summary:
    """The Summary of rows with an array of terms and a target. Rows with a null or NaN in either raise an error."""
    return summarize_targets(rows, names, [target], theta)[target]


def summarize_targets(rows: DataFrame, names: Sequence[str], targets: Sequence[str], theta: str = "theta") -> dict[str, Summary]:
    """The Summary of each of several targets of the same terms, all from one triangle of [terms | targets]."""
    width, p = len(names) + len(targets), len(names)
    factor, n = _factor(rows.select(_arrays(F.col(theta), targets).alias("row")), width)
    return {t: Summary(factor[:, [*range(p), p + i]], n, tuple(names)) for i, t in enumerate(targets)}


def norms(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the Euclidean length of each column, under its name."""
    return rows.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in columns])


def gram(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, value: the sum of the product of each two columns, a before or at b; all in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{i}").alias("value")) for i, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")


def residual(rows: DataFrame, coefficients: dict[str, float], target: str) -> DataFrame:
    """l2, l1: the lengths of what the coefficients leave of the target. A pass over the rows."""
    left = F.col(target)
    for name, c in coefficients.items():
        left = left - F.lit(float(c)) * F.col(name)
    return rows.agg(F.sqrt(F.sum(left * left)).alias("l2"), F.sum(F.abs(left)).alias("l1"))


def normalised(rows: DataFrame, columns: Sequence[str], mean: bool = False) -> DataFrame:
    """rows with each column divided by its length, or with mean by its root mean square; lengths come from one pass and go back as one row."""
    share = F.count("*").cast("double") if mean else F.lit(1.0)
    lengths = rows.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c)) / share).alias(f"_n_{c}") for c in columns])
    joined = rows.crossJoin(F.broadcast(lengths))  # one row
    return joined.withColumns({c: F.col(c) / scale(F.col(f"_n_{c}")) for c in columns}).drop(*[f"_n_{c}" for c in columns])


def scale(length: Column) -> Column:
    """What to divide by: nearly empty columns stay as they are."""
    return F.when(length < 1e-14, 1.0).otherwise(length)
