"""Operator 12, whitening of embeddings by spectral divide and conquer.

Rows are reduced to sums, then to products of what is left after centring; both are as small as the
dimension allows, whatever the number of rows. The covariance is taken apart without an eigenvalue routine: the
polar factor of the covariance less a shift, from QDWH iterations, is its sign, half of the sign and the identity is
the projector on the components above the shift, and orthonormal bases of the two invariant subspaces give two
smaller problems, which are split in the same way. The components are broadcast, and rows are projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Entries become whole numbers in these units, from this zero.
UNIT, ZERO = 64.0, 1_000_000
#: Rows that a task multiplies at a time.
ROWS = 4096
EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, its sign, by QR-based dynamically weighted Halley iterations."""
    n, size = len(a), np.abs(a).sum(1).max()
    x, low = a / size, EPS  # no singular value over EPS of the largest is below that; six steps take it to one
    for _ in range(12):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))[0]
        new = q / r * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        moved, x, low = np.abs(new - x).max(), (new + new.T) / 2, min(low * (p + q * low**2) / (1 + r * low**2), 1 - EPS)
        if moved < 1e-14 * n:
            break
    return x


def _parted(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below the shift; None if an eigenvalue is too near to it."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(float(np.trace(projector))))
    if not 0 < k < n or np.abs(projector @ projector - projector).max() > 1e-9:
        return None
    basis = np.linalg.qr(projector @ rng.standard_normal((n, k)))[0]
    whole = np.linalg.qr(projector @ basis, mode="complete")[0]  # one more step sharpens the subspace
    above, below = whole[:, :k], whole[:, k:]
    return (above, below) if np.abs(below.T @ a @ above).max() <= 1e3 * EPS * n * np.abs(a).max() else None


def components(a: np.ndarray, most: int | None = None, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns; at most the first so many.

    Subspaces that hold none of these are not taken further. A part that is a multiple of the identity, to rounding, has any basis.
    """
    n, rng = len(a), np.random.default_rng(seed)
    most, scale = n if most is None else min(most, n), np.abs(a).max(initial=0.0)
    values, vectors = [], []
    todo = [(a, np.eye(n))] if n else []  # the last is the largest by its values
    while todo and sum(map(len, values)) < most:
        part, basis = todo.pop()
        part = (part + part.T) / 2
        own, middle = np.diag(part), float(np.trace(part)) / len(part)
        rest = part - middle * np.eye(len(part))
        if len(part) == 1 or np.abs(rest).max() <= 4 * EPS * len(part) * scale:
            values.append(own.copy())
            vectors.append(basis)
            continue
        spread = float(np.linalg.norm(rest)) / np.sqrt(len(part))
        for shift in (float(np.median(own)), middle, *(middle + spread * s for s in (0.1, -0.1, 0.3, -0.3, 0.03, -0.03, 0.6, -0.6))):
            halves = _parted(part, shift, rng)
            if halves:
                break
        else:  # eigenvalues lie at every shift to rounding: the part is as good as one value
            values.append(own.copy())
            vectors.append(basis)
            continue
        above, below = halves
        todo += [(below.T @ part @ below, basis @ below), (above.T @ part @ above, basis @ above)]
    if not values:
        return np.zeros(0), np.zeros((n, 0))
    found, columns = np.concatenate(values), np.column_stack(vectors)
    order = np.argsort(-found, kind="stable")[:most]
    return found[order], columns[:, order]


def whole(embedding: Column) -> Column:
    """Whether a vector is there and has finite entries only."""
    return F.coalesce(embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """Whole numbers, a row a vector; places that a vector does not reach hold ZERO, as an entry of 0 does."""
    out = np.full((len(column), width), ZERO, np.int64)
    flat = np.floor(UNIT * column.flatten().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64) + ZERO
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], place: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, _numbers(part.column(place), width)


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of partial matrices given as rows i and row: each row number is added up by a task that holds one row at a time."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, np.zeros(width)
        for pdf in frames:
            for i, row in zip(pdf["i"], pdf["row"]):
                if last is not None and i != last:
                    yield pd.DataFrame({"i": [last], "row": [held]})
                    held = np.zeros(width)
                last, held = i, held + np.asarray(row)
        if last is not None:
            yield pd.DataFrame({"i": [last], "row": [held]})

    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Partials of one row number meet in two steps, so that no task reads those of all tasks at once.
    first = parts.withColumn("part", F.pmod("part", F.lit(64))).repartition(tasks, "i", "part").sortWithinPartitions("i", "part").select("i", "row").mapInPandas(fold, "i int, row array<double>")
    found = first.repartition(tasks, "i").sortWithinPartitions("i").mapInPandas(fold, "i int, row array<double>").collect()  # width rows
    out = np.zeros((max((r["i"] for r in found), default=-1) + 1, width))
    for r in found:
        out[r["i"]] += np.asarray(r["row"])
    return out


def _partials(i: list[int], rows: np.ndarray, part: int) -> pd.DataFrame:
    return pd.DataFrame({"i": pd.Series(i, dtype="int32"), "row": list(rows), "part": pd.Series([part] * len(i), dtype="int32")})


def sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension's whole numbers. rows: embedding, all of them whole."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for part, x in _blocks(batches, 0, width):
            n += part.num_rows
            total = [a + int(b) for a, b in zip(total, (x - ZERO).sum(0))]
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, width), pa.int32()), "total": pa.array([str(n), *(str(t + n * ZERO) for t in total)])})

    found = rows.select("embedding").mapInArrow(task, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # width + 1 rows
    by = {r["i"]: int(r["total"]) for r in found}
    return by.get(-1, 0), [by.get(i, 0) for i in range(width)]


def _centre(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers next to the means, and what the means lie above them."""
    near = [(2 * s + n) // (2 * n) for s in total]
    return np.array(near, np.int64), np.array([(s - n * m) / n for s, m in zip(total, near)])


def covariance(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance (divisor n) of the whole numbers, centred before they are multiplied."""
    width, (near, above) = len(total), _centre(n, total)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, any_ = np.zeros((width, width)), False
        for _, x in _blocks(batches, 0, width):
            z, any_ = (x - near) - above, True
            held += z.T @ z
        if any_:
            for i in range(0, width, 512):
                yield pa.RecordBatch.from_pandas(_partials(list(range(i, min(i + 512, width))), held[i : i + 512], TaskContext.get().partitionId()), preserve_index=False)

    v = _added(rows.select("embedding").mapInArrow(task, "i int, row array<double>, part int"), width)
    return (v + v.T) / (2 * n) if len(v) else np.zeros((width, width))


def whiten(table: DataFrame, most: int = 32) -> DataFrame:
    """A row for each vector and component up to most: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    table: vec_id and embedding; other columns are not read. Vectors that are null or hold null or non-finite entries are not rows of the result;
    a shorter vector than the longest counts as having zeros behind its end, an empty one as zeros. Null ids and repeated rows are
    rows like others. A component has the same sign for all rows. Along components in which rows do not differ, to rounding, whitened is null and
    explained 0, and identity_error leaves them out. deviation is exact (decimal). Entries over 2^56 raise an error. No vectors, or none with entries: no rows.
    """
    rows = table.select("vec_id", "embedding").filter(whole(F.col("embedding")))
    width = rows.agg(F.max(F.size("embedding")).alias("w")).first()["w"] or 0
    n, total = sums(rows, width)
    kind = table.schema["vec_id"].dataType.simpleString()
    if not n or not width:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    v = covariance(rows, n, total)
    values, vectors = components(v, most)
    trace = float(np.trace(v))
    real = values > 16 * EPS * max(width, 1) * max(float(values.max(initial=0.0)), 0.0)
    near, above = _centre(n, total)
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
    turn = vectors * scale
    shared = rows.sparkSession.sparkContext.broadcast((near, above, turn, n, total))  # width times most numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, above, turn, n, total = shared.value
        for part, x in _blocks(batches, 1, width):
            z = (x - near) - above
            apart = int(np.abs(x - near).max(initial=0)) + 1
            if n * apart < 1 << 31 and (n * apart) ** 2 * max(width, 1) < 1 << 62:
                y = n * (x - near) - np.array([s - n * int(m) for s, m in zip(total, near)], np.int64)
                far = [str(d) for d in (y * y).sum(1)]
            else:  # numbers too large for 64 bits are exact as Python's own
                left = [s - n * int(m) for s, m in zip(total, near)]
                far = [str(sum((n * int(a) - b) ** 2 for a, b in zip(r, left))) for r in x - near]
            yield pa.RecordBatch.from_pydict({"vec_id": part.column(0), "far": pa.array(far), "white": pa.array(list(z @ turn), pa.list_(pa.float64()))})

    # Written once: the covariance of these numbers and the result both come from here.
    white = cut(rows.mapInArrow(project, f"vec_id {kind}, far string, white array<double>"))
    identity = _identity_error(white, n, real)
    share = [float(x) / trace if trace > 0 and ok else 0.0 for x, ok in zip(values, real)]
    one = F.posexplode(F.arrays_zip(F.col("white").alias("white"), F.array(*map(F.lit, share)).alias("share"), F.array(*[F.lit(bool(r)) for r in real]).alias("real"))).alias("at", "x")
    out = white.select("vec_id", F.col("far").cast("decimal(38,0)").alias("deviation"), one)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.col("x.real"), F.col("x.white")).alias("whitened"), F.col("x.share").alias("explained"), F.lit(identity).cast("double").alias("identity_error"))


def _identity_error(white: DataFrame, n: int, real: np.ndarray) -> float:
    """The largest entry of the whitened rows' covariance less the identity, over the components in which rows differ."""
    k = len(real)
    if not real.any():
        return 0.0

    def add(column: int, mean: np.ndarray | None):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held, any_ = np.zeros((1 if mean is None else k, k)), False
            for batch in batches:
                if batch.num_rows:
                    w, any_ = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, k), True
                    held += w.sum(0, keepdims=True) if mean is None else (w - mean).T @ (w - mean)
            if any_:
                yield pa.RecordBatch.from_pandas(_partials(list(range(len(held))), held, TaskContext.get().partitionId()), preserve_index=False)

        return task

    rows, schema = white.select("white"), "i int, row array<double>, part int"
    mean = _added(rows.mapInArrow(add(0, None), schema), k)[0] / n
    held = _added(rows.mapInArrow(add(0, mean), schema), k) / n - np.eye(k)
    return float(np.abs(held[np.ix_(real, real)]).max())
