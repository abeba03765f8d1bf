"""Derivatives and filters of periodic fields.

A snapshot is one row with an array of values on an even grid of one period, 2 pi long, so no
derivative needs a shuffle. The odd derivatives of the highest wave that an even grid holds are
zero, as only their imaginary part would be left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def spectrum(weights: Callable[[np.ndarray], np.ndarray]):
    """A function of an array Column: an array of fields, one for each row of weights(k), by which the field's waves k are multiplied.

    Rows of equal length are transformed together, forth once and back once a field; all in one pass over Arrow batches.
    """

    @F.pandas_udf("array<array<double>>")
    def run(values: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        for n, part in values.dropna().groupby(values.dropna().map(len)):
            if n:
                waves = np.fft.rfft(np.stack(part.to_numpy()).astype(float))
                fields = np.stack([np.fft.irfft(waves * w, n) for w in weights(np.arange(n // 2 + 1))], axis=1)
            else:
                fields = np.zeros((len(part), len(weights(np.arange(1))), 0))
            out.loc[part.index] = pd.Series([list(f) for f in fields], index=part.index)
        return out

    return run.asNondeterministic()  # so that it runs once, however often its result is used


def derivatives(orders: Sequence[int]):
    """A function of an array Column: the array of its derivatives of these orders."""
    return spectrum(lambda k: np.stack([(1j * k) ** r for r in orders]))


def derivative(order: int):
    """A function of an array Column: its derivative of that order."""
    return lambda field: F.get(derivatives([order])(field), F.lit(0))


def low_pass(modes: int):
    """A function of an array Column: the field of its waves 0 to modes."""
    return lambda field: F.get(spectrum(lambda k: (k <= modes)[None].astype(float))(field), F.lit(0))


def with_derivatives(snapshots: DataFrame, orders: Sequence[int], u: str = "u") -> DataFrame:
    """snapshots with an array column d<r> for each order r; all come from one transform of the field."""
    once = snapshots.withColumn("_d", derivatives(orders)(F.col(u)))
    return once.withColumns({f"d{r}": F.get("_d", F.lit(i)) for i, r in enumerate(orders)}).drop("_d")


def points(snapshots: DataFrame, arrays: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, i (the place on the grid) and a scalar column for each array: one row a grid point."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return snapshots.select(*keys, F.posexplode(zipped).alias("i", "_v")).select(*keys, "i", *[F.col("_v")[a].alias(a) for a in arrays])


def fourier(grid: DataFrame, keys: Sequence[str], n: int, modes: int, i: str = "i", u: str = "u") -> DataFrame:
    """keys, k, a, b: the cosine and sine sums of each series over its n grid points, for waves 0 to modes.

    Each point adds to a few waves, and the sums are taken before rows are shuffled.
    """
    angle = 2 * math.pi / n * F.col("k") * F.col(i)
    waves = grid.select(*keys, i, u, F.explode(F.sequence(F.lit(0), F.lit(modes))).alias("k"))
    return waves.groupBy(*keys, "k").agg(F.sum(F.col(u) * F.cos(angle)).alias("a"), F.sum(F.col(u) * F.sin(angle)).alias("b"))


def synthesis(waves: DataFrame, keys: Sequence[str], n: int, order: int = 0) -> DataFrame:
    """keys, i, u: the field, or a derivative of it, that the sums of fourier() stand for."""
    k = F.col("k")
    weight = F.when((k == 0) | (2 * k == n), 1.0 / n).otherwise(2.0 / n)
    if order % 2:
        weight = F.when(2 * k == n, 0.0).otherwise(weight)
    turned = {0: (F.col("a"), F.col("b")), 1: (F.col("b"), -F.col("a")), 2: (-F.col("a"), -F.col("b")), 3: (-F.col("b"), F.col("a"))}[order % 4]
    power = F.pow(k.cast("double"), F.lit(float(order))) if order else F.lit(1.0)
    angle = 2 * math.pi / n * k * F.col("i")
    spread = waves.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spread.groupBy(*keys, "i").agg(F.sum(weight * power * (turned[0] * F.cos(angle) + turned[1] * F.sin(angle))).alias("u"))


def neighbours(rows: DataFrame, keys: Sequence[str], order: str, value: str, reach: int = 1) -> DataFrame:
    """rows with before_1, after_1 and so on: the values that stand so many rows before and after within keys, in an order; null where there are none.

    Rows are dealt by ranges of keys and order, so a key with most of the rows is spread, and a task reads its range row by row. Only the first and last rows of a range need rows of other
    ranges: these few, reach at either end of each, come to the driver, and what they lack goes back to them. Of rows with equal keys and order any may be first.
    """
    spark, keys, ks = rows.sparkSession, list(keys), range(1, reach + 1)
    names = [f"{side}_{k}" for side in ("before", "after") for k in ks]
    kept = [c for c in rows.columns if c not in names]
    alike = F.xxhash64(*[x for c in keys for x in (F.col(c), F.col(c).isNull())]) if keys else F.lit(0).cast("long")
    one = rows.select(*kept, alike.alias("_code"), F.col(value).cast("double").alias("_value"))
    added = ", ".join(["_part int", "_place long", "_edge boolean", *(f"{n} double" for n in names)])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in one.schema.fields), added])

    def shifted(pdf: pd.DataFrame) -> pd.DataFrame:
        code, number = pdf["_code"].to_numpy(), pdf["_value"].to_numpy(float)
        for k in ks:
            for side, step in (("before", k), ("after", -k)):
                other, same = np.roll(number, step), np.roll(code, step) == code
                same[:k] &= side == "after"
                same[len(same) - k :] &= side == "before"
                pdf[f"{side}_{k}"] = np.where(same, other, np.nan)
        return pdf

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A batch is put together with the rows held back of those before, whose neighbours after come only now."""
        part, place, held, lead = TaskContext.get().partitionId(), 0, None, 0
        for pdf in frames:
            pdf = pdf.assign(_part=part, _place=np.arange(place, place + len(pdf)))
            place += len(pdf)
            both = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(both) > lead + reach:
                yield shifted(both.copy()).iloc[lead : len(both) - reach].assign(_edge=lambda x: x["_place"] < reach)
                lead = min(reach, len(both) - reach)
                held = both.iloc[len(both) - reach - lead :].reset_index(drop=True)
            else:
                held = both
        if held is not None:
            yield shifted(held.copy()).iloc[lead:].assign(_edge=True)

    ranged = one.repartitionByRange(*[F.col(c) for c in keys], order).sortWithinPartitions(*keys, order)
    found = written(ranged.mapInPandas(scan, schema))
    edges = sorted(found.filter("_edge").select("_part", "_place", "_code", "_value").collect())  # 2 * reach rows a range
    fixes: dict[tuple[int, int], dict[str, float]] = {}
    for at, (part, place, code, _) in enumerate(edges):
        for side, way in (("before", -1), ("after", 1)):
            for k in ks:
                other = at + way * k
                if 0 <= other < len(edges) and edges[other][0] != part and edges[other][2] == code:
                    fixes.setdefault((part, place), {})[f"{side}_{k}"] = edges[other][3]
    lacking = [(p, i, *[x.get(n) for n in names]) for (p, i), x in fixes.items()]
    sent = spark.createDataFrame(lacking, ", ".join(["_part int", "_place long", *(f"_{n} double" for n in names)]))
    joined = found.join(F.broadcast(sent), ["_part", "_place"], "left")
    return joined.select(*kept, *[F.coalesce(F.when(~F.isnan(n), F.col(n)), F.col(f"_{n}")).alias(n) for n in names])


def rates(grid: DataFrame, keys: Sequence[str], step: float, u: str = "u", time: str = "j", name: str = "u_t") -> DataFrame:
    """grid with central differences in time within keys, one-sided at the ends; null where there is one time only. A key may hold any share of the rows."""
    before, after = F.col("before_1"), F.col("after_1")
    slope = F.when(before.isNull(), (after - F.col(u)) / step).when(after.isNull(), (F.col(u) - before) / step).otherwise((after - before) / (2 * step))
    return neighbours(grid, keys, time, u).withColumn(name, slope).drop("before_1", "after_1")


def time_derivative(grid: DataFrame, keys: Sequence[str], step: float, u: str = "u", time: str = "j") -> Column:
    """What rates() gives, as a Column, for keys of few rows: a key's rows come to one task."""
    w = Window.partitionBy(*keys).orderBy(time)
    before, after = F.lag(u).over(w), F.lead(u).over(w)
    return F.when(before.isNull(), (after - F.col(u)) / step).when(after.isNull(), (F.col(u) - before) / step).otherwise((after - before) / (2 * step))


def step_error(grid: DataFrame, keys: Sequence[str], place: str, step: float, u: str = "u", time: str = "j") -> DataFrame:
    """keys and error: how far central differences over doubled steps are from those over single ones, in units of their length.

    Only places and times with two neighbours on either side count.
    """
    near = neighbours(grid, [*keys, place], time, u, 2)
    wide = near.withColumn("_fine", (F.col("after_1") - F.col("before_1")) / (2 * step)).withColumn("_wide", (F.col("after_2") - F.col("before_2")) / (4 * step))
    both = wide.filter("_fine IS NOT NULL AND _wide IS NOT NULL")
    apart = F.col("_wide") - F.col("_fine")
    return both.groupBy(*keys).agg((F.sqrt(F.sum(apart * apart)) / (F.sqrt(F.sum(F.col("_fine") * F.col("_fine"))) + 1e-10)).alias("error"))


def diffuse(snapshots: DataFrame, rate: float, steps: int = 1, u: str = "u") -> DataFrame:
    """Explicit steps of u_t = u_xx on the grid's own spacing; arrays stay in their rows."""
    for _ in range(steps):
        n = F.size(u)
        moved = F.transform(F.col(u), lambda x, i: x + rate * (F.get(F.col(u), F.pmod(i + 1, n)) - 2 * x + F.get(F.col(u), F.pmod(i - 1 + n, n))))
        snapshots = snapshots.withColumn(u, moved)
    return snapshots


def long_derivative(blocks: DataFrame, keys: Sequence[str], block: str, order: int, u: str = "u") -> DataFrame:
    """keys, block and u: a derivative of periodic fields too long for a row, which are given in blocks 0, 1 and so on of equal length, and come back in the same ones.

    The transform is done in two steps. Each task of the first takes the same few places of all blocks and transforms across the blocks; turned by an
    angle of place and wave, the results are dealt out by wave, and each task of the second transforms along the places. There the waves are multiplied, and the
    way back is the same. A task holds blocks times a few places, or one block's places; nobody holds a field. A missing block, or one of another length, raises an error.
    """
    kinds = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    keys = list(keys)
    sized = blocks.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.size(u)).alias("_m"), F.min(F.size(u)).alias("_least"), F.max(block).alias("_top"), F.countDistinct(block).alias("_all"))
    whole = (F.col("_m") == F.col("_least")) & (F.col("_top") == F.col("_n") - 1) & (F.col("_all") == F.col("_n"))
    counted = sized.select(*keys, "_n", F.when(whole, F.col("_m")).otherwise(F.raise_error(F.lit("blocks are missing, repeated or of unequal length")).cast("int")).alias("_m"))
    # So many places go together that a task of the first step holds about as many numbers as a block has.
    wide = blocks.join(counted, keys).withColumn("_w", F.greatest(F.lit(1), F.ceil(F.col("_m") / F.col("_n")).cast("int")))
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.col("_m") / F.col("_w")).cast("int") - 1), lambda c: F.struct(c.alias("c"), F.slice(u, c * F.col("_w") + 1, F.col("_w")).alias("v")))
    cut_up = wide.select(*keys, F.col(block).cast("long").alias("_b"), "_n", "_m", "_w", F.explode(chunks).alias("x")).select(*keys, "_b", "_n", "_m", "_w", "x.c", "x.v")

    def spread(pdf: pd.DataFrame, matrix: np.ndarray, names: str) -> pd.DataFrame:
        """A row for each row of a complex matrix."""
        first = pdf.iloc[0]
        out = pd.DataFrame({**{k: [first[k]] * len(matrix) for k in keys}, names: np.arange(len(matrix)), "_n": first["_n"], "_m": first["_m"], "_w": first["_w"], "c": first["c"]})
        return out.assign(re=list(np.ascontiguousarray(matrix.real)), im=list(np.ascontiguousarray(matrix.imag)))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        n, m, w, c = (int(pdf[x].iloc[0]) for x in ("_n", "_m", "_w", "c"))
        found = np.fft.fft(np.stack(pdf["v"].to_numpy()), axis=0)
        place = c * w + np.arange(found.shape[1])
        return spread(pdf, found * np.exp(-2j * np.pi * np.outer(np.arange(n), place) / (n * m)), "_k")

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        n, m, w, k = (int(pdf[x].iloc[0]) for x in ("_n", "_m", "_w", "_k"))
        line = np.concatenate(pdf["re"].to_list()) + 1j * np.concatenate(pdf["im"].to_list())
        wave, size = k + n * np.arange(m), n * m
        signed = np.where(2 * wave > size, wave - size, wave)
        factor = (1j * signed) ** order
        if order % 2:
            factor = np.where(2 * wave == size, 0, factor)
        back = np.fft.ifft(np.fft.fft(line) * factor)
        back = back * np.exp(2j * np.pi * k * np.arange(m) / size)
        first = pdf.iloc[0]
        parts = [back[i : i + w] for i in range(0, m, w)]
        out = pd.DataFrame({**{x: [first[x]] * len(parts) for x in keys}, "_k": k, "_n": n, "_m": m, "_w": w, "c": np.arange(len(parts))})
        return out.assign(re=[p.real for p in parts], im=[p.imag for p in parts])

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        found = np.fft.ifft(np.stack(pdf["re"].to_numpy()) + 1j * np.stack(pdf["im"].to_numpy()), axis=0).real
        first = pdf.iloc[0]
        return pd.DataFrame({**{k: [first[k]] * len(found) for k in keys}, "_b": np.arange(len(found)), "c": first["c"], "v": list(found)})

    schema = f"{kinds}, _k long, _n long, _m int, _w int, c int, re array<double>, im array<double>"
    waves = cut_up.groupBy(*keys, "c").applyInPandas(across, schema)
    turned = waves.groupBy(*keys, "_k").applyInPandas(along, schema)
    fields = turned.groupBy(*keys, "c").applyInPandas(home, f"{kinds}, _b long, c int, v array<double>")
    joined = fields.groupBy(*keys, "_b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"])).alias(u))  # a block's places
    return joined.withColumnRenamed("_b", block)
