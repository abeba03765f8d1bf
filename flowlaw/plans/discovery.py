"""From tables to the terms that explain a target."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.laws import Law, rate
from ..functions.terms import Term, theta
from ..operators import noise, recovery, sampling, spectral
from ..operators.summary import Summary, summarize
from ..sources.tables import event_snapshots, table

#: Short names of the columns of a line item.
ITEM = {"q": "l_quantity", "p": "l_extendedprice", "d": "l_discount", "t": "l_tax"}


def products(columns: dict[str, Column], degree: int = 2) -> dict[str, Column]:
    """By name: 1, and all products of up to degree columns."""
    out = {"1": F.lit(1.0)}
    for k in range(1, degree + 1):
        for names in combinations_with_replacement(columns, k):
            out[" ".join(names)] = reduce(lambda a, b: a * b, [columns[n] for n in names])
    return out


def charges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """theta: products of a line item's numbers; y: its price less the discount."""
    columns = {k: F.col(v).cast("double") for k, v in ITEM.items()}
    terms = products(columns)
    rows = table(spark, sf_dir, "lineitem").select(F.array(*terms.values()).alias("theta"), (columns["p"] * (1 - columns["d"])).alias("y"))
    return rows, list(terms)


def charge_summary(spark: SparkSession, sf_dir: str) -> Summary:
    rows, names = charges(spark, sf_dir)
    return summarize(rows, names)


def field_points(snapshots: DataFrame, terms: Sequence[Term], orders: Sequence[int], keys: Sequence[str] = ("series", "j")) -> DataFrame:
    """keys, i, u, d1 and so on, theta at all grid points of the snapshots."""
    wide = spectral.with_derivatives(snapshots, orders)
    grid = spectral.points(wide, ["u", *[f"d{r}" for r in orders]], list(keys))
    return theta(grid, terms, "u", [f"d{r}" for r in orders])


def field_rows(snapshots: DataFrame, terms: Sequence[Term], law: Law, orders: Sequence[int]) -> DataFrame:
    """theta and y at all grid points; y is the rate that the law gives the field there."""
    return field_points(snapshots, terms, orders).withColumn("y", rate(law, F.col("u"), [F.col(f"d{r}") for r in orders]))


def law_rows(snapshots: DataFrame, known: Mapping[str, Law], terms: Sequence[Term], orders: Sequence[int], level: float = 0.01, seed: int = 0) -> DataFrame:
    """series, j, i, theta and a column for each law, by its name: the rate of every field under it, measured with noise.

    The noise is level times a normal number, of a hash of law and place, times the size of the rate's own largest part at the place.
    """
    derivatives = [F.col(f"d{r}") for r in orders]
    drawn = lambda name: noise.gauss(F.lit(name), F.col("series"), F.col("j"), F.col("i"), seed=seed)
    rates = {name: rate(law, F.col("u"), derivatives) * (1 + level * drawn(name)) for name, law in known.items()}
    return field_points(snapshots, terms, orders).select("series", "j", "i", "theta", *[y.alias(name) for name, y in rates.items()])


def identify(rows: DataFrame, names: Sequence[str], method: str = "ccp", sampler: str | Callable = "random", samples: int = 5000, row_id: str = "row_id", seed: int = 42, debias: bool = True, full: Summary | None = None, within: float = 0.5, **how: object) -> recovery.Recovery:
    """The terms that explain rows of an id, theta and y, chosen on a sample of them and, with debias, fitted on all.

    sampler: a name in sampling.SAMPLERS or a function like those. method: a name in recovery.METHODS, or "best subset". full is the
    summary of all rows where it is known already, as when several methods or samplers are compared.

    A sample of fixed size may be too much alike to tell terms apart, as are the largest of very many rows. So with debias the choice is checked: if
    it leaves more of all rows than all terms together do (by more than within, as a share), the terms are chosen again on all rows, whose summary is at hand.
    """
    some = summarize(sampling.sample(rows, sampler, samples, row_id, seed), names)
    full = (full or summarize(rows, names)) if debias else None

    def chosen(s: Summary) -> recovery.Recovery:
        if method == "best subset":
            found = recovery.best_subset(rows.sparkSession, s, full=full, **how)
        else:
            found = recovery.identify(s, method, full=full, **how)
        return recovery.refitted(found, full) if full else found

    found = chosen(some)
    if full and some.n < full.n:
        enough = max((1 + within) * full.fit(range(len(names)))[1], 1e-9 * float(np.linalg.norm(full.target)))
        if found.residual > enough:
            again = chosen(full)
            found = again if again.residual < found.residual else found
    return found


def smooth_fields(spark: SparkSession, sf_dir: str, modes: int = 4) -> DataFrame:
    """series, j, u: the first waves of the event fields, with mean 0 and unit spread. A snapshot stays in its row."""
    low = event_snapshots(spark, sf_dir).select("series", "j", spectral.low_pass(modes)(F.col("u")).alias("v"))
    return low.select("series", "j", arrays.standardised(F.col("v")).alias("u"))


def found_terms(spark: SparkSession, found: recovery.Recovery) -> DataFrame:
    """term, coefficient of a result."""
    one = recovery.as_frame(spark, [found])
    return one.select(F.explode(F.arrays_zip("names", "coefficients")).alias("x")).select(F.col("x.names").alias("term"), F.col("x.coefficients").alias("coefficient"))
