"""The dictionary of candidate terms: which there are, what they are called, and their Columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """u^p times the r-th derivative to the power q; wave is "", "sin" or "cos", which then stands for u^p."""

    p: int = 0
    r: int = 0
    q: int = 0
    wave: str = ""

    @property
    def name(self) -> str:
        first = f"{self.wave}(u)" if self.wave else "" if self.p == 0 else "u" if self.p == 1 else f"u^{self.p}"
        d = derivative_name(self.r)
        second = "" if self.q == 0 else d if self.q == 1 else f"({d})^{self.q}"
        return " ".join(x for x in (first, second) if x) or "1"

    def column(self, u: Column, derivative: Sequence[Column]) -> Column:
        """derivative[r - 1] is the r-th derivative."""
        factors = [{"sin": F.sin, "cos": F.cos}[self.wave](u)] if self.wave else [u] * self.p
        factors += [derivative[self.r - 1] for _ in range(self.q)]
        return reduce(lambda a, b: a * b, factors) if factors else F.lit(1.0)


def derivative_name(r: int) -> str:
    return "u" if r == 0 else "u_" + "x" * r if r <= 4 else f"u_x^{{{r}}}"


def dictionary(powers: int = 3, orders: int = 4, cross: bool = True, total: int = 4, constant: bool = True, waves: bool = False) -> list[Term]:
    """Terms in order: constant, powers, derivatives, their products, powers of derivatives, waves.

    total limits the degree of products, not that of pure powers. waves adds sin u and cos u, alone and
    times the first three derivatives.
    """
    out = [Term()] * constant + [Term(p=p) for p in range(1, powers + 1)] + [Term(r=r, q=1) for r in range(1, orders + 1)]
    if cross:
        out += [Term(p, r, 1) for r in range(1, orders + 1) for p in range(1, powers + 1) if p + 1 <= total]
        out += [Term(p, r, q) for r in range(1, orders + 1) for q in range(2, powers + 1) for p in range(powers + 1) if p + q <= total]
    if waves:
        out += [Term(wave=w) for w in ("sin", "cos")] + [Term(r=r, q=1, wave=w) for r in range(1, min(3, orders) + 1) for w in ("sin", "cos")]
    return out


def describe(terms: Sequence[Term]) -> str:
    return "\n".join(f"{i:4d}  {t.name}" for i, t in enumerate(terms))


def theta(rows: DataFrame, terms: Sequence[Term], u: str = "u", derivatives: Sequence[str] = ()) -> DataFrame:
    """rows with theta, the array of the terms' values; one projection, no shuffle."""
    columns = [t.column(F.col(u), [F.col(d) for d in derivatives]).cast("double") for t in terms]
    return rows.withColumn("theta", F.array(*columns))
