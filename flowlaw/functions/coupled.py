"""Terms over several fields, and laws that couple them: each field's rate is a sum of terms over all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import derivative_name


@dataclass(frozen=True)
class Joint:
    """A product of fields, by name and as often as each counts, and, with an order, of one derivative of a field."""

    fields: tuple[str, ...] = ()
    derived: str = ""
    order: int = 0

    @property
    def name(self) -> str:
        powers = [f if n == 1 else f"{f}^{n}" for f in dict.fromkeys(self.fields) if (n := self.fields.count(f))]
        d = [derivative_name(self.order).replace("u", self.derived, 1)] if self.order else []
        return " ".join([*powers, *d]) or "1"

    def column(self) -> Column:
        """Over columns named like the fields, and d<order>_<field> for derivatives."""
        factors = [F.col(f) for f in self.fields] + ([F.col(f"d{self.order}_{self.derived}")] if self.order else [])
        return reduce(lambda a, b: a * b, factors) if factors else F.lit(1.0)


Coupled = Mapping[str, Mapping[Joint, float]]


def joint_terms(fields: Sequence[str], degree: int = 3, orders: int = 2, cross: bool = False) -> list[Joint]:
    """The constant, all products of up to degree fields, all derivatives up to an order, and, with cross, fields times derivatives."""
    out = [Joint()] + [Joint(x) for k in range(1, degree + 1) for x in combinations_with_replacement(fields, k)]
    slopes = [Joint((), f, r) for r in range(1, orders + 1) for f in fields]
    return out + slopes + ([Joint((g,), s.derived, s.order) for s in slopes for g in fields] if cross else [])


def waves(sigma: float = 1.0) -> dict[str, dict[Joint, float]]:
    """The cubic wave equation of a complex field u + i v, by its parts: the rates of u and of v."""
    return {
        "u": {Joint((), "v", 2): -1.0, Joint(("u", "u", "v")): -sigma, Joint(("v", "v", "v")): -sigma},
        "v": {Joint((), "u", 2): 1.0, Joint(("u", "u", "u")): sigma, Joint(("u", "v", "v")): sigma},
    }


def rate_of(law: Mapping[Joint, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(c)) * t.column() for t, c in law.items()])


def joint_theta(points: DataFrame, terms: Sequence[Joint]) -> DataFrame:
    """points with theta, the array of the terms' values; one projection."""
    return points.withColumn("theta", F.array(*[t.column().cast("double") for t in terms]))
