"""Evolution laws u_t = sum of coefficient times term, as mappings from terms to coefficients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import Term

Law = Mapping[Term, float]

U, U2, U3 = Term(p=1), Term(p=2), Term(p=3)
TRANSPORT = Term(1, 1, 1)
DX2, DX3, DX4 = Term(r=2, q=1), Term(r=3, q=1), Term(r=4, q=1)


def laws(nu: float = 0.05, eps: float = 0.01, growth: float = 1.0, spread: float = 0.1, beta: float = 1 / 6) -> dict[str, dict[Term, float]]:
    """The known laws by name."""
    return {
        "kdv": {TRANSPORT: -6.0, DX3: -1.0},
        "ks": {TRANSPORT: -1.0, DX2: -1.0, DX4: -1.0},
        "burgers": {TRANSPORT: -1.0, DX2: nu},
        "allen_cahn": {DX2: eps, U: 1.0, U3: -1.0},
        "fisher_kpp": {DX2: spread, U: growth, U2: -growth},
        "kdv_burgers": {TRANSPORT: -1.0, DX2: nu, DX3: -beta},
        "swift_hohenberg": {U: 1.0, U3: -1.0, DX2: -2.0, DX4: -1.0},
        "fitzhugh_nagumo": {DX2: 1.0, U2: 1.0, U3: -1.0},
    }


def rate(law: Law, u: Column, derivatives: Sequence[Column]) -> Column:
    """u_t at a point under a law; derivatives[r - 1] is the r-th."""
    return reduce(lambda a, b: a + b, [F.lit(float(c)) * t.column(u, derivatives) for t, c in law.items()])


def named(law: Law) -> list[str]:
    return [t.name for t in law]
