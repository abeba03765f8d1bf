"""Sparse regression on a Summary: which few terms explain the target.

A Summary is as small as the dictionary, so the searches are a few lines of linear algebra; the
rows were reduced by Spark before. Best-subset search, whose nodes may be many, is in search.py.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .search import choice, frontier
from .summary import Summary

RESULT = "method string, names array<string>, support array<int>, coefficients array<double>, residual double, meta map<string, string>"


@dataclass(frozen=True)
class Recovery:
    """coefficients are those of the support's terms, in its order."""

    method: str
    support: tuple[int, ...]
    names: tuple[str, ...]
    coefficients: tuple[float, ...]
    residual: float
    meta: dict[str, str] = field(default_factory=dict)

    def __str__(self) -> str:
        lines = [f"  {n:>18s}: {c:+.6f}" for n, c in zip(self.names, self.coefficients)]
        return "\n".join([f"{self.method}: {len(self.support)} terms, residual={self.residual:.4e}", *lines])


def _result(method: str, s: Summary, support: list[int], coefficients: np.ndarray | None = None, **meta: object) -> Recovery:
    fitted, left = s.fit(support)
    if coefficients is not None:
        fitted, left = coefficients, float(np.linalg.norm(s.target - s.terms[:, support] @ coefficients))
    return Recovery(method, tuple(support), tuple(s.names[i] for i in support), tuple(map(float, fitted)), left, {k: str(v) for k, v in meta.items()})


def truncated(s: Summary, support: list[int], threshold: float | None) -> list[int]:
    """The terms whose fitted coefficient is over threshold times the largest."""
    size = np.abs(s.fit(support)[0])
    kept = [i for i, c in zip(support, size) if c > (1e-4 if threshold is None else threshold) * size.max(initial=0)]
    return kept or support


def pursuit(s: Summary, k: int) -> list[int]:
    """Terms picked one by one by their correlation with what is left, in order of choice."""
    scaled, chosen, left = s.terms / s.norms, [], s.target
    for _ in range(min(k, scaled.shape[1])):
        gain = np.abs(scaled.T @ left)
        gain[chosen] = -1
        if gain.max() <= 1e-12 * np.linalg.norm(s.target):
            break
        chosen.append(int(gain.argmax()))
        part = scaled[:, chosen]
        left = s.target - part @ np.linalg.lstsq(part, s.target, rcond=None)[0]
    return chosen


def omp(s: Summary, k: int = 2, threshold: float = 0.0, full: Summary | None = None, centre: bool = False) -> Recovery:
    """The first k picks, refitted; with a threshold, less those whose coefficient is that small a share of the largest.

    With full, the summary of all rows, s is that of a sample: columns are scaled by their lengths over all rows, and coefficients
    are those of the sample. centre takes all columns less their means. Coefficients of 1e-10 and less, on unit columns, count as none.
    """
    own = s.centred() if centre else s
    length = (full or s).norms
    scaled = Summary(own.factor / np.append(length, 1.0), own.n, own.names)
    support = sorted(pursuit(scaled, k))
    size = np.abs(scaled.fit(support)[0])
    support = [i for i, c in zip(support, size) if c > 1e-10] or support
    return _result("omp", own, truncated(own, support, threshold))


def lasso_weights(s: Summary, alpha: float = 0.1, sweeps: int = 5000, tolerance: float = 1e-4) -> np.ndarray:
    """The penalised coefficients of the unit columns, by coordinate descent; the penalty is alpha times the number of rows."""
    scaled = s.terms / s.norms
    g, c, w = scaled.T @ scaled, scaled.T @ s.target, np.zeros(scaled.shape[1])
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(w)):
            if g[i, i] > 0:
                r = c[i] - g[i] @ w + g[i, i] * w[i]
                new = np.sign(r) * max(abs(r) - alpha * s.n, 0.0) / g[i, i]
                moved, w[i] = max(moved, abs(new - w[i])), new
        if moved <= tolerance * np.abs(w).max(initial=1e-300):
            break
    return w


def lasso(s: Summary, alpha: float = 0.1, sweeps: int = 5000, tolerance: float = 1e-4, full: Summary | None = None, mean: bool = False) -> Recovery:
    """Terms whose penalised coefficient is over a thousandth of the largest, refitted without penalty, on all rows if full has them.

    On unit columns the penalty grows with the rows and the columns' part in the target with their root only, so with many rows nothing is left. With mean, columns are
    divided by their root mean square in place of their length, and the choice is the same for any number of rows alike.
    """
    size = np.abs(lasso_weights(s, alpha / np.sqrt(max(s.n, 1)) if mean else alpha, sweeps, tolerance))
    limit = 1e-3 * size.max() if size.max(initial=0) > 1e-10 else 1e-10
    support = [i for i in range(len(size)) if size[i] > limit] or [int(size.argmax())]
    return _result("lasso", full or s, support, alpha=alpha)


def _leaves(laplacian: np.ndarray, inside: np.ndarray, size: int, limit: float) -> list[np.ndarray]:
    """Halves of halves by the second eigenvector of the terms' graph, until they are small or well connected."""
    if len(inside) <= size:
        return [inside]
    values, vectors = np.linalg.eigh(laplacian[np.ix_(inside, inside)])
    if values[1] > limit:
        return [inside]
    order = inside[np.argsort(vectors[:, 1], kind="stable")]
    return [x for half in np.split(order, [len(order) // 2]) for x in _leaves(laplacian, np.sort(half), size, limit)]


def likeness(s: Summary, active: np.ndarray | None = None) -> np.ndarray:
    """How alike each two unit columns are, a mean over the rows; none is like itself."""
    scaled = (s.terms / s.norms)[:, np.arange(len(s.names)) if active is None else active]
    alike = np.abs(scaled.T @ scaled) / max(s.n, 1)
    np.fill_diagonal(alike, 0)
    return alike


def laplacian(alike: np.ndarray) -> np.ndarray:
    return np.diag(alike.sum(1)) - alike


def votes(s: Summary, groups: list[np.ndarray], active: np.ndarray) -> np.ndarray:
    """Of each active term: in how many fits of two groups (places in active) its coefficient on a unit column matters."""
    scaled, out = s.terms / s.norms, np.zeros(len(active), int)
    for a, b in combinations(groups, 2):
        both = np.concatenate([a, b])
        size = np.abs(np.linalg.lstsq(scaled[:, active[both]], s.target, rcond=None)[0])
        out[both[size > max(1e-3 * size.max(), 1e-10)]] += 1
    return out


def survivors(counts: np.ndarray, groups: int) -> np.ndarray:
    """Which terms have votes enough: half of the groups, or all others where that rules out none."""
    stay = counts >= max(1, groups // 2)
    return counts >= max(1, groups - 1) if stay.all() and groups > 1 else stay


def ccp(s: Summary, cluster: int = 8, limit: float = 0.5, threshold: float | None = None, rounds: int = 8, full: Summary | None = None) -> Recovery:
    """Groups of correlated terms vote in pairs: a term stays if it matters in enough fits of two groups.

    s may be a sample's summary; full then is that of all rows, on which what is left is fitted. At most six terms stay, of these such as have a coefficient over 1e-6 on unit columns.
    """
    whole, active, did, counts = full or s, np.arange(len(s.names)), 0, np.zeros(len(s.names), int)
    while did < rounds and len(active) > cluster:
        groups = _leaves(laplacian(likeness(s, active)), np.arange(len(active)), cluster, limit)
        counts = votes(s, groups, active)
        stay = survivors(counts, len(groups))
        did += 1
        if stay.all() or not stay.any():
            break
        active = active[stay]
    support = active.tolist()
    if len(support) > 6:
        own = whole.only(support)
        picked = sorted(pursuit(own, 6))
        size = np.abs(Summary(own.factor / np.append(own.norms, 1.0), own.n, own.names).fit(picked)[0])
        support = [support[i] for i, c in zip(picked, size) if c > 1e-6] or [support[i] for i in picked]
    return _result("ccp", whole, truncated(whole, support, threshold), rounds=did)


def tolerances(floor: float, high: float = 100.0, low: float = 0.01, steps: int = 30) -> list[float]:
    """Allowed residuals in units of a noise floor, evenly spaced on a log scale from high to low."""
    return [float(x) for x in np.geomspace(high * floor, low * floor, steps)]


def stable_choice(points: Sequence[tuple[int, list[int], float]], scale: Sequence[float], halvings: int, floor: float, longest: bool = True) -> tuple[list[int] | None, dict[str, object]]:
    """The support that stays longest the smallest one within the tolerances of a scale (or, unless longest, the one at their small end), and how it was found; None if no tolerance is met.

    points: number of terms, support and residual, a row for each number of terms; so this is a small matter. Of runs of equal winners the longest
    counts, of those as long the one from the small end. From that run's own least tolerance on, the tolerance is halved until three winners in a row are the same,
    none is left or it comes under the floor; the last of them is the result.
    """

    def winner(eps: float) -> list[int] | None:
        return next((sorted(support) for _, support, left in sorted(points, key=lambda x: x[0]) if left <= eps), None)

    runs: list[list] = []  # support, least tolerance, length
    for eps in sorted(scale):
        found = winner(eps)
        if found is not None:
            if runs and runs[-1][0] == found:
                runs[-1][2] += 1
            else:
                runs.append([found, eps, 1])
    if not runs:
        return None, {}
    support, eps, length = max(runs, key=lambda r: (r[2], -r[1])) if longest else runs[0]
    same, halved = 1, 0
    while same < 3 and halved < halvings and eps / 2 >= floor:
        eps, halved = eps / 2, halved + 1
        found = winner(eps)
        if found is None:
            break
        support, same = (support, same + 1) if found == support else (found, 1)
    return support, {"plateau": length, "halvings": halved}


def best_subset(spark: SparkSession, s: Summary, most: int | None = None, steps: int = 30, threshold: float | None = None, halvings: int = 60, floor: float = 1e-12, full: Summary | None = None, scale: Sequence[float] | None = None, slack: float = 0.01) -> Recovery:
    """The support that stays longest optimal as the allowed residual falls, out of all choices of terms, by branch and bound.

    For each of many tolerances (scale; by default evenly spaced on a log scale down from the target's length) the least number of terms that meets it wins, see
    stable_choice(). Numbers of terms are tried up to the first whose best choice leaves at most the least tolerance, or 1 + slack times what all terms leave, or up to
    most. If that is reached before, meta says so.
    """
    top = float(np.linalg.norm(s.target)) or 1.0
    scale = [top * 10.0 ** (-i / 3) for i in range(steps)] if scale is None else list(scale)
    least = max(min(scale), (1 + slack) * s.fit(range(len(s.names)))[1], floor * top)
    points = frontier(spark, s, len(s.names) if most is None else most, least)
    support, meta = stable_choice(points, scale, halvings, floor * top)
    if support is None:
        return _result("best subset", full or s, list(range(len(s.names))), warning="no choice meets any tolerance")
    if points[-1][2] > max(least, 1e-6 * top):
        meta["warning"] = f"no {len(points[-1][1])} terms leave less than {least:.3g}"
    return _result("best subset", full or s, truncated(full or s, support, threshold), **meta)


def nearest(s: Summary, most: int = 3, slack: float = 0.5, threshold: float | None = None, full: Summary | None = None) -> Recovery:
    """The fewest terms, out of all choices of at most so many, that leave at most 1 + slack times what the best choice of most leaves.

    Choices are searched by branch and bound in one place; what is within a thousand millionth of the target counts as nothing left.
    """
    best = [choice(s, k) for k in range(1, min(most, len(s.names)) + 1)]
    enough = max((1 + slack) * best[-1][1], 1e-9 * float(np.linalg.norm(s.target)))
    chosen = next(x for x, left in best if left <= enough)
    return _result("nearest", full or s, truncated(full or s, list(chosen), threshold))


#: By name: functions of a Summary and of options that return a Recovery. Own methods may be added.
METHODS: dict[str, Callable[..., Recovery]] = {"omp": omp, "lasso": lasso, "ccp": ccp, "nearest": nearest}


def identify(s: Summary, method: str = "ccp", **how: object) -> Recovery:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    return METHODS[method](s, **how)


def refitted(found: Recovery, s: Summary) -> Recovery:
    """The same terms with the coefficients and the residual that other rows give them."""
    return _result(found.method, s, list(found.support), **found.meta)


def as_frame(spark: SparkSession, found: list[Recovery]) -> DataFrame:
    rows = [(r.method, list(r.names), list(r.support), list(r.coefficients), r.residual, r.meta) for r in found]
    return spark.createDataFrame(rows, RESULT)
