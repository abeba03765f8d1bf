"""Exact best-subset search by branch and bound, on Spark.

A node of the search is a set of terms that must be taken and one of terms that may be. What all of them together
leave of the target bounds from below what any choice between the two sets leaves; leaving one term out of the fit raises that by an amount known in
closed form. Terms without which no choice can beat the best one known must be taken; a node that must take too many, or
whose bound is not below the best, is closed. A small search ends on the driver after a fixed number of nodes. Of a larger one the open nodes are
rows of a table: each task works on its own for a number of nodes and hands back the ones that are still open, which are dealt out again with the best choice so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import temporary
from .summary import Summary, triangle

#: Nodes before open ones become rows; nodes that a task works on before it hands back; how much better a choice must be, as a share of the target's square.
FIRST, SHARE, TIE = 2000, 20_000, 1e-14
NODES = "must array<int>, may array<int>, bound double"


@dataclass
class Best:
    """The best choice so far: the square of what it leaves of the unit target, and its terms."""

    left: float
    support: tuple[int, ...]

    def offer(self, left: float, support: Sequence[int]) -> None:
        if left < self.left - TIE:
            self.left, self.support = left, tuple(sorted(support))


def unit(s: Summary) -> np.ndarray:
    """The factor of unit columns and a unit target."""
    size = float(np.linalg.norm(s.target)) or 1.0
    return triangle(np.column_stack([s.terms / s.norms, s.target / size]))


def _fit(r: np.ndarray, chosen: list[int]) -> tuple[float, np.ndarray]:
    """What the chosen columns leave, squared, and by how much that grows if one of them goes. Columns that others make up add nothing."""
    if not chosen:
        return float(r[:, -1] @ r[:, -1]), np.zeros(0)
    small = np.linalg.qr(r[:, [*chosen, -1]], mode="r")
    p = len(chosen)
    a, y = small[:p, :p], small[:p, p]
    left = float(small[p:, p] @ small[p:, p]) if len(small) > p else 0.0
    if len(a) == p and np.abs(np.diag(a)).min() > 1e-10:
        inverse = np.linalg.inv(a)
        return left, (inverse @ y) ** 2 / (inverse * inverse).sum(1)
    turn, values, _ = np.linalg.svd(r[:, chosen], full_matrices=False)
    base = turn[:, values > 1e-10 * max(values[0], 1e-300)]
    left = float(np.sum((r[:, -1] - base @ (base.T @ r[:, -1])) ** 2))
    return left, np.array([max(_left(r, [c for c in chosen if c != x]) - left, 0.0) for x in chosen])


def _left(r: np.ndarray, chosen: list[int]) -> float:
    if not chosen:
        return float(r[:, -1] @ r[:, -1])
    turn, values, _ = np.linalg.svd(r[:, chosen], full_matrices=False)
    base = turn[:, values > 1e-10 * max(values[0], 1e-300)]
    return float(np.sum((r[:, -1] - base @ (base.T @ r[:, -1])) ** 2))


def _next(r: np.ndarray, chosen: list[int]) -> tuple[float, int]:
    """The term that leaves least beside the chosen ones, and what is left then, nearly; all candidates at once."""
    rest = r
    if chosen:
        base = np.linalg.qr(r[:, chosen])[0]
        rest = r - base @ (base.T @ r)
        rest = rest - base @ (base.T @ rest)
    y, size = rest[:, -1], np.einsum("ij,ij->j", rest[:, :-1], rest[:, :-1])
    gain = np.where(size > 1e-20, (rest[:, :-1].T @ y) ** 2 / np.maximum(size, 1e-300), 0.0)
    gain[chosen] = -1.0
    best = int(gain.argmax())
    return float(y @ y) - float(gain[best]), best


def greedy(r: np.ndarray, k: int) -> Best:
    """A good choice to start with: terms taken one by one, then swapped as long as that helps."""
    n, chosen = r.shape[1] - 1, []
    for _ in range(min(k, n)):
        chosen.append(_next(r, chosen)[1])
    now = _left(r, chosen)
    for _ in range(10 if len(chosen) < n else 0):
        (about, c), i = min((_next(r, [*chosen[:i], *chosen[i + 1 :]]), i) for i in range(len(chosen)))
        swapped = [*chosen[:i], *chosen[i + 1 :], c]
        if about >= now - TIE or (left := _left(r, swapped)) >= now - TIE:
            break
        now, chosen = left, swapped
    return Best(now, tuple(sorted(chosen)))


def explore(r: np.ndarray, k: int, best: Best, nodes: list[tuple[list[int], list[int], float]], budget: int) -> list[tuple[list[int], list[int], float]]:
    """Works on nodes (must, may, bound), the last one first, for a number of them; improves best and returns the nodes that are still open."""
    open_ = list(nodes)
    while open_ and budget > 0:
        must, may, bound = open_.pop()
        if bound > best.left - TIE:
            continue
        budget -= 1
        every = [*must, *may]
        left, growth = _fit(r, every)
        if left > best.left - TIE:
            continue
        if len(every) <= k:
            best.offer(left, every)
            continue
        gain = growth[len(must) :]
        # At least len(every) - k of the terms that may be taken are left out, so at least that far up in their order of growth.
        if left + np.sort(gain)[len(every) - k - 1] > best.left - TIE:
            continue
        needed = left + gain > best.left - TIE
        must = [*must, *(x for x, f in zip(may, needed) if f)]
        rest = [(g, x) for x, g, f in zip(may, gain, needed) if not f]
        if len(must) > k:
            continue
        if len(must) == k:
            best.offer(_fit(r, must)[0], must)
            continue
        rest.sort()
        g, x = rest.pop()  # the term whose loss costs most
        others = [c for _, c in rest]
        open_.append((must, others, left + g))
        if len(must) + 1 == k:
            best.offer(_fit(r, [*must, x])[0], [*must, x])
        open_.append(([*must, x], others, left))
    return open_


def best_choice(spark: SparkSession, s: Summary, k: int, first: int = FIRST, share: int = SHARE) -> tuple[list[int], float]:
    """The k terms that leave least of the target, out of all choices, and what they leave (its length). A choice that is better by TIE or less counts as no better.

    With fewer than k terms, all of them. The table of open nodes lies in the shared folder and is written anew each round.
    """
    r, n = unit(s), len(s.names)
    k = min(k, n)
    best = greedy(r, k)
    open_ = explore(r, k, best, [([], list(range(n)), 0.0)], first)
    table: DataFrame | None = spark.createDataFrame([(m, c, float(b)) for m, c, b in open_], NODES) if open_ else None
    while table is not None:
        best, table = _round(spark, table, r, k, best, share)
    return list(best.support), s.fit(best.support)[1]


def _node_frame(rows: list[tuple]) -> pd.DataFrame:
    must, may, bound, done = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
    lists = lambda x: pd.Series([np.array(v, np.int32) for v in x], dtype=object)
    return pd.DataFrame({"must": lists(must), "may": lists(may), "bound": pd.Series(bound, dtype=float), "done": pd.Series(done, dtype=bool)})


def _round(spark: SparkSession, table: DataFrame, r: np.ndarray, k: int, best: Best, share: int) -> tuple[Best, DataFrame | None]:
    """One round over all open nodes: the best choice after it, and the nodes that are open then."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = (best.left, best.support)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, budget = Best(*known), share
        for pdf in frames:
            given = [(list(map(int, m)), list(map(int, c)), float(b)) for m, c, b in zip(pdf["must"], pdf["may"], pdf["bound"])]
            before = budget
            rest = explore(r, k, own, given, max(budget, 0))
            budget = 0 if rest else before - len(given)
            yield _node_frame([(m, c, b, False) for m, c, b in rest])
        yield _node_frame([(list(own.support), [], own.left, True)])

    path = temporary(spark)
    # Nodes are dealt at random, so that tasks get parts of the search of all kinds.
    dealt = table.repartition(tasks, F.xxhash64("must", "may"))
    dealt.mapInPandas(work, f"{NODES}, done boolean").write.parquet(path)
    found = spark.read.schema(f"{NODES}, done boolean").parquet(path)
    for row in found.filter("done").orderBy("bound").collect():  # a row a task
        best.offer(row["bound"], row["must"])
    left = found.filter(~F.col("done") & (F.col("bound") <= best.left - TIE)).drop("done")
    return best, left if left.limit(1).count() else None


def frontier(spark: SparkSession, s: Summary, most: int, enough: float = 0.0) -> list[tuple[int, list[int], float]]:
    """k, support and residual of the best choice of each number of terms up to most, or up to the first that leaves at most enough."""
    out = []
    for k in range(1, min(most, len(s.names)) + 1):
        support, left = best_choice(spark, s, k)
        out.append((k, support, left))
        if left <= enough:
            break
    return out


def _listed(r: np.ndarray, k: int, most: int = 1 << 14) -> Best:
    """The best of all choices of k terms, by batches of small factorisations."""
    best, y, every = Best(np.inf, ()), r[:, -1], combinations(range(r.shape[1] - 1), k)
    while some := list(islice(every, most)):
        base, small = np.linalg.qr(np.ascontiguousarray(r[:, np.array(some)].transpose(1, 0, 2)))
        shares = np.where(np.abs(np.diagonal(small, axis1=1, axis2=2)) > 1e-10, base.transpose(0, 2, 1) @ y, 0.0)
        left = y @ y - (shares**2).sum(1)
        at = int(left.argmin())
        best.offer(float(left[at]), some[at])
    return best


def choice(s: Summary, k: int, few: int = 5000) -> tuple[list[int], float]:
    """best_choice() in one place, however long it takes: for the groups of a sweep, each of which has a task. A few choices are simply all tried."""
    r, n = unit(s), len(s.names)
    k = min(k, n)
    if math.comb(n, k) <= few:
        best = _listed(r, k)
    else:
        best = greedy(r, k)
        explore(r, k, best, [([], list(range(n)), 0.0)], 1 << 62)
    return list(best.support), s.fit(best.support)[1]
