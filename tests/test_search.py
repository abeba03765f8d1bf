"""Exact search and fits by absolute residuals, against enumeration; triangles of many parts and many targets."""

import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlaw.operators import recovery, robust, search, summary


def made(n, p, true, noise, seed=0, alike=0.6):
    """A summary of correlated terms and a target of some of them, with noise."""
    rng = np.random.default_rng(seed)
    x = alike * rng.normal(size=(n, 1)) + (1 - alike) * rng.normal(size=(n, p))
    y = x[:, true] @ rng.uniform(0.5, 2, len(true))
    y = y + noise * y.std() * rng.normal(size=n)
    return summary.Summary(summary.triangle(np.column_stack([x, y])), n, tuple(f"t{i}" for i in range(p)))


@pytest.mark.parametrize("noise", [0.0, 0.1, 2.0])
def test_search_equals_enumeration(spark, noise):
    s = made(300, 12, [1, 4, 7, 9, 11], noise)
    for k in (1, 2, 3, 5, 8, 12):
        want = min(s.fit(c)[1] for c in combinations(range(12), k))
        for support, left in (search.best_choice(spark, s, k), search.choice(s, k), search.choice(s, k, few=0)):
            assert len(support) == k and left == pytest.approx(want, abs=1e-7)


def test_search_over_tasks_equals_enumeration(spark):
    """With few nodes a task, open nodes are dealt out over several rounds."""
    s = made(200, 14, [2, 5, 9], 1.5, seed=3)
    for k in (3, 4):
        want = min(s.fit(c)[1] for c in combinations(range(14), k))
        assert search.best_choice(spark, s, k, first=3, share=5)[1] == pytest.approx(want, abs=1e-9)


def test_dependent_terms():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 4))
    x = np.column_stack([x, x[:, 0] + x[:, 1], x[:, 2], np.zeros(100)])
    y = x[:, 4] + 0.5 * x[:, 3] + 0.01 * rng.normal(size=100)
    s = summary.Summary(summary.triangle(np.column_stack([x, y])), 100, tuple("abcdefg"))
    for k in (1, 2, 3):
        assert search.choice(s, k)[1] == pytest.approx(min(s.fit(c)[1] for c in combinations(range(7), k)), abs=1e-9)


@pytest.mark.parametrize("true", [[3, 9, 17, 25, 33], [0, 3, 9, 17, 25, 38]])
def test_laws_of_five_and_six_terms_of_forty(spark, true):
    s = made(3000, 40, true, 0.05)
    found = recovery.best_subset(spark, s)
    assert list(found.support) == true and "warning" not in found.meta


def outliers(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * (1, 5, 1, 1, 1, 1)
    y = 2 * x[:, 1] - 3 * x[:, 3] + 0.01 * rng.normal(size=n)
    y[::33] += 300 * (1 + x[::33, 0])
    return x, y, spark.createDataFrame([(t.tolist(), float(v)) for t, v in zip(x, y)], "theta array<double>, y double").repartition(5)


def test_absolute_fit_equals_the_linear_programme(spark):
    """Some least sum of absolute residuals runs through as many points as there are terms."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(25, 2))
    y = x @ [1.0, -2.0] + rng.standard_t(1, size=25)
    rows = spark.createDataFrame([(t.tolist(), float(v)) for t, v in zip(x, y)], "theta array<double>, y double")
    corner = lambda c: float(np.abs(y - x @ np.linalg.solve(x[list(c)], y[list(c)])).sum())
    through = lambda j: min(float(np.abs(y - x[:, j] * y[i] / x[i, j]).sum()) for i in range(25))
    fits, size = robust.absolute_fits(rows, ("a", "b"), [[0, 1], [0], [1]])
    assert size == pytest.approx(np.abs(y).sum())
    for fit, want in zip(fits, (min(corner(c) for c in combinations(range(25), 2)), through(0), through(1))):
        assert fit.residual == pytest.approx(want, rel=5e-4)
        assert np.abs(y - x[:, list(fit.support)] @ fit.coefficients).sum() == pytest.approx(fit.residual)


def test_outliers_mislead_squares_only(spark):
    x, y, rows = outliers(spark)
    names = list("abcdef")
    plain = summary.summarize(rows, names)
    assert set(recovery.best_subset(spark, plain, most=2).names) != {"b", "d"}
    found = robust.best_subset(spark, rows, names, steps=300)
    assert found.names == ("b", "d") and found.coefficients == pytest.approx((2, -3), abs=0.05)
    assert float(found.meta["noise floor"]) == pytest.approx(0.1 * np.abs(y).sum())
    assert found.residual == pytest.approx(np.abs(y - x[:, [1, 3]] @ found.coefficients).sum())


def test_first_rounds_are_over_a_sample(spark, monkeypatch):
    """Of many rows a sample is fitted first: the same fit, and fewer passes over all rows where a law holds but for outliers."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20000, 3))
    y = x @ [2.0, -1.0, 0.5]
    y[::10] += 5 + x[::10, 0]
    rows = spark.createDataFrame([(t.tolist(), float(v)) for t, v in zip(x, y)], "theta array<double>, y double").cache()
    passes, once, out = [], robust._round, []
    monkeypatch.setattr(robust, "_round", lambda *a: passes.append(len(out)) or once(*a))
    for start in (1 << 16, 2000):
        monkeypatch.setattr(robust, "START", start)
        out.append(robust.absolute_fits(rows, ("a", "b", "c"), [[0, 1, 2]])[0])
    for a, b in zip(*out):
        assert a.residual == pytest.approx(b.residual, rel=1e-6) and a.coefficients == pytest.approx(b.coefficients, abs=1e-5)
    assert passes.count(1) < passes.count(0)


def test_absolute_fit_edges(spark):
    none = spark.createDataFrame([], "theta array<double>, y double")
    fits, size = robust.absolute_fits(none, ("a", "b"), [[0], [0, 1]])
    assert size == 0 and [list(f.coefficients) for f in fits] == [[0], [0, 0]]
    zero = spark.createDataFrame([([1.0, 0.0], 0.0)] * 4, "theta array<double>, y double")
    fits, _ = robust.absolute_fits(zero, ("a", "b"), [[0, 1]])
    assert list(fits[0].coefficients) == pytest.approx([0, 0]) and fits[0].residual == 0


def test_many_targets_share_a_triangle(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(500, 4)), rng.normal(size=(500, 3))
    rows = spark.createDataFrame([(t.tolist(), *map(float, v)) for t, v in zip(x, y)], "theta array<double>, u double, v double, w double").repartition(3)
    found = summary.summarize_targets(rows, list("abcd"), ["u", "v", "w"])
    for k, t in enumerate("uvw"):
        want = np.linalg.lstsq(x, y[:, k], rcond=None)[0]
        got, left = found[t].fit(range(4))
        assert got == pytest.approx(want) and left == pytest.approx(np.linalg.norm(y[:, k] - x @ want)) and found[t].n == 500


def test_ten_thousand_triangles_in_bounded_memory():
    """Merging holds one triangle and one block, however many triangles come."""
    width = 40
    one = np.triu(np.random.default_rng(6).normal(size=(width, width)))
    tracemalloc.start()
    ((_, n, factor),) = summary.reduced(((0, one, 7) for _ in range(10_000)), width)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 70_000 and factor.T @ factor == pytest.approx(10_000 * one.T @ one)
    assert peak < 8 * (2 * summary.BLOCK + 4 * width) * width * 8  # 10,000 triangles would take 128 MB


def test_many_parts(spark):
    rows = spark.range(0, 20_000, 1, 600).select(F.array(F.lit(1.0), F.col("id") / 20_000.0, F.rand(1)).alias("theta"), (F.col("id") * 2.0).alias("y"))
    s = summary.summarize(rows, ("1", "x", "r"))
    assert s.n == 20_000 and s.fit([0, 1])[0] == pytest.approx([0, 40_000], abs=1e-5)


def test_wide_dictionary(spark):
    """A thousand terms: a task holds a triangle of 8 MB and a block of rows."""
    wave = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda k: F.sin(k * F.col("id") * 0.001 + k))
    rows = spark.range(0, 6000, 1, 4).select(wave.alias("theta")).withColumn("y", F.get("theta", F.lit(3)) - 2 * F.get("theta", F.lit(700)))
    s = summary.summarize(rows, [f"s{k}" for k in range(1000)])
    assert s.n == 6000 and s.fit([3, 700])[0] == pytest.approx([1, -2])
    assert set(recovery.omp(s, 2).support) == {3, 700}
