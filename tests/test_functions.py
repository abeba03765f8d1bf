"""Dictionary terms, metrics and splines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlaw.functions import metrics, splines
from flowlaw.functions.terms import Term, derivative_name, describe, dictionary, theta


def test_order_and_names():
    names = [t.name for t in dictionary(2, 3, True, 2)]
    assert names == ["1", "u", "u^2", "u_x", "u_xx", "u_xxx", "u u_x", "u u_xx", "u u_xxx", "(u_x)^2", "(u_xx)^2", "(u_xxx)^2"]
    assert derivative_name(5) == "u_x^{5}" and Term(1, 5, 1).name == "u u_x^{5}" and Term(0, 5, 2).name == "(u_x^{5})^2"
    assert [t.name for t in dictionary(1, 1, False, waves=True)][-4:] == ["sin(u)", "cos(u)", "sin(u) u_x", "cos(u) u_x"]
    assert describe(dictionary(1, 0)).splitlines()[1].endswith("u")


@pytest.mark.parametrize("how, size", [((2, 3, 2), 12), ((2, 4, 3), 23), ((3, 4, 4), 40), ((3, 5, 5), 59), ((6, 7, 7), 196)])
def test_sizes(how, size):
    powers, orders, total = how
    assert len(dictionary(powers, orders, True, total)) == size
    assert len(dictionary(powers, orders, False, total)) == 1 + powers + orders


def test_theta(spark):
    row = theta(spark.createDataFrame([(2.0, 3.0)], "u double, d1 double"), dictionary(2, 1, True, 3, waves=True), "u", ["d1"]).first()
    assert row.theta == pytest.approx([1, 2, 4, 3, 6, 12, 9, 18, math.sin(2), math.cos(2), 3 * math.sin(2), 3 * math.cos(2)])
    assert theta(spark.createDataFrame([], "u double"), dictionary(2, 0)).count() == 0


def test_jaccard(spark):
    cases = [(["a", "b"], ["a", "b"], 1.0), (["a"], ["b"], 0.0), (["a", "b"], ["a", "c"], 1 / 3), (["a", "b", "c"], ["a", "b"], 2 / 3), ([], [], 0.0), (["a", "a"], ["a"], 1.0)]
    rows = spark.createDataFrame(cases, "a array<string>, b array<string>, want double").select(metrics.jaccard(F.col("a"), F.col("b")).alias("got"), "want", metrics.covers(F.col("a"), F.col("b")).alias("covers")).collect()
    assert all(r.got == pytest.approx(r.want) for r in rows) and [r.covers for r in rows] == [True, False, False, True, True, True]


def test_relative_error(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 2.0), (0, 0.0, 3.0), (1, 3.0, 0.0), (1, 4.0, 0.0)], "k int, a double, b double")
    got = dict(rows.groupBy("k").agg(metrics.relative_error(F.col("a"), F.col("b"))).collect())
    assert got[0] == pytest.approx(3 / math.sqrt(14)) and got[1] == pytest.approx(5)


def bspline(x, knots, k, i):
    """By the recursion over any knots."""
    if k == 0:
        return float(knots[i] <= x < knots[i + 1])
    return (x - knots[i]) / (knots[i + k] - knots[i]) * bspline(x, knots, k - 1, i) + (knots[i + k + 1] - x) / (knots[i + k + 1] - knots[i + 1]) * bspline(x, knots, k - 1, i + 1)


@pytest.mark.parametrize("degree", [0, 1, 2, 3, 5])
def test_splines(spark, degree):
    n, xs = 9, [0.0, 0.04, 0.31, 0.5, 0.77, 0.999, 1.25, -0.1]
    points = spark.createDataFrame(list(enumerate(xs)), "id int, x double")
    knots = np.arange(-degree, n + degree + 1) / n
    got = np.zeros((len(xs), n))
    for r in splines.design(points, "id", F.col("x"), n, degree).collect():
        got[r.row, r.col] += r.val
    for row, x in enumerate(xs):
        want = np.zeros(n)
        for i in range(n + degree):
            want[i % n] += bspline(x % 1.0, knots, degree, i)
        assert got[row] == pytest.approx(np.roll(want, 0), abs=1e-12)
    if degree:
        low = splines.design(points, "id", F.col("x"), n, degree, 1).groupBy("row").agg(F.sum("val")).collect()
        assert all(abs(r[1]) < 1e-9 for r in low)
    with pytest.raises(ValueError):
        splines.design(points, "id", F.col("x"), degree, degree)


def derived(x, knots, k, i, m):
    """The m-th derivative, by the rule for differences."""
    if m == 0:
        return bspline(x, knots, k, i) if all(knots[i + k] > knots[i] for _ in (0,)) or k == 0 else 0.0
    over = lambda v, w: v / w if w else 0.0
    return k * (over(derived(x, knots, k - 1, i, m - 1), knots[i + k] - knots[i]) - over(derived(x, knots, k - 1, i + 1, m - 1), knots[i + k + 1] - knots[i + 1]))


@pytest.mark.parametrize("degree, derivative", [(0, 0), (1, 0), (1, 1), (2, 1), (3, 0), (3, 2), (5, 3), (2, 3)])
def test_uneven_knots(spark, degree, derivative):
    knots = [0.0, 0.4, 0.5, 1.1, 1.7, 1.8, 2.6, 3.0, 3.3, 4.1, 4.2, 5.0, 5.5, 6.1]
    n, low, high = len(knots) - degree - 1, knots[degree], knots[len(knots) - degree - 1]
    xs = [low, low + 0.01, (low + high) / 2, high - 0.3, high - 1e-9]
    points = spark.createDataFrame([*enumerate(xs), (98, None), (99, float("nan"))], "id int, x double")
    got = np.zeros((len(xs), n))
    for r in splines.on_knots(points, "id", F.col("x"), knots, degree, derivative).collect():
        got[r.row, r.col] += r.val
    want = np.array([[0.0 if derivative > degree else derived(x, knots, degree, i, derivative) for i in range(n)] for x in xs])
    assert got == pytest.approx(want, abs=1e-7)
    around = spark.createDataFrame([(0, xs[1] + 3 * (high - low))], "id int, x double")
    wrapped = {r.col: r.val for r in splines.on_knots(around, "id", F.col("x"), knots, degree, derivative, outside="wrap").collect()}
    assert all(wrapped.get(i, 0) == pytest.approx(want[1][i], abs=1e-6) for i in range(n))
    with pytest.raises(Exception, match="outside the knots"):
        splines.on_knots(around, "id", F.col("x"), knots, degree).collect()
    if degree < 3 and derivative <= degree:
        assert splines.on_knots(around, "id", F.col("x"), knots, degree, derivative, outside="extrapolate").count() == degree + 1


def test_ends_and_checks(spark):
    """At repeated end knots the first and the last spline are one; wrong knots are refused."""
    points = spark.createDataFrame([(0, 0.0), (1, 1.0)], "id int, x double")
    got = {(r.row, r.col): r.val for r in splines.on_knots(points, "id", F.col("x"), [0, 0, 0, 0.5, 1, 1, 1], 2).collect()}
    assert got[0, 0] == pytest.approx(1) and got[1, 3] == pytest.approx(1)
    for knots, degree in (([0, 1, 2], 1), ([0, 2, 1, 3], 1), ([0, 0, 0, 0], 1), ([0, 1], -1)):
        with pytest.raises(ValueError):
            splines.on_knots(points, "id", F.col("x"), knots, degree)
    with pytest.raises(ValueError):
        splines.on_knots(points, "id", F.col("x"), [0, 1], 0, outside="ignore")


def test_flags(spark):
    row = spark.createDataFrame([(["p", "q"], [2.0, -0.01])], "n array<string>, c array<double>").select(metrics.flagged(F.col("n"), F.col("c"), F.array(F.lit("p"))).alias("f"), metrics.significant(F.col("c")).alias("s")).first()
    assert [(x.term, x.right, x.line) for x in row.f] == [("p", True, "                   p: +2.000000"), ("q", False, "                   q: -0.010000")] and row.s == [0]


def test_kronecker(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((2, 3)), rng.random((3, 2))
    entries = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "row int, col int, val double")
    got = np.zeros((6, 6))
    for r in splines.kronecker(entries(a), entries(b), 3, 2).collect():
        got[r.row, r.col] = r.val
    assert got == pytest.approx(np.kron(a, b))
