"""Summaries, recovery, spectra, plateaus, sampling and noise against plain numpy."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlaw.functions import arrays, splines
from flowlaw.operators import noise, plateau, recovery, sampling, smoothing, spectral, summary
from flowlaw.plans import discovery

NAMES = ("1", "a", "b", "c", "d")


def planted(spark, n=600, parts=5, seed=0):
    rng = np.random.default_rng(seed)
    theta = np.column_stack([np.ones(n), rng.normal(size=(n, 4)) * (1, 0.1, 1e4, 10)])
    y = 3 * theta[:, 2] - 0.5 * theta[:, 4]
    rows = [(i, t.tolist(), float(v)) for i, (t, v) in enumerate(zip(theta, y))]
    return theta, y, spark.createDataFrame(rows, "row_id long, theta array<double>, y double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_summary_equals_lstsq(spark, parts):
    theta, y, rows = planted(spark, parts=parts)
    s = summary.summarize(rows, NAMES)
    assert s.n == len(y) and s.norms == pytest.approx(np.linalg.norm(theta, axis=0))
    assert s.gram() == pytest.approx(theta.T @ theta)
    for chosen in ((0, 1, 2, 3, 4), (2, 4), (1,), ()):
        want = np.linalg.lstsq(theta[:, chosen], y, rcond=None)[0]
        got, left = s.fit(chosen)
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert left == pytest.approx(np.linalg.norm(y - theta[:, chosen] @ want), abs=1e-8)


def test_summary_edges(spark):
    none = summary.summarize(spark.createDataFrame([], "theta array<double>, y double"), NAMES)
    assert none.n == 0 and none.factor.shape == (6, 6)
    few = summary.summarize(spark.createDataFrame([([1.0, 2.0], 3.0)], "theta array<double>, y double"), ("a", "b"))
    assert few.n == 1 and few.fit([0])[0] == pytest.approx([3.0])
    with pytest.raises(Exception, match="not a number"):
        summary.summarize(spark.createDataFrame([([float("nan"), 2.0], 3.0)], "theta array<double>, y double"), ("a", "b"))


def test_methods_find_the_planted_terms(spark):
    _, _, rows = planted(spark)
    s = summary.summarize(rows, NAMES)
    for found in (recovery.omp(s, 2), recovery.ccp(s, cluster=2), recovery.best_subset(spark, s), recovery.lasso(s, 1e-6)):
        assert set(found.names) == {"b", "d"}, found.method
        assert dict(zip(found.names, found.coefficients)) == pytest.approx({"b": 3.0, "d": -0.5})
        assert found.residual < 1e-6
    assert "b: +3.000000" in str(recovery.omp(s, 2))
    with pytest.raises(ValueError):
        recovery.identify(s, "guess")
    assert recovery.as_frame(spark, [recovery.omp(s)]).first().names == list(recovery.omp(s).names)


def test_lasso_shrinks(spark):
    _, _, rows = planted(spark)
    s = summary.summarize(rows, NAMES)
    sizes = [len(recovery.lasso(s, a).support) for a in (1e-9, 1e-3, 10.0)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 1


def test_lasso_whatever_the_rows(spark):
    """The same rows a thousand times over leave the same terms."""
    _, _, rows = planted(spark)
    s = summary.summarize(rows, NAMES)
    many = summary.Summary(s.factor * 1000**0.5, s.n * 1000, s.names)
    assert recovery.lasso(s, 0.01).names != recovery.lasso(many, 0.01).names
    assert set(recovery.lasso(s, 0.01, mean=True).names) == set(recovery.lasso(many, 0.01, mean=True).names) >= {"b", "d"}


def test_all_choices(spark):
    _, _, rows = planted(spark, 100)
    s = summary.summarize(rows, NAMES)
    for k, support, left in recovery.frontier(spark, s, 3):
        assert len(support) == k and left == pytest.approx(min(s.fit(c)[1] for c in combinations(range(5), k)), abs=1e-9)


@pytest.mark.parametrize("n", [16, 15])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_spectral(spark, n, order):
    x = 2 * math.pi * np.arange(n) / n
    fields = [np.sin(x), np.cos(3 * x) + 2]
    want = {1: [np.cos(x), -3 * np.sin(3 * x)], 2: [-np.sin(x), -9 * np.cos(3 * x)], 3: [-np.cos(x), 27 * np.sin(3 * x)]}[order]
    rows = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(fields)] + [(2, None), (3, [])], "id int, u array<double>")
    got = {r.id: r[f"d{order}"] for r in spectral.with_derivatives(rows, [order]).collect()}
    assert got[0] == pytest.approx(want[0], abs=1e-10) and got[1] == pytest.approx(want[1], abs=1e-10) and got[2] is None and got[3] == []
    grid = spectral.points(rows.filter("id < 2"), ["u"], ["id"])
    for r in (0, order):
        back = spectral.synthesis(spectral.fourier(grid, ["id"], n, n // 2), ["id"], n, r).orderBy("id", "i").collect()
        assert [x.u for x in back] == pytest.approx(np.concatenate(fields if r == 0 else want), abs=1e-9)


def test_highest_wave(spark):
    """Of an even grid's highest wave, odd derivatives are zero and even ones are not."""
    rows = spark.createDataFrame([([1.0, -1.0] * 4,)], "u array<double>")
    got = spectral.with_derivatives(rows, [1, 2]).first()
    assert got.d1 == pytest.approx([0] * 8) and got.d2 == pytest.approx([-16, 16] * 4)


def test_time_derivative_and_diffusion(spark):
    rows = spark.createDataFrame([("a", j, float(j * j)) for j in range(5)] + [("b", 0, 1.0)], "s string, j int, u double")
    got = {(r.s, r.j): r.v for r in rows.select("s", "j", spectral.time_derivative(rows, ["s"], 0.5).alias("v")).collect()}
    assert [got["a", j] for j in range(5)] == [2, 4, 8, 12, 14] and got["b", 0] is None
    moved = spectral.diffuse(spark.createDataFrame([([0.0, 1.0, 0.0, 0.0],)], "u array<double>"), 0.25).first().u
    assert moved == [0.25, 0.5, 0.25, 0.0]


def test_scaled_arrays(spark):
    scaled = spark.createDataFrame([([1.0, 3.0],), ([2.0, 2.0],)], "u array<double>").select(arrays.standardised(F.col("u")), arrays.rescaled(F.col("u"))).collect()
    assert list(scaled[0]) == [[-1.0, 1.0], [0.0, 1.0]] and list(scaled[1]) == [[0.0, 0.0], [0.0, 0.0]]


def test_step_error(spark):
    """Of a parabola in time both differences are right; of a cubic one the doubled step is off by three steps squared."""
    rows = spark.createDataFrame([("a", 0, j, float(j * j)) for j in range(7)] + [("b", 0, j, float(j**3)) for j in range(7)], "s string, i int, j int, u double")
    got = {r.s: r.error for r in spectral.step_error(rows, ["s"], "i", 1.0).collect()}
    fine = [3 * j * j + 1 for j in (2, 3, 4)]
    assert got["a"] == pytest.approx(0) and got["b"] == pytest.approx(3 * math.sqrt(3) / math.sqrt(sum(x * x for x in fine)), rel=1e-6)


def test_plateaus(spark):
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate("aabbb")] + [("k", 5, None), ("k", 6, None), ("z", 0, None)], "k string, o int, v string")
    runs = plateau.plateau_runs(rows, ["k"], "o", F.col("v"))
    assert sorted(map(tuple, runs.select("k", "start", "stop", "length").collect())) == [("k", 0, 1, 2), ("k", 2, 4, 3), ("k", 5, 6, 2), ("z", 0, 0, 1)]
    first = {r.k: r for r in plateau.first_plateau(runs, ["k"]).collect()}
    assert (first["k"].value, first["k"].start, first["z"].value) == ("a", 0, None)


def brute_runs(rows):
    out = []
    for k, o, v in sorted(rows):
        if out and out[-1][0] == k and out[-1][1] == v:
            out[-1][3:] = [o, out[-1][4] + 1]
        else:
            out.append([k, v, o, o, 1])
    return sorted(map(tuple, out), key=str)


def test_plateaus_over_tasks(spark):
    """One key with nearly all rows, runs over several tasks' ranges, nulls, and arrays as values."""
    rng = np.random.default_rng(4)
    values = np.repeat(rng.integers(0, 3, 300), rng.integers(1, 40, 300)).tolist()
    rows = [("hot", i, None if v == 2 else v) for i, v in enumerate(values)] + [("cold", i, 1) for i in range(5)]
    frame = spark.createDataFrame(rows, "k string, o int, v int").repartition(9)
    want = brute_runs([(k, o, -1 if v is None else v) for k, o, v in rows])
    got = [(r.k, -1 if r.value is None else r.value, r.start, r.stop, r.length) for r in plateau.plateau_runs(frame, ["k"], "o", F.col("v")).collect()]
    assert sorted(got, key=str) == want
    listed = plateau.plateau_runs(frame, ["k"], "o", F.array("v", F.lit(1)), extra=["v"])
    assert sorted(((r.k, -1 if r.value[0] is None else r.value[0], r.start, r.stop, r.length) for r in listed.collect()), key=str) == want
    assert all(r.v == r.value[0] for r in listed.collect())
    same = spark.createDataFrame([("k", i, 5) for i in range(1000)], "k string, o int, v int")
    assert [tuple(r) for r in plateau.plateau_runs(same, ["k"], "o", F.col("v")).collect()] == [("k", 5, 0, 999, 1000)]
    assert plateau.plateau_runs(same.limit(0), ["k"], "o", F.col("v")).count() == 0


def test_sampling(spark):
    _, _, rows = planted(spark, 400)
    assert sampling.head(rows, 10).count() == 10 and sampling.largest(rows, 5, F.col("theta")[3], "row_id").count() == 5
    few = {r.row_id for r in sampling.uniform(rows, 50, "row_id", seed=1).collect()}
    assert len(few) == 50 and few == {r.row_id for r in sampling.uniform(rows.repartition(3), 50, "row_id", seed=1).collect()}
    assert few != {r.row_id for r in sampling.uniform(rows, 50, "row_id", seed=2).collect()}
    assert 20 < sampling.fraction(rows, 0.1, "row_id").count() < 70
    chosen = sampling.signal_rows(rows, 30, "row_id")
    assert chosen.count() == 30 and summary.summarize(chosen, NAMES).fit([2, 4])[0] == pytest.approx([3, -0.5])
    block = np.array([[1.0, 0], [0, 2], [3, 0], [0, 1]])
    assert sampling.pivots(block, 2) == [2, 1] and sampling.pivots(block, 4) == [2, 1, 0, 3]
    for name in sampling.SAMPLERS:
        assert sampling.sample(rows, name, 20).count() == (400 if name == "full" else 20)
        assert sampling.sample(rows, name, 1000).count() == 400 and sampling.sample(rows.limit(0), name, 20).count() == 0
    assert sampling.sample(rows, lambda r, m, i, s: r.filter("row_id % 2 = 0"), 5).count() == 200
    with pytest.raises(ValueError):
        sampling.sample(rows, "guess", 5)


def test_spanning_rows(spark):
    """Four of thousands of rows hold a direction of their own: all are found, whatever task has them."""
    rng = np.random.default_rng(0)
    theta = np.column_stack([rng.normal(size=3000), *np.zeros((4, 3000))])
    for k, row in enumerate((7, 1500, 2222, 2999)):
        theta[row, k + 1] = 10.0 * (k + 1)
    rows = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(theta)], "row_id long, theta array<double>").repartition(11)
    assert {7, 1500, 2222, 2999} <= {r.row_id for r in sampling.spanning_rows(rows, 5, "row_id").collect()}


def test_sensor_noise(spark):
    rows = spark.createDataFrame([(s, j, [float(np.sin(i + j)) for i in range(500)]) for s in "ab" for j in range(3, 6)], "series string, j int, u array<double>")
    noisy = {(r.series, r.j): np.array(r.u) for r in noise.sensor_noise(rows, ["series"], "j", 0.1, 1).collect()}
    was = {(r.series, r.j): np.array(r.u) for r in rows.collect()}
    spread = np.concatenate(list(was.values())).std()
    assert all((noisy[s, 3] == was[s, 3]).all() for s in "ab")
    step = np.concatenate([noisy[k] - was[k] for k in was if k[1] > 3]) / spread
    assert abs(step.mean()) < 0.01 and abs(step.std() - 0.1) < 0.01
    assert noise.sensor_noise(rows, ["series"]).columns == rows.columns and noise.sensor_noise(rows.limit(0), ["series"]).count() == 0


def test_a_sample_too_much_alike_is_checked(spark):
    """The largest rows are copies of a few in which two terms are the same: the choice is made on all rows then."""
    rng = np.random.default_rng(2)
    small = np.column_stack([np.ones(600), rng.normal(size=(600, 4))])
    big = np.repeat([[1.0, 50.0, 50.0, 1.0, 1.0], [1.0, 60.0, 60.0, 1.0, 1.0], [1.0, 70.0, 70.0, 1.0, 1.0]], 40, axis=0)
    theta = np.vstack([small, big])
    rows = spark.createDataFrame([(i, t.tolist(), float(t[2] - t[3])) for i, t in enumerate(theta)], "row_id long, theta array<double>, y double")
    found = discovery.identify(rows, NAMES, "omp", "signal_qr", 60, k=2)
    assert dict(zip(found.names, found.coefficients)) == pytest.approx({"b": 1.0, "c": -1.0})


def test_recovery_under_noise(spark):
    """Terms are found and coefficients are near, with noise in terms and target, by any method and sampler."""
    rng = np.random.default_rng(8)
    theta = np.column_stack([np.ones(3000), rng.normal(size=(3000, 4)) * (1, 0.1, 1e4, 10)])
    y = (3 * theta[:, 2] - 0.5 * theta[:, 4]) * (1 + 0.02 * rng.normal(size=3000))
    rows = spark.createDataFrame([(i, t.tolist(), float(v)) for i, (t, v) in enumerate(zip(theta, y))], "row_id long, theta array<double>, y double")
    for method, how in (("omp", {"k": 2}), ("nearest", {"most": 3}), ("best subset", {"most": 2})):
        for sampler in ("random", "signal_qr", "full"):
            found = discovery.identify(rows, NAMES, method, sampler, 500, **how)
            assert set(found.names) == {"b", "d"}, (method, sampler, found)
            assert dict(zip(found.names, found.coefficients)) == pytest.approx({"b": 3.0, "d": -0.5}, rel=0.05)
    rough = discovery.identify(rows, NAMES, "omp", "random", 500, debias=False, k=2)
    assert rough.coefficients != discovery.identify(rows, NAMES, "omp", "random", 500, k=2).coefficients


def test_centred_pursuit(spark):
    """An offset of the target is no term when columns are taken less their means."""
    rng = np.random.default_rng(1)
    theta = np.column_stack([np.ones(500), rng.normal(size=(500, 2)) + 5])
    y = 2 * theta[:, 1] + 100
    s = summary.summarize(spark.createDataFrame([(t.tolist(), float(v)) for t, v in zip(theta, y)], "theta array<double>, y double"), ("1", "a", "b"))
    found = recovery.omp(s, 1, centre=True)
    assert found.names == ("a",) and found.coefficients == pytest.approx((2.0,)) and recovery.omp(s, 1).coefficients != pytest.approx((2.0,))


def test_small_coefficients_go(spark):
    """A pick whose coefficient on a unit column is next to nothing is none, in pursuit and behind the cap of six terms."""
    rng = np.random.default_rng(2)
    theta = rng.normal(size=(400, 12))
    y = theta[:, 0] + theta[:, 1]
    rows = spark.createDataFrame([(t.tolist(), float(v)) for t, v in zip(theta, y)], "theta array<double>, y double")
    s = summary.summarize(rows, [f"t{i}" for i in range(12)])
    assert recovery.omp(s, 5).names == ("t0", "t1")
    assert recovery.ccp(s, cluster=12, threshold=0.0).names == ("t0", "t1")


def test_tightening(spark):
    """The tolerance is halved until three winners in a row are the same: a small third term is found behind a long plateau of two."""
    rng = np.random.default_rng(3)
    theta = rng.normal(size=(300, 5))
    y = theta @ np.array([1.0, 1.0, 1e-3, 0, 0])
    rows = spark.createDataFrame([(t.tolist(), float(v)) for t, v in zip(theta, y)], "theta array<double>, y double")
    s = summary.summarize(rows, list("abcde"))
    found = recovery.best_subset(spark, s, most=3, threshold=1e-6)
    assert found.names == ("a", "b", "c") and int(found.meta["halvings"]) >= 2 and "warning" not in found.meta
    assert "warning" in recovery.best_subset(spark, s, most=2, threshold=1e-6).meta


def test_votes_and_graph(spark):
    theta, y, rows = planted(spark)
    s = summary.summarize(rows, NAMES)
    unit = theta / np.linalg.norm(theta, axis=0)
    alike = np.abs(unit.T @ unit) / len(y)
    np.fill_diagonal(alike, 0)
    assert recovery.likeness(s) == pytest.approx(alike, abs=1e-12) and recovery.laplacian(alike).sum(1) == pytest.approx(np.zeros(5))
    groups = [np.array([0, 1]), np.array([2, 3]), np.array([4])]
    want = np.zeros(5, int)
    for a, b in combinations(groups, 2):
        both = np.concatenate([a, b])
        size = np.abs(np.linalg.lstsq(unit[:, both], y, rcond=None)[0])
        want[both[size > 1e-3 * size.max()]] += 1
    assert (recovery.votes(s, groups, np.arange(5)) == want).all()
    assert recovery.survivors(np.array([2, 1, 0]), 3).tolist() == [True, True, False] and recovery.survivors(np.array([2, 1, 1]), 3).tolist() == [True, False, False]


def test_noise(spark):
    _, _, rows = planted(spark, 3000)
    flat = rows.select("row_id", F.col("theta")[1].alias("a"), F.lit(5.0).alias("c"))
    noisy = noise.add_noise(flat, ["a", "c"], ["row_id"], 0.1, 1)
    both = noisy.join(flat.select("row_id", F.col("a").alias("was")), "row_id").toPandas()
    step = (both["a"] - both["was"]) / both["was"].std()
    assert abs(step.mean()) < 0.01 and abs(step.std() - 0.1) < 0.01 and np.isfinite(both["c"]).all()
    assert noise.add_noise(flat.repartition(2), ["a"], ["row_id"], 0.1, 1).orderBy("row_id").first().a == noisy.orderBy("row_id").first().a


def test_smoothing(spark):
    x = 2 * np.pi * np.arange(64) / 64
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(0, np.sin(x).tolist()), (1, (np.sin(x) + 0.05 * rng.normal(size=64)).tolist()), (2, None)], "id int, u array<double>")
    got = {r.id: r.u for r in smoothing.smoothed(rows, 64, 12, 5).collect()}
    assert got[0] == pytest.approx(np.sin(x), abs=1e-4) and got[2] is None
    assert np.abs(np.array(got[1]) - np.sin(x)).max() < 0.08 and np.std(np.array(got[1]) - np.sin(x)) < 0.04
    b = smoothing.design_matrix(spark, 64, 12, 5)
    want = b @ np.linalg.lstsq(b, np.array(rows.filter("id = 1").first().u), rcond=None)[0]
    assert got[1] == pytest.approx(want)
    slope = smoothing.design_matrix(spark, 64, 12, 5, 1) @ np.linalg.lstsq(b, np.sin(x), rcond=None)[0] / (2 * np.pi)
    assert slope == pytest.approx(np.cos(x), abs=2e-3)


def test_spline_fit(spark):
    """Uneven and periodic knots against dense least squares; what points leave open is settled by the bend."""
    rng = np.random.default_rng(5)
    knots = [0, 0, 0, 0, 0.1, 0.35, 0.5, 0.8, 1, 1, 1, 1]
    x = rng.random(300)
    y = np.sin(5 * x) + 0.01 * rng.normal(size=300)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y double")
    b = smoothing.matrix(spark, x, knots, 3)
    got = smoothing.spline_fit(points, "id", "x", "y", knots, 3)
    assert got == pytest.approx(np.linalg.lstsq(b, y, rcond=None)[0], abs=1e-8)
    values = {r.row: r.value for r in smoothing.spline_values(points, "id", "x", got, knots, 3).collect()}
    assert [values[i] for i in range(300)] == pytest.approx(b @ got, abs=1e-9)
    few, at = points.limit(5), np.linspace(0, 1, 40)
    shortest, flat = (smoothing.spline_fit(few, "id", "x", "y", knots, 3, flat_at=f) for f in (None, at))
    small, bend = smoothing.matrix(spark, [r.x for r in few.orderBy("id").collect()], knots, 3), smoothing.matrix(spark, at, knots, 3, 2)
    want = [r.y for r in few.orderBy("id").collect()]
    assert small @ shortest == pytest.approx(want, abs=1e-8) and small @ flat == pytest.approx(want, abs=1e-8)
    assert np.linalg.norm(bend @ flat) < np.linalg.norm(bend @ shortest) and np.linalg.norm(shortest) < np.linalg.norm(flat)
    free = splines.null_space(small)
    assert free.shape == (8, 3) and np.abs(small @ free).max() < 1e-10 and splines.null_space(b) is None
    even = np.arange(-3, 12) / 8
    round_ = smoothing.spline_fit(points, "id", "x", "y", even.tolist(), 3, periodic=True)
    assert len(round_) == 8
