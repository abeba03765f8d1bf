"""Sparse least squares, surfaces, coupled laws, long fields, and what survives failures."""

import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlaw.functions import coupled, splines
from flowlaw.operators import smoothing, sparse, spectral, summary
from flowlaw.plans import sweeps
from flowlaw.sources import results, tables
from flowlaw.streaming.refit import Refit, keyed_fits


def cells(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "row int, col int, val double")


def solved(spark, a, y, **how):
    found = sparse.least_squares(cells(spark, a), spark.createDataFrame(list(enumerate(map(float, y))), "row int, y double"), **how).collect()
    out = np.zeros(a.shape[1])
    for r in found:
        out[r.col] = r.x
    return out


def test_shortest_solution(spark):
    """Full, deficient and wide matrices, with empty rows and columns."""
    rng = np.random.default_rng(0)
    for shape, spare in (((30, 5), 0.4), ((6, 12), 0.5), ((20, 6), 0.0)):
        a = rng.normal(size=shape) * (rng.random(shape) > spare)
        a[:, -1] = a[:, 0] if shape[0] > shape[1] else a[:, -1]
        a[2] = 0
        y = rng.normal(size=shape[0])
        assert solved(spark, a, y) == pytest.approx(np.linalg.lstsq(a, y, rcond=None)[0], abs=1e-7)
    assert solved(spark, np.eye(3), np.zeros(3)) == pytest.approx([0, 0, 0])
    assert sparse.least_squares(cells(spark, np.zeros((2, 2))), spark.createDataFrame([(0, 1.0)], "row int, y double")).count() == 0
    doubled = cells(spark, np.eye(2)).union(cells(spark, np.eye(2)))
    assert {r.col: r.x for r in sparse.least_squares(doubled, spark.createDataFrame([(0, 1.0), (1, 3.0)], "row int, y double")).collect()} == pytest.approx({0: 0.5, 1: 1.5})


def test_ten_thousand_columns(spark):
    """A periodic curve on 10,000 intervals: no row or triangle of all columns is ever made."""
    points = spark.range(40_000).select("id", ((F.col("id") * 7919 % 40_000) / 40_000.0).alias("x")).withColumn("y", F.sin(6.283185307179586 * F.col("x")))
    entries = splines.design(points, "id", F.col("x"), 10_000, 1)
    found = sparse.spline_solve(points, entries, "id", "y", tolerance=1e-6)
    got = {r.col: r.x for r in found.collect()}
    assert len(got) == 10_000
    # A hat's coefficient is the curve's value at its own top, which lies at the start of the interval behind it.
    assert max(min(abs(got[c] - np.sin(2 * np.pi * (c + s) / 10_000)) for s in (-1, 0, 1)) for c in range(0, 10_000, 97)) < 1e-3


def test_flattest_spline_equals_the_dense_one(spark):
    knots = [0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    points = spark.createDataFrame([(0, 0.5, 1.0), (1, 0.7, 2.0), (2, 3.5, 0.0)], "id int, x double, y double")
    dense = smoothing.spline_fit(points, "id", "x", "y", knots, 1, flat_at=[0.25, 1.5, 2.5, 3.75])
    entries = splines.on_knots(points, "id", F.col("x"), knots, 1)
    at = spark.createDataFrame(list(enumerate([0.25, 1.5, 2.5, 3.75])), "id int, x double")
    bend = splines.on_knots(at, "id", F.col("x"), knots, 1, 1)
    got = {r.col: r.x for r in sparse.spline_solve(points, entries, "id", "y", bend, 1e-4, tolerance=1e-13).collect()}
    assert [got[k] for k in range(5)] == pytest.approx(dense, abs=1e-3)


def test_surfaces(spark):
    rng = np.random.default_rng(2)
    a, b, y = rng.normal(size=(9, 3)), rng.normal(size=(7, 2)), rng.normal(size=(9, 7))
    core = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(9) for j in range(7)], "i int, j int, val double")
    found = sparse.tensor_fit(core, a, b)
    want = np.linalg.lstsq(np.kron(a, b), y.ravel(), rcond=None)[0].reshape(3, 2)
    assert {(r.k, r.l): r.c for r in found.collect()} == pytest.approx({(k, m): want[k, m] for k in range(3) for m in range(2)})
    shown = {(r.i, r.j): r.val for r in sparse.surface(found, a, b).collect()}
    assert shown == pytest.approx({(i, j): (a @ want @ b.T)[i, j] for i in range(9) for j in range(7)})


def test_coupled_terms():
    terms = coupled.joint_terms(("u", "v"), 2, 2, cross=True)
    assert [t.name for t in terms] == ["1", "u", "v", "u^2", "u v", "v^2", "u_x", "v_x", "u_xx", "v_xx", "u u_x", "v u_x", "u v_x", "v v_x", "u u_xx", "v u_xx", "u v_xx", "v v_xx"]
    assert [t.name for t in coupled.waves()["u"]] == ["v_xx", "u^2 v", "v^3"]


@pytest.mark.parametrize("n, m, order", [(64, 4096, 1), (64, 4096, 2), (5, 3, 1), (1, 8, 3), (16, 1, 2)])
def test_long_fields(spark, n, m, order):
    rng = np.random.default_rng(3)
    field = np.fft.irfft(np.fft.rfft(rng.normal(size=n * m))[: n * m // 2 + 1] * np.exp(-np.arange(n * m // 2 + 1) / 50), n * m)
    blocks = spark.createDataFrame([("a", b, field[b * m : (b + 1) * m].tolist()) for b in range(n)] + [("b", 0, [1.0, 2.0])], "k string, block int, u array<double>").repartition(3)
    found = {(r.k, r.block): r.u for r in spectral.long_derivative(blocks, ["k"], "block", order).collect()}
    want = np.fft.irfft(np.fft.rfft(field) * (1j * np.arange(n * m // 2 + 1)) ** order, n * m)
    got = np.concatenate([found["a", b] for b in range(n)])
    assert got == pytest.approx(want, abs=1e-8 * max(np.abs(want).max(), 1)) and len(found["b", 0]) == 2


def test_long_fields_are_whole(spark):
    with pytest.raises(Exception, match="missing"):
        spectral.long_derivative(spark.createDataFrame([(0, [1.0]), (2, [1.0])], "block int, u array<double>").withColumn("k", F.lit(1)), ["k"], "block", 1).collect()


def test_a_poisoned_key_is_a_result(spark, tmp_path):
    """A failing and a slow key have rows with their errors; a second run takes these alone."""
    rows = spark.range(400).select((F.col("id") % 4).alias("k"), F.array(F.lit(1.0), F.rand(2)).alias("theta"), F.rand(3).alias("y"))
    names, path, seen = ("1", "x"), str(tmp_path / "sweep"), []

    def run(poisoned, slow):
        def fit(s):
            if s.n == 100 and poisoned:
                raise ValueError("bad key")
            if slow:
                time.sleep(5)
            return (float(s.fit([0])[0][0]),)

        def work(left):
            seen.append(sorted(r.k for r in left.collect()))
            some = rows.join(left, "k", "left_semi")
            good = sweeps.of_groups(some.filter("k < 2"), ["k"], names, lambda s: (float(s.n),), "value double", isolated=True)
            return good.unionByName(sweeps.of_groups(some.filter("k >= 2"), ["k"], names, fit, "value double", isolated=True, seconds=1))

        return {r.k: r for r in results.resumed(spark.createDataFrame([(k,) for k in range(4)], "k long"), path, ["k"], work).collect()}

    first = run(True, False)
    assert [first[k].value for k in (0, 1)] == [100, 100] and first[2].error == "ValueError: bad key" and first[3].value is None
    second = run(False, True)
    assert second[2].error == "TimeoutError: took longer than 1 seconds"
    spark.createDataFrame([(9, 1.0)], "k long, value double").write.parquet(f"{path}/run=2/half")  # a run that broke off
    third = run(False, False)
    assert seen == [[0, 1, 2, 3], [2, 3], [2, 3]] and all(r.error is None for r in third.values()) and len(third) == 4
    assert run(True, True).keys() == third.keys() and len(seen) == 3


def test_store_needs_its_mark(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(2).write.parquet(f"{path}/_temporary_of_nobody")
    assert results.store(spark.range(5), path).count() == 5 and results.store(spark.range(9), path).count() == 5


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master=master))
    assert tables.shared_dir(session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert tables.shared_dir(session("local[4]", **{"spark.sql.warehouse.dir": "file:/w"})) == "file:/w/_tables"
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(session("spark://host:7077", **{"spark.sql.warehouse.dir": "file:/w"}))


def streamed(spark, tmp_path, name):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    rows = [(int(i % 3), t.tolist(), float(t @ [1, -2, 0.5] * (1 + i % 3))) for i, t in enumerate(x)]
    frame = spark.createDataFrame(rows, "k long, theta array<double>, y double")
    source = str(tmp_path / name)
    for part in range(4):
        frame.filter(F.col("k") >= 0).filter(F.pmod(F.hash("y"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(source)
    return frame, source


def test_refit_goes_on_after_a_restart(spark, tmp_path):
    frame, source = streamed(spark, tmp_path, "refit")
    state, checkpoint = str(tmp_path / "factor"), str(tmp_path / "check")
    stream = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    first = Refit(list("abc"), lambda s: None, state, spark)
    first.start(stream(), checkpoint).awaitTermination()
    frame.limit(50).coalesce(1).write.mode("append").parquet(source)
    second = Refit(list("abc"), lambda s: None, state, spark)  # another driver
    assert second.last == first.last and second.summary.n == 900
    second.start(stream(), checkpoint).awaitTermination()
    whole = summary.summarize(frame.unionByName(frame.limit(50)), list("abc"))
    assert second.summary.n == 950 and second.summary.gram() == pytest.approx(whole.gram())


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    frame, source = streamed(spark, tmp_path, "keyed")
    checkpoint, out = str(tmp_path / "check"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
        fits = keyed_fits(stream, ["k"], list("abc"), [0, 1, 2])
        fits.writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    frame.limit(60).coalesce(1).write.mode("append").parquet(source)
    run()  # the state comes from the store
    last = spark.read.parquet(out).groupBy("k").agg(F.max_by("coefficients", "n").alias("c"), F.max("n").alias("n")).collect()
    counts = {r.k: r["count"] for r in frame.unionByName(frame.limit(60)).groupBy("k").count().collect()}
    for r in last:
        assert r.n == counts[r.k] and r.c == pytest.approx([1 * (1 + r.k), -2 * (1 + r.k), 0.5 * (1 + r.k)])


@pytest.mark.parametrize("reach", [1, 2, 3])
def test_neighbours_over_ranges(spark, reach):
    """A key with most of the rows, short keys, a null key and nulls in the values, over many ranges and small batches."""
    from pyspark.sql import Window

    rows = spark.range(500).select(F.when(F.col("id") < 400, 0).when(F.col("id") < 403, 1).when(F.col("id") < 404, 2).otherwise(F.when(F.col("id") > 450, 3)).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 50 != 7, F.rand(5)).alias("v"))
    rows = rows.repartition(5).cache()
    w = Window.partitionBy("k").orderBy("t")
    want = rows.select("t", *[F.lag("v", k).over(w).alias(f"before_{k}") for k in range(1, reach + 1)], *[F.lead("v", k).over(w).alias(f"after_{k}") for k in range(1, reach + 1)])
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for size in ("2", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = spectral.neighbours(rows, ["k"], "t", "v", reach).select(want.columns)
            assert sorted(found.collect(), key=lambda r: r.t) == sorted(want.collect(), key=lambda r: r.t)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
