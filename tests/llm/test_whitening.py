"""Whitening against numpy's own eigenvectors and exact arithmetic."""

import numpy as np
import pytest

from flowlaw.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, whitened string"


def test_polar_factor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        values, vectors = np.linalg.eigh(a)
        assert np.allclose(whitening.polar(a), vectors @ np.diag(np.sign(values)) @ vectors.T, atol=1e-12)


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0], [5.0, 5.0, 5.0, 1.0], [1e8, 1.0, 1e-3, 1e-6, 0.0], list(np.arange(1.0, 41.0)), [2.0] * 20 + [1.0] * 20, list(np.geomspace(1, 1e-10, 24)), [1e6, *np.linspace(1, 1.001, 20)]])
def test_components(values):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.components(a)
    size = max(values)
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-13 * size * len(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * found, atol=1e-12 * size * len(values))
    some, first = whitening.components(a, 3)
    assert np.allclose(some, found[:3], atol=1e-12 * size) and first.shape == (len(values), min(3, len(values)))


def test_components_of_zeros_and_nothing():
    assert whitening.components(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    assert whitening.components(np.zeros((0, 0)))[0].tolist() == []


def brute(vectors, most=32):
    """deviation, and whitened up to sign, of each vector."""
    x = np.array([[int(np.floor(64.0 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    far = [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    z = (x * n - s).astype(float) / n
    values, turn = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:most]
    return far, z @ turn[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def held(found):
    out = {}
    for r in found:
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_query_at_a_small_scale(spark, data):
    vectors = dict(spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect())
    found = held(queries.op12_whitening(spark, data).collect())
    ids = sorted(vectors)
    far, white, share = brute([vectors[i] for i in ids])
    assert sorted(found) == ids
    for k in range(1, 33):
        own = np.array([found[i][k].whitened for i in ids])
        sign = np.sign(own @ white[:, k - 1])
        assert np.allclose(own, sign * white[:, k - 1], atol=1e-6), k
        assert abs(found[ids[0]][k].explained / share[k - 1] - 1) < 1e-9
    for i, d in zip(ids, far):
        assert all(r.deviation == d and r.n == len(ids) and r.identity_error < 1e-9 for r in found[i].values()) and len(found[i]) == 32


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.standard_normal(5).astype("f4")], 1, 2, "x") for i in range(40)]
    bad = [(100, None, None, None, None), (101, [1.0, None, 0.0, 0.0, 0.0], 1, 1, ""), (102, [float("nan")] * 5, 1, 1, ""), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1, 1, "")]
    short = [(None, [1.0, 2.0], 1, 1, "s"), (5, [], 1, 1, "e"), good[3], good[3]]
    found = whitening.whiten(spark.createDataFrame([*good, *bad, *short], SCHEMA).repartition(5)).collect()
    vectors = [v + [0.0] * (5 - len(v)) for _, v, *_ in [*good, *short]]
    far, white, _ = brute(vectors)
    assert len(found) == len(vectors) * 5 and {r.vec_id for r in found} == {None, *range(40)}
    assert sorted({int(r.deviation) for r in found}) == sorted(set(far)) and max(r.identity_error for r in found) < 1e-10
    assert np.allclose(sorted(abs(r.whitened) for r in found if r.component == 1), sorted(abs(white[:, 0])), atol=1e-9)
    assert len([r for r in found if r.vec_id == 3 and r.component == 1]) == 3


def test_rows_that_do_not_differ(spark):
    flat = spark.createDataFrame([(i, [float(i % 3), 1.0], 0, 0, "") for i in range(9)], SCHEMA)
    found = whitening.whiten(flat).collect()
    assert {(r.component, r.whitened is None) for r in found} == {(1, False), (2, True)} and len(found) == 18
    same = whitening.whiten(spark.createDataFrame([(1, [2.0, 2.0], 0, 0, "")] * 3, SCHEMA)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in same)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], 0, 0, "")], SCHEMA)).count() == 0


def test_large_entries_are_exact(spark):
    vectors = [[float(i) * 1e7, -float(i * i)] for i in range(1, 60)]
    found = held(whitening.whiten(spark.createDataFrame([(i, v, 0, 0, "") for i, v in enumerate(vectors)], SCHEMA.replace("float", "double"))).collect())
    far, _, _ = brute(vectors)
    assert [int(found[i][1].deviation) for i in range(len(vectors))] == far
