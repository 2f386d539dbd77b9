"""Neighbour search against brute force, with the pairs that it meets; the neighbour graph and its plane."""

import math

import numpy as np
import pytest

from tidemark.operators import neighbours as N
from tidemark.operators import pairs as P
from tidemark.operators import warping as W

SCHEMA = "signal_id long, role string, idx long, x array<double>"


def frame(spark, real, syn):
    rows = [(2 * i, "real", i, r.tolist()) for i, r in enumerate(real)] + [(2 * i + 1, "synthetic", i, r.tolist()) for i, r in enumerate(syn)]
    return spark.createDataFrame(rows, SCHEMA)


def clusters(rng, n, dims=6, k=12):
    centres = rng.normal(size=(k, dims)) * 30
    return centres[rng.integers(0, k, n)] + rng.normal(size=(n, dims))


@pytest.mark.parametrize("cosine", [False, True])
def test_pivots_are_exact_and_meet_few_pairs(spark, cosine):
    rng = np.random.default_rng(8)
    real, syn = clusters(rng, 700), clusters(np.random.default_rng(9), 500)
    real[100:160] = real[5]  # copies
    syn[3] = real[7]
    met = spark.sparkContext.accumulator(0)
    got = N.nearest_k(frame(spark, real, syn), 3, ("RR", "RS", "SR"), cosine, size=16, compared=met).collect()
    metric = P.cosine_matrix if cosine else P.l2_matrix
    for name, a, b in (("RR", real, real), ("RS", real, syn), ("SR", syn, real)):
        d = metric(a, b)
        if a is b:
            np.fill_diagonal(d, np.inf)
        want = np.sort(d, axis=1)[:, :3]
        rows = sorted((r.i, r.d, r.j) for r in got if r.pair_set == name)
        assert [r[0] for r in rows] == [i for i in range(len(a)) for _ in range(3)]
        assert np.allclose([r[1] for r in rows], want.ravel(), atol=1e-9)
        assert all(math.isclose(d[i, j], e, abs_tol=1e-9) for i, e, j in rows)
        if not cosine and a is b:  # equal distances: the smaller number
            assert [r[2] for r in rows if r[0] == 120] == [5, 100, 101]
    assert met.value < 0.5 * (700 * 700 + 2 * 700 * 500)


def test_few_and_no_signals(spark):
    one = frame(spark, np.ones((1, 4)), np.zeros((0, 4)))
    assert N.nearest_k(one, 2, ("RR", "RS")).count() == 0
    assert N.nearest_k(one.limit(0)).count() == 0
    two = frame(spark, np.ones((2, 4)), np.zeros((1, 4)))
    assert sorted(tuple(r) for r in N.nearest_k(two, 5, ("RR", "RS")).collect()) == [("RR", 0, 1, 0.0), ("RR", 1, 0, 0.0), ("RS", 0, 0, 2.0), ("RS", 1, 0, 2.0)]


def test_warping_is_exact_with_less_work(spark):
    rng = np.random.default_rng(10)
    walk = lambda n: np.cumsum(rng.normal(size=(n, 40)), axis=1) + 20 * rng.integers(0, 5, (n, 1))
    real, syn = walk(70), walk(50)
    syn[2] = syn[8] = real[4]
    work = spark.sparkContext.accumulator(0)
    got = {(r.pair_set, r.i): (r.d, r.j) for r in W.nearest_warped(frame(spark, real, syn), ("RS", "RR", "SR", "SS"), 16, work).collect()}
    full = 0
    for name, a, b in (("RS", real, syn), ("RR", real, real), ("SR", syn, real), ("SS", syn, syn)):
        d = P.dtw_matrix(a, b)
        full += d.size * 40 * 40
        if a is b:
            np.fill_diagonal(d, np.inf)
        for i in range(len(a)):
            assert math.isclose(got[name, i][0], d[i].min(), abs_tol=1e-9) and got[name, i][1] == d[i].argmin()
    assert got["RS", 4] == (0.0, 2) and work.value < 0.4 * full
    assert (W.lower_bounds(real, syn) <= P.dtw_matrix(real, syn) + 1e-9).all()


def test_curve():
    a, b = N.curve()
    assert abs(a - 1.577) < 2e-3 and abs(b - 0.895) < 2e-3


def test_fuzzy_graph(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 3))
    x[1] = x[0]
    d = P.l2_matrix(x, x)
    np.fill_diagonal(d, np.inf)
    k = 5
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    directed = {}
    for i in range(40):
        e = d[i, near[i]]
        rho = e[e > 0].min()
        low, high = 1e-9, 1e9
        for _ in range(200):
            mid = (low * high) ** 0.5
            low, high = (low, mid) if np.exp(-np.maximum(e - rho, 0) / mid).sum() > math.log2(k + 1) else (mid, high)
        directed |= {(i, int(j)): math.exp(-max(v - rho, 0) / high) for j, v in zip(near[i], e, strict=True)}
    want = {(i, j): directed.get((i, j), 0) + directed.get((j, i), 0) - directed.get((i, j), 0) * directed.get((j, i), 0) for i, j in {(min(p), max(p)) for p in directed}}
    rows = spark.createDataFrame([(i, int(j), float(d[i, j])) for i in range(40) for j in near[i]], "i long, j long, d double")
    got = {(r.i, r.j): r.w for r in N.fuzzy_graph(rows, k).collect()}
    assert set(got) <= set(want) and all(math.isclose(got.get(e, 0.0), w, abs_tol=1e-6) for e, w in want.items())


def trustworthiness(x, y, k):
    n = len(x)
    dx, dy = P.l2_matrix(x, x), P.l2_matrix(y, y)
    np.fill_diagonal(dx, -1)
    np.fill_diagonal(dy, np.inf)
    rank = np.argsort(np.argsort(dx, axis=1, kind="stable"), axis=1)  # 0: itself
    near = np.argsort(dy, axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(rank[i, j] - k, 0) for i in range(n) for j in near[i])


@pytest.mark.parametrize("vertices", [4096, 60])
def test_plane_keeps_neighbours(spark, vertices):
    """In one task, and dealt over several with rounds between them."""
    rng = np.random.default_rng(12)
    x = clusters(rng, 240, dims=10, k=6)
    df = frame(spark, x[:120], x[120:])
    at = N.plane(df, vertices=vertices).collect()
    y = np.zeros((240, 2))
    for r in at:
        y[r.idx + (0 if r.role == "real" else 120)] = r.x
    assert len(at) == 240 and np.isfinite(y).all()
    assert trustworthiness(x, y, 7) > (0.95 if vertices > 240 else 0.9)
    again = {(r.role, r.idx): tuple(r.x) for r in N.plane(df.repartition(5), vertices=vertices).collect()}
    assert again.keys() == {(r.role, r.idx) for r in at}
