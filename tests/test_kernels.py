"""Kernels against plain formulas, and the behaviour that theory demands of the measures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import features as E
from tidemark.operators import measures as M
from tidemark.operators import pairs as P
from tidemark.operators import transforms as T
from tidemark.operators.neighbours import nearest_k
from tidemark.sources import signals as G


def frame(spark, real, synthetic):
    rows = [(i, role, [float(v) for v in x]) for role, xs in (("real", real), ("synthetic", synthetic)) for i, x in enumerate(xs)]
    return spark.createDataFrame([(k, role, i, x) for k, (i, role, x) in enumerate(rows)], "signal_id long, role string, idx long, x array<double>")


def test_edges_of_transforms(spark):
    df = spark.createDataFrame([(1, [3.0] * 8), (2, [1.0, 2.0, 4.0]), (3, [5.0]), (4, []), (5, None), (6, [1.0, float("nan")]), (7, [float("inf"), 1.0])], "signal_id long, x array<double>")
    x = F.col("x")
    got = {r[0]: r for r in df.select("signal_id", T.minmax(x).alias("m"), T.zscore_signal(x).alias("z"), T.detrend(x).alias("d"), E.permutation_entropy(x).alias("p"), E.simpson(x, F.lit(1.0)).alias("s")).collect()}
    assert got[1].m == [-1.0] * 8 and got[1].z == [0.0] * 8 and got[1].p < 1e-9
    assert got[2].p is not None and got[3].p is None and got[3].s == 0.0
    assert np.allclose(got[2].d, np.array([1, 2, 4]) - np.polyval(np.polyfit([0, 1, 2], [1, 2, 4], 1), [0, 1, 2]))
    assert {r.signal_id for r in T.usable(df).collect()} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        T.normalise(df, "other")
    with pytest.raises(ValueError):
        T.pad(df.where("signal_id < 3"), allow=False)


def test_resampling_and_smoothing():
    t = np.arange(64) / 64
    x = np.sin(2 * np.pi * 3 * t)
    assert np.allclose(T.resample_one(x, 128)[::2], x) and np.allclose(T.resample_one(x, 32), x[::2])
    line = 2.0 * np.arange(40) + 1
    assert np.allclose(T.savgol_one(line, 11, 3), line)
    y = T.surrogate_one(x + 0.3 * np.cos(9 * t), 1)
    assert math.isclose(y.std(), (x + 0.3 * np.cos(9 * t)).std(), rel_tol=1e-9) and np.array_equal(y, T.surrogate_one(x + 0.3 * np.cos(9 * t), 1))


def test_entropies_order_noise_and_sine():
    rng = np.random.default_rng(0)
    noise, sine = rng.normal(size=600), np.sin(np.arange(600) / 8)
    assert E.sample_entropy_one(noise) > 3 * E.sample_entropy_one(sine)
    assert E.lz_complexity_one(noise) > 2 * E.lz_complexity_one(sine)
    assert math.isnan(E.sample_entropy_one(np.ones(3))) and E.lz_complexity_one(np.zeros(64)) < 0.3


def test_hurst_of_noises(spark):
    rng = np.random.default_rng(1)
    white = rng.normal(size=(6, 4096))
    brown = np.cumsum(white, axis=1)
    df = frame(spark, white, brown).withColumn("x", T.profile(F.col("x")))
    h = E.hurst(E.fluctuations(G.samples(df).withColumnRenamed("v", "y"), ["role", "signal_id"], T.window_sizes(4096)), ["role", "signal_id"], [2.0])[1].groupBy("role").avg("h").collect()
    by = {r[0]: r[1] for r in h}
    assert abs(by["real"] - 0.5) < 0.1 and abs(by["synthetic"] - 1.5) < 0.1


def test_pair_kernels():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(5, 9)), rng.normal(size=(4, 7))

    def slow(x, y):
        d = np.full((len(x) + 1, len(y) + 1), np.inf)
        d[0, 0] = 0
        for i, j in itertools.product(range(len(x)), range(len(y))):
            d[i + 1, j + 1] = abs(x[i] - y[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
        return d[-1, -1]

    assert np.allclose(P.dtw_matrix(a, b), [[slow(x, y) for y in b] for x in a])
    c = np.vstack([a[:2], rng.normal(size=(3, 9))])
    assert np.allclose(P.l2_matrix(a, c), np.sqrt(((a[:, None] - c[None]) ** 2).sum(axis=2)), atol=1e-12)


def test_rank_statistics(spark):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(size=40), 1), np.round(rng.normal(size=55) + 0.3, 1)
    df = spark.createDataFrame([("k", "real", float(v)) for v in x] + [("k", "synthetic", float(v)) for v in y] + [("k", "real", float("nan")), ("one", "real", 1.0)], "k string, role string, value double")
    rows = stats.compare(df, ["k"]).collect()
    assert len(rows) == 1
    r = rows[0]
    delta = np.mean(np.sign(x[:, None] - y[None]))
    grid = np.unique(np.r_[x, y])
    cdf = lambda v: np.searchsorted(np.sort(v), grid, "right") / len(v)
    assert math.isclose(r.delta, delta, abs_tol=1e-12) and math.isclose(r.u, (delta + 1) / 2 * len(x) * len(y), rel_tol=1e-12)
    assert math.isclose(r.w1, (np.abs(cdf(x) - cdf(y))[:-1] * np.diff(grid)).sum(), rel_tol=1e-9)


def test_p_values():
    assert math.isclose(stats.mann_whitney_p(0, 3, 3, 0), 0.1, rel_tol=1e-12)
    assert math.isclose(stats.wilcoxon_p(0, 5, 0), 2 / 32, rel_tol=1e-12)
    assert math.isclose(stats.student_p(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(stats.student_p(12.706204736, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.chi2_3_p(7.814727903), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.normal_quantile(0.975), 1.959963984540054, rel_tol=1e-9)
    rng = np.random.default_rng(4)
    assert stats.shapiro(rng.normal(size=200).tolist())[1] > 0.05 > stats.shapiro(rng.exponential(size=200).tolist())[1]
    assert stats.shapiro([1.0, 2.0]) is None


@pytest.mark.parametrize(("name", "shift", "expect"), [("same", 0.0, 1.0), ("shifted", 60.0, 0.0)])
def test_coverage_of_scenarios(spark, name, shift, expect):
    rng = np.random.default_rng(5)
    real = rng.normal(size=(40, 16))
    df = frame(spark, real, real + shift)
    c = M.coverage(df).first()
    assert (c.coverage, c.outliers) == (expect, expect)
    d = M.intrinsic_diversity(df).first()
    assert all(math.isclose(v, 1.0, rel_tol=1e-9) for v in d)
    score = M.time_score(M.hjorth_metrics(df)).first()["score"]
    assert math.isclose(score, 1.0, abs_tol=1e-6)  # Hjorth parameters do not see a shift


def test_nearest_is_exact_over_blocks(spark):
    rng = np.random.default_rng(6)
    real, syn = rng.normal(size=(23, 5)), rng.normal(size=(31, 5))
    syn[4] = syn[9] = real[7]
    df = frame(spark, real, syn)
    got = {(r.pair_set, r.i): (r.d, r.j) for r in nearest_k(df, 1, ("RS", "SR", "RR"), size=3).collect()}
    d = np.sqrt(((real[:, None] - syn[None]) ** 2).sum(axis=2))
    for i in range(23):
        assert got["RS", i][1] == d[i].argmin() and math.isclose(got["RS", i][0], d[i].min(), abs_tol=1e-9)
    for j in range(31):
        assert got["SR", j][1] == d[:, j].argmin()
    assert got["RS", 7] == (0.0, 4) and len(got) == 23 * 2 + 31


def test_attack_sweep_and_weights(spark):
    rows = spark.createDataFrame([("a", True, 0.9), ("a", True, 0.8), ("a", False, 0.3), ("a", False, 0.8)], "attack string, member boolean, value double")
    assert M.threshold_accuracy(rows).first()["accuracy"] == 0.75
    w = M.entropy_weights([0.2, 0.8])
    assert math.isclose(sum(w), 1) and w[1] > w[0]


def test_npy_and_channel_checks(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(2, 3))
    rows = {r.signal_id: r.x for r in G.read_npy(spark, str(tmp_path)).collect()}
    assert rows == {0: [0.0, 1.0, 2.0], 1: [3.0, 4.0, 5.0]}
    df = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [1.0, 2.0]), (2, 0, [1.0])], "sample_id long, channel int, x array<double>")
    assert not any(r.valid for r in G.validate_channels(df).collect())


def test_registered_with_the_references_sizes(monkeypatch):
    import inspect

    from tidemark.plans import measures, spectral_pairs

    seen = {}

    def spy(name, operator):
        def call(*args, **kwargs):
            bound = inspect.signature(operator).bind(*args, **kwargs)
            bound.apply_defaults()
            seen.update({name: bound.arguments})
            raise StopIteration

        return call

    for module, operators, name, query in ((measures, measures.M, "membership", measures.ag39), (spectral_pairs, spectral_pairs.X, "surrogate_z", spectral_pairs.fe22)):
        monkeypatch.setattr(operators, name, spy(name, getattr(operators, name)))
        monkeypatch.setattr(module.G, "short", lambda spark, d: None)
        with pytest.raises(StopIteration):
            query(None, "")
    assert seen["membership"]["trees"] == 100 and seen["surrogate_z"]["n"] >= 10


@pytest.mark.parametrize("n", [0, 1, 2, 7, 12, 13])
def test_sampled_pairs_do_not_recur(spark, n):
    signals = spark.createDataFrame([(role, k) for role in ("real", "synthetic") for k in range(n)], "role string, idx long")
    for pair_set in P.SETS:
        every = {(i, j) for i in range(n) for j in range(n) if pair_set == "RS" or i < j}
        for cap in (None, 5):
            got = [(r["i"], r["j"]) for r in P.sample_pairs(signals, pair_set, cap).collect()]
            assert len(set(got)) == len(got) == min(len(every), cap or len(every))
            assert set(got) <= every


def test_exact_quantiles(spark):
    from tidemark.functions.ranks import quantiles

    rng = np.random.default_rng(7)
    values = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0, 5.0], [300, 1, 2]), "c": np.array([4.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("d", None), ("a", None)]
    got = {r.k: (r.q0, r.q1, r.q5, r.q9) for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.99}).collect()}
    for k, v in values.items():
        assert np.allclose(got[k], np.quantile(v, [0, 0.1, 0.5, 0.99]), rtol=0, atol=1e-12)
    assert got["d"] == (None,) * 4


def test_twelve_components(spark):
    rng = np.random.default_rng(8)
    rows = {r.component: r.value for r in M.diversity_score(frame(spark, rng.normal(size=(60, 8)), rng.normal(size=(60, 8)))).collect()}
    assert len(rows) == 13 and all(0 <= v <= 1 for v in rows.values())
    assert {"pca_mixing", "graph_mixing", "graph_overlap", "graph_cov_shape", "local_p10"} <= set(rows)
    apart = {r.component: r.value for r in M.diversity_score(frame(spark, rng.normal(size=(60, 8)), rng.normal(size=(60, 8)) + 9)).collect()}
    assert apart["graph_overlap"] < 0.5 < rows["graph_overlap"] and apart["score"] < rows["score"]
