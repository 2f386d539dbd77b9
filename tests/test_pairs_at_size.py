"""Faults that show on incomplete samples and larger tables: what the pair metrics read, shuffle and return."""

import math

import numpy as np

from tidemark.operators import measures as M
from tidemark.operators import pairs as P
from tidemark.operators import spectral_pairs as X

SCHEMA = "signal_id long, role string, idx long, x array<double>"


def frame(spark, real, syn):
    rows = [(2 * i, "real", i, r.tolist()) for i, r in enumerate(real)] + [(2 * i + 1, "synthetic", i, r.tolist()) for i, r in enumerate(syn)]
    return spark.createDataFrame(rows, SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sample_without_all_channels(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 4, 16))
    rows = [(s, "real" if s % 2 == 0 else "synthetic", c, x[s, c].tolist()) for s in range(6) for c in range(4) if s < 5 or c < 3]
    channels = spark.createDataFrame(rows, "sample_id long, role string, channel int, x array<double>")
    rho = np.array([[np.corrcoef(x[s])[a, b] if s < 5 or b < 3 else 0.0 for a in range(4) for b in range(a + 1, 4)] for s in range(6)])
    got = {r.signal_id: r.x for r in M.correlation_signals(channels).collect()}
    assert np.allclose([got[s] for s in range(6)], rho)
    d = [math.sqrt(2) * np.linalg.norm(rho[i] - rho[j]) for i in (0, 2, 4) for j in (1, 3, 5)]
    one = M.spatial(channels).first()
    assert math.isclose(one.rs_mean, np.mean(d), abs_tol=1e-9) and math.isclose(one.rs_sd, np.std(d), abs_tol=1e-9)


def test_pairs_are_not_shuffled(spark):
    """The blocks are stored once; the meeting of all pairs moves none of them."""
    rng = np.random.default_rng(4)
    real, syn = rng.normal(size=(40, 5)), rng.normal(size=(30, 5))
    met = P.pairwise(frame(spark, real, syn), lambda i, j, a, b, wanted: {"n": [int(wanted.sum())]}, "n long", size=8)
    assert "Exchange" not in plan(met) and "CartesianProduct" in plan(met)
    assert {r.pair_set: r.n for r in met.groupBy("pair_set").sum("n").toDF("pair_set", "n").collect()} == {"RR": 780, "RS": 1200, "SS": 435}
    d = np.linalg.norm(real[:, None] - syn[None], axis=2)
    by = {r.pair_set: r for r in P.mean_distances(frame(spark, real, syn), sets=("RS",)).collect()}
    assert math.isclose(by["RS"].mean, d.mean(), abs_tol=1e-9) and math.isclose(by["RS"].sd, d.std(), abs_tol=1e-9)


def test_queries_are_not_sent_to_slabs(spark):
    """Only the k nearest of each query leave a task; what meets is read, not shuffled."""
    from tidemark.operators.neighbours import nearest_k

    rng = np.random.default_rng(5)
    df = nearest_k(frame(spark, rng.normal(size=(90, 4)), rng.normal(size=(60, 4))), 2, ("RS",), size=8)
    text = plan(df)
    met = text[text.index("CartesianProduct") :]
    assert "Exchange" not in met and text.count("Exchange") == 1
    assert df.count() == 180


def test_compared_over_many_ranges(spark, monkeypatch):
    """Ranks of all pairs' values in small ranges, with ties, against the formula; values leave a task as arrays of a range."""
    rng = np.random.default_rng(6)
    real, syn = np.round(rng.normal(size=30), 1), np.round(rng.normal(size=25) + 0.3, 1)
    monkeypatch.setattr(P, "RANGE", 100)
    monkeypatch.setattr(P, "HELD", 50)
    rows = [("real", "x", float(v)) for v in real] + [("synthetic", "x", float(v)) for v in syn] + [("real", "x", None)]
    values = spark.createDataFrame(rows, "role string, statistic string, value double")
    rr = np.round(np.abs(real[:, None] - real)[np.triu_indices(30, 1)], 12)
    rs = np.round(np.abs(real[:, None] - syn), 12).ravel()
    ss = np.round(np.abs(syn[:, None] - syn)[np.triu_indices(25, 1)], 12)
    sign = np.sign(rr[:, None] - rs)
    counts = np.unique(np.concatenate([rr, rs]), return_counts=True)[1].astype(float)
    got = {r.pair_set: r for r in X.differences_compared(values, ["x"]).collect()}
    for name, d in (("RR", rr), ("RS", rs), ("SS", ss)):
        assert got[name].n == len(d) and math.isclose(got[name].mean, d.mean()) and math.isclose(got[name].sd, d.std(ddof=1))
    assert math.isclose(got["RS"].delta, sign.mean(), abs_tol=1e-12) and math.isclose(got["RS"].u, ((sign + 1) / 2).sum())
    assert math.isclose(got["RS"].ties, (counts**3 - counts).sum())
    means = {r.pair_set: r.mean for r in X.mean_differences(values).collect()}
    assert all(math.isclose(means[name], d.mean()) for name, d in (("RR", rr), ("RS", rs), ("SS", ss)))


def test_warping_keeps_plans_short(spark):
    """Each pass reads stored tables; nothing is cached, and no plan repeats the passes before it."""
    from tidemark.operators.warping import nearest_warped

    rng = np.random.default_rng(7)
    df = nearest_warped(frame(spark, rng.normal(size=(9, 4)), rng.normal(size=(7, 4))), ("RS", "RR"), 4)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in text and text.count("MapInArrow") == 2
    assert df.count() == 18


def test_frobenius_of_incomplete_samples(spark, tmp_path):
    """pm09 and sc09 over a table whose last sample lacks channels."""
    from tidemark import catalog

    rng = np.random.default_rng(8)
    x = rng.normal(size=(22, 8))
    spark.createDataFrame([(k, k % 10, v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rho = np.zeros((6, 6))
    for s in range(6):
        own = np.corrcoef(x[4 * s : 4 * s + 4])
        rho[s] = [own[a, b] if b < len(own) else 0.0 for a in range(4) for b in range(a + 1, 4)]
    d = math.sqrt(2) * np.linalg.norm(rho[:, None] - rho[None], axis=2)
    real, syn = (0, 2, 4), (1, 3, 5)
    got = {(r.pair_set, r.i, r.j): r.d for r in catalog.queries()["pm09_frobenius"](spark, str(tmp_path)).collect()}
    want = {(name, i, j): d[one[i], other[j]] for name, one, other in (("RR", real, real), ("RS", real, syn), ("SS", syn, syn)) for i in range(3) for j in range(3) if name == "RS" or i < j}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)
    rr, rs = ([v for k, v in want.items() if k[0] == name] for name in ("RR", "RS"))
    score = catalog.queries()["sc09_spatial_score"](spark, str(tmp_path)).first().score
    assert math.isclose(score, 1 / (1 + abs((np.mean(rs) - np.mean(rr)) / np.std(rr))), abs_tol=2e-6)


def test_all_pairs_over_blocks(spark):
    """Pairs are written where two blocks meet: no shuffle after the blocks, each pair once."""
    signals = frame(spark, np.zeros((23, 1)), np.zeros((9, 1)))
    rr, rs = (P.all_pairs(signals, name, 4) for name in ("RR", "RS"))
    assert "Exchange" not in plan(rr) and "CartesianProduct" in plan(rr)
    assert sorted((r.i, r.j) for r in rr.collect()) == [(i, j) for i in range(23) for j in range(i + 1, 23)]
    assert sorted((r.i, r.j) for r in rs.collect()) == [(i, j) for i in range(23) for j in range(9)]
    assert P.all_pairs(signals.where("idx < 0"), "RR").count() == 0


def test_numbers_when_cuts_differ_each_time(spark, monkeypatch):
    """Approximate quantiles may come out otherwise each time they are computed; numbers and pairs are the same."""
    from pyspark.sql import functions as F

    from tidemark.functions import ranks

    clock = F.expr("java_method('java.lang.System', 'nanoTime')").cast("long") * 7919 % 500
    monkeypatch.setattr(ranks.F, "percentile_approx", lambda column, steps, accuracy: F.transform(F.array(*map(F.lit, steps)), lambda s: clock + 0 * F.max(column)))
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("signal_id"), F.when(F.col("id") % 7 < 3, "real").otherwise("synthetic").alias("role"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = sorted((r.role, r.signal_id, r.idx) for r in P.indexed(rows).collect())
        n = sum(g[0] == "real" for g in got)
        pairs = sorted((r.i, r.j) for r in P.all_pairs(P.indexed(rows), "RS").collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    for role in ("real", "synthetic"):
        assert [g[2] for g in got if g[0] == role] == list(range(sum(g[0] == role for g in got)))
    assert pairs == [(i, j) for i in range(n) for j in range(500 - n)]


def test_envelope_of_a_band(spark):
    """Against the rows of each scalogram; signals of two lengths, one of zeros; only the band is formed and nothing is shuffled."""
    rng = np.random.default_rng(9)
    freqs = [5.0, 14.0, 20.0, 29.0, 40.0]
    x = [rng.normal(size=96), rng.normal(size=64), np.zeros(96), rng.normal(size=96)]
    df = spark.createDataFrame([("real", k, v.tolist()) for k, v in enumerate(x)], "role string, idx long, x array<double>")
    found = X.band_envelope(df, freqs, 128.0)
    assert "Exchange" not in plan(found) and "Window" not in plan(found)
    got = {r.idx: r.x for r in found.collect()}
    for k, v in enumerate(x):
        mean = X.scalogram(v, 128.0, np.array(freqs))[1:4].mean(axis=0)
        mean = mean / np.median(mean) if np.median(mean) > 0 else mean
        assert np.allclose(got[k], np.convolve(mean, np.ones(3), "same") / 3, atol=1e-12)
