"""Kernels that take all pairs of two blocks at a time, against the plain form of each pair."""

import math

import numpy as np

from tidemark.operators import pairs as P
from tidemark.operators import spectral_pairs as X

SCHEMA = "signal_id long, role string, idx long, x array<double>"


def frame(spark, real, syn):
    rows = [(2 * i, "real", i, r.tolist()) for i, r in enumerate(real)] + [(2 * i + 1, "synthetic", i, r.tolist()) for i, r in enumerate(syn)]
    return spark.createDataFrame(rows, SCHEMA)


def test_similarities_of_blocks():
    """Images of any scale, constant ones and copies; only wanted pairs count."""
    rng = np.random.default_rng(11)
    a, b = (np.abs(rng.normal(size=(n, 9 * 40))) * rng.uniform(0.1, 9, (n, 1)) + rng.uniform(0, 2, (n, 1)) for n in (6, 11))
    a[1], b[2], b[3], b[4] = 0.0, 0.0, a[0], a[0] + 1e-9
    wanted = np.add.outer(np.arange(6), -np.arange(11)) < 2
    found = X.similarities(a, b, 9, wanted)
    for i, j in np.argwhere(wanted):
        assert np.allclose([v[i, j] for v in found], X.similarity(a[i].reshape(9, -1), b[j].reshape(9, -1)), atol=1e-9)


def test_time_frequency_score_leaves_no_row_a_pair(spark):
    rng = np.random.default_rng(12)
    real, syn, freqs = rng.normal(size=(5, 64)), rng.normal(size=(4, 64)), [float(f) for f in range(4, 14)]
    images = [[X.scalogram(x, 128.0, np.array(freqs)) for x in rows] for rows in (real, syn)]
    s = [0.4 * m + 0.3 / (1 + n) + 0.3 * c for m, n, c in (X.similarity(u, v) for u in images[0] for v in images[1])]
    found = X.time_frequency_score(frame(spark, real, syn), 128.0, freqs)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    one = found.first()
    assert math.isclose(one.score, np.mean(s), abs_tol=1e-9) and math.isclose(one.sd, np.std(s, ddof=1), abs_tol=1e-9)
    rows = {(r.pair_set, r.i, r.j): r.ssim for r in X.scalogram_similarity(frame(spark, real, syn), 128.0, freqs).collect()}
    assert len(rows) == 10 + 20 + 6 and math.isclose(rows["RS", 4, 3], X.similarity(images[0][4], images[1][3])[0], abs_tol=1e-9)


def test_warping_in_whole_numbers_first():
    """On noise, where bounds say nothing: each row's nearest, equal ones included, and few pairs in full."""
    from tidemark.operators import warping as W

    rng = np.random.default_rng(13)
    a, b = rng.normal(size=(20, 48)), rng.normal(size=(150, 48))
    b[40] = b[90] = a[3]
    d = P.dtw_matrix(a, b)
    limit = np.sort(d, axis=1)[:, 9].copy()
    p, q, found, cells = W.near_pairs(a, b, *np.nonzero(np.ones(d.shape, bool)), limit)
    assert (found == d[p, q]).all() and len(p) < 300 and cells < 1.3 * d.size * 48 * 48
    assert all(min(zip(found[p == i], q[p == i], strict=True)) == (d[i].min(), d[i].argmin()) for i in range(20))
    assert np.allclose(limit, d.min(axis=1))
    for top in (0.0, 1e300, np.inf):  # limits that leave no room for whole numbers
        p, q, found, _ = W.near_pairs(a[:4], b[:60] * 1e-3, *np.nonzero(np.ones((4, 60), bool)), np.full(4, top), np.full(60, top))
        assert (found == P.dtw_matrix(a[:4], b[:60] * 1e-3)[p, q]).all() and (len(p) >= 4 if top else not len(p))
    assert (W.lower_bounds(a, b) <= d + 1e-9).all()


def test_fluctuations_of_columns(spark):
    """Means of some columns, and pairs, against plain sums over windows; signals travel, not their residuals."""
    rng = np.random.default_rng(14)
    real, syn, sizes, qs = rng.normal(size=(5, 90)), rng.normal(size=(4, 90)), [8, 13, 30], [-2.0, -1.0, 0.0, 1.0, 3.0]
    rest = lambda x, n: [(lambda y, i: y - np.polyval(np.polyfit(i, y, 1), i))(p, np.arange(n)) for p in np.cumsum(x - x.mean())[: len(x) // n * n].reshape(-1, n)]
    logs = np.log(sizes)

    def plain(x, y):
        f2 = [np.array([(u * v).mean() for u, v in zip(rest(x, n), rest(y, n), strict=True)]) for n in sizes]
        own = [[np.array([(u * u).mean() for u in rest(z, n)]) for n in sizes] for z in (x, y)]
        rho = np.tanh(np.mean([np.arctanh(f.mean() / np.sqrt(a.mean() * b.mean())) for f, a, b in zip(f2, *own, strict=True)]))
        fq = lambda f: np.array([[(np.abs(v) ** (q / 2)).mean() ** (1 / q) for v in f] for q in qs if q])
        hq = np.array([np.polyfit(logs, np.log(row), 1)[0] for row in fq(f2)])
        alpha = hq + np.array([q for q in qs if q]) * np.gradient(hq, [q for q in qs if q])
        return rho, np.polyfit(logs, 0.5 * np.log([abs(f.mean()) for f in f2]), 1)[0], hq.mean(), (fq(f2) / (np.sqrt(fq(own[0]) * fq(own[1])) + 1e-12)).mean(), np.ptp(alpha)

    want = np.array([plain(x, y) for x in real for y in syn])
    signals = frame(spark, real, syn)
    rows = sorted(X.cross_fluctuations(signals, sizes, qs, 90, ("RS",)).collect(), key=lambda r: (r.i, r.j))
    assert np.allclose([[r[c] for c in X.FLUCTUATIONS] for r in rows], want)
    got = X.mean_fluctuations(signals, sizes, qs, 90, ("RS",), ("h", "p")).first()
    assert np.allclose([got.h, got.h_sd, got.p, got.p_sd], [want[:, 1].mean(), want[:, 1].std(), want[:, 3].mean(), want[:, 3].std()])
    halves = X._cross(sizes, [-1.0, 0.5, 1.0], 90, ("hq",))
    assert np.isfinite(halves[1](*(halves[0](x) for x in (real, syn)))["hq"]).all()


def test_coherence_by_matrix_products(spark, monkeypatch):
    """Against each pair's own formula, with few segments and with many; a constant signal's is 0, copies' equal."""
    from tidemark.operators import features as E

    rng = np.random.default_rng(15)
    real, syn = rng.normal(size=(5, 256)), rng.normal(size=(4, 256))
    real[2], syn[1] = 3.0, real[1]
    signals, config = frame(spark, real, syn), E.SpectrumConfig(128.0)
    size = config.coherence_segment(256)
    freqs, (low, high) = np.arange(size // 2 + 1) * 128.0 / size, config.band
    mask = (freqs >= low) & (freqs <= high)

    def plain(x, y):
        u, v = (E.segment_spectra(z, size, config.overlap) for z in (x, y))
        power = (np.abs(u) ** 2).sum(axis=0) * (np.abs(v) ** 2).sum(axis=0)
        c = np.where(power > 1e-20, np.abs((u.conj() * v).sum(axis=0)) ** 2 / np.where(power > 1e-20, power, 1), 0.0)
        return X.simpson_last(c[mask], 128.0 / size) / (high - low)

    want = np.array([[plain(x, y) for y in syn] for x in real])
    for flat in (X.FLAT, 1):
        monkeypatch.setattr(X, "FLAT", flat)
        got = {(r.i, r.j): r.coherence for r in X.coherence(signals, config, ("RS",)).where("band = 'Global'").collect()}
        assert np.allclose([[got[i, j] for j in range(4)] for i in range(5)], want, atol=1e-12)
    assert math.isclose(X.mean_coherence(signals, config).first()["mean"], want.mean(), abs_tol=1e-12)


def test_values_are_sent_in_small_steps_and_rounds(spark, monkeypatch):
    """Sorted values come back bit for bit and are packed well; a key at a time gives the same as all together."""
    import zlib

    from tidemark.operators import features as E

    v = np.sort(np.random.default_rng(16).normal(size=5000))
    v = np.unique(np.concatenate([v, [0.0, 1e300, -1e300, 5e-324]]))
    assert (P._unpacked(P._packed(v)) == v).all()
    near = np.linspace(0.3, 0.301, 5000) + 1e-12 * np.sin(np.arange(5000))
    assert len(zlib.compress(P._packed(near), 1)) < 0.8 * len(zlib.compress(near.tobytes(), 1))
    rng = np.random.default_rng(17)
    signals = frame(spark, rng.normal(size=(7, 256)), rng.normal(size=(6, 256)))
    found = []
    for most in (P.SHUFFLED, 10):
        monkeypatch.setattr(P, "SHUFFLED", most)
        rows = X.coherence_compared(signals, E.SpectrumConfig(128.0, bands=[("Low", 1.0, 20.0)])).collect()
        found.append(sorted((r.band, r.pair_set, r.n, round(r["mean"], 12), r.u, r.ties) for r in rows))
    assert found[0] == found[1] and len(found[0]) == 6


def test_plane_scores_leave_a_row_a_signal_and_task(spark, monkeypatch):
    """Sums over all pairs are added up within a task; rows do not grow with the pairs of blocks."""
    from tidemark.operators import measures as M

    rng = np.random.default_rng(18)
    real, syn, inner, seen = rng.normal(size=(40, 2)), rng.normal(size=(30, 2)) + 1, P.pairwise, []
    monkeypatch.setattr(P, "pairwise", lambda *args, **options: seen.append(inner(*args, **options | {"size": 1})) or seen[-1])
    score = M.embedding_scores(frame(spark, real, syn)).first()
    own = lambda x: np.linalg.norm(x[:, None] - x, axis=2).sum(axis=1) / (len(x) - 1)
    other = np.linalg.norm(real[:, None] - syn, axis=2)
    s = [(o - a) / np.maximum(a, o) for a, o in ((own(real), other.mean(axis=1)), (own(syn), other.mean(axis=0)))]
    assert math.isclose(score.mixing, 1 - abs((s[0].mean() + s[1].mean()) / 2), abs_tol=1e-9)
    assert seen[0].where("pair_set = 'RS'").count() <= 8 * (40 + 30)
