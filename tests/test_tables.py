"""Table functions against the operators; similarity in colour against windows one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tables
from tidemark.operators import features as E
from tidemark.operators import spectral_pairs as X


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(5)
    rows = [(s, "real", t, float(v)) for s in range(6) for t, v in enumerate(np.abs(np.convolve(rng.normal(size=400), np.ones(6))))]
    df = spark.createDataFrame(rows, "signal_id long, role string, t long, v double").repartition(4)
    df.createOrReplaceTempView("samples_of_tables")
    tables.register(spark)
    return df


def test_bursts_in_sql(spark, samples):
    got = spark.sql("SELECT * FROM bursts(TABLE(SELECT signal_id, t, v FROM samples_of_tables) PARTITION BY signal_id ORDER BY (t), 128.0D, 0.6D, 16.0D, 16.0D)").collect()
    want = E.bursts(samples, 128.0, p=60.0, min_ms=16.0, merge_ms=16.0).select("signal_id", "start", "end", "peak", "duration_s").collect()
    key = lambda r: (r.signal_id, r.start, r.end, round(r.peak, 9), round(r.duration_s, 9))
    assert sorted(map(key, got)) == sorted(map(key, want)) and got


@pytest.mark.parametrize(("size", "step"), [(64, 32), (50, 50), (10, 25)])
def test_windows_in_sql(spark, samples, size, step):
    got = spark.sql(f"SELECT * FROM windows(TABLE(SELECT signal_id, t, v FROM samples_of_tables) PARTITION BY signal_id ORDER BY (t), {size}, {step})").collect()
    x = {r.signal_id: [e.v for e in sorted(r.s)] for r in samples.groupBy("signal_id").agg(F.collect_list(F.struct("t", "v")).alias("s")).collect()}
    want = {(s, w): v[w * step : w * step + size] for s, v in x.items() for w in range((len(v) - size) // step + 1)}
    assert {(r.signal_id, r.window): list(r.x) for r in got} == want


def test_colour_similarity():
    rng = np.random.default_rng(6)
    a, b = rng.random((12, 15)) * 4, rng.random((12, 15)) * 3
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    total = []
    for k in range(3):
        u, v = (np.round(255 * np.clip(3 * (x - low) / (high - low) - k, 0, 1)) for x in (a, b))
        for i in range(6):
            for j in range(9):
                p, q = u[i : i + 7, j : j + 7].ravel(), v[i : i + 7, j : j + 7].ravel()
                c = np.cov(p, q)
                total.append((2 * p.mean() * q.mean() + 2.55**2) * (2 * c[0, 1] + 7.65**2) / ((p.mean() ** 2 + q.mean() ** 2 + 2.55**2) * (c[0, 0] + c[1, 1] + 7.65**2)))
    ssim, nrmse, _ = X.colour_similarity(a, b)
    assert np.isclose(ssim, np.mean(total)) and np.isclose(nrmse, np.sqrt(((a - b) ** 2).mean()) / (high - low))
    assert np.allclose(X.colour_similarity(a, a), (1, 0, 1)) and X.colour_similarity(a * 0, a * 0)[0] == pytest.approx(1)
