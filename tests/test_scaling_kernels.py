"""Kernels that replaced quadratic ones, against those; densities; the npy source."""

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import density as D
from tidemark.operators import features as E
from tidemark.sources import npy


def words_by_search(bits):
    s, words, at = bytes(bits), 0, 0
    while at < len(s):
        size = 1
        while at + size <= len(s) and s.find(s[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        words, at = words + 1, at + size
    return words


@given(st.one_of(st.lists(st.booleans(), max_size=200), st.tuples(st.lists(st.booleans(), min_size=1, max_size=6), st.integers(1, 40)).map(lambda p: p[0] * p[1])))
@settings(max_examples=300, deadline=None)
def test_history_words(bits):
    assert E.history_words(bits) == words_by_search(bits)


def test_history_of_a_long_signal():
    began = time.perf_counter()
    assert E.history_words(([True] * 30 + [False] * 7) * 8000) < 60
    assert E.history_words((np.random.default_rng(1).random(300_000) < 0.5).tolist()) > 10_000
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("k", [1, 2, 3])
def test_pairs_within(k):
    rng = np.random.default_rng(k)
    for trial in range(40):
        x = rng.normal(size=rng.integers(k, 300)) if trial % 2 else rng.integers(0, 6, rng.integers(k, 300)) * 0.5
        t = np.lib.stride_tricks.sliding_window_view(x, k)
        for r in (0.0, 0.5, 1.0, 0.13, 50.0):  # 0.5 and 1.0 are met exactly
            want = (int((np.abs(t[:, None] - t[None]).max(axis=2) <= r).sum()) - len(t)) // 2
            assert E.pairs_within(t, r) == want


def test_sample_entropy_of_a_long_signal():
    x = np.random.default_rng(2).normal(size=30_000)
    began = time.perf_counter()
    assert 2.0 < E.sample_entropy_one(x) < 2.4
    assert time.perf_counter() - began < 60


def test_density_against_plain_sum(spark):
    rng = np.random.default_rng(3)
    values = {"real": rng.normal(size=400), "synthetic": rng.normal(2, 3, size=300), "flat": np.ones(5)}
    rows = [("f", r, float(v)) for r, vs in values.items() for v in vs] + [("f", "real", None), ("f", "real", float("nan"))]
    out = D.kernel_density(spark.createDataFrame(rows, "feature string, role string, value double"), ["feature"], 256).collect()
    assert {r.role for r in out} == {"real", "synthetic"} and len(out) == 512
    for role in ("real", "synthetic"):
        v = values[role]
        h = v.std(ddof=1) * len(v) ** -0.2
        own = sorted((r.x, r.density) for r in out if r.role == role)
        want = [np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi)) for x, _ in own]
        assert np.abs(np.array([d for _, d in own]) - want).max() < 5e-3 * max(want)
        assert abs(sum(d for _, d in own) * (own[1][0] - own[0][0]) - 1) < 0.01


def test_plane_density_against_plain_sum(spark):
    rng = np.random.default_rng(4)
    p = {"real": rng.normal(size=(200, 2)), "synthetic": rng.normal(1, 2, size=(150, 2))}
    rows = [(r, float(a), float(b)) for r, v in p.items() for a, b in v]
    out = D.plane_density(spark.createDataFrame(rows, "role string, a double, b double"), 64).collect()
    assert len(out) == 2 * 64 * 64
    for role, v in p.items():
        h = v.std(axis=0, ddof=1) * len(v) ** (-1 / 6)
        own = [r for r in out if r.role == role]
        want = np.array([np.exp(-0.5 * (((r.a - v[:, 0]) / h[0]) ** 2 + ((r.b - v[:, 1]) / h[1]) ** 2)).sum() for r in own]) / (len(v) * h[0] * h[1] * 2 * math.pi)
        assert np.abs(np.array([r.density for r in own]) - want).max() < 0.03 * want.max()


def test_npy_source(spark, tmp_path):
    npy.register(spark)
    a, b, c = np.arange(2000.0).reshape(500, 4), np.array([1, 2, 3], np.int16), np.asfortranarray(np.arange(6.0, dtype=np.float32).reshape(2, 3))
    for name, x in (("a", a), ("b", b), ("c", c), ("e", np.zeros((0, 4)))):
        np.save(tmp_path / f"{name}.npy", x)
    (tmp_path / "note.txt").write_text("no array")
    df = spark.read.format("npy").option("partitionBytes", 4096).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 + 1 + 1
    rows = {(r.path.rsplit("/", 1)[1], r.signal_id): r.x for r in df.collect()}
    assert len(rows) == 503 and all(rows["a.npy", i] == a[i].tolist() for i in range(500))
    assert rows["b.npy", 0] == [1.0, 2.0, 3.0] and rows["c.npy", 1] == [3.0, 4.0, 5.0]
    assert df.where(F.col("signal_id") == 7).count() == 1
    one = spark.read.format("npy").load(f"file://{tmp_path}/b.npy").first()
    assert one.x == [1.0, 2.0, 3.0]
    np.save(tmp_path / "z.npy", np.array([{}], object), allow_pickle=True)
    with pytest.raises(Exception, match="object arrays"):
        spark.read.format("npy").load(str(tmp_path)).count()
