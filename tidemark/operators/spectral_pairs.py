"""Pair metrics on spectra, scalograms and fluctuations. What belongs to one signal is computed once and then meets in blocks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions import stats
from tidemark.functions.ranks import running
from tidemark.operators import features as E
from tidemark.operators import pairs as P
from tidemark.operators import transforms as T


def simpson_last(y: np.ndarray, step: float) -> np.ndarray:
    """Simpson's integral along the last axis."""
    n = y.shape[-1]
    if n < 2:
        return np.zeros(y.shape[:-1])
    if n == 2:
        return step * y.sum(axis=-1) / 2
    m = n if n % 2 else n - 1
    w = np.ones(m)
    w[1:-1:2], w[2:-1:2] = 4, 2
    out = step / 3 * (y[..., :m] @ w)
    return out if n % 2 else out + step * (5 * y[..., -1] + 8 * y[..., -2] - y[..., -3]) / 12


def coherence_bands(config: E.SpectrumConfig) -> list[tuple[str, float, float]]:
    """The global band and the bands within it; the last ends with the analysis band."""
    low, high = config.band
    inside = [(n, max(a, low), min(b, high)) for n, a, b in config.bands if a < high and b > low]
    return [("Global", low, high), *inside]


#: Signals in a block whose coherence is taken; most segments for which it is one product of matrices.
COHERENT, FLAT = 128, 8


def _coherence(signals: DataFrame, config: E.SpectrumConfig):
    """(signals of one length, names of the bands, what a matrix of signals is prepared to, a function of two such matrices and of bands: a
    matrix of values per band).

    The segments' spectra at a frequency, over the root of their summed power, are a unit vector u; coherence is |u* v|^2. That is the
    product of the matrices u u* and v v*, taken as real vectors, so a band's integral over all frequencies is one matrix product.
    """
    n = signals.agg(F.min(F.size("x"))).first()[0] or 8
    size = config.coherence_segment(n)
    freqs = np.arange(size // 2 + 1) * config.fs / size
    high, step = config.band[1], config.fs / size
    segments = 1 + (n - size) // (size - int(size * config.overlap))
    inside = {}
    for name, lo, hi in coherence_bands(config):
        at = np.flatnonzero((freqs >= lo) & ((freqs <= hi) if hi >= high else (freqs < hi)))
        inside[name] = (at[0] if len(at) else 0, simpson_last(np.eye(len(at)), step) / (hi - lo))
    per = segments**2 if segments <= FLAT else 2 * segments

    def prepare(rows: np.ndarray) -> np.ndarray:
        x = np.stack([E.segment_spectra(row, size, config.overlap) for row in rows])
        power = np.sqrt((np.abs(x) ** 2).sum(axis=1, keepdims=True))
        u = np.divide(x, power, out=np.zeros_like(x), where=power > 0)
        parts = [u.real, u.imag]
        if segments <= FLAT:
            s, t = np.triu_indices(segments, 1)
            cross = math.sqrt(2) * u[:, s] * u[:, t].conj()
            parts = [np.abs(u) ** 2, cross.real, cross.imag]
        return np.concatenate(parts, axis=1).transpose(0, 2, 1).reshape(len(rows), -1)

    def values(a: np.ndarray, b: np.ndarray, bands: list[str]) -> list[np.ndarray]:
        out = []
        for first, weights in map(inside.get, bands):
            x, y = (v[:, first * per : (first + len(weights)) * per] for v in (a, b))
            if segments <= FLAT:
                found = (x * np.repeat(weights, per)) @ y.T
            else:
                u, v = (z.reshape(len(z), -1, 2, segments) for z in (x, y))
                u, v = (z[:, :, 0] + 1j * z[:, :, 1] for z in (u, v))
                found = (np.abs(np.einsum("iks,jks->ijk", u.conj(), v)) ** 2) @ weights
            out.append(np.round(found, 13))  # the same for copies, wherever they meet
        return out

    return signals.select("role", "idx", F.slice("x", 1, n).alias("x")), [*inside], prepare, values


def coherence(signals: DataFrame, config: E.SpectrumConfig, sets: tuple[str, ...] = ("RR", "RS", "SS")) -> DataFrame:
    """(pair_set, i, j, band, coherence): magnitude-squared coherence, integrated over the band by its width, for all pairs of
    signals (role, idx, x) of one length. 0 / 0 counts as 0."""
    own, bands, prepare, values = _coherence(signals, config)

    def kernel(i, j, a, b, wanted):
        p, q = np.nonzero(wanted)
        return {"i": np.tile(i[p], len(bands)), "j": np.tile(j[q], len(bands)), "band": np.repeat(bands, len(p)), "coherence": np.concatenate([v[p, q] for v in values(a, b, bands)])}

    return P.pairwise(own, kernel, "i long, j long, band string, coherence double", sets, COHERENT, prepare=prepare)


def mean_coherence(signals: DataFrame, config: E.SpectrumConfig, band: str = "Global", sets: tuple[str, ...] = ("RS",)) -> DataFrame:
    """(pair_set, n, mean) of the coherence of all pairs in one band; a row per two blocks leaves the kernel."""
    own, _, prepare, values = _coherence(signals, config)
    found = P.pairwise(own, lambda i, j, a, b, wanted: P.moments(values(a, b, [band])[0][wanted]), "n long, mean double, m2 double", sets, COHERENT, prepare=prepare)
    return P.pooled(found, "pair_set").select("pair_set", "n", "mean")


def coherence_compared(signals: DataFrame, config: E.SpectrumConfig) -> DataFrame:
    """P.compared() of the coherence of all pairs, by band; no row per pair leaves a task."""
    own, bands, prepare, values = _coherence(signals, config)

    def kernel(i, j, a, b, wanted, keys=tuple(bands)):
        ones = np.ones(int(wanted.sum()), np.int64)
        return {band: (v[wanted], ones) for band, v in zip(keys, values(a, b, keys), strict=True)}

    return P.compared(own, kernel, bands, COHERENT, prepare=prepare).withColumnRenamed("key", "band")


def similarity_compared(signals: DataFrame, fs: float, freqs: list[float]) -> DataFrame:
    """P.compared() of the similarities of all pairs of scalograms, of signals (role, idx, x) of one length, by metric."""
    metrics = ["ssim", "nrmse", "cosine"]

    def kernel(i, j, a, b, wanted, keys=tuple(metrics)):
        ones = np.ones(int(wanted.sum()), np.int64)
        return {m: (v[wanted], ones) for m, v in zip(metrics, similarities(a, b, len(freqs), wanted), strict=True) if m in keys}

    return P.compared(signals, kernel, metrics, IMAGES, prepare=_imaged(fs, freqs)).withColumnRenamed("key", "metric")


def differences_compared(values: DataFrame, names: list[str], digits: int = 12) -> DataFrame:
    """P.compared() of absolute differences between all signals' values (role, statistic, value), to so many digits. Equal values are
    counted first: distinct ones meet, with the product of their counts."""
    tables = []
    for name in names:
        counted = values.where((F.col("statistic") == name) & A.finite(F.col("value"))).groupBy("role", "value").agg(F.count(F.lit(1)).alias("n"))
        rows = P.indexed(counted.withColumnRenamed("value", "signal_id")).select("role", "idx", F.array("signal_id", F.col("n").cast("double")).alias("x"))

        def kernel(i, j, a, b, wanted, name=name):
            w = np.multiply.outer(a[:, 1].astype(np.int64), b[:, 1].astype(np.int64))
            if not wanted.all():  # within a role; equal values with themselves
                w = np.where(i[:, None] == j[None], w - np.minimum(a[:, 1].astype(np.int64)[:, None], w), w)
                w = np.where(i[:, None] == j[None], w // 2, w)
            kept = wanted & (w > 0)
            return {name: (np.round(np.abs(a[:, 0][:, None] - b[:, 0][None]), digits)[kept], w[kept])}

        tables.append(P.compared(rows, kernel, [name], 1024, own=True).withColumnRenamed("key", "statistic"))
    return reduce(DataFrame.unionByName, tables)


def mean_differences(values: DataFrame) -> DataFrame:
    """(pair_set, n, mean) of absolute differences between all signals' values (role, value), by running counts of distinct values."""
    counted = values.where(A.finite(F.col("value"))).groupBy(F.lit(1).alias("k"), F.col("value").alias("v")).agg(F.count_if(F.col("role") == "real").alias("a"), F.count_if(F.col("role") == "synthetic").alias("b"))
    totals = counted.groupBy("k").agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    run = running(counted, ["k"], "v", ["a", "b"]).join(totals, "k").withColumn("gap", F.coalesce(F.col("next_v") - F.col("v"), F.lit(0.0)))
    a, b, n, m = (F.col(c).cast("double") for c in ("run_a", "run_b", "n", "m"))
    one = run.groupBy("n", "m").agg(F.sum(F.col("gap") * a * (n - a)).alias("RR"), F.sum(F.col("gap") * (a * (m - b) + b * (n - a))).alias("RS"), F.sum(F.col("gap") * b * (m - b)).alias("SS"))
    pairs = {"RR": F.expr("n * (n - 1) div 2"), "RS": F.expr("n * m"), "SS": F.expr("m * (m - 1) div 2")}
    rows = one.select(F.inline(F.array(*(F.struct(F.lit(s).alias("pair_set"), c.alias("n"), (F.col(s) / c).alias("mean")) for s, c in pairs.items()))))
    return rows.where("n > 0")


def coherence_by_position(signals: DataFrame, config: E.SpectrumConfig, strategy: str = "consecutive") -> DataFrame:
    """coherence() of pairs by position only: RS of equal idx, RR and SS by the given strategy. Segment spectra are made once a signal."""
    n = signals.agg(F.min(F.size("x"))).first()[0] or 8
    size = config.coherence_segment(n)
    freqs = np.arange(size // 2 + 1) * config.fs / size
    high = config.band[1]
    masks = [(name, (freqs >= a) & ((freqs <= b) if b >= high else (freqs < b)), b - a) for name, a, b in coherence_bands(config)]
    wanted = P.zip_pairs(signals, "RS").unionByName(P.zip_pairs(signals, "RR", strategy)).unionByName(P.zip_pairs(signals, "SS", strategy))
    both = P.attach(wanted, signals, "x").select("pair_set", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("left.x").alias("a"), F.col("right.x").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for pair_set, i, j, a, b in rows.itertuples(index=False):
                x, y = (E.segment_spectra(np.asarray(v, float)[:n], size, config.overlap) for v in (a, b))
                power = (np.abs(x) ** 2).sum(axis=0) * (np.abs(y) ** 2).sum(axis=0)
                c = np.divide(np.abs((x.conj() * y).sum(axis=0)) ** 2, power, out=np.zeros(len(freqs)), where=power > 0)
                out += [(pair_set, i, j, name, float(simpson_last(c[m], config.fs / size)) / width) for name, m, width in masks]
            yield pd.DataFrame(out, columns=["pair_set", "i", "j", "band", "coherence"])

    return both.mapInPandas(run, "pair_set string, i long, j long, band string, coherence double")


def compare_pair_sets(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, pair_set, n, mean, sd, u, delta, p): summaries of the sets, and the Mann-Whitney test and Cliff's delta of RR against RS."""
    by = rows.groupBy(key, "pair_set").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    found = stats.compare(rows.select(key, F.col("pair_set").alias("role"), F.col(value).alias("value")), [key], "RR", "RS")
    tests = found.select(key, "u", "delta", stats.p_of_u(F.col("u"), F.col("n1"), F.col("n2"), F.col("ties")).alias("p"))
    return by.join(tests, key, "left")


def similarity_rows(found: DataFrame) -> DataFrame:
    """(pair_set, i, j, metric, value) from scalogram_similarity()."""
    return found.select("pair_set", "i", "j", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("ssim", "nrmse", "cosine")))))


def spectral_distance(p: Column, q: Column, step: float) -> Column:
    """Wasserstein-1 in Hz between two spectra on one grid, each as a distribution."""
    share = lambda x: (lambda t: F.transform(x, lambda v: v / t))(F.aggregate(x, F.lit(0.0), lambda a, v: a + v))
    d = F.zip_with(share(p), share(q), lambda a, b: a - b)
    run = F.aggregate(d, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["w"] + F.abs(a["s"] + v)).alias("w")))
    return run["w"] * step


def spectral_wasserstein(signals: DataFrame, config: E.SpectrumConfig, n: int) -> DataFrame:
    """(band, wd_hz, z_wd): RS pairs by position, against the chain of real neighbours; z needs five of those. n: the signals' length."""
    size = min(n, int(4 * config.fs))
    step = config.fs / size
    p = E.psd(signals, config, lambda _: size, ("role", "idx"))
    rows = []
    for name, lo, hi in coherence_bands(config):
        first, last = max(0, math.ceil(lo / step)), math.floor(hi / step)
        if last > first:
            rows.append(F.struct(F.lit(name).alias("band"), F.lit(first + 1).alias("first"), F.lit(last - first + 1).alias("n")))
    both = P.zip_pairs(signals, "RS").unionByName(P.zip_pairs(signals, "RR", "chain"))
    joined = P.attach(both, p, "p").select("pair_set", "left", "right", F.inline(F.array(*rows)))
    d = joined.select("pair_set", "band", spectral_distance(F.slice("left.p", F.col("first"), F.col("n")), F.slice("right.p", F.col("first"), F.col("n")), step).alias("d"))
    of = lambda s: F.when(F.col("pair_set") == s, F.col("d"))
    by = d.groupBy("band").agg(F.avg(of("RS")).alias("wd_hz"), F.avg(of("RR")).alias("rr"), F.stddev_samp(of("RR")).alias("sd"), F.count(of("RR")).alias("n"))
    return by.select("band", "wd_hz", F.when(F.col("n") >= 5, (F.col("wd_hz") - F.col("rr")) / F.nullif(F.col("sd"), F.lit(0.0))).alias("z_wd"))


def fast_length(n: int) -> int:
    """The least length from n on without prime factors over 11."""
    while True:
        m = n
        for p in (2, 3, 5, 7, 11):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def wavelets(n: int, fs: float, freqs: np.ndarray, w: float = 6.0) -> tuple[int, np.ndarray]:
    """The zeros put before a signal of n samples, and the transforms of the analytic Morlet wavelets, (frequencies, padded length)."""
    scales = w * fs / (2 * np.pi * freqs)
    room = math.ceil(4 * scales.max())
    omega = 2 * np.pi * np.fft.fftfreq(fast_length(n + 2 * room))
    s = scales[:, None] * omega[None]
    return room, np.pi**-0.25 * np.where(omega > 0, np.exp(-0.5 * (s - w) ** 2), 0.0) * np.sqrt(scales)[:, None]


def scalogram(x: np.ndarray, fs: float, freqs: np.ndarray, w: float = 6.0) -> np.ndarray:
    """The amplitude of the analytic Morlet transform, (frequencies, samples); zeros beyond the ends."""
    room, wavelet = wavelets(len(x), fs, freqs, w)
    padded = np.zeros(wavelet.shape[1])
    padded[room : room + len(x)] = x
    return np.abs(np.fft.ifft(np.fft.fft(padded)[None] * wavelet, axis=1))[:, room : room + len(x)]


def scalograms(signals: DataFrame, fs: float, freqs: list[float], keys: tuple[str, ...] = ("role", "idx")) -> DataFrame:
    """(keys, x): the scalogram of each signal, row after row. One signal at a time is transformed."""
    grid = np.array(freqs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = scalogram(np.asarray(batch.column("x")[k].as_py(), float), fs, grid).ravel().tolist()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in keys), pa.array([out], pa.list_(pa.float64()))], names=[*keys, "x"])

    slim = signals.select(*keys, "x")
    return slim.mapInArrow(run, ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys) + ", x array<double>")


#: Signals that are transformed together.
TOGETHER = 64


def band_envelope(signals: DataFrame, freqs: list[float], fs: float, band: tuple[float, float] = (13.0, 30.0), smooth_ms: float = 20.0, keys: tuple[str, ...] = ("role", "idx")) -> DataFrame:
    """(keys, x): the mean amplitude of a band's rows of each signal's scalogram over its median, smoothed by a centred mean with zeros
    beyond the ends. Only the band's rows are formed, and nothing is shuffled."""
    grid = np.array(freqs)
    inside = [k for k, f in enumerate(freqs) if band[0] <= f <= band[1]]
    if not inside:
        raise ValueError("no frequency in the band")
    width = max(1, round(smooth_ms / 1000 * fs))
    ahead = (width - 1) // 2

    def envelopes(x: np.ndarray, room: int, wavelet: np.ndarray) -> np.ndarray:
        """Of signals of one length, one a row."""
        n = x.shape[1]
        padded = np.zeros((len(x), wavelet.shape[1]))
        padded[:, room : room + n] = x
        spectra, total = np.fft.fft(padded, axis=1), np.zeros(x.shape)
        for k in inside:
            total += np.abs(np.fft.ifft(spectra * wavelet[k], axis=1))[:, room : room + n]
        mean = total / len(inside)
        middle = np.median(mean, axis=1, keepdims=True)
        mean = np.divide(mean, middle, out=mean, where=middle > 0)
        framed = np.pad(mean, ((0, 0), (width - 1 - ahead, ahead)))
        return sum((framed[:, k : k + n] for k in range(width)), np.zeros(x.shape)) / width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                rows = [np.asarray(x, float) for x in part.column("x").to_pylist()]
                out: list[np.ndarray] = [np.zeros(0)] * len(rows)
                for n in {len(x) for x in rows} - {0}:
                    own = [k for k, x in enumerate(rows) if len(x) == n]
                    if n not in made:
                        made[n] = wavelets(n, fs, grid)
                    for k, x in zip(own, envelopes(np.stack([rows[k] for k in own]), *made[n]), strict=True):
                        out[k] = x
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), found], names=[*keys, "x"])

    slim = signals.select(*keys, "x")
    return slim.mapInArrow(run, ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys) + ", x array<double>")


def mean_scalogram(images: DataFrame, samples: int, fs: float, freqs: list[float]) -> DataFrame:
    """(role, f, t, amplitude): the mean over the signals of a role. Partial sums leave each batch, a row per role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for role, x in zip(batch.column("role").to_pylist(), batch.column("x"), strict=True):
                own = sums.setdefault(role, [0, 0.0])
                own[0], own[1] = own[0] + 1, own[1] + np.asarray(x.as_py())
        for role, (n, total) in sums.items():
            k = np.arange(len(total))
            yield pa.RecordBatch.from_pydict({"role": [role] * len(k), "k": k, "n": np.full(len(k), n), "total": total})

    parts = images.select("role", "x").mapInArrow(run, "role string, k long, n long, total double")
    grid = F.array(*map(F.lit, freqs))
    by = parts.groupBy("role", "k").agg((F.sum("total") / F.sum("n")).alias("amplitude"))
    return by.select("role", F.get(grid, F.floor(F.col("k") / samples).cast("int")).alias("f"), (F.pmod("k", F.lit(samples)) / fs).alias("t"), "amplitude")


def _box(x: np.ndarray, k: int) -> np.ndarray:
    """Means over k x k windows that lie inside."""
    c = np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    return (c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]) / (k * k)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(SSIM on the jointly scaled images, NRMSE, cosine)."""
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    if high - low < 1e-6:
        high = low + 1e-6
    u, v = (a - low) / (high - low), (b - low) / (high - low)
    mu, mv = _box(u, 7), _box(v, 7)
    fix = 49 / 48
    su, sv, suv = (fix * (_box(p * q, 7) - m * n) for p, q, m, n in ((u, u, mu, mu), (v, v, mv, mv), (u, v, mu, mv)))
    c1, c2 = 0.01**2, 0.03**2
    ssim = ((2 * mu * mv + c1) * (2 * suv + c2) / ((mu * mu + mv * mv + c1) * (su + sv + c2))).mean()
    return float(ssim), float(np.sqrt(((a - b) ** 2).mean()) / (high - low)), float((a * b).sum() / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))


def colour_similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(SSIM of the images in colour, averaged over the three channels of 0 to 255, NRMSE, cosine); both on one scale of intensities."""
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    if high <= low:
        high = low + 1e-6
    level = lambda x: (x - low) / (high - low)
    channels = [tuple(np.round(255 * np.clip(3 * level(x) - k, 0, 1)) for x in (a, b)) for k in range(3)]
    fix, c1, c2, found = 49 / 48, (0.01 * 255) ** 2, (0.03 * 255) ** 2, []
    for u, v in channels:
        mu, mv = _box(u, 7), _box(v, 7)
        su, sv, suv = (fix * (_box(p * q, 7) - m * n) for p, q, m, n in ((u, u, mu, mu), (v, v, mv, mv), (u, v, mu, mv)))
        found.append(((2 * mu * mv + c1) * (2 * suv + c2) / ((mu * mu + mv * mv + c1) * (su + sv + c2))).mean())
    return float(np.mean(found)), float(np.sqrt(((a - b) ** 2).mean()) / (high - low)), float((a * b).sum() / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))


def mean_scalogram_similarity(means: DataFrame, freqs: int) -> DataFrame:
    """(ssim, nrmse, cosine) of the two roles' mean scalograms (role, f, t, amplitude): two images, whatever the number of signals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            images = [np.array(rows["x"][rows["role"] == g].iloc[0], float).reshape(freqs, -1) for g in ("real", "synthetic")]
            yield pd.DataFrame([colour_similarity(*images)], columns=["ssim", "nrmse", "cosine"])

    images = means.groupBy("role").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "t", "amplitude"))), lambda s: s["amplitude"]).alias("x"))
    both = images.where(F.col("role").isin("real", "synthetic")).coalesce(1)
    return both.mapInPandas(lambda batches: run([pd.concat(list(batches), ignore_index=True)]), "ssim double, nrmse double, cosine double")


#: Signals in a block whose scalograms meet.
IMAGES = 64


def _imaged(fs: float, freqs: list[float]):
    """A function from signals to their scalograms, one a row."""
    return lambda rows: np.stack([scalogram(x, fs, np.array(freqs)).ravel() for x in rows])


def _windows(images: np.ndarray, width: int, two: np.ndarray, seven: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Sums over the 7 x 7 windows of images (rows of `width`, one after the other), in out; the last six of each row lie across its end."""
    k = seven.shape[1]
    np.add(images[:, :-width], images[:, width:], out=two)
    np.add(two[:, :k], two[:, 2 * width : 2 * width + k], out=seven)
    seven += two[:, 4 * width : 4 * width + k]
    seven += images[:, 6 * width :]
    pairs = np.add(seven[:, :-1], seven[:, 1:], out=two[:, : k - 1])
    np.add(pairs[:, : k - 6], pairs[:, 2 : k - 4], out=out)
    out += pairs[:, 4 : k - 2]
    out += seven[:, 6:]
    return out


def similarities(a: np.ndarray, b: np.ndarray, n_freqs: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """similarity() of all wanted pairs of images, one a row: three matrices. Window means and deviations are made once an image, a pair
    takes the windows of its product; some pairs at a time, so that they stay in a processor's cache."""
    width = a.shape[1] // n_freqs
    k, some = (n_freqs - 6) * width, max(1, (1 << 15) // a.shape[1])
    product, two, seven = (np.empty((some, c)) for c in (a.shape[1], a.shape[1] - width, k))
    buffers = [np.empty((some, k - 6)) for _ in range(4)]
    low, high = np.minimum(a.min(axis=1)[:, None], b.min(axis=1)[None]), np.maximum(a.max(axis=1)[:, None], b.max(axis=1)[None])
    span = np.where(high - low < 1e-6, 1e-6, high - low)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2

    def own(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, square = (np.empty((len(images), k - 6)) for _ in range(2))
        for x, m, s in zip(images, mean, square, strict=True):
            _windows(x[None], width, two[:1], seven[:1], m[None])
            _windows((x * x)[None], width, two[:1], seven[:1], s[None])
        mean /= 49
        return mean, mean * mean, 49 / 48 * (square / 49 - mean * mean)

    (ma, ea, va), (mb, eb, vb) = own(a), own(b)
    inside = (np.arange(k - 6) % width < width - 6).astype(float)
    ssim, shift, base = np.zeros(low.shape), 2 * low, 2 * low**2 + c1
    for i in np.flatnonzero(wanted.any(axis=1)):
        there = np.flatnonzero(wanted[i])
        x, m = a[i] * (2 / 48), ma[i] * (2 * 49 / 48)
        for at in range(there[0], there[-1] + 1, some):
            j = slice(at, min(at + some, there[-1] + 1))
            n = j.stop - at
            cov, diff, sums, energy = (v[:n] for v in buffers)
            _windows(np.multiply(b[j], x, out=product[:n]), width, two[:n], seven[:n], cov)
            cov -= np.multiply(mb[j], m, out=diff)
            cov += c2[i, j, None]
            np.add(mb[j], ma[i], out=sums)
            sums *= shift[i, j, None]
            np.add(eb[j], ea[i], out=energy)
            energy -= sums
            energy += base[i, j, None]  # the sum of the scaled means' squares
            np.subtract(mb[j], ma[i], out=diff)
            diff *= diff
            cov *= np.subtract(energy, diff, out=diff)  # twice their product
            np.add(vb[j], va[i], out=sums)
            sums += c2[i, j, None]
            energy *= sums
            cov /= energy
            ssim[i, j] = cov @ inside
    dots, na, nb = a @ b.T, (a * a).sum(axis=1), (b * b).sum(axis=1)
    d = np.maximum(na[:, None] + nb[None] - 2 * dots, 0)
    for i, j in np.argwhere(wanted & (d < 1e-5 * (na[:, None] + nb[None]))):  # close pairs by their differences
        d[i, j] = ((a[i] - b[j]) ** 2).sum()
    return ssim / inside.sum(), np.sqrt(d / a.shape[1]) / span, dots / np.maximum(np.sqrt(na)[:, None] * np.sqrt(nb)[None], 1e-12)


def scalogram_similarity(signals: DataFrame, fs: float, freqs: list[float], sets: tuple[str, ...] = ("RR", "RS", "SS")) -> DataFrame:
    """(pair_set, i, j, ssim, nrmse, cosine) of the scalograms of all pairs of signals (role, idx, x) of one length."""

    def kernel(i, j, a, b, wanted):
        p, q = np.nonzero(wanted)
        ssim, nrmse, cosine = similarities(a, b, len(freqs), wanted)
        return {"i": i[p], "j": j[q], "ssim": ssim[p, q], "nrmse": nrmse[p, q], "cosine": cosine[p, q]}

    return P.pairwise(signals, kernel, "i long, j long, ssim double, nrmse double, cosine double", sets, IMAGES, prepare=_imaged(fs, freqs))


def time_frequency_score(signals: DataFrame, fs: float, freqs: list[float]) -> DataFrame:
    """(score, sd): 0.4 SSIM + 0.3 / (1 + NRMSE) + 0.3 cosine over all RS pairs of scalograms; a row per pair of blocks leaves the kernel."""

    def kernel(i, j, a, b, wanted):
        ssim, nrmse, cosine = similarities(a, b, len(freqs), wanted)
        return P.moments((0.4 * ssim + 0.3 / (1 + nrmse) + 0.3 * cosine)[wanted])

    found = P.pairwise(signals, kernel, "n long, mean double, m2 double", ("RS",), IMAGES, prepare=_imaged(fs, freqs))
    return P.pooled(found, "pair_set").agg(F.max("mean").alias("score"), F.sqrt(F.max("m2") / F.nullif(F.max("n") - 1, F.lit(0))).alias("sd"))


def zip_similarity(images: DataFrame, n_freqs: int) -> DataFrame:
    """(pair_set, i, j, metric, value) of pairs by position: RS of equal idx, RR and SS of consecutive ones."""
    wanted = P.zip_pairs(images, "RS").unionByName(P.zip_pairs(images, "RR")).unionByName(P.zip_pairs(images, "SS"))
    both = P.attach(wanted, images, "x").select("pair_set", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("left.x").alias("a"), F.col("right.x").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(np.asarray(a.as_py()).reshape(n_freqs, -1), np.asarray(b.as_py()).reshape(n_freqs, -1)) for a, b in zip(batch.column(3), batch.column(4), strict=True)]
            ssim, nrmse, cosine = (pa.array(c, pa.float64()) for c in (zip(*found, strict=True) if found else ((), (), ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), ssim, nrmse, cosine], names=["pair_set", "i", "j", "ssim", "nrmse", "cosine"])

    rows = both.mapInArrow(run, "pair_set string, i long, j long, ssim double, nrmse double, cosine double")
    return rows.select("pair_set", "i", "j", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("ssim", "nrmse", "cosine")))))


def compare_similarities(rows: DataFrame) -> DataFrame:
    """(metric, pair_set, n, mean, sd, delta, p): delta and p of RR against RS, Wilcoxon's for pairs of equal rank, on both sets' rows."""
    rows = rows.persist()
    by = rows.groupBy("metric", "pair_set").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    effect = stats.compare(rows.withColumnRenamed("pair_set", "role"), ["metric"], "RR", "RS").select("metric", "delta")
    a = rows.where("pair_set = 'RR'").select("metric", (F.col("i") / 2).cast("long").alias("k"), F.col("value").alias("a"))
    b = rows.where("pair_set = 'RS'").select("metric", F.col("i").alias("k"), F.col("value").alias("b"))
    ranks = stats.signed_rank(a.join(b, ["metric", "k"]), ["metric"])
    p = F.udf(lambda w, n, ties: stats.wilcoxon_p(w, n, ties), "double")
    tests = effect.join(ranks.select("metric", p(F.least("w_plus", "w_minus"), "n", "ties").alias("p")), "metric", "left")
    return by.join(tests, "metric", "left")


def residuals(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The residuals of each row's profile from the line of each window, for every window size, one after the other."""
    y = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)
    out = []
    for n in sizes:
        parts = y[:, : y.shape[1] // n * n].reshape(len(y), -1, n)
        i = np.arange(n) - (n - 1) / 2
        out.append((parts - parts.mean(axis=2, keepdims=True) - (parts @ i / (i @ i))[:, :, None] * i).reshape(len(y), -1))
    return np.concatenate(out, axis=1)


def powers(qs: np.ndarray):
    """A function from v to v ** (q / 2) of each q; of whole q by products of the root and of its inverse."""
    if (qs != np.rint(qs)).any():
        return lambda v: [v ** (q / 2) for q in qs]
    order = [int(q) for q in qs]
    steps = [sign * k for sign in (1, -1) for k in range(1, max(0, *(sign * q for q in order)) + 1)]

    def run(v: np.ndarray) -> list[np.ndarray]:
        made = {1: np.sqrt(v), 2: v}
        for q in steps:
            if q not in made:
                made[q] = 1 / made[1] if q == -1 else made[q - 1] * made[1] if q > 0 else made[q + 1] * made[-1]
        return [made[q] for q in order]

    return run


def _cross(sizes: list[int], q_values: list[float], n: int, columns: tuple[str, ...]):
    """(what a matrix of signals is prepared to, a function of two such matrices: a matrix of values by column)."""
    spans, at = [], 0
    for size in sizes:
        spans.append((size, at, at + n // size * size))
        at = spans[-1][2]
    qs = np.array([q for q in q_values if abs(q) > 1e-6])
    logs = np.log(np.array(sizes, float))
    slopes = (logs - logs.mean()) / ((logs - logs.mean()) ** 2).sum()
    least, raised = 1e-300, powers(qs)

    def linear(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        z, h = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
        for (_, lo, hi), slope in zip(spans, slopes, strict=True):
            u, v = a[:, lo:hi], b[:, lo:hi]
            f = u @ v.T / (hi - lo)  # windows are of one size, so this is the mean over them
            fu, fv = ((x * x).mean(axis=1) for x in (u, v))
            z += np.arctanh(np.clip(f / np.sqrt(np.maximum(fu[:, None] * fv[None], least)), -0.999999, 0.999999))
            h += slope / 2 * np.log(np.maximum(np.abs(f, out=f), least))
        return {"rho": np.tanh(z / len(spans)), "h": h}

    def fractal(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        hq, p = np.zeros((len(qs), len(a), len(b))), np.zeros((len(a), len(b)))
        f2, floor = np.empty(p.shape), np.full(p.shape, least)
        for (size, lo, hi), slope in zip(spans, slopes, strict=True):
            starts, own = range(lo, hi, size), []
            sums, u = np.zeros(hq.shape), a[:, lo:hi] / size
            for k in starts:
                np.abs(np.matmul(u[:, k - lo : k - lo + size], b[:, k : k + size].T, out=f2), out=f2)
                for total, power in zip(sums, raised(np.maximum(f2, floor, out=f2)), strict=True):
                    total += power
            for x in (a, b):
                f = np.maximum((x[:, lo:hi].reshape(len(x), -1, size) ** 2).mean(axis=2), least)
                own.append([v.mean(axis=1) ** (1 / q) for v, q in zip(raised(f), qs, strict=True)])
            for k, q in enumerate(qs):
                level = np.log(sums[k] / len(starts)) / q
                hq[k] += slope * level
                if "p" in columns:
                    p += np.exp(level) / (np.sqrt(own[0][k][:, None] * own[1][k][None]) + 1e-12)
        alpha = hq + qs[:, None, None] * np.gradient(hq, qs, axis=0)
        return {"hq": hq.mean(axis=0), "p": p / (len(spans) * len(qs)), "delta_alpha": alpha.max(axis=0) - alpha.min(axis=0)}

    def values(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        out = {c: np.empty((len(a), len(b))) for c in columns}
        for i, j in itertools.product(range(0, len(a), TILE), range(0, len(b), TILE)):
            x, y = a[i : i + TILE], b[j : j + TILE]
            found = linear(x, y) if {"rho", "h"} & {*columns} else {}
            found |= fractal(x, y) if {"hq", "p", "delta_alpha"} & {*columns} else {}
            for c in columns:
                out[c][i : i + TILE, j : j + TILE] = found[c]
        return out

    return lambda rows: residuals(rows, sizes), values


#: Columns of cross_fluctuations(), signals in a block, and in the parts of it that stay in a processor's cache.
FLUCTUATIONS, RESIDUALS, TILE = ("rho", "h", "hq", "p", "delta_alpha"), 256, 64


def cross_fluctuations(signals: DataFrame, sizes: list[int], q_values: list[float], n: int, sets: tuple[str, ...] = ("RR", "RS", "SS"), columns: tuple[str, ...] = FLUCTUATIONS) -> DataFrame:
    """(pair_set, i, j, columns) of all pairs of signals (role, idx, x) of n samples.

    rho: the detrended cross-correlation, averaged over scales by Fisher's z; h: its exponent; hq: exponents by q of
    |detrended covariance|; p: F_xy(q) over sqrt(F_x(q) F_y(q)), averaged; delta_alpha: the width of the spectrum.
    """
    prepare, values = _cross(sizes, q_values, n, columns)

    def kernel(i, j, a, b, wanted):
        r, c = np.nonzero(wanted)
        return {"i": i[r], "j": j[c]} | {name: v[r, c] for name, v in values(a, b).items()}

    return P.pairwise(signals, kernel, ", ".join(["i long, j long", *(f"{c} double" for c in columns)]), sets, RESIDUALS, prepare=prepare)


def mean_fluctuations(signals: DataFrame, sizes: list[int], q_values: list[float], n: int, sets: tuple[str, ...] = ("RR", "RS", "SS"), columns: tuple[str, ...] = FLUCTUATIONS) -> DataFrame:
    """(pair_set, columns, <column>_sd): means and deviations (of the population) of cross_fluctuations(); a row per two blocks and column
    leaves the kernel, and only what the columns need is computed."""
    prepare, values = _cross(sizes, q_values, n, columns)

    def kernel(i, j, a, b, wanted):
        rows = [P.moments(v[wanted]) for v in values(a, b).values()]
        return {"name": list(columns)} | {c: np.concatenate([r[c] for r in rows]) for c in ("n", "mean", "m2")}

    found = P.pooled(P.pairwise(signals, kernel, "name string, n long, mean double, m2 double", sets, RESIDUALS, prepare=prepare), "pair_set", "name")
    of = lambda name, v: F.max(F.when(F.col("name") == name, v))
    return found.groupBy("pair_set").agg(*(of(c, F.col("mean")).alias(c) for c in columns), *(of(c, F.sqrt(F.col("m2") / F.col("n"))).alias(f"{c}_sd") for c in columns))


def surrogate_z(signals: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """(statistic, z): how far each real signal's entropies lie from those of its phase-randomised copies, averaged."""
    real = signals.where("role = 'real'").select("signal_id", "x")
    columns = ("SampEn", "PermEn", "LZC")
    copies = E.entropies(T.surrogates(real, n, seed), ("signal_id", "surrogate_no")).groupBy("signal_id").agg(*(f(c).alias(f"{c}_{k}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    both = E.entropies(real, ("signal_id",)).join(copies, "signal_id")
    z = [F.struct(F.lit(c).alias("statistic"), ((F.col(c) - F.col(f"{c}_m")) / (F.col(f"{c}_s") + 1e-12)).alias("z")) for c in columns]
    return both.select(F.inline(F.array(*z))).groupBy("statistic").agg(F.avg("z").alias("z"))
