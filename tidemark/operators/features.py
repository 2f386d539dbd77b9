"""Features of single signals: Hjorth parameters, spectra and band power, bursts, entropies, fractal exponents."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays as A

EPS = 1e-9


def hjorth(x: Column) -> Column:
    """struct(activity, mobility, complexity)."""
    d1 = A.difference(x)

    def out(p: Column) -> Column:
        mobility = p["s1"] / (p["s0"] + EPS)
        return F.struct((p["s0"] * p["s0"]).alias("activity"), mobility.alias("mobility"), ((p["s2"] / (p["s1"] + EPS)) / (mobility + EPS)).alias("complexity"))

    deviations = A.let(d1, lambda d: F.struct(A.deviation(x).alias("s0"), A.deviation(d).alias("s1"), A.deviation(A.difference(d)).alias("s2")))
    return A.let(deviations, out)


#: (name, low, high) in Hz; half open, the last closed.
BANDS = [("Delta", 0.5, 4.0), ("Theta", 4.0, 8.0), ("Alpha", 8.0, 13.0), ("Beta", 13.0, 30.0), ("Gamma", 30.0, 80.0), ("Ripple", 80.0, 250.0), ("Fast Ripple", 250.0, 500.0)]


@dataclass(frozen=True)
class SpectrumConfig:
    """fs in Hz; the analysis band is clipped to the Nyquist frequency; win_seconds None: by the lowest frequency."""

    fs: float
    band: tuple[float, float] = (0.5, 500.0)
    win_seconds: float | None = None
    overlap: float = 0.5
    bands: list = field(default_factory=lambda: list(BANDS))

    def __post_init__(self):
        object.__setattr__(self, "band", (self.band[0], min(self.band[1], self.fs / 2)))
        if not 0 < self.band[0] < self.band[1] or not 0 <= self.overlap < 1:
            raise ValueError(f"bad spectrum settings {self}")

    def segment(self, n: int) -> int:
        """Samples of a Welch segment: ten periods of the lowest frequency, then less until there are four segments."""
        size = min(max(8, math.ceil(10 * self.fs / self.band[0])), n) if self.win_seconds is None else min(n, max(8, int(self.win_seconds * self.fs)))
        return _shrink(size, n, self.overlap, (1, 0.75, 0.5, 0.33, 0.25), 4)

    def coherence_segment(self, n: int) -> int:
        size = max(8, min(n // 2, math.ceil(10 * self.fs / self.band[0])))
        return min(n, _shrink(size, n, self.overlap, (1, 0.75, 0.5, 0.33), 2))


def _shrink(size: int, n: int, overlap: float, factors: tuple, least: int) -> int:
    for factor in factors:
        now = max(8, int(size * factor))
        step = now - int(now * overlap)
        if now <= n and 1 + (n - now) // step >= least:
            return now
    return max(min(now, n), 1)


def segment_spectra(x: np.ndarray, size: int, overlap: float) -> np.ndarray:
    """The windowed spectra of the segments, each less its mean: (segments, bins)."""
    step = size - int(size * overlap)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    return np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window, axis=1)


def welch_one(x: np.ndarray, fs: float, size: int, overlap: float) -> tuple[np.ndarray, np.ndarray]:
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = (np.abs(segment_spectra(x, size, overlap)) ** 2).mean(axis=0) / (fs * (window**2).sum())
    power[1 : len(power) - (size % 2 == 0)] *= 2
    return np.arange(len(power)) * fs / size, power


def psd(signals: DataFrame, config: SpectrumConfig, size_of=None, keys: tuple[str, ...] = ("signal_id", "role")) -> DataFrame:
    """(keys, f array, p array) of signals that have eight samples at least. size_of: segment length by signal length."""
    size_of = size_of or config.segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [welch_one(v, config.fs, size_of(len(v)), config.overlap) for v in (np.asarray(x, float) for x in batch.column("x").to_pylist())]
            lists = [pa.array([f[k].tolist() for f in found], pa.list_(pa.float64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *lists], names=[*keys, "f", "p"])

    slim = signals.where(F.size("x") >= 8).select(*keys, "x")
    kinds = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(run, f"{kinds}, f array<double>, p array<double>")


def simpson(y: Column, step: Column) -> Column:
    """The integral of equally spaced values: one value 0, two a trapezoid, an even number with a cubic end correction."""
    n = F.size(y)
    odd = lambda v, m: step / 3 * F.aggregate(F.transform(v, lambda w, i: w * F.when((i == 0) | (i == m - 1), 1).when(i % 2 == 1, 4).otherwise(2)), F.lit(0.0), lambda a, b: a + b)
    at = lambda k: F.element_at(y, -k)
    even = odd(F.slice(y, 1, F.greatest(n - 1, F.lit(1))), n - 1) + step * (5 * at(1) + 8 * at(2) - at(3)) / 12
    return F.when(n <= 1, 0.0).when(n == 2, step * (at(1) + at(2)) / 2).when(n % 2 == 1, odd(y, n)).otherwise(even)


def _within(f: Column, p: Column, inside) -> Column:
    return F.transform(F.filter(F.arrays_zip(f.alias("f"), p.alias("p")), lambda z: inside(z["f"])), lambda z: z["p"])


def band_power(spectra: DataFrame, config: SpectrumConfig) -> DataFrame:
    """(signal_id, role, band, rel_power): each band's share of the analysis band; empty bands are 0."""
    step = F.element_at("f", 2) - F.element_at("f", 1)
    low, high = config.band
    rows = spectra.withColumns({"whole": _within(F.col("f"), F.col("p"), lambda f: (f >= low) & (f <= high)), "step": step})
    rows = rows.withColumn("total", simpson(F.col("whole"), F.col("step")))
    shares = []
    for k, (name, lo, hi) in enumerate(config.bands):
        last = k == len(config.bands) - 1
        part = _within(F.col("f"), F.col("p"), lambda f, lo=lo, hi=hi, last=last: (f >= lo) & ((f <= hi) if last else (f < hi)) & (f >= low) & (f <= high))
        shares.append(F.struct(F.lit(name).alias("band"), A.let(part, lambda y: F.when(F.size(y) > 0, F.coalesce(simpson(y, F.col("step")) / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)).alias("rel_power")))
    return rows.select("signal_id", "role", F.inline(F.array(*shares)))


def dominant_frequency(spectra: DataFrame, config: SpectrumConfig) -> DataFrame:
    """(signal_id, role, f): where the spectrum within the analysis band is greatest, the lowest such; null without bins."""
    low, high = config.band
    inside = F.filter(F.arrays_zip("f", "p"), lambda z: (z["f"] >= low) & (z["f"] <= high))
    best = F.array_max(F.transform(inside, lambda z: F.struct(z["p"].alias("p"), (-z["f"]).alias("f"))))
    return spectra.select("signal_id", "role", (-best["f"]).alias("f"))


def permutation_entropy(x: Column, m: int = 3, tau: int = 1) -> Column:
    """Normalised by ln m!; earlier values rank first among equals; null for signals that are too short."""
    count = F.size(x) - (m - 1) * tau

    def pattern(i: Column) -> Column:
        v = [F.element_at(x, i + k * tau) for k in range(m)]
        bits = [F.when(v[a] > v[b], 1).otherwise(0) for a in range(m) for b in range(a + 1, m)]
        code = F.lit(0)
        for bit in bits:
            code = code * 2 + bit
        return code

    def entropy(codes: Column) -> Column:
        share = lambda c: F.size(F.filter(codes, lambda d: d == c)) / F.size(codes)
        terms = F.transform(F.array_distinct(codes), lambda c: A.let(share(c), lambda p: -p * F.log(p + 1e-12)))
        return A.total(terms) / math.log(math.factorial(m))

    return F.when(count > 0, A.let(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), pattern), entropy))


#: Pairs of templates that are compared at once.
COMPARED = 1 << 20


def pairs_within(t: np.ndarray, r: float) -> int:
    """How many pairs of rows differ by r at most in every column. Rows are sorted by cells of width r in all columns; only rows of one
    cell and of cells next to each other are compared, and whole runs of equal rows at once."""
    if not np.isfinite(t).all():
        t = t[np.isfinite(t).all(axis=1)]
    t, times = np.unique(t, axis=0, return_counts=True)
    count = int((times * (times - 1) // 2).sum())  # equal rows
    if r <= 0 or len(t) < 2:
        return count if r >= 0 else 0
    cells = np.floor((t - t.min(axis=0)) / (r * (1 + 1e-9))).astype(np.int64)
    base = int(cells.max()) + 3
    if base ** t.shape[1] >= 1 << 62:  # too fine to number: cells of the first column alone
        cells, base = cells[:, :1], int(cells[:, 0].max()) + 3
    code = np.zeros(len(t), np.int64)
    for c in cells.T:
        code = code * base + c + 1
    order = np.argsort(code, kind="stable")
    t, times, code = t[order], times[order], code[order]
    names, first, sizes = np.unique(code, return_index=True, return_counts=True)
    for offset in itertools.product((-1, 0, 1), repeat=cells.shape[1]):
        step = 0
        for o in offset:
            step = step * base + o
        if step < 0:
            continue
        at = np.searchsorted(names, names + step)
        met = np.flatnonzero(at < len(names))
        met = met[names[at[met]] == names[met] + step]
        # each row of a cell against the rows of the other cell; within a cell, against those after it
        rows = np.concatenate([np.arange(first[m], first[m] + sizes[m]) for m in met]) if len(met) else np.zeros(0, np.int64)
        partner = np.repeat(at[met], sizes[met])
        start, stop = (rows + 1 if not step else first[partner]), first[partner] + sizes[partner]
        ends = np.cumsum(stop - start)
        done = 0
        while done < len(rows):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + COMPARED)))
            width = (stop - start)[done:upto]
            left = np.repeat(rows[done:upto], width)
            right = np.arange(len(left)) + np.repeat(start[done:upto] - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
            near = (np.abs(t[left] - t[right]) <= r).all(axis=1)
            count += int((times[left[near]] * times[right[near]]).sum())
            done = upto
    return count


def sample_entropy_one(x: np.ndarray, m: int = 2, r: float | None = None) -> float:
    """NaN if too short, inf without matches; templates within r are counted by cells of width r."""
    n = len(x)
    if n <= m + 1:
        return math.nan
    r = 0.2 * (x.std() + 1e-12) if r is None else r

    def share(k: int) -> float:
        t = np.lib.stride_tricks.sliding_window_view(x, k)
        return 2 * pairs_within(t, r) / (len(t) * (len(t) - 1)) if len(t) > 1 else 0.0

    a, b = share(m + 1), share(m)
    return -math.log(a / b) if a and b else math.inf


def lz_complexity_one(x: np.ndarray, threshold: float | None = None) -> float:
    """The number of words of an exhaustive history of x > threshold (its median), times log2(n) / n."""
    n = len(x)
    if n < 2:
        return math.nan
    return history_words((x > (np.median(x) if threshold is None else threshold)).tolist()) * math.log2(n) / n


def history_words(bits: list[bool]) -> int:
    """Words of the exhaustive history: each is the shortest that does not occur before its last symbol. A suffix automaton of what
    lies before grows by a symbol at a time, and the word's place in it moves along: linear time."""
    follow, link, length, last = [[-1, -1]], [-1], [0], 0
    words, state, size = 0, 0, 0
    for bit in bits:
        bit = int(bit)
        known = follow[state][bit]  # does the word go on as something seen before?
        new = len(length)
        follow.append([-1, -1])
        link.append(0)
        length.append(length[last] + 1)
        p, last = last, new
        while p >= 0 and follow[p][bit] < 0:
            follow[p][bit] = new
            p = link[p]
        if p >= 0:
            q = follow[p][bit]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                follow.append(follow[q][:])
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and follow[p][bit] == q:
                    follow[p][bit] = copy
                    p = link[p]
                link[q] = link[new] = copy
        if known < 0:
            words, state, size = words + 1, 0, 0
            continue
        size += 1
        state = known
        while state and length[link[state]] >= size:  # the state was split: the word belongs to its shorter half
            state = link[state]
    return words + (size > 0)


STATISTICS = {"SampEn": sample_entropy_one, "LZC": lz_complexity_one}


def entropies(signals: DataFrame, keys: tuple[str, ...] = ("signal_id", "role"), m: int = 2, r: float | None = None, pe_m: int = 3, pe_tau: int = 1, threshold: float | None = None) -> DataFrame:
    """(keys, SampEn, PermEn, LZC); what is not finite is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [np.asarray(v, float) for v in batch.column("x").to_pylist()]
            own = [[sample_entropy_one(v, m, r) for v in xs], [lz_complexity_one(v, threshold) for v in xs]]
            own = [pa.array([v if math.isfinite(v) else None for v in c], pa.float64()) for c in own]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "PermEn")), *own], names=[*keys, "PermEn", "SampEn", "LZC"])

    slim = signals.select(*keys, "x", permutation_entropy(F.col("x"), pe_m, pe_tau).alias("PermEn"))
    kinds = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(run, f"{kinds}, PermEn double, SampEn double, LZC double").select(*keys, "SampEn", "PermEn", "LZC")


def bursts(samples: DataFrame, fs: float, threshold: str = "percentile", p: float = 75.0, kappa: float = 1.5, min_ms: float = 20.0, merge_ms: float = 50.0) -> DataFrame:
    """(signal_id, role, start, end, peak, peak_t, duration_s): runs of samples (signal_id, role, t, v) at or over the
    threshold. Short runs go first; then runs are joined over short gaps. threshold: "percentile" p, or "std": mean + kappa * sd."""
    limit = F.percentile("v", p / 100) if threshold == "percentile" else F.avg("v") + kappa * F.stddev_pop("v")
    limits = samples.groupBy("signal_id").agg(limit.alias("limit"))
    above = samples.join(limits, "signal_id").where("v >= limit")
    by = Window.partitionBy("signal_id").orderBy("t")
    runs = above.withColumn("new", F.coalesce(F.col("t") - F.lag("t").over(by) > 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by))
    peak = F.max(F.struct("v", (-F.col("t")).alias("t")))
    runs = runs.groupBy("signal_id", "role", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), peak.alias("peak"))
    runs = runs.where((F.col("end") - F.col("start") + 1) >= round(min_ms / 1000 * fs))
    order = Window.partitionBy("signal_id").orderBy("start")
    gap = F.col("start") - F.lag("end").over(order) - 1
    joined = runs.withColumn("new", F.coalesce(gap > round(merge_ms / 1000 * fs), F.lit(True)).cast("int")).withColumn("burst", F.sum("new").over(order))
    return joined.groupBy("signal_id", "role", "burst").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("peak").alias("peak")).select(
        "signal_id", "role", "start", "end", F.col("peak.v").alias("peak"), (-F.col("peak.t")).alias("peak_t"), ((F.col("end") - F.col("start") + 1) / fs).alias("duration_s")
    )


def burst_summary(found: DataFrame, samples: DataFrame, fs: float) -> DataFrame:
    """Nine features per signal; signals without bursts have zeros, and null intervals."""
    spans = samples.groupBy("signal_id", "role").agg((F.count(F.lit(1)) / fs).alias("seconds"))
    gaps = found.withColumn("ibi", (F.col("start") - F.lag("start").over(Window.partitionBy("signal_id").orderBy("start"))) / fs)
    by = gaps.groupBy("signal_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("duration_s").alias("mean_duration"), F.median("duration_s").alias("median_duration"), F.avg("peak").alias("mean_peak"), F.median("peak").alias("median_peak"),
        F.avg("ibi").alias("mean_ibi"), F.median("ibi").alias("median_ibi"), F.sum("duration_s").alias("busy"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return spans.join(by, "signal_id", "left").select(
        "signal_id", "role", F.coalesce("n", F.lit(0)).alias("n_bursts"), zero(F.col("n") / F.col("seconds")).alias("rate_hz"), *(zero(F.col(c)).alias(c) for c in ("mean_duration", "median_duration", "mean_peak", "median_peak")),
        "mean_ibi", "median_ibi", zero(F.col("busy") / F.col("seconds")).alias("duty_cycle"),
    )


def fluctuations(profiles: DataFrame, keys: list[str], sizes: list[int], columns: tuple[str, str] = ("y", "y")) -> DataFrame:
    """(keys, n, window, f2): mean product of the detrended columns of profiles (keys, t, columns) in windows of n samples.

    One pass writes each sample once per scale; the sums of a window give its lines and residuals in closed form.
    """
    a, b = columns
    last = profiles.groupBy(*keys).agg((F.max("t") + 1).alias("__len"))
    placed = profiles.join(last, keys).select("*", F.explode(F.array(*map(F.lit, sizes))).alias("n")).withColumns({"window": F.floor(F.col("t") / F.col("n")), "i": (F.pmod("t", "n") - (F.col("n") - 1) / 2)})
    placed = placed.where(F.col("window") < F.floor(F.col("__len") / F.col("n")))
    sums = placed.groupBy(*keys, "n", "window").agg(F.covar_pop(a, b).alias("ab"), F.covar_pop("i", a).alias("ia"), F.covar_pop("i", b).alias("ib"), F.var_pop("i").alias("ii"))
    return sums.select(*keys, "n", "window", (F.col("ab") - F.col("ia") * F.col("ib") / F.col("ii")).alias("f2"))


def hurst(f2: DataFrame, keys: list[str], q_values: list[float], least: int = 4) -> tuple[DataFrame, DataFrame]:
    """F(q, n) as (keys, n, q, fq), and H(q) as (keys, q, h), the slope of ln F over ln n; q near 0 is left out. Fewer than
    `least` scales give no slope."""
    moments = f2.select(*keys, "n", F.explode(F.array(*(F.lit(float(q)) for q in q_values if abs(q) > 1e-6))).alias("q"), F.abs("f2").alias("a")).where("a > 0")
    fq = moments.groupBy(*keys, "n", "q").agg(F.pow(F.avg(F.pow("a", F.col("q") / 2)), 1 / F.first("q")).alias("fq"))
    slope = F.regr_slope(F.log("fq"), F.log("n"))
    return fq, fq.where("fq > 0").groupBy(*keys, "q").agg(F.when(F.count(F.lit(1)) >= least, slope).alias("h"))


def delta_alpha(h: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, delta_alpha): the width of the spectrum, alpha = H + q dH/dq, slopes by second-order differences."""
    w = Window.partitionBy(*keys).orderBy("q")
    hl, hr, ql, qr = F.lag("h").over(w), F.lead("h").over(w), F.lag("q").over(w), F.lead("q").over(w)
    left, right = F.col("q") - ql, qr - F.col("q")
    inner = (left * left * hr - right * right * hl + (right * right - left * left) * F.col("h")) / (left * right * (left + right))
    slope = F.when(ql.isNull(), (hr - F.col("h")) / right).when(qr.isNull(), (F.col("h") - hl) / left).otherwise(inner)
    return h.withColumn("alpha", F.col("h") + F.col("q") * slope).groupBy(*keys).agg((F.max("alpha") - F.min("alpha")).alias("delta_alpha"))


def correlations(channels: DataFrame) -> DataFrame:
    """(sample_id, role, c1, c2, rho) for c1 < c2; a constant channel correlates 0 with others."""
    a = channels.select("sample_id", "role", F.col("channel").alias("c1"), F.col("x").alias("a"))
    b = channels.select("sample_id", F.col("channel").alias("c2"), F.col("x").alias("b"))

    def rho(p: Column) -> Column:
        u, v = p["u"], p["v"]
        return A.dot(u, v) / F.nullif(A.norm(u) * A.norm(v), F.lit(0.0))

    centred = lambda x: A.let(A.mean(x), lambda m: F.transform(x, lambda v: v - m))
    joined = a.join(b, "sample_id").where("c1 < c2")
    return joined.select("sample_id", "role", "c1", "c2", F.coalesce(A.let(F.struct(centred(F.col("a")).alias("u"), centred(F.col("b")).alias("v")), rho), F.lit(0.0)).alias("rho"))
