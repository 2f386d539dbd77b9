"""Per-signal transforms. x is an array of doubles; each function adds or replaces columns and keeps the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays as A


def minmax(x: Column) -> Column:
    """To [-1, 1]; a constant signal to -1."""
    low, high = F.array_min(x), F.array_max(x)
    return A.let(F.struct(low.alias("l"), F.when(high > low, high - low).otherwise(F.lit(1.0)).alias("r")), lambda s: F.transform(x, lambda v: 2 * (v - s["l"]) / s["r"] - 1))


def zscore_signal(x: Column) -> Column:
    """By the signal's own mean and deviation; a constant signal to 0."""
    return A.let(F.struct(A.mean(x).alias("m"), A.deviation(x).alias("s")), lambda p: F.transform(x, lambda v: (v - p["m"]) / F.when(p["s"] > 0, p["s"]).otherwise(F.lit(1.0))))


def zscore_global(signals: DataFrame) -> DataFrame:
    """All signals by the one mean and deviation of all samples of real signals."""
    one = signals.where("role = 'real'").select(F.explode("x").alias("v")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    mean, sd = one["m"] or 0.0, one["s"] or 1.0
    return signals.withColumn("x", F.transform("x", lambda v: (v - F.lit(mean)) / F.lit(sd)))


def normalise(signals: DataFrame, mode: str | None) -> DataFrame:
    """mode: None or "none", "zscore_global", "zscore_per_signal"."""
    match mode:
        case None | "none":
            return signals
        case "zscore_global":
            return zscore_global(signals)
        case "zscore_per_signal":
            return signals.withColumn("x", zscore_signal(F.col("x")))
    raise ValueError(f"unknown normalisation {mode!r}")


def usable(signals: DataFrame) -> DataFrame:
    """Signals that have samples, all of them finite."""
    return signals.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: ~A.finite(v)))


def detrend(x: Column) -> Column:
    """The residuals of the straight line through the samples."""
    n = F.size(x)
    mid = (n - 1) / 2
    slope = F.aggregate(F.transform(x, lambda v, i: v * (i - mid)), F.lit(0.0), lambda a, v: a + v) / F.nullif((n * n - 1) * n / 12, F.lit(0.0))
    return A.let(F.struct(A.mean(x).alias("m"), F.coalesce(slope, F.lit(0.0)).alias("b")), lambda p: F.transform(x, lambda v, i: v - p["m"] - p["b"] * (i - mid)))


def pad(signals: DataFrame, allow: bool = True) -> DataFrame:
    """Zeros at the end up to the longest signal; allow=False raises if lengths differ."""
    shortest, longest = signals.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest == longest:
        return signals
    if not allow:
        raise ValueError(f"signals of {shortest} to {longest} samples")
    return signals.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("x"))))


def common_length(a: Column, b: Column) -> tuple[Column, Column]:
    """Both cut to the shorter length, each less its mean."""
    n = F.least(F.size(a), F.size(b))
    centred = lambda x: A.let(F.slice(x, 1, n), lambda s: A.let(A.mean(s), lambda m: F.transform(s, lambda v: v - m)))
    return centred(a), centred(b)


def clean(x: Column) -> Column:
    """What is not finite becomes 0."""
    return F.transform(x, lambda v: F.when(A.finite(v), v).otherwise(F.lit(0.0)))


def row_normalise(x: Column) -> Column:
    return A.let(F.greatest(A.norm(x), F.lit(1e-12)), lambda n: F.transform(x, lambda v: v / n))


def profile(x: Column) -> Column:
    """The running sum of the centred signal."""
    return A.let(A.mean(x), lambda m: A.running(F.transform(x, lambda v: v - m)))


def moving_average(samples: DataFrame, keys: list[str], width: int) -> DataFrame:
    """samples (keys, t, v) with `smooth`: the mean of `width` samples centred as in a convolution of the same length, zeros beyond the ends."""
    if width < 1:
        raise ValueError("width")
    behind = width - 1 - (width - 1) // 2
    frame = Window.partitionBy(*keys).orderBy("t").rowsBetween(-behind, (width - 1) // 2)
    return samples.withColumn("smooth", F.sum("v").over(frame) / width)


def interpolate(grid: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f, y): points (keys, f, y) read at the f of grid (keys, f), linear in between, constant beyond the ends."""
    both = points.select(*keys, "f", "y", F.lit(0).alias("asked")).unionByName(grid.select(*keys, "f", F.lit(None).cast("double").alias("y"), F.lit(1).alias("asked")))
    own = Window.partitionBy(*keys).orderBy("f", "asked")
    left, right = own.rowsBetween(Window.unboundedPreceding, Window.currentRow), own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at = F.when(F.col("asked") == 0, F.struct("f", "y"))
    found = both.withColumns({"l": F.last(at, True).over(left), "r": F.first(at, True).over(right)}).where("asked = 1")
    share = (F.col("f") - F.col("l.f")) / F.nullif(F.col("r.f") - F.col("l.f"), F.lit(0.0))
    y = F.when(F.col("l").isNull(), F.col("r.y")).when(F.col("r").isNull(), F.col("l.y")).otherwise(F.col("l.y") + F.coalesce(share, F.lit(0.0)) * (F.col("r.y") - F.col("l.y")))
    return found.select(*keys, "f", y.alias("y"))


def decibels(power: Column, ref: Column | float = 1.0, eps: float = 1e-12) -> Column:
    return 10 * F.log10((power + eps) / ref)


def intensity(amplitude: Column, mode: str = "amplitude", ref: Column | float = 1.0) -> Column:
    """amplitude, power or db of an amplitude."""
    match mode:
        case "amplitude":
            return amplitude
        case "power":
            return amplitude * amplitude
        case "db":
            return decibels(amplitude * amplitude, ref)
    raise ValueError(f"unknown intensity {mode!r}")


def frequency_grid(low: float, high: float, n: int, scale: str = "linear") -> list[float]:
    if not 0 < low < high or n < 2 or scale not in ("linear", "log"):
        raise ValueError("frequencies")
    return (np.linspace(low, high, n) if scale == "linear" else np.geomspace(low, high, n)).tolist()


def window_sizes(length: int, n_scales: int = 10) -> list[int]:
    """Distinct whole scales, even in the logarithm, from 10 to a quarter of the length (100 at most)."""
    top = min(length // 4, 100)
    return [] if top <= 10 else sorted({int(v) for v in np.logspace(1, np.log10(top), n_scales)})


def _per_signal(signals: DataFrame, kernel) -> DataFrame:
    """x replaced by kernel(x, row of the other columns), batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["x"] = [kernel(np.asarray(x, float), rows.iloc[i]) for i, x in enumerate(rows["x"])]
            yield rows

    return signals.mapInPandas(run, signals.schema)


def resample_one(x: np.ndarray, n: int) -> np.ndarray:
    """Fourier resampling to n samples; the unpaired bin of an even length is split or joined."""
    m = min(n, len(x))
    spectrum = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    out[: m // 2 + 1] = spectrum[: m // 2 + 1]
    if m % 2 == 0 and n != len(x):
        out[m // 2] *= 2 if n < len(x) else 0.5
    return np.fft.irfft(out, n) * (n / len(x))


def resample(signals: DataFrame, original_fs: float, target_fs: float) -> DataFrame:
    return _per_signal(signals, lambda x, _: resample_one(x, int(len(x) * target_fs / original_fs)))


def savgol_one(x: np.ndarray, window: int, order: int) -> np.ndarray:
    """Least-squares smoothing; the polynomial of the first and last window gives the ends."""
    window = min(window, len(x) - (len(x) + 1) % 2)
    window -= (window + 1) % 2
    if window <= order:
        return x
    h = window // 2
    design = np.vander(np.arange(-h, h + 1), order + 1, increasing=True)
    weights = np.linalg.pinv(design)[0]
    y = np.convolve(x, weights[::-1], "same")
    for part, to in ((slice(0, window), slice(0, h)), (slice(len(x) - window, len(x)), slice(len(x) - h, len(x)))):
        fit = design @ (np.linalg.pinv(design) @ x[part])
        y[to] = fit[:h] if to.start == 0 else fit[-h:]
    return y


def savgol(signals: DataFrame, window: int = 11, order: int = 3) -> DataFrame:
    return _per_signal(signals, lambda x, _: savgol_one(x, window, order))


def surrogate_one(x: np.ndarray, seed: int) -> np.ndarray:
    """Random phases, the spectrum's amplitudes; mean and deviation of x."""
    rng = np.random.default_rng(seed)
    spectrum = np.fft.rfft(x)
    free = slice(1, len(spectrum) - (len(x) % 2 == 0))
    spectrum[free] = np.abs(spectrum[free]) * np.exp(2j * np.pi * rng.random(len(spectrum[free])))
    y = np.fft.irfft(spectrum, len(x))
    return (y - y.mean()) / (y.std() + 1e-12) * x.std() + x.mean()


def surrogates(signals: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n phase-randomised copies of each signal (signal_id, x), numbered by surrogate_no; the same on every run."""
    copies = signals.withColumn("surrogate_no", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__seed", F.abs(F.xxhash64("signal_id", "surrogate_no", F.lit(seed)) % 2147483647))
    return _per_signal(copies, lambda x, row: surrogate_one(x, int(row["__seed"]))).drop("__seed")


def colours(levels: Column, low: float, high: float) -> Column:
    """(r, g, b), 0 to 255, on a dark-to-bright ramp."""
    at = F.least(F.greatest((levels - low) / (high - low or 1.0), F.lit(0.0)), F.lit(1.0))
    part = lambda v: F.round(255 * F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).cast("int")
    return F.struct(part(3 * at).alias("r"), part(3 * at - 1).alias("g"), part(3 * at - 2).alias("b"))
