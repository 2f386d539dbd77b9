"""Comparison of real and synthetic values: distances, rank statistics, tests, effect sizes.

Tables are long, (keys, role, value). Equal values are counted before they are ordered, so the orderings are
over distinct values only, and every result is one row per key.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import finite
from tidemark.functions.ranks import quantiles, running


def compare(values: DataFrame, keys: list[str], first: str = "real", second: str = "synthetic") -> DataFrame:
    """(keys, n1, n2, w1: Wasserstein-1, delta: Cliff's delta of first over second, u: Mann-Whitney U of first, ties: sum of t^3 - t).

    Values that are not finite are left out. A key without values on one side has nulls.
    """
    kept = values.where(finite(F.col("value")) & F.col("role").isin(first, second))
    counted = kept.groupBy(*keys, F.col("value").alias("v")).agg(F.count_if(F.col("role") == first).alias("a"), F.count_if(F.col("role") == second).alias("b"))
    totals = counted.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    run = running(counted, keys, "v", ["a", "b"]).join(totals, keys)
    gap = F.abs(F.col("run_a") / F.col("n1") - F.col("run_b") / F.col("n2")) * (F.col("next_v") - F.col("v"))
    below, above = F.col("run_b") - F.col("b"), F.col("n2") - F.col("run_b")
    t = (F.col("a") + F.col("b")).cast("double")
    both = (F.max("n1") > 0) & (F.max("n2") > 0)
    run = run.where("n1 > 0 and n2 > 0")
    return run.groupBy(*keys).agg(
        F.max("n1").alias("n1"), F.max("n2").alias("n2"),
        F.when(both, F.coalesce(F.sum(gap), F.lit(0.0))).alias("w1"),
        F.when(both, F.sum(F.col("a") * (below - above)) / (F.max("n1") * F.max("n2"))).alias("delta"),
        F.when(both, F.sum(F.col("a") * (below + F.col("b") / 2))).alias("u"),
        F.sum(t * t * t - t).alias("ties"),
    )


def summary(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, role, n, mean, sd: of the population, median, q1, q3) of the finite values."""
    kept = values.where(finite(F.col("value")))
    moments = kept.groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return moments.join(quantiles(kept, [*keys, "role"], "value", {"median": 0.5, "q1": 0.25, "q3": 0.75}), [*keys, "role"])


def robust_sd(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sd): 1.4826 times the median of the absolute deviations from the median."""
    middle = quantiles(values, keys, "value", {"__m": 0.5})
    away = values.join(middle, keys).select(*keys, F.abs(F.col("value") - F.col("__m")).alias("value"))
    return quantiles(away, keys, "value", {"sd": 0.5}).withColumn("sd", 1.4826 * F.col("sd"))


def paired(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, sd: of the sample, t, cohens_d) of the differences a - b; no spread gives nulls."""
    by = pairs.withColumn("d", F.col("a") - F.col("b")).where(finite(F.col("d"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return by.withColumns({"t": F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0)) * F.sqrt("n"), "cohens_d": F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0))})


def signed_rank(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, w_plus, w_minus, ties) of the differences a - b without zeros: Wilcoxon's signed ranks, averaged over ties."""
    d = pairs.select(*keys, (F.col("a") - F.col("b")).alias("d")).where(finite(F.col("d")) & (F.col("d") != 0))
    counted = d.groupBy(*keys, F.abs("d").alias("v")).agg(F.count_if(F.col("d") > 0).alias("plus"), F.count(F.lit(1)).alias("t"))
    run = running(counted, keys, "v", ["t"])
    rank = F.col("run_t") - (F.col("t") - 1) / 2
    t = F.col("t").cast("double")
    return run.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("plus") * rank).alias("w_plus"), F.sum((F.col("t") - F.col("plus")) * rank).alias("w_minus"), F.sum(t * t * t - t).alias("ties"))


# p-values: a row per test, so plain Python functions over a few numbers


@lru_cache(maxsize=256)
def _u_counts(n: int, m: int) -> tuple[int, ...]:
    """How many orders of n and m values have each U."""
    counts = [1] + [0] * (n * m)
    for i in range(1, n + 1):  # product of (1 - q^(m + i)) / (1 - q^i)
        for k in range(n * m, m + i - 1, -1):
            counts[k] -= counts[k - m - i]
        for k in range(i, n * m + 1):
            counts[k] += counts[k - i]
    return tuple(counts)


def mann_whitney_p(u: float, n: int, m: int, ties: float) -> float | None:
    """Two-sided; exact without ties if a side has 8 values at most, else normal with corrections for ties and continuity."""
    if not n or not m:
        return None
    big = max(u, n * m - u)
    if min(n, m) <= 8 and not ties:
        counts = _u_counts(n, m)
        return min(1.0, 2 * sum(counts[math.ceil(big) :]) / sum(counts))
    total = n + m
    var = n * m / 12 * (total + 1 - ties / (total * (total - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, math.erfc(max(0.0, big - n * m / 2 - 0.5) / math.sqrt(2 * var)))


def wilcoxon_p(w: float, n: int, ties: float) -> float | None:
    """Two-sided, of the smaller rank sum; exact without ties up to 50 pairs, else normal."""
    if not n:
        return None
    if n <= 50 and not ties:
        counts = [1] + [0] * (n * (n + 1) // 2)
        for i in range(1, n + 1):
            for k in range(len(counts) - 1, i - 1, -1):
                counts[k] += counts[k - i]
        return min(1.0, 2 * sum(counts[: int(w) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var)) if var > 0 else 1.0


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + num * d) or tiny), (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def student_p(t: float, df: float) -> float:
    """Two-sided."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def chi2_3_p(x: float) -> float:
    """The upper tail with three degrees of freedom."""
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)


def normal_quantile(p: float) -> float:
    """By Newton steps on erfc."""
    z = 0.0
    for _ in range(60):
        step = (0.5 * math.erfc(-z / math.sqrt(2)) - p) * math.sqrt(2 * math.pi) * math.exp(min(50.0, z * z / 2))
        z -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return z


def blom(i: int, n: int) -> float:
    """The normal score of rank i (from 1 on) of n."""
    return normal_quantile((i - 0.375) / (n + 0.25))


def shapiro(values: list[float]) -> tuple[float, float] | None:
    """(W, p) by Royston's approximation; None for fewer than three values."""
    x = sorted(values)
    n = len(x)
    if n < 3:
        return None
    m = [blom(i + 1, n) for i in range(n)]
    mid = sum(x) / n
    return shapiro_of(n, x[0], x[1], x[-2], x[-1], sum(p * q for p, q in zip(m, x, strict=True)), sum(v * v for v in m), sum((v - mid) ** 2 for v in x))


def shapiro_of(n: int, low: float, low2: float, high2: float, high: float, mx: float, ss: float, spread: float) -> tuple[float, float] | None:
    """The same from sums: the two least and the two greatest values, the sum of normal score times value, the sum of the squared
    scores, and the sum of the squared deviations."""
    if n < 3 or low == high:
        return None if n < 3 else (1.0, 1.0)
    u, m1, m2 = 1 / math.sqrt(n), blom(n, n), blom(n - 1, n)
    if n == 3:
        b = math.sqrt(0.5) * (high - low)
    else:
        poly = lambda c: sum(k * u**i for i, k in enumerate(c))
        last = poly([m1 / math.sqrt(ss), 0.221157, -0.147981, -2.07119, 4.434685, -2.706056])
        if n > 5:
            before = poly([m2 / math.sqrt(ss), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633])
            eps = (ss - 2 * m1**2 - 2 * m2**2) / (1 - 2 * last**2 - 2 * before**2)
            b = last * (high - low) + before * (high2 - low2) + (mx - m1 * (high - low) - m2 * (high2 - low2)) / math.sqrt(eps)
        else:
            eps = (ss - 2 * m1**2) / (1 - 2 * last**2)
            b = last * (high - low) + (mx - m1 * (high - low)) / math.sqrt(eps)
    w = min(1.0, b * b / spread)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(1 - w) if w < 1 else -50.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu, s = 0.544 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        if y >= g:
            return w, 0.0
        y = -math.log(g - y)
    else:
        k = math.log(n)
        mu, s = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3, math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
    return w, 0.5 * math.erfc((y - mu) / s / math.sqrt(2))


def shapiro_wilk(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, p) of the finite values. Ranks come from ranges, scores are summed by distinct value; no group is gathered."""
    kept = values.where(finite(F.col("value")))
    counted = kept.groupBy(*keys, F.col("value").alias("v")).agg(F.count(F.lit(1)).alias("t"))
    totals = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.var_pop("value") * F.count(F.lit(1))).alias("spread"))

    @F.pandas_udf("struct<m double, mm double>")
    def scores(last: pd.Series, t: pd.Series, n: pd.Series) -> pd.DataFrame:
        own = [[blom(i, int(k)) for i in range(int(r - c) + 1, int(r) + 1)] for r, c, k in zip(last, t, n, strict=True)]
        return pd.DataFrame({"m": [sum(m) for m in own], "mm": [sum(v * v for v in m) for m in own]})

    run = running(counted, keys, "v", ["t"]).join(totals, keys).withColumn("s", scores("run_t", "t", "n"))
    by = run.groupBy(*keys, "n", "spread").agg(
        F.min("v").alias("low"), F.min(F.when(F.col("run_t") >= 2, F.col("v"))).alias("low2"), F.max(F.when(F.col("run_t") - F.col("t") < F.col("n") - 1, F.col("v"))).alias("high2"), F.max("v").alias("high"),
        F.sum(F.col("s.m") * F.col("v")).alias("mx"), F.sum("s.mm").alias("ss"),
    )
    p = F.udf(lambda *a: (lambda o: float(o[1]) if o else None)(shapiro_of(*a)), "double")
    return by.select(*keys, "n", p("n", "low", "low2", "high2", "high", "mx", "ss", "spread").alias("p"))


def p_of_u(u: Column, n: Column, m: Column, ties: Column) -> Column:
    return F.udf(mann_whitney_p, "double")(u, n, m, ties)


def format_p(p: Column) -> Column:
    """A p-value for a report."""
    return F.when(p.isNull(), "—").when(F.isnan(p), "nan").when(p < 0.001, F.format_string("< 0.001 (exact=%.3e)", p)).otherwise(F.format_string("%.3f", p))
