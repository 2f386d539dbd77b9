"""Queries of sources and per-signal transforms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions.stats import format_p
from tidemark.operators import transforms as T
from tidemark.plans.sql import CHAN, LONG, S, SIG, r
from tidemark.sources import signals as G


def _long(df):
    """(signal_id, t, value) of x, to six digits."""
    return G.samples(df, "signal_id").select("signal_id", F.col("t").cast("long").alias("t"), A.r6("v").alias("value"))


def _map(to):
    return lambda spark, d: _long(G.short(spark, d).withColumn("x", to(F.col("x"))))


QUERIES = {
    "io01_scan": lambda spark, d: G.short(spark, d).select("signal_id", "role", F.size("x").cast("long").alias("n"), A.r6(A.total(F.col("x"))).alias("total")),
    "io07_format_p": lambda spark, d: G.short(spark, d).select("signal_id", format_p(F.abs(F.element_at("x", 1)) / 4).alias("p")),
    "pr02_channel_shape": lambda spark, d: G.validate_channels(G.channels(spark, d), 4, 64).select("sample_id", F.col("n_channels").cast("long").alias("n_channels"), F.col("min_length").cast("long").alias("length"), "valid"),
    "pr03_resample": lambda spark, d: _long(T.resample(G.long_view(spark, d), G.FS, 100.0)),
    "pr04_minmax": _map(T.minmax),
    "pr05_zscore_global": lambda spark, d: _long(T.zscore_global(G.short(spark, d))),
    "pr06_zscore_per_signal": _map(T.zscore_signal),
    "pr08_detrend": lambda spark, d: _long(T.usable(G.short(spark, d)).withColumn("x", T.detrend(F.col("x")))),
    "pr09_pad": lambda spark, d: _long(T.pad(G.short(spark, d).withColumn("x", F.slice("x", 1, 40 + F.pmod("signal_id", F.lit(25)).cast("int"))))),
    "pr12_finite": lambda spark, d: G.samples(G.short(spark, d), "signal_id").withColumn("v", F.when(F.col("t") % 7 != 0, F.col("v"))).where(A.finite(F.col("v"))).groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"), A.r6(F.sum("v")).alias("total")),
    "pr16_difference": _map(lambda x: A.difference(A.difference(x))),
    "pr18_savgol": lambda spark, d: _long(T.savgol(G.short(spark, d))),
    "pr20_frequency_grid": lambda spark, d: G.short(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n")).select("role", F.posexplode(F.array(*map(F.lit, T.frequency_grid(0.5, 40.0, 30)))).alias("k", "f")).select("role", F.col("k").cast("long").alias("k"), A.r6("f").alias("f")),
    "pr22_profile": lambda spark, d: _long(G.short(spark, d).withColumn("x", T.profile(F.col("x")))),
    "pr25_phase_surrogate": lambda spark, d: pr25(spark, d),
    "pr27_row_normalise": _map(T.row_normalise),
}


def pr25(spark, d):
    """The amplitudes of the spectrum of each signal's surrogate, and whether its samples have moved."""
    short = G.short(spark, d).select("signal_id", "x")
    copies = T.surrogates(short, 1).select("signal_id", F.col("x").alias("y")).join(short, "signal_id")
    moved = F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b))) > 0.01
    rows = copies.select("signal_id", moved.alias("moved"), F.size("y").alias("n"), F.posexplode("y").alias("t", "v")).withColumn("k", F.explode(F.expr("sequence(0, n div 2)")))
    part = lambda wave: F.sum(F.col("v") * wave(2 * math.pi * F.col("k") * F.col("t") / F.col("n")))
    by = rows.groupBy("signal_id", "k", "moved").agg(part(F.cos).alias("re"), part(F.sin).alias("im"))
    return by.select("signal_id", F.col("k").cast("long").alias("k"), A.r6(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)).alias("amplitude"), "moved")


def pr10(spark, d):
    """Pairs (2k, 2k + 1), the second signal shortened."""
    s = G.indexed(G.short(spark, d))
    a, b = (s.where(f"role = '{role}'").select("idx", F.col("x").alias(c)) for role, c in (("real", "a"), ("synthetic", "b")))
    pairs = a.join(b.withColumn("b", F.slice("b", 1, 50)), "idx")
    x, y = T.common_length(F.col("a"), F.col("b"))
    return pairs.select("idx", F.size(x).cast("long").alias("n"), A.r6(A.dot(x, y)).alias("product"))


def pr11(spark, d):
    """What is not finite as 0, then each channel's total."""
    rows = G.channels(spark, d).withColumn("x", F.transform("x", lambda v, i: F.when(i % 9 == 0, F.lit(float("nan"))).when(i % 11 == 0, F.lit(float("inf"))).otherwise(v)))
    return rows.select("sample_id", "channel", A.r6(A.total(T.clean(F.col("x")))).alias("total"))


def pr17(spark, d):
    """Each signal read at every half step."""
    points = G.samples(G.short(spark, d), "signal_id").select("signal_id", F.col("t").cast("double").alias("f"), F.col("v").alias("y"))
    grid = G.short(spark, d).select("signal_id", F.explode(F.sequence(F.lit(-2), F.lit(130))).alias("k")).select("signal_id", (F.col("k") / 2).alias("f"))
    return T.interpolate(grid, points, ["signal_id"]).select("signal_id", "f", A.r6("y").alias("y"))


def pr19(spark, d):
    return T.moving_average(G.samples(G.short(spark, d), "signal_id"), ["signal_id"], 6).select("signal_id", F.col("t").cast("long").alias("t"), A.r6("smooth").alias("value"))


def pr21(spark, d):
    """The window sizes that fit each signal, by its length."""
    lengths = G.short(spark, d).unionByName(G.long_view(spark, d).withColumn("label", F.lit(0))).select(F.size("x").alias("n")).distinct()
    sizes = F.udf(T.window_sizes, "array<int>")
    return lengths.select(F.col("n").cast("long").alias("length"), F.explode(sizes("n")).alias("size")).select("length", F.col("size").cast("long").alias("size"))


def pr23(spark, d):
    v = F.abs("v")
    return G.samples(G.short(spark, d), "signal_id").select("signal_id", F.col("t").cast("long").alias("t"), A.r6(T.intensity(v, "power")).alias("power"), A.r6(T.intensity(v, "db")).alias("db"))


def pr24(spark, d):
    s = G.samples(G.short(spark, d), "signal_id")
    return s.select("signal_id", "t", T.colours(F.col("v"), -3.0, 3.0).alias("c")).select("signal_id", F.col("t").cast("long").alias("t"), "c.r", "c.g", "c.b")


QUERIES |= {"pr10_truncate_demean": pr10, "pr11_clean_channels": pr11, "pr17_interpolate": pr17, "pr19_moving_average": pr19, "pr21_window_sizes": pr21, "pr23_intensity": pr23, "pr24_colours": pr24}

_P = "abs(x[1]) / 4"
SQL = {
    "io01_scan": f"WITH {SIG} SELECT signal_id, role, len(x)::BIGINT AS n, {r('list_sum(x)', 'total')} FROM sig",
    "io07_format_p": f"WITH {SIG} SELECT signal_id, CASE WHEN {_P} < 0.001 THEN format('< 0.001 (exact={{:.3e}})', {_P}) ELSE format('{{:.3f}}', {_P}) END AS p FROM sig",
    "pr02_channel_shape": f"WITH {CHAN} SELECT sample_id, count(DISTINCT channel)::BIGINT AS n_channels, min(len(x))::BIGINT AS length, count(DISTINCT channel) = 4 AND min(len(x)) = 64 AND max(len(x)) = 64 AS valid FROM ch GROUP BY sample_id",
    "pr04_minmax": f"WITH {S} SELECT signal_id, t, {r('2 * (v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END - 1', 'value')} FROM (SELECT *, min(v) OVER (PARTITION BY signal_id) AS lo, max(v) OVER (PARTITION BY signal_id) AS hi FROM s)",
    "pr05_zscore_global": f"WITH {S}, g AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM s WHERE role = 'real') SELECT signal_id, t, {r('(v - m) / sd', 'value')} FROM s, g",
    "pr06_zscore_per_signal": f"WITH {S} SELECT signal_id, t, {r('(v - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END', 'value')} FROM (SELECT *, avg(v) OVER (PARTITION BY signal_id) AS m, stddev_pop(v) OVER (PARTITION BY signal_id) AS sd FROM s)",
    "pr08_detrend": f"WITH {S}, f AS (SELECT signal_id, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM s GROUP BY 1) SELECT signal_id, t, {r('v - a - b * t', 'value')} FROM s JOIN f USING (signal_id)",
    "pr09_pad": f"WITH {S} SELECT signal_id, t, {r('CASE WHEN t < 40 + signal_id % 25 THEN v ELSE 0 END', 'value')} FROM s",
    "pr10_truncate_demean": f"WITH {S}, p AS (SELECT a.idx, a.v AS a, b.v AS b FROM s a JOIN s b ON a.idx = b.idx AND a.t = b.t WHERE a.role = 'real' AND b.role = 'synthetic' AND a.t < 50) SELECT idx, count(*)::BIGINT AS n, {r('covar_pop(a, b) * count(*)', 'product')} FROM p GROUP BY idx",
    "pr11_clean_channels": f"WITH {CHAN} SELECT sample_id, channel, {r('sum(CASE WHEN t % 9 = 0 OR t % 11 = 0 THEN 0 ELSE v END)', 'total')} FROM c GROUP BY ALL",
    "pr12_finite": f"WITH {S} SELECT signal_id, count(*)::BIGINT AS n, {r('sum(v)', 'total')} FROM s WHERE t % 7 <> 0 GROUP BY signal_id",
    "pr16_difference": f"WITH {S}, d AS (SELECT signal_id, t, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d FROM s WINDOW w AS (PARTITION BY signal_id ORDER BY t)) SELECT signal_id, t - 2 AS t, {r('d', 'value')} FROM d WHERE t >= 2",
    "pr17_interpolate": f"WITH {SIG}, g AS (SELECT signal_id, x, unnest(range(-2, 131)) / 2 AS f FROM sig), h AS (SELECT *, least(greatest(f, 0), len(x) - 1) AS u FROM g) SELECT signal_id, f, {r('x[floor(u)::INT + 1] + (u - floor(u)) * (x[ceil(u)::INT + 1] - x[floor(u)::INT + 1])', 'y')} FROM h",
    "pr19_moving_average": f"WITH {S} SELECT signal_id, t, {r('sum(v) OVER (PARTITION BY signal_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6', 'value')} FROM s",
    "pr24_colours": f"WITH {S}, z AS (SELECT signal_id, t, least(greatest((v + 3.0) / 6.0, 0), 1) AS a FROM s) SELECT signal_id, t, " + ", ".join(f"round(255 * least(greatest(3 * a - {k}, 0), 1))::INTEGER AS {c}" for k, c in enumerate("rgb")) + " FROM z",
    "pr18_savgol": f"""WITH {S}, w AS (SELECT signal_id, t, greatest(0, least(t - 5, count(*) OVER (PARTITION BY signal_id) - 11)) AS a FROM s),
      j AS (SELECT w.signal_id, w.t, w.t - a - 5 AS q, y.t - a - 5 AS i, y.v FROM w JOIN s y ON y.signal_id = w.signal_id AND y.t BETWEEN a AND a + 10)
      SELECT signal_id, t, {r("sum(v * (1 / 11.0::DOUBLE + q * i / 110.0::DOUBLE + (q * q - 10) * (i * i - 10) / 858.0::DOUBLE + (q ** 3 - 17.8::DOUBLE * q) * (i ** 3 - 17.8::DOUBLE * i) / 6177.6::DOUBLE))", "value")} FROM j GROUP BY signal_id, t""",
    "pr03_resample": f"""WITH {LONG}, x AS (SELECT signal_id, k, sum(v * cos(2 * pi() * ((k * t) % 512) / 512)) AS re, -sum(v * sin(2 * pi() * ((k * t) % 512) / 512)) AS im FROM l, range(201) g(k) GROUP BY ALL)
      SELECT signal_id, t, {r("sum((re * cos(2 * pi() * ((k * t) % 400) / 400) - im * CASE WHEN k = 200 THEN 0 ELSE sin(2 * pi() * ((k * t) % 400) / 400) END) * CASE k WHEN 0 THEN 1 ELSE 2 END) / 512", "value")} FROM x, range(400) h(t) GROUP BY signal_id, t""",
    "pr25_phase_surrogate": f"""WITH {S}, n AS (SELECT signal_id, len(x) AS n FROM sig), f AS (SELECT signal_id, k, sum(v * cos(2 * pi() * k * t / n)) AS re, sum(v * sin(2 * pi() * k * t / n)) AS im
      FROM s JOIN n USING (signal_id), range(33) g(k) WHERE k <= n // 2 GROUP BY ALL) SELECT signal_id, k, {r('sqrt(re * re + im * im)', 'amplitude')}, true AS moved FROM f""",
    "pr20_frequency_grid": f"WITH {SIG} SELECT DISTINCT role, k::BIGINT AS k, {r('0.5 + k * 39.5 / 29', 'f')} FROM sig, range(30) g(k)",
    "pr21_window_sizes": f"WITH {SIG}, {LONG.replace('l AS (', 'l_ AS (')}, n AS (SELECT DISTINCT len(x) AS length FROM sig UNION SELECT DISTINCT len(x) FROM lng), m AS (SELECT length, least(length // 4, 100) AS top FROM n WHERE least(length // 4, 100) > 10) SELECT DISTINCT length::BIGINT AS length, floor(CASE WHEN k = 9 THEN top ELSE 10 ** (1 + k * (log10(top) - 1) / 9) END)::BIGINT AS size FROM m, range(10) g(k)",
    "pr22_profile": f"WITH {S} SELECT signal_id, t, {r('sum(v - m) OVER (PARTITION BY signal_id ORDER BY t)', 'value')} FROM (SELECT *, avg(v) OVER (PARTITION BY signal_id) AS m FROM s)",
    "pr23_intensity": f"WITH {S} SELECT signal_id, t, {r('v * v', 'power')}, {r('10 * log10(v * v + 1e-12)', 'db')} FROM s",
    "pr27_row_normalise": f"WITH {S} SELECT signal_id, t, {r('v / greatest(sqrt(sum(v * v) OVER (PARTITION BY signal_id)), 1e-12)', 'value')} FROM s",
}
