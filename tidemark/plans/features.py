"""Queries of per-signal features."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.operators import features as E
from tidemark.operators import transforms as T
from tidemark.plans.sql import CHAN, LONG, S, SIG, r
from tidemark.sources import signals as G

CONFIG = E.SpectrumConfig(G.FS)
SIZE = CONFIG.segment(512)
SIZES, QS = T.window_sizes(512), [-3.0, -2.0, -1.0, 1.0, 2.0, 3.0]


def fe01(spark, d):
    h = G.short(spark, d).select("signal_id", "role", E.hjorth(F.col("x")).alias("h"))
    return h.select("signal_id", "role", *(A.r6(f"h.{c}").alias(c) for c in ("activity", "mobility", "complexity")))


def fe02(spark, d):
    p = E.psd(G.long_view(spark, d), CONFIG).select("signal_id", F.posexplode(F.arrays_zip("f", "p")).alias("k", "z"))
    return p.select("signal_id", F.col("k").cast("long").alias("bin"), A.r6("z.f").alias("f"), A.r6(F.col("z.p") * 1000).alias("milli_pxx"))


def fe03(spark, d):
    """The spectrum of one segment of four seconds, by its integral over 0.5 to 64 Hz."""
    p = E.psd(G.long_view(spark, d), CONFIG, lambda n: min(n, int(4 * G.FS)))
    p = p.select("signal_id", F.filter(F.arrays_zip("f", "p"), lambda z: (z["f"] >= 0.5) & (z["f"] <= 64)).alias("z")).withColumn("area", E.simpson(F.col("z.p"), F.lit(G.FS / 512)))
    return p.select("signal_id", F.posexplode("z").alias("k", "w"), "area").select("signal_id", F.col("k").cast("long").alias("k"), A.r6(F.col("w.p") / F.col("area")).alias("p"))


def fe04(spark, d):
    """The integral of every signal over 64, 63, 2 and 1 samples."""
    s = G.short(spark, d)
    return s.select("signal_id", *(A.r6(E.simpson(F.slice("x", 1, n), F.lit(0.5))).alias(f"n{n}") for n in (64, 63, 2, 1)))


def fe05(spark, d):
    return E.band_power(E.psd(G.long_view(spark, d), CONFIG), CONFIG).select("signal_id", "band", A.r6("rel_power").alias("rel_power"))


def fe06(spark, d):
    return E.dominant_frequency(E.psd(G.long_view(spark, d), CONFIG), CONFIG).select("signal_id", A.r6("f").alias("f"))


def _envelope(spark, d):
    return G.samples(G.long_view(spark, d)).withColumn("v", F.abs("v"))


BURST = {"fs": G.FS, "threshold": "percentile", "p": 60.0, "min_ms": 16.0, "merge_ms": 16.0}


def fe11(spark, d):
    b = E.bursts(_envelope(spark, d), **BURST)
    return b.select("signal_id", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "peak_t")), A.r6("peak").alias("peak"), A.r6("duration_s").alias("duration_s"))


BURST_FEATURES = ("rate_hz", "mean_duration", "median_duration", "mean_peak", "median_peak", "mean_ibi", "median_ibi", "duty_cycle")


def fe12(spark, d):
    e = _envelope(spark, d)
    return E.burst_summary(E.bursts(e, **BURST), e, G.FS).select("signal_id", F.col("n_bursts").cast("long").alias("n_bursts"), *(A.r6(c).alias(c) for c in BURST_FEATURES))


def _entropy(column):
    return lambda spark, d: E.entropies(G.short(spark, d)).select("signal_id", A.r6(column).alias("value"))


def _profiles(spark, d):
    return G.samples(G.long_view(spark, d).withColumn("x", T.profile(F.col("x"))), "signal_id").withColumnRenamed("v", "y")


def fe17(spark, d):
    return E.hurst(E.fluctuations(_profiles(spark, d), ["signal_id"], SIZES), ["signal_id"], QS)[0].select("signal_id", F.col("n").cast("long").alias("n"), "q", A.r6("fq").alias("fq"))


def fe16(spark, d):
    return E.hurst(E.fluctuations(_profiles(spark, d), ["signal_id"], SIZES), ["signal_id"], QS)[1].select("signal_id", "q", A.r6("h").alias("h"))


def fe18(spark, d):
    h = E.hurst(E.fluctuations(_profiles(spark, d), ["signal_id"], SIZES), ["signal_id"], QS)[1]
    return E.delta_alpha(h, ["signal_id"]).select("signal_id", A.r6("delta_alpha").alias("delta_alpha"))


def fe19(spark, d):
    return E.correlations(G.channels(spark, d)).select("sample_id", "c1", "c2", A.r6("rho").alias("rho"))


QUERIES = {
    "fe01_hjorth": fe01, "fe02_welch_psd": fe02, "fe03_normalised_psd": fe03, "fe04_simpson": fe04, "fe05_relative_power": fe05, "fe06_dominant_frequency": fe06,
    "fe11_bursts": fe11, "fe12_burst_summary": fe12, "fe13_sample_entropy": _entropy("SampEn"), "fe14_permutation_entropy": _entropy("PermEn"), "fe15_lz_complexity": _entropy("LZC"),
    "fe16_hurst": fe16, "fe17_fluctuation_moments": fe17, "fe18_spectrum_width": fe18, "fe19_channel_correlation": fe19,
}


def _welch(size: int, step: int, to: str = "psd") -> str:
    """Table psd (signal_id, bin, f, p) of the long view by a join with the Fourier basis."""
    return f"""
seg AS (SELECT signal_id, k, t - k * {step} AS m, v - avg(v) OVER (PARTITION BY signal_id, k) AS v FROM l JOIN range({1 + (512 - size) // step}) g(k) ON t >= k * {step} AND t < k * {step} + {size}),
win AS (SELECT signal_id, k, m, v * (0.5 - 0.5 * cos(2 * pi() * m / {size})) AS v FROM seg),
basis AS (SELECT m, b, cos(2 * pi() * ((m * b) % {size}) / {size}) AS c, sin(2 * pi() * ((m * b) % {size}) / {size}) AS s FROM range({size}) g(m), range({size // 2 + 1}) h(b)),
dft AS (SELECT signal_id, k, b, sum(v * c) AS re, sum(v * s) AS im FROM win JOIN basis USING (m) GROUP BY ALL),
{to} AS (SELECT signal_id, b AS bin, b * {G.FS} / {size} AS f, avg(re * re + im * im) * CASE WHEN b = 0 OR 2 * b = {size} THEN 1 ELSE 2 END
           / ({G.FS} * (SELECT sum((0.5 - 0.5 * cos(2 * pi() * m / {size})) ** 2) FROM range({size}) g(m))) AS p FROM dft GROUP BY signal_id, b)
"""


WELCH = _welch(SIZE, SIZE - int(SIZE * 0.5))


def simpson_sql(source: str, keys: str, y: str, order: str, step: str) -> str:
    """(keys, area): the integral of y by keys."""
    return f"""
(SELECT {keys}, CASE WHEN max(n) = 1 THEN 0 WHEN max(n) = 2 THEN sum(y) * max(h) / 2 WHEN max(n) % 2 = 1 THEN max(h) / 3 * sum(y * CASE WHEN i IN (1, n) THEN 1 WHEN i % 2 = 0 THEN 4 ELSE 2 END)
   ELSE coalesce(max(h) / 3 * sum(y * CASE WHEN i IN (1, n - 1) THEN 1 WHEN i % 2 = 0 THEN 4 ELSE 2 END) FILTER (i < n), 0) + max(h) * sum(y * CASE n - i WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN -1 ELSE 0 END) / 12 END AS area
 FROM (SELECT {keys}, {y} AS y, {step} AS h, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}) GROUP BY {keys})
"""


_BANDS = "bands(band, lo, hi, last) AS (VALUES " + ", ".join(f"('{n}', {a}, {b}, {str(k == len(E.BANDS) - 1).lower()})" for k, (n, a, b) in enumerate(E.BANDS)) + ")"
_H = f"{G.FS / SIZE!r}"
RELATIVE = f"""
{LONG}, {WELCH}, {_BANDS}, inside AS (SELECT * FROM psd WHERE f >= 0.5 AND f <= 64), total AS {simpson_sql("inside", "signal_id", "p", "f", _H)},
inband AS (SELECT signal_id, band, f, p FROM inside JOIN bands ON f >= lo AND (f < hi OR (last AND f <= hi))), part AS {simpson_sql("inband", "signal_id, band", "p", "f", _H)},
rel AS (SELECT t.signal_id, b.band, coalesce(part.area / t.area, 0) AS rel_power FROM total t CROSS JOIN bands b LEFT JOIN part ON part.signal_id = t.signal_id AND part.band = b.band)
"""
RUNS = f"""
{LONG}, e AS (SELECT signal_id, role, t, abs(v) AS v FROM l), lim AS (SELECT signal_id, quantile_cont(v, 0.6) AS q FROM e GROUP BY 1),
ab AS (SELECT signal_id, role, t, v, t - row_number() OVER (PARTITION BY signal_id ORDER BY t) AS g FROM e JOIN lim USING (signal_id) WHERE v >= q),
runs AS (SELECT signal_id, role, min(t) AS a, max(t) AS z, max(v) AS pk, arg_min(t, (-v, t)) AS pt FROM ab GROUP BY signal_id, role, g HAVING count(*) >= 2),
mg AS (SELECT *, sum(nw) OVER (PARTITION BY signal_id ORDER BY a) AS burst FROM (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY signal_id ORDER BY a) - 1 <= 2 THEN 0 ELSE 1 END AS nw FROM runs)),
bu AS (SELECT signal_id, role, min(a) AS start, max(z) AS "end", max(pk) AS peak, arg_min(pt, (-pk, pt)) AS peak_t, (max(z) - min(a) + 1) / {G.FS} AS duration_s FROM mg GROUP BY signal_id, role, burst)
"""
_SCALES = ", ".join(f"({n})" for n in SIZES)
FLUCT = f"""
{LONG}, prof AS (SELECT signal_id, t, sum(v - m) OVER (PARTITION BY signal_id ORDER BY t) AS y FROM (SELECT *, avg(v) OVER (PARTITION BY signal_id) AS m FROM l)),
sc(n) AS (VALUES {_SCALES}), wi AS (SELECT signal_id, n, t // n AS w, t, y FROM prof, sc WHERE t // n < 512 // n),
f2 AS (SELECT signal_id, n, w, abs(var_pop(y) - covar_pop(t, y) ** 2 / var_pop(t)) AS f2 FROM wi GROUP BY ALL),
fq AS (SELECT signal_id, n, q0::DOUBLE AS q, avg(f2 ** (q0 / 2.0)) ** (1.0 / max(q0)) AS fq FROM f2, (VALUES (-3), (-2), (-1), (1), (2), (3)) v(q0) WHERE f2 > 0 GROUP BY signal_id, n, q0),
hq AS (SELECT signal_id, q, CASE WHEN count(*) >= 4 THEN regr_slope(ln(fq), ln(n)) END AS h FROM fq GROUP BY ALL)
"""

SQL = {
    "fe01_hjorth": f"""WITH {S}, d AS (SELECT signal_id, role, v, v - lag(v) OVER w AS d1, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d2 FROM s WINDOW w AS (PARTITION BY signal_id ORDER BY t)),
      h AS (SELECT signal_id, role, var_pop(v) AS a, stddev_pop(v) AS s0, stddev_pop(d1) AS s1, stddev_pop(d2) AS s2 FROM d GROUP BY ALL)
      SELECT signal_id, role, {r("a", "activity")}, {r("s1 / (s0 + 1e-9)", "mobility")}, {r("(s2 / (s1 + 1e-9)) / (s1 / (s0 + 1e-9) + 1e-9)", "complexity")} FROM h""",
    "fe02_welch_psd": f"WITH {LONG}, {WELCH} SELECT signal_id, bin::BIGINT AS bin, {r('f', 'f')}, {r('p * 1000', 'milli_pxx')} FROM psd",
    "fe03_normalised_psd": f"WITH {LONG}, {_welch(512, 256)}, i AS (SELECT * FROM psd WHERE f >= 0.5 AND f <= 64), a AS {simpson_sql('i', 'signal_id', 'p', 'f', '0.25')} SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY f) - 1 AS k, {r('p / area', 'p')} FROM i JOIN a USING (signal_id)",
    "fe04_simpson": "WITH " + S + "".join(f", a{n} AS {simpson_sql(f'(SELECT * FROM s WHERE t < {n})', 'signal_id', 'v', 't', '0.5')}" for n in (64, 63, 2, 1)) + " SELECT signal_id, " + ", ".join(r(f"a{n}.area", f"n{n}") for n in (64, 63, 2, 1)) + " FROM a64 JOIN a63 USING (signal_id) JOIN a2 USING (signal_id) JOIN a1 USING (signal_id)",
    "fe05_relative_power": f"WITH {RELATIVE} SELECT signal_id, band, {r('rel_power', 'rel_power')} FROM rel",
    "fe06_dominant_frequency": f"WITH {LONG}, {WELCH} SELECT signal_id, {r('f', 'f')} FROM psd WHERE f >= 0.5 AND f <= 64 QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY p DESC, f) = 1",
    "fe11_bursts": f'WITH {RUNS} SELECT signal_id, start, "end", peak_t, {r("peak", "peak")}, {r("duration_s", "duration_s")} FROM bu',
    "fe12_burst_summary": f"""WITH {RUNS}, ib AS (SELECT *, (start - lag(start) OVER (PARTITION BY signal_id ORDER BY start)) / {G.FS} AS ibi FROM bu),
      a AS (SELECT signal_id, count(*) AS n, avg(duration_s) AS md, median(duration_s) AS dd, avg(peak) AS mp, median(peak) AS dp, avg(ibi) AS mi, median(ibi) AS di, sum(duration_s) AS busy FROM ib GROUP BY 1)
      SELECT signal_id, coalesce(n, 0)::BIGINT AS n_bursts, {r("coalesce(n / 4.0, 0)", "rate_hz")}, {r("coalesce(md, 0)", "mean_duration")}, {r("coalesce(dd, 0)", "median_duration")}, {r("coalesce(mp, 0)", "mean_peak")},
             {r("coalesce(dp, 0)", "median_peak")}, {r("mi", "mean_ibi")}, {r("di", "median_ibi")}, {r("coalesce(busy / 4.0, 0)", "duty_cycle")} FROM lng LEFT JOIN a USING (signal_id)""",
    "fe15_lz_complexity": f"""WITH RECURSIVE {S}, md AS (SELECT signal_id, median(v) AS m, count(*) AS n FROM s GROUP BY 1),
      st AS (SELECT signal_id, n, string_agg(CASE WHEN v > m THEN '1' ELSE '0' END, '' ORDER BY t) AS b FROM s JOIN md USING (signal_id) GROUP BY ALL),
      w(signal_id, n, b, pos, size, words) AS (SELECT signal_id, n, b, 0, 1, 0 FROM st UNION ALL
        SELECT signal_id, n, b, CASE WHEN old THEN pos ELSE pos + size END, CASE WHEN old THEN size + 1 ELSE 1 END, words + CASE WHEN old THEN 0 ELSE 1 END
        FROM (SELECT *, contains(b[1:pos + size - 1], b[pos + 1:pos + size]) AS old FROM w WHERE pos + size <= n))
      SELECT signal_id, {r("(max(words) + max(CASE WHEN pos < n AND pos + size > n THEN 1 ELSE 0 END)) * log2(max(n)) / max(n)", "value")} FROM w GROUP BY signal_id""",
    "fe13_sample_entropy": f"""WITH {S}, sd AS (SELECT signal_id, 0.2 * (stddev_pop(v) + 1e-12) AS r FROM s GROUP BY 1), tp AS (SELECT signal_id, t, v AS a, lead(v) OVER w AS b, lead(v, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY signal_id ORDER BY t)),
      m AS (SELECT x.signal_id, count(*) FILTER (x.b IS NOT NULL AND y.b IS NOT NULL AND abs(x.a - y.a) <= r AND abs(x.b - y.b) <= r) AS m2,
                   count(*) FILTER (x.c IS NOT NULL AND y.c IS NOT NULL AND abs(x.a - y.a) <= r AND abs(x.b - y.b) <= r AND abs(x.c - y.c) <= r) AS m3 FROM tp x JOIN tp y ON x.signal_id = y.signal_id AND x.t <> y.t JOIN sd ON sd.signal_id = x.signal_id GROUP BY 1)
      SELECT signal_id, {r("CASE WHEN m3 > 0 AND m2 > 0 THEN -ln((m3 / (62.0 * 61)) / (m2 / (63.0 * 62))) END", "value")} FROM m""",
    "fe14_permutation_entropy": f"""WITH {S}, p AS (SELECT signal_id, v AS a, lead(v) OVER w AS b, lead(v, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY signal_id ORDER BY t)),
      k AS (SELECT signal_id, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY signal_id, a > b, a > c, b > c)
      SELECT signal_id, {r("sum(-(n / 62.0) * ln(n / 62.0 + 1e-12)) / ln(6)", "value")} FROM k GROUP BY signal_id""",
    "fe16_hurst": f"WITH {FLUCT} SELECT signal_id, q, {r('h', 'h')} FROM hq",
    "fe17_fluctuation_moments": f"WITH {FLUCT} SELECT signal_id, n::BIGINT AS n, q, {r('fq', 'fq')} FROM fq",
    "fe18_spectrum_width": f"""WITH {FLUCT}, n AS (SELECT *, lag(h) OVER w AS hl, lead(h) OVER w AS hr, q - lag(q) OVER w AS dl, lead(q) OVER w - q AS dr FROM hq WINDOW w AS (PARTITION BY signal_id ORDER BY q)),
      al AS (SELECT signal_id, h + q * CASE WHEN dl IS NULL THEN (hr - h) / dr WHEN dr IS NULL THEN (h - hl) / dl ELSE (dl * dl * hr - dr * dr * hl + (dr * dr - dl * dl) * h) / (dl * dr * (dl + dr)) END AS alpha FROM n)
      SELECT signal_id, {r("max(alpha) - min(alpha)", "delta_alpha")} FROM al GROUP BY signal_id""",
    "fe19_channel_correlation": f"WITH {CHAN} SELECT a.sample_id, a.channel AS c1, b.channel AS c2, {r('corr(a.v, b.v)', 'rho')} FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.t = b.t AND a.channel < b.channel GROUP BY ALL",
}


def unrounded(sql: str) -> str:
    """A twin's statement with `value` as it is before rounding."""
    return re.sub(r"round\(CASE WHEN isfinite\((.*)\) THEN \1 END, 6\) \+ 0\.0 AS value", r"CASE WHEN isfinite(\1) THEN \1 END AS value", sql, flags=re.DOTALL)


#: CTE el (role, idx, feature, value): the three entropies of every signal.
ENTROPIES = f"""{SIG}, en AS ({" UNION ALL ".join(f"SELECT '{name}' AS feature, signal_id, value FROM ({unrounded(SQL[key])})" for name, key in (("SampEn", "fe13_sample_entropy"), ("PermEn", "fe14_permutation_entropy"), ("LZC", "fe15_lz_complexity")))}),
el AS (SELECT role, idx, feature, round(value, 9) AS value FROM en JOIN sig USING (signal_id))"""
