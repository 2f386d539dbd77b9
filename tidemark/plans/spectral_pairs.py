"""Queries of pair metrics on spectra, scalograms and fluctuations, and of the scores that rest on them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions import stats
from tidemark.functions.scratch import stored
from tidemark.operators import features as E
from tidemark.operators import measures as M
from tidemark.operators import pairs as P
from tidemark.operators import spectral_pairs as X
from tidemark.operators import transforms as T
from tidemark.plans.features import BURST_FEATURES, CONFIG, ENTROPIES, QS, SIZES, _welch
from tidemark.plans.sql import LONG, S, r, w1
from tidemark.sources import signals as G

N = 512
FREQS = T.frequency_grid(1.0, 50.0, 20)
ENTROPY = ["SampEn", "PermEn", "LZC"]


def _idx(spark, d):
    return P.indexed(G.long_view(spark, d))


def _round(df, *keys):
    return df.select(*(F.col(k) for k in keys), *(A.r6(c).alias(c) for c in df.columns if c not in keys))


def pm01(spark, d):
    return _round(X.coherence(_idx(spark, d), CONFIG, ("RS",)), "pair_set", "i", "j", "band")


def pm02(spark, d):
    """Mean and deviation of the coherence by set and band, with the effect of RR over RS."""
    out = X.coherence_compared(_idx(spark, d), CONFIG)
    return _round(out.select("pair_set", "band", "n", "mean", "sd", F.col("delta").alias("delta_rr_rs")), "pair_set", "band", "n")


def _p(found):
    return found.withColumn("p", stats.p_of_u(F.col("u"), F.col("n1"), F.col("n2"), F.col("ties"))).drop("n1", "n2", "ties")


def pm02_tests(spark, d):
    """The Mann-Whitney test of RR against RS by band, over all pairs."""
    return _round(_p(X.coherence_compared(_idx(spark, d), CONFIG)).where("pair_set = 'RS'").select("band", "u", "delta", "p"), "band")


def pm02_zip(spark, d):
    """Coherence of pairs by position: mean and deviation by set and band, and the effect of RR over RS."""
    out = X.compare_pair_sets(X.coherence_by_position(_idx(spark, d), CONFIG), "band", "coherence")
    return _round(out.select("pair_set", "band", "n", "mean", "sd", "u", F.col("delta").alias("delta_rr_rs")), "pair_set", "band", "n")


def pm08_all(spark, d):
    """Similarities of all pairs of scalograms: mean and deviation by set, and RR against RS by Mann-Whitney and Cliff's delta."""
    return _round(_p(X.similarity_compared(_idx(spark, d), G.FS, FREQS)), "metric", "pair_set", "n")


def _entropy_pairs(spark, d):
    e = E.entropies(P.indexed(G.short(spark, d)), ("role", "idx"))
    rows = stored(e.select("role", F.inline(F.array(*(F.struct(F.lit(c).alias("statistic"), F.round(c, 9).alias("value")) for c in ENTROPY)))), "entropies")
    return _p(X.differences_compared(rows, ENTROPY))


def pm13_three(spark, d):
    """Absolute differences of all three entropies between signals: mean and deviation by set, and RR against RS."""
    return _round(_entropy_pairs(spark, d).drop("p"), "statistic", "pair_set", "n")


def pm13_tests(spark, d):
    """The Mann-Whitney test of RR against RS on those differences."""
    return _round(_entropy_pairs(spark, d).where("pair_set = 'RS'").select("statistic", "p"), "statistic")


def ag31_tests(spark, d):
    """The report of the entropies: Mann-Whitney between the roles, and how far real signals lie from their surrogates."""
    found = stats.compare(_entropies(spark, d), ["feature"])
    p = found.select("feature", "u", "delta", stats.p_of_u(F.col("u"), F.col("n1"), F.col("n2"), F.col("ties")).alias("p"))
    z = X.surrogate_z(G.short(spark, d)).select(F.col("statistic").alias("feature"), F.col("z").alias("surrogate_z"))
    return _round(p.join(z, "feature", "left"), "feature")


def pm15(spark, d):
    """The similarity in colour of the mean scalograms of both roles."""
    return _round(X.mean_scalogram_similarity(X.mean_scalogram(_images(spark, d), N, G.FS, FREQS), len(FREQS)))


def pm04(spark, d):
    return _round(X.spectral_wasserstein(_idx(spark, d), CONFIG, N), "band")


def _images(spark, d):
    return X.scalograms(_idx(spark, d), G.FS, FREQS)


def fe07(spark, d):
    return _images(spark, d).select("role", F.col("idx").cast("long").alias("idx"), F.size("x").alias("n"), A.r6(A.mean(F.col("x"))).alias("mean"), A.r6(F.array_max("x")).alias("peak"))


def fe09(spark, d):
    return _round(X.mean_scalogram(_images(spark, d), N, G.FS, FREQS), "role")


def fe10(spark, d):
    """The envelope of 13 to 30 Hz: the band's mean amplitude over its median, smoothed over 20 ms."""
    points = X.band_envelope(_idx(spark, d), FREQS, G.FS).select("role", "idx", F.posexplode("x").alias("t", "v"))
    return points.select("role", "idx", "t", A.r6("v").alias("v"))


def ag32_envelope(spark, d):
    """Burst features on the envelope of 13 to 30 Hz: means by role, spread, Wasserstein distance over the real deviation."""
    own = stored(X.band_envelope(_idx(spark, d), FREQS, G.FS), "envelopes")  # limits, runs and spans read it
    e = own.select((2 * F.col("idx") + F.when(F.col("role") == "real", 0).otherwise(1)).alias("signal_id"), "role", F.posexplode("x").alias("t", "v"))
    f = M.unpivoted(E.burst_summary(E.bursts(e, G.FS), e, G.FS), ("n_bursts", *BURST_FEATURES))
    own = stats.summary(f, ["feature"]).join(stats.robust_sd(f.where(A.finite(F.col("value"))), ["feature", "role"]).withColumnRenamed("sd", "robust"), ["feature", "role"], "left")
    wide = own.groupBy("feature").agg(*(F.max(F.when(F.col("role") == g, F.col(c))).alias(f"{g}_{c}") for g in ("real", "synthetic") for c in ("n", "mean", "sd", "robust")))
    both = wide.join(stats.compare(f, ["feature"]).select("feature", "w1"), "feature")
    return _round(both.withColumn("wd_norm", F.col("w1") / (F.col("real_sd") + 1e-12)).drop("w1"), "feature", "real_n", "synthetic_n")


def pm05(spark, d):
    return _round(X.scalogram_similarity(_idx(spark, d), G.FS, FREQS, ("RS",)), "pair_set", "i", "j")


def sc07(spark, d):
    """The mean over pairs of 0.4 SSIM + 0.3 / (1 + NRMSE) + 0.3 cosine."""
    return _round(X.time_frequency_score(_idx(spark, d), G.FS, FREQS))


def _cross(spark, d, *columns, sets=("RR", "RS", "SS")):
    return X.mean_fluctuations(_idx(spark, d), SIZES, QS, N, sets, columns)


def pm10(spark, d):
    return _round(_cross(spark, d, "rho", "h").select("pair_set", "rho", "rho_sd", "h", "h_sd"), "pair_set")


def pm10_pairs(spark, d):
    return _round(X.cross_fluctuations(_idx(spark, d), SIZES, QS, N, ("RS",), ("rho", "h")).select("i", "j", "rho", "h"), "i", "j")


def pm11(spark, d):
    return _round(_cross(spark, d, "hq", "p", "delta_alpha"), "pair_set")


def _entropies(spark, d):
    """Rounded, so that equal entropies are equal in whatever order their terms were added."""
    own = E.entropies(P.indexed(G.short(spark, d)), ("role", "idx"))
    return M.unpivoted(own, ("SampEn", "PermEn", "LZC")).withColumn("value", F.round("value", 9))


def ag31(spark, d):
    """Entropies of both roles: means, Wasserstein distance, also over the real deviation, Cliff's delta."""
    long = _entropies(spark, d)
    by = long.groupBy("feature").agg(*(F.avg(F.when(F.col("role") == g, F.col("value"))).alias(f"{g}_mean") for g in ("real", "synthetic")), F.stddev_pop(F.when(F.col("role") == "real", F.col("value"))).alias("sd"))
    both = by.join(stats.compare(long, ["feature"]), "feature")
    return _round(both.select("feature", "real_mean", "synthetic_mean", "w1", (F.col("w1") / F.nullif(F.col("sd"), F.lit(0.0))).alias("w1_norm"), "delta"), "feature")


def pm13(spark, d):
    """Mean absolute difference of permutation entropies by set."""
    e = E.entropies(P.indexed(G.short(spark, d)), ("role", "idx")).select("role", F.col("PermEn").alias("value"))
    return _round(X.mean_differences(e), "pair_set", "n")


def fe22(spark, d):
    return _round(X.surrogate_z(G.short(spark, d)), "statistic")


def _near(x: float, y: float, span: float) -> float:
    return 1 - min(abs(x - y), span) / span


def sc08(spark, d):
    """The complexity score: exponents of cross-correlation, fluctuations and multifractal cross-correlation, and entropies."""
    c = {r["pair_set"]: r for r in _cross(spark, d, "h", "hq", "delta_alpha", sets=("RR", "RS")).collect()}
    w = {r["feature"]: r["w1_norm"] for r in ag31(spark, d).collect()}
    own = E.hurst(E.fluctuations(G.samples(G.long_view(spark, d).withColumn("x", T.profile(F.col("x"))), "signal_id", "role").withColumnRenamed("v", "y"), ["signal_id", "role"], SIZES), ["signal_id", "role"], QS)[1]
    gaps = [r["real"] - r["synthetic"] for r in own.groupBy("q").agg(*(F.avg(F.when(F.col("role") == g, F.col("h"))).alias(g) for g in ("real", "synthetic"))).collect()]
    spectrum = math.exp(-math.sqrt(sum(g * g for g in gaps) / len(gaps)) / 0.15)
    parts = {
        "dcca": _near(c["RS"]["h"], c["RR"]["h"], 0.9),
        "mfdfa": 0.5 * _near(sum(gaps) / len(gaps), 0.0, 0.9) + 0.5 * spectrum,
        "mfdcca": 0.7 * _near(c["RS"]["hq"], c["RR"]["hq"], 0.9) + 0.3 * _near(c["RS"]["delta_alpha"], c["RR"]["delta_alpha"], 0.5),
    } | {k: 1 / (1 + v) for k, v in w.items() if v is not None}
    rows = spark.createDataFrame([(k, float(v), 1.0) for k, v in parts.items()], "component string, value double, weight double")
    return _round(rows.select("component", "value").unionByName(M.geometric_mean(rows).select(F.lit("score").alias("component"), F.col("score").alias("value"))), "component")


def sc05(spark, d):
    """The frequency score: bands, dominant frequency, coherence, spectral distance."""
    s = _idx(spark, d).persist()
    p = E.psd(s, CONFIG).persist()
    five = [b[0] for b in E.BANDS[:5]]
    by = E.band_power(p, CONFIG).where(F.col("band").isin(five)).groupBy("band").agg(*(F.avg(F.when(F.col("role") == g, F.col("rel_power"))).alias(g) for g in ("real", "synthetic")))
    band = by.agg(F.avg(F.abs(F.col("real") - F.col("synthetic")) * 100)).first()[0]
    f = E.dominant_frequency(p, CONFIG).groupBy("role").agg(F.avg("f").alias("f")).collect()
    f = {r["role"]: r["f"] for r in f}
    coh = X.mean_coherence(s, CONFIG).first()["mean"]
    wd = X.spectral_wasserstein(s, CONFIG, N).where("band = 'Global'").first()["wd_hz"]
    score = 0.4 * max(0.2, 1 - band / 20) + 0.2 * max(0.2, 1 - abs(f["real"] - f["synthetic"]) / 3) + 0.2 * min(max(coh, 0), 1) + 0.2 / (1 + wd)
    return _round(spark.createDataFrame([(score,)], "score double"))


def sc10(spark, d):
    """The geometric mean of the five domains' scores."""
    time = M.time_score(M.hjorth_metrics(G.short(spark, d))).first()["score"]
    space = M.spatial(G.channels(spark, d)).first()["f_spatial"]
    parts = {"time": time, "frequency": sc05(spark, d).first()["score"], "time_frequency": sc07(spark, d).first()["score"], "complexity": sc08(spark, d).where("component = 'score'").first()["value"], "spatial": min(max(space, 0.0), 1.0)}
    rows = spark.createDataFrame([(k, float(v), 0.2) for k, v in parts.items()], "component string, value double, weight double")
    return _round(rows.select("component", "value").unionByName(M.geometric_mean(rows).select(F.lit("score").alias("component"), F.col("score").alias("value"))), "component")


def pl01(spark, d):
    """Histograms of the Hjorth parameters: twenty bins over the range of both roles."""
    long = M.unpivoted(M.hjorth_features(G.short(spark, d)), M.HJORTH)
    span = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bins = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20), F.lit(19)).cast("long")
    return long.join(span, "feature").groupBy("feature", "role", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pl02(spark, d):
    """The mean spectrum by role."""
    p = E.psd(G.long_view(spark, d), CONFIG).select("role", F.inline(F.arrays_zip("f", "p")))
    return p.groupBy("role", A.r6("f").alias("f")).agg(A.r6(F.avg("p") * 1000).alias("milli_pxx"))


QUERIES = {
    "pm01_coherence_pairs": pm01, "pm02_coherence": pm02, "pm04_spectral_wasserstein": pm04, "fe07_scalogram": fe07, "fe09_mean_scalogram": fe09, "fe10_band_envelope": fe10, "pm05_scalogram_similarity": pm05,
    "pm10_dcca": pm10, "pm10_dcca_pairs": pm10_pairs, "pm11_mfdcca": pm11, "pm13_entropy_differences": pm13, "fe22_surrogate_z": fe22, "ag31_entropy_metrics": ag31,
    "pm15_mean_scalogram_colours": pm15, "pm02_coherence_tests": pm02_tests, "pm02_coherence_by_position": pm02_zip, "pm08_scalograms_all": pm08_all, "pm13_three_entropies": pm13_three, "pm13_entropy_tests": pm13_tests, "ag31_entropy_tests": ag31_tests, "ag32_envelope_bursts": ag32_envelope,
    "sc05_frequency_score": sc05, "sc07_time_frequency_score": sc07, "sc08_complexity_score": sc08, "sc10_fidelity_score": sc10, "pl01_hjorth_histogram": pl01, "pl02_mean_psd": pl02,
}

_C = CONFIG.coherence_segment(N)
_STEP = _C - int(_C * 0.5)
_SPECTRA = _welch(_C, _STEP).split("psd AS (SELECT")[0].rstrip().rstrip(",")
_BANDS = ", ".join(f"('{n}', {a}, {b}, {str(b >= CONFIG.band[1]).lower()})" for n, a, b in X.coherence_bands(CONFIG))
_INSIDE = ", ".join(f"('{n}', {max(0, math.ceil(a * N / G.FS))}, {math.floor(b * N / G.FS)})" for n, a, b in X.coherence_bands(CONFIG) if math.floor(b * N / G.FS) > max(0, math.ceil(a * N / G.FS)))


def _coherence(pairs: str) -> str:
    """CTEs up to a (pair_set, i, j, band, coherence) of the pairs that the condition on x and y chooses."""
    return f"""{LONG}, {_SPECTRA}, sp AS (SELECT role, idx, k, b, re, im FROM dft JOIN lng USING (signal_id)), co AS (
      SELECT CASE WHEN x.role <> y.role THEN 'RS' WHEN x.role = 'real' THEN 'RR' ELSE 'SS' END AS pair_set, x.idx AS i, y.idx AS j, x.b, (sum(x.re * y.re + x.im * y.im) ** 2 + sum(x.re * y.im - x.im * y.re) ** 2) / nullif(sum(x.re ** 2 + x.im ** 2) * sum(y.re ** 2 + y.im ** 2), 0) AS c
      FROM sp x JOIN sp y ON ({pairs}) AND x.k = y.k AND x.b = y.b GROUP BY ALL),
      bd(band, lo, hi, last) AS (VALUES {_BANDS}), ib AS (SELECT pair_set, i, j, band, lo, hi, b, coalesce(c, 0) AS c FROM co JOIN bd ON b * {G.FS} / {_C} >= lo AND (b * {G.FS} / {_C} < hi OR (last AND b * {G.FS} / {_C} <= hi))),
      n AS (SELECT *, row_number() OVER (PARTITION BY pair_set, i, j, band ORDER BY b) AS p, count(*) OVER (PARTITION BY pair_set, i, j, band) AS m FROM ib),
      a AS (SELECT pair_set, i, j, band, {G.FS / _C!r} / (max(hi) - max(lo)) * CASE WHEN max(m) = 1 THEN 0 WHEN max(m) = 2 THEN sum(c) / 2 WHEN max(m) % 2 = 1 THEN sum(c * CASE WHEN p IN (1, m) THEN 1 WHEN p % 2 = 0 THEN 4 ELSE 2 END) / 3
        ELSE coalesce(sum(c * CASE WHEN p IN (1, m - 1) THEN 1 WHEN p % 2 = 0 THEN 4 ELSE 2 END) FILTER (p < m), 0) / 3 + sum(c * CASE m - p WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN -1 ELSE 0 END) / 12 END AS coherence FROM n GROUP BY pair_set, i, j, band)"""


def _coherence_summary(pairs: str, more: str) -> str:
    return f"""WITH {_coherence(pairs)}, ef AS (SELECT x.band, avg(sign(x.coherence - y.coherence)) AS delta, sum((sign(x.coherence - y.coherence) + 1) / 2) AS u FROM a x JOIN a y ON x.band = y.band AND x.pair_set = 'RR' AND y.pair_set = 'RS' GROUP BY 1)
      SELECT pair_set, band, count(*) AS n, {r("avg(coherence)", "mean")}, {r("stddev_samp(coherence)", "sd")}, {r("max(delta)", "delta_rr_rs")}{more} FROM a LEFT JOIN ef USING (band) GROUP BY pair_set, band"""


SQL = {
    "pm01_coherence_pairs": f"WITH {_coherence("x.role = 'real' AND y.role = 'synthetic'")} SELECT pair_set, i, j, band, {r('coherence', 'coherence')} FROM a",
    "pm02_coherence": _coherence_summary("(x.role = 'real' AND y.role = 'synthetic') OR (x.role = y.role AND x.idx < y.idx)", ""),
    "pm02_coherence_by_position": _coherence_summary("x.idx = y.idx AND x.role = 'real' AND y.role = 'synthetic' OR x.role = y.role AND x.idx % 2 = 0 AND y.idx = x.idx + 1", f", {r('max(u)', 'u')}"),
    "pm04_spectral_wasserstein": f"""WITH {LONG}, {_welch(N, N // 2)}, pp AS (SELECT role, idx, bin, p FROM psd JOIN lng USING (signal_id)), bd(band, lo, hi) AS (VALUES {_INSIDE}),
      sh AS (SELECT role, idx, band, bin, p / sum(p) OVER (PARTITION BY role, idx, band) AS s FROM pp JOIN bd ON bin BETWEEN lo AND hi),
      pr AS (SELECT CASE WHEN y.role = 'real' THEN 'RR' ELSE 'RS' END AS ps, x.idx, band, bin, x.s - y.s AS e FROM sh x JOIN sh y USING (band, bin) WHERE x.role = 'real' AND ((y.role = 'synthetic' AND y.idx = x.idx) OR (y.role = 'real' AND y.idx = x.idx + 1))),
      d AS (SELECT ps, idx, band, sum(abs(c)) * {G.FS / N!r} AS d FROM (SELECT *, sum(e) OVER (PARTITION BY ps, idx, band ORDER BY bin) AS c FROM pr) GROUP BY ALL)
      SELECT band, {r("avg(d) FILTER (ps = 'RS')", "wd_hz")}, {r("CASE WHEN count(*) FILTER (ps = 'RR') >= 5 THEN (avg(d) FILTER (ps = 'RS') - avg(d) FILTER (ps = 'RR')) / nullif(stddev_samp(d) FILTER (ps = 'RR'), 0) END", "z_wd")} FROM d GROUP BY band""",
    "pm10_dcca": f"""WITH {LONG}, pf AS (SELECT role, idx, t, sum(v - m) OVER (PARTITION BY role, idx ORDER BY t) AS y FROM (SELECT *, avg(v) OVER (PARTITION BY signal_id) AS m FROM l)),
      sc(n) AS (VALUES {", ".join(f"({n})" for n in SIZES)}), wi AS (SELECT role, idx, n, t // n AS w, t, y FROM pf, sc WHERE t // n < {N} // n),
      ln AS (SELECT role, idx, n, w, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM wi GROUP BY ALL),
      rs AS (SELECT role, idx, n, t, y - a - b * t AS e FROM wi JOIN ln USING (role, idx, n, w)),
      f1 AS (SELECT role, idx, n, avg(e * e) AS f FROM rs GROUP BY ALL),
      f2 AS (SELECT CASE WHEN x.role <> y.role THEN 'RS' WHEN x.role = 'real' THEN 'RR' ELSE 'SS' END AS pair_set, x.role AS ra, y.role AS rb, x.idx AS i, y.idx AS j, n, avg(x.e * y.e) AS f FROM rs x JOIN rs y USING (n, t) WHERE (x.role = 'real' AND y.role = 'synthetic') OR (x.role = y.role AND x.idx < y.idx) GROUP BY ALL),
      o AS (SELECT f2.pair_set, f2.i, f2.j, f2.n, f2.f, f2.f / sqrt(p.f * q.f) AS rho FROM f2 JOIN f1 p ON p.role = f2.ra AND p.idx = f2.i AND p.n = f2.n JOIN f1 q ON q.role = f2.rb AND q.idx = f2.j AND q.n = f2.n),
      e AS (SELECT pair_set, i, j, tanh(avg(atanh(least(greatest(rho, -0.999999), 0.999999)))) AS rho, regr_slope(0.5 * ln(abs(f)), ln(n)) AS h FROM o GROUP BY ALL)
      SELECT pair_set, {r("avg(rho)", "rho")}, {r("stddev_pop(rho)", "rho_sd")}, {r("avg(h)", "h")}, {r("stddev_pop(h)", "h_sd")} FROM e GROUP BY pair_set""",
    "pm10_dcca_pairs": f"""WITH {LONG}, pf AS (SELECT role, idx, t, sum(v - m) OVER (PARTITION BY role, idx ORDER BY t) AS y FROM (SELECT *, avg(v) OVER (PARTITION BY signal_id) AS m FROM l)),
      sc(n) AS (VALUES {", ".join(f"({n})" for n in SIZES)}), wi AS (SELECT role, idx, n, t // n AS w, t, y FROM pf, sc WHERE t // n < {N} // n),
      ln AS (SELECT role, idx, n, w, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM wi GROUP BY ALL),
      rs AS (SELECT role, idx, n, t, y - a - b * t AS e FROM wi JOIN ln USING (role, idx, n, w)),
      f1 AS (SELECT role, idx, n, avg(e * e) AS f FROM rs GROUP BY ALL),
      f2 AS (SELECT x.idx AS i, y.idx AS j, n, avg(x.e * y.e) AS f FROM rs x JOIN rs y USING (n, t) WHERE x.role = 'real' AND y.role = 'synthetic' GROUP BY ALL),
      o AS (SELECT f2.i, f2.j, f2.n, f2.f, f2.f / sqrt(p.f * q.f) AS rho FROM f2 JOIN f1 p ON p.role = 'real' AND p.idx = f2.i AND p.n = f2.n JOIN f1 q ON q.role = 'synthetic' AND q.idx = f2.j AND q.n = f2.n)
      SELECT i, j, {r("tanh(avg(atanh(least(greatest(rho, -0.999999), 0.999999))))", "rho")}, {r("regr_slope(0.5 * ln(abs(f)), ln(n))", "h")} FROM o GROUP BY i, j""",
    "ag31_entropy_metrics": f"""WITH {ENTROPIES}, {w1("el", "feature")}, m AS (SELECT feature, avg(value) FILTER (role = 'real') AS rm, avg(value) FILTER (role = 'synthetic') AS sm, stddev_pop(value) FILTER (role = 'real') AS sd FROM el GROUP BY 1)
      SELECT feature, {r("rm", "real_mean")}, {r("sm", "synthetic_mean")}, {r("w1", "w1")}, {r("w1 / nullif(sd, 0)", "w1_norm")}, {r("delta", "delta")} FROM cmp JOIN m USING (feature)""",
    "pm13_three_entropies": f"""WITH {ENTROPIES}, ds AS (SELECT x.feature AS statistic, CASE WHEN x.role <> y.role THEN 'RS' WHEN x.role = 'real' THEN 'RR' ELSE 'SS' END AS pair_set, abs(x.value - y.value) AS value
        FROM el x JOIN el y ON x.feature = y.feature AND ((x.role = 'real' AND y.role = 'synthetic') OR (x.role = y.role AND x.idx < y.idx)) WHERE x.value IS NOT NULL AND y.value IS NOT NULL),
      rs AS (SELECT statistic, CASE pair_set WHEN 'RR' THEN 'real' ELSE 'synthetic' END AS role, round(value, 12) AS value FROM ds WHERE pair_set <> 'SS'), {w1("rs", "statistic")}
      SELECT statistic, pair_set, count(*) AS n, {r("avg(value)", "mean")}, {r("stddev_samp(value)", "sd")}, {r("max(u)", "u")}, {r("max(delta)", "delta")} FROM ds LEFT JOIN cmp USING (statistic) GROUP BY statistic, pair_set""",
    "pm13_entropy_differences": f"""WITH {S}, p AS (SELECT signal_id, role, idx, v AS a, lead(v) OVER w AS b, lead(v, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY signal_id ORDER BY t)),
      k AS (SELECT signal_id, role, idx, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY signal_id, role, idx, a > b, a > c, b > c),
      e AS (SELECT role, idx, sum(-(n / 62.0) * ln(n / 62.0 + 1e-12)) / ln(6) AS v FROM k GROUP BY role, idx),
      d AS (SELECT CASE WHEN x.role <> y.role THEN 'RS' WHEN x.role = 'real' THEN 'RR' ELSE 'SS' END AS pair_set, abs(x.v - y.v) AS d FROM e x JOIN e y ON (x.role = 'real' AND y.role = 'synthetic') OR (x.role = y.role AND x.idx < y.idx))
      SELECT pair_set, count(*) AS n, {r("avg(d)", "mean")} FROM d GROUP BY pair_set""",
    "pl02_mean_psd": f"WITH {LONG}, {_welch(CONFIG.segment(N), CONFIG.segment(N) - int(CONFIG.segment(N) * 0.5))} SELECT role, {r('f', 'f')}, {r('avg(p) * 1000', 'milli_pxx')} FROM psd JOIN lng USING (signal_id) GROUP BY role, f",
    "pl01_hjorth_histogram": f"""WITH {S}, d AS (SELECT signal_id, role, v, v - lag(v) OVER w AS d1, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d2 FROM s WINDOW w AS (PARTITION BY signal_id ORDER BY t)),
      h0 AS (SELECT signal_id, role, stddev_pop(v) AS s0, stddev_pop(d1) AS s1, stddev_pop(d2) AS s2 FROM d GROUP BY ALL), hj AS (SELECT role, s0 * s0 AS activity, s1 / (s0 + 1e-9) AS mobility, (s2 / (s1 + 1e-9)) / (s1 / (s0 + 1e-9) + 1e-9) AS complexity FROM h0),
      hl AS (SELECT role, feature, value FROM hj UNPIVOT (value FOR feature IN (activity, mobility, complexity))), sp AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM hl GROUP BY 1)
      SELECT feature, role, least(floor((value - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, count(*) AS n FROM hl JOIN sp USING (feature) GROUP BY ALL""",
}
