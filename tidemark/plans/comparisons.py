"""Queries that compare whole sets of signals: band power, fractal spectra, privacy, splits, sampled pairs, chart rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions import stats
from tidemark.functions.density import kernel_density, plane_density
from tidemark.operators import features as E
from tidemark.operators import measures as M
from tidemark.operators import pairs as P
from tidemark.operators import spectral_pairs as X
from tidemark.operators import transforms as T
from tidemark.operators.neighbours import fuzzy_graph, nearest_k, plane
from tidemark.plans.features import CONFIG, FLUCT, QS, RELATIVE, SIZES
from tidemark.plans.spectral_pairs import FREQS
from tidemark.plans.sql import S, SIG, r, w1
from tidemark.sources import signals as G


def _round(df, *keys):
    return df.select(*(F.col(k) for k in keys), *(A.r6(c).alias(c) for c in df.columns if c not in keys))


def _power(spark, d):
    own = P.indexed(G.long_view(spark, d))
    shares = E.band_power(E.psd(own, CONFIG), CONFIG).select("signal_id", "band", "rel_power")
    return shares.join(own.select("signal_id", "role", "idx"), "signal_id")


def ag33(spark, d):
    """Mean shares of the bands by role, their difference, and the paired statistics."""
    out = M.relative_power(_power(spark, d))
    return _round(out.select("band", "real_mean", "synthetic_mean", "diff", F.col("n").cast("long").alias("n"), "t", "cohens_d", F.col("w").cast("double").alias("w")), "band", "n")


def ag33_tests(spark, d):
    """The test that normality chooses, its p-value and how a report writes it."""
    out = M.relative_power_tests(_power(spark, d))
    return out.select("band", "test", A.r6("normality").alias("normality"), A.r6("p").alias("p"), stats.format_p(F.col("p")).alias("p_text"), "significant")


def _exponents(spark, d):
    profiles = G.samples(G.long_view(spark, d).withColumn("x", T.profile(F.col("x"))), "signal_id").withColumnRenamed("v", "y")
    h = E.hurst(E.fluctuations(profiles, ["signal_id"], SIZES), ["signal_id"], QS)[1]
    return h.join(G.long_view(spark, d).select("signal_id", "role"), "signal_id")


def ag35(spark, d):
    """Generalised Hurst exponents of both roles by q: means, U and Cliff's delta."""
    h = _exponents(spark, d).select("q", "role", F.col("h").alias("value"))
    means = h.groupBy("q").agg(*(F.avg(F.when(F.col("role") == g, F.col("value"))).alias(f"{g}_mean") for g in ("real", "synthetic")))
    out = stats.compare(h, ["q"]).join(means, "q")
    return out.select("q", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), A.r6("real_mean").alias("real_mean"), A.r6("synthetic_mean").alias("synthetic_mean"), A.r6("u").alias("u"), A.r6("delta").alias("delta"))


def jn15(spark, d):
    """Which real signals are members: half of each label."""
    return M.split(G.short(spark, d)).select("signal_id", "label", "member")


SAMPLE = 20_000


def jn08(spark, d):
    """Pairs of real signals drawn with replacement, by an arithmetic hash of the draw's number."""
    signals = P.indexed(G.short(spark, d)).where("role = 'real'").select("idx")
    n = signals.count()
    draws = P.sample_with_replacement(spark, n, SAMPLE)
    return draws.join(signals.select(F.col("idx").alias("i")), "i").select("k", F.col("i").cast("long").alias("i"), "j")


def ag20_dtw(spark, d):
    """The table row of dynamic time warping: nearest synthetic signals against nearest real ones."""
    out = M.distance_metrics(P.indexed(G.short(spark, d)).select("role", "idx", "x"), "dtw")
    return _round(out, "metric", "real_idx", "synth_idx", "risk")


def sc12(spark, d):
    """The privacy score and its components."""
    return _round(M.privacy_score(P.indexed(G.short(spark, d))), "component")


def pm08(spark, d):
    """Similarities of scalograms by position: mean and deviation by set, and the effect and p of RR against RS."""
    images = X.scalograms(P.indexed(G.long_view(spark, d)), G.FS, FREQS)
    rows = X.zip_similarity(images, len(FREQS))
    return _round(X.compare_similarities(rows), "metric", "pair_set", "n")


def pl03(spark, d):
    """The scalogram of the first signal of each role, a row per frequency and sample, with the range of intensities."""
    first = P.indexed(G.long_view(spark, d)).where("idx = 0")
    rows = X.scalograms(first, G.FS, FREQS).select("role", F.array_min("x").alias("vmin"), F.array_max("x").alias("vmax"), F.posexplode("x").alias("k", "v"))
    width = 512
    return rows.select("role", A.r6(F.get(F.array(*map(F.lit, FREQS)), F.floor(F.col("k") / width).cast("int"))).alias("f"), F.pmod("k", F.lit(width)).cast("long").alias("t"), A.r6("v").alias("intensity"), A.r6("vmin").alias("vmin"), A.r6("vmax").alias("vmax"))


def pl06(spark, d):
    """Where the signals lie in the plane of the first two principal components."""
    return M.mean_frame(P.indexed(G.short(spark, d))).select("role", F.col("idx").cast("long").alias("idx"), A.r6(F.get("pc", F.lit(0))).alias("dim1"), A.r6(F.get("pc", F.lit(1))).alias("dim2"))


def ag27(spark, d):
    """Overlap, mixing and covariance shape in the plane of principal components and in that of the neighbour graph."""
    return _round(M.geometry(P.indexed(G.short(spark, d))), "space")


def fe21_knn(spark, d):
    """The fourteen nearest others of every signal, whatever its role: the neighbour graph's table."""
    signals = G.short(spark, d).select(F.lit("real").alias("role"), F.col("signal_id").alias("idx"), "x")
    return nearest_k(signals, 14).select("i", "j", A.r6("d").alias("d"))


def fe21_graph(spark, d):
    """Its edges with the united memberships."""
    signals = G.short(spark, d).select(F.lit("real").alias("role"), F.col("signal_id").alias("idx"), "x")
    return _round(fuzzy_graph(nearest_k(signals, 14).select("i", "j", "d"), 14), "i", "j")


def fe21(spark, d):
    """Where the signals lie in the plane of their neighbour graph."""
    return plane(P.indexed(G.short(spark, d))).select("role", F.col("idx").cast("long").alias("idx"), A.r6(F.get("x", F.lit(0))).alias("dim1"), A.r6(F.get("x", F.lit(1))).alias("dim2"))


def pl01_density(spark, d):
    """Densities of the Hjorth parameters of both roles on one grid each."""
    out = kernel_density(M.unpivoted(M.hjorth_features(G.short(spark, d)), M.HJORTH), ["feature"], 64)
    return _round(out.withColumn("k", F.col("k").cast("long")), "feature", "role", "k")


def pl06_density(spark, d):
    """The density of both roles in the plane of the first two samples, as of a given embedding."""
    points = G.short(spark, d).select("role", F.element_at("x", 1).alias("a"), F.element_at("x", 2).alias("b"))
    return _round(plane_density(points, 24).select("role", F.col("ka").cast("long").alias("ka"), F.col("kb").cast("long").alias("kb"), "a", "b", "density"), "role", "ka", "kb")


def pl07(spark, d):
    """Box rows of the Hjorth parameters by role: quartiles, range and mean."""
    long = M.unpivoted(M.hjorth_features(G.short(spark, d)), M.HJORTH)
    return _round(stats.summary(long, ["feature"]).join(long.groupBy("feature", "role").agg(F.min("value").alias("low"), F.max("value").alias("high")), ["feature", "role"]), "feature", "role", "n")


QUERIES = {
    "ag33_relative_power": ag33, "ag33_relative_power_tests": ag33_tests, "ag35_mfdfa_comparison": ag35, "jn15_stratified_members": jn15, "jn08_sampled_with_replacement": jn08,
    "ag20_distance_metrics_dtw": ag20_dtw, "sc12_privacy_score": sc12, "pm08_scalogram_comparison": pm08, "pl03_single_scalogram": pl03, "pl06_plane": pl06, "pl07_box": pl07,
    "ag27_plane_geometry": ag27, "fe21_nearest_fourteen": fe21_knn, "fe21_neighbour_graph": fe21_graph, "fe21_neighbour_plane": fe21,
    "pl01_hjorth_density": pl01_density, "pl06_plane_density": pl06_density,
}

_HJL = f"""{S}, d AS (SELECT signal_id, role, v, v - lag(v) OVER w AS d1, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d2 FROM s WINDOW w AS (PARTITION BY signal_id ORDER BY t)),
h0 AS (SELECT signal_id, role, stddev_pop(v) AS s0, stddev_pop(d1) AS s1, stddev_pop(d2) AS s2 FROM d GROUP BY ALL),
hj AS (SELECT role, s0 * s0 AS activity, s1 / (s0 + 1e-9) AS mobility, (s2 / (s1 + 1e-9)) / (s1 / (s0 + 1e-9) + 1e-9) AS complexity FROM h0),
hl AS (SELECT role, feature, value FROM hj UNPIVOT (value FOR feature IN (activity, mobility, complexity)))"""
SQL = {
    "pl01_hjorth_density": f"""WITH {_HJL}, o AS (SELECT feature, role, count(*) AS n, stddev_samp(value) * count(*) ** -0.2 AS h, min(value) AS lo, max(value) AS hi FROM hl GROUP BY 1, 2),
      g AS (SELECT feature, min(lo) OVER w - 3 * max(h) OVER w AS low, (max(hi) OVER w + 3 * max(h) OVER w - (min(lo) OVER w - 3 * max(h) OVER w)) / 63 AS step, role, n, h FROM o WINDOW w AS (PARTITION BY feature)),
      p AS (SELECT feature, role, n, h, low, step, floor((value - low) / step) AS f, (value - low) / step AS z FROM hl JOIN g USING (feature, role)),
      b AS (SELECT feature, role, n, h, low, step, f + c AS g, CASE c WHEN 0 THEN 1 - (z - f) ELSE z - f END AS w FROM p, range(2) x(c))
      SELECT feature, role, k, {r("any_value(low + k * step)", "x")}, {r("sum(w * exp(-0.5 * ((k - g) * step / h) ** 2) / (n * h * sqrt(2 * pi())))", "density")} FROM b, range(64) t(k) GROUP BY feature, role, k""",
    "pl06_plane_density": f"""WITH {SIG}, v AS (SELECT role, x[1] AS a, x[2] AS b FROM sig), o AS (SELECT role, count(*) AS n, stddev_samp(a) * count(*) ** (-1 / 6.0) AS ha, stddev_samp(b) * count(*) ** (-1 / 6.0) AS hb, min(a) AS la, max(a) AS ua, min(b) AS lb, max(b) AS ub FROM v GROUP BY 1),
      e AS (SELECT min(la) - 3 * max(ha) AS la, max(ua) + 3 * max(ha) AS ua, min(lb) - 3 * max(hb) AS lb, max(ub) + 3 * max(hb) AS ub FROM o),
      g AS (SELECT role, n, ha, hb, e.la, e.lb, (e.ua - e.la) / 23 AS sa, (e.ub - e.lb) / 23 AS sb FROM o, e),
      p AS (SELECT role, (a - la) / sa AS za, (b - lb) / sb AS zb FROM v JOIN g USING (role)),
      w AS (SELECT role, floor(za) + i AS ga, floor(zb) + j AS gb, sum((CASE i WHEN 0 THEN 1 - (za - floor(za)) ELSE za - floor(za) END) * (CASE j WHEN 0 THEN 1 - (zb - floor(zb)) ELSE zb - floor(zb) END)) AS w FROM p, range(2) x(i), range(2) y(j) GROUP BY ALL)
      SELECT role, ka, kb, {r("any_value(la + ka * sa)", "a")}, {r("any_value(lb + kb * sb)", "b")}, {r("sum(w * exp(-0.5 * (((ka - ga) * sa / ha) ** 2 + ((kb - gb) * sb / hb) ** 2)) / (n * ha * hb * 2 * pi()))", "density")}
      FROM w JOIN g USING (role), range(24) s(ka), range(24) t(kb) GROUP BY role, ka, kb""",
    "fe21_nearest_fourteen": f"""WITH {SIG}, d AS (SELECT a.signal_id AS i, b.signal_id AS j, list_distance(a.x, b.x) AS d FROM sig a JOIN sig b ON a.signal_id <> b.signal_id)
      SELECT i, j, {r("d", "d")} FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM d) WHERE k <= 14""",
    "ag33_relative_power": f"""WITH {RELATIVE}, rp AS (SELECT band, role, idx, rel_power AS v FROM rel JOIN lng USING (signal_id)),
      m AS (SELECT band, 100 * avg(v) FILTER (role = 'real') AS rm, 100 * avg(v) FILTER (role = 'synthetic') AS sm FROM rp GROUP BY 1),
      pr AS (SELECT band, a.v - b.v AS d FROM rp a JOIN rp b USING (band, idx) WHERE a.role = 'real' AND b.role = 'synthetic'),
      st AS (SELECT band, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM pr GROUP BY 1),
      rk AS (SELECT band, d, rank() OVER w + (count(*) OVER e - 1) / 2.0 AS rk FROM pr WHERE d <> 0 WINDOW w AS (PARTITION BY band ORDER BY abs(d)), e AS (PARTITION BY band, abs(d))),
      wx AS (SELECT band, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0))::DOUBLE AS w FROM rk GROUP BY 1)
      SELECT band, {r("rm", "real_mean")}, {r("sm", "synthetic_mean")}, {r("abs(rm - sm)", "diff")}, n, {r("mean / nullif(sd, 0) * sqrt(n)", "t")}, {r("mean / nullif(sd, 0)", "cohens_d")}, {r("w", "w")} FROM m LEFT JOIN st USING (band) LEFT JOIN wx USING (band)""",
    "ag35_mfdfa_comparison": f"""WITH {FLUCT}, hr AS (SELECT q, role, h AS value FROM hq JOIN lng USING (signal_id)), {w1("hr", "q")}, m AS (SELECT q, avg(value) FILTER (role = 'real') AS rm, avg(value) FILTER (role = 'synthetic') AS sm FROM hr GROUP BY 1)
      SELECT q, n1, n2, {r("rm", "real_mean")}, {r("sm", "synthetic_mean")}, {r("u", "u")}, {r("delta", "delta")} FROM cmp JOIN m USING (q)""",
    "jn15_stratified_members": f"WITH {SIG} SELECT signal_id, label, row_number() OVER (PARTITION BY label ORDER BY (signal_id * 7919 + 104729 + 42 * 15485863 + signal_id * 31) % 1000003, signal_id) <= ceil(count(*) OVER (PARTITION BY label) / 2) AS member FROM sig WHERE role = 'real'",
    "jn08_sampled_with_replacement": f"""WITH {SIG}, c AS (SELECT count(*) AS n FROM sig WHERE role = 'real'), k AS (SELECT k, n, ('0x' || md5(k || 'i')[1:15])::BIGINT % n AS i, ('0x' || md5(k || 'j')[1:15])::BIGINT % n AS j FROM range({SAMPLE}) g(k), c WHERE n > 0)
      SELECT k, i, j FROM k WHERE i <> j""",
    "pl07_box": f"""WITH {_HJL} SELECT feature, role, count(*) AS n, {r("avg(value)", "mean")}, {r("stddev_pop(value)", "sd")}, {r("median(value)", "median")}, {r("quantile_cont(value, 0.25)", "q1")}, {r("quantile_cont(value, 0.75)", "q3")}, {r("min(value)", "low")}, {r("max(value)", "high")} FROM hl GROUP BY feature, role""",
}
