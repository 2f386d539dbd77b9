"""Queries of pairings, distances, comparisons and scores."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions import stats
from tidemark.operators import features as E
from tidemark.operators import measures as M
from tidemark.operators import pairs as P
from tidemark.operators import transforms as T
from tidemark.plans.features import BURST_FEATURES, CONFIG, RELATIVE, RUNS
from tidemark.plans.sql import CHAN, S, SIG, r, w1
from tidemark.sources import signals as G


def _idx(spark, d):
    return P.indexed(G.short(spark, d))


def _pairs(make):
    return lambda spark, d: make(_idx(spark, d)).select("pair_set", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


def _round(df, *keys):
    return df.select(*(F.col(k) for k in keys), *(A.r6(c).alias(c) for c in df.columns if c not in keys))


def _nearest(metric, sets):
    return lambda spark, d: _round(P.nearest(_idx(spark, d), metric, sets=sets), "pair_set", "i", "j")


def _hjorth_long(spark, d):
    return M.unpivoted(M.hjorth_features(G.short(spark, d)), M.HJORTH)


def ag13(spark, d):
    """Hjorth features of pairs by position: signed ranks and p."""
    h = _idx(spark, d).select("role", "idx", E.hjorth(F.col("x")).alias("h"))
    a, b = (h.where(F.col("role") == role).select("idx", F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"h.{f}").alias(c)) for f in M.HJORTH)))) for role, c in (("real", "a"), ("synthetic", "b")))
    return a.join(b, ["idx", "feature"])


def pm09(spark, d):
    return P.distances(M.correlation_signals(G.channels(spark, d))).select("pair_set", "i", "j", A.r6(F.sqrt(F.lit(2.0)) * F.col("d")).alias("d"))


def ag36(spark, d):
    rows = G.short(spark, d).select((F.pmod("label", F.lit(2)) == 0).alias("member"), F.inline(F.array(*(F.struct(F.lit(f"v{k}").alias("attack"), F.round(F.element_at("x", k), 2).alias("value")) for k in (1, 2)))))
    return _round(M.threshold_accuracy(rows), "attack")


def _scores(spark, d):
    return G.short(spark, d).select("label", F.abs(F.element_at("x", 1)).alias("value")).groupBy("label").agg(F.avg("value").alias("value"))


def sc02(spark, d):
    rows = {r["label"]: r["value"] for r in _scores(spark, d).collect()}
    weights = dict(zip(sorted(rows), M.entropy_weights([rows[k] for k in sorted(rows)]), strict=True))
    mapped = F.create_map(*(F.lit(v) for kv in weights.items() for v in kv))
    return _scores(spark, d).select("label", A.r6(mapped[F.col("label")]).alias("weight"))


def sc05_bands(spark, d):
    """The band part of the frequency score: mean share by role and band, their difference in percent, and the similarity."""
    p = E.band_power(E.psd(G.long_view(spark, d), CONFIG), CONFIG)
    by = p.groupBy("band").agg(*(F.avg(F.when(F.col("role") == role, F.col("rel_power") * 100)).alias(role) for role in ("real", "synthetic")))
    return _round(by.withColumn("similarity", F.greatest(F.lit(0.2), 1 - F.abs(F.col("real") - F.col("synthetic")) / 20)), "band")


def ag32(spark, d):
    """Burst features on the rectified signal: means by role, and the Wasserstein distance over the real deviation."""
    e = G.samples(G.long_view(spark, d)).withColumn("v", F.abs("v"))
    f = M.unpivoted(E.burst_summary(E.bursts(e, G.FS, p=60.0, min_ms=16.0, merge_ms=16.0), e, G.FS), ("n_bursts", *BURST_FEATURES))
    by = stats.compare(f, ["feature"]).join(stats.summary(f, ["feature"]).groupBy("feature").agg(*(F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c}") for role in ("real", "synthetic") for c in ("mean",)), F.max(F.when(F.col("role") == "real", F.col("sd"))).alias("sd")), "feature")
    return _round(by.select("feature", "real_mean", "synthetic_mean", (F.col("w1") / (F.col("sd") + 1e-12)).alias("wd_norm")), "feature")


def sc12_l2(spark, d):
    """The distance part of the privacy score."""
    one = M.distance_metrics(_idx(spark, d))
    return one.select(A.r6(M.ramp(F.col("d"))).alias("score"))


def ag27(spark, d):
    """Overlap, mixing and covariance shape of the first two principal components."""
    s = M.mean_frame(_idx(spark, d)).select("role", "idx", F.col("pc").alias("x"))
    return _round(M.embedding_scores(s))


def ag25(spark, d):
    """The same scores on the first two samples of each signal, as a given embedding."""
    return _round(M.embedding_scores(_idx(spark, d).withColumn("x", F.slice("x", 1, 2))))


def sc11(spark, d):
    """The diversity score and its twelve components."""
    return _round(M.diversity_score(_idx(spark, d)), "component")


def ag39(spark, d):
    return _round(M.membership(G.short(spark, d)))


def pm12(spark, d):
    """The nearest synthetic signal of each real one by dynamic time warping."""
    return _round(P.nearest(T.normalise(_idx(spark, d), "zscore_global"), "dtw", sets=("RS",)), "pair_set", "i", "j")


def _mean_pairs(spark, d):
    return _round(P.mean_distances(_idx(spark, d), sets=("RR", "RS", "SS")).drop("sd"), "pair_set", "n")


def _spatial(spark, d):
    return _round(M.spatial(G.channels(spark, d)))


def _u(spark, d):
    c = stats.compare(_hjorth_long(spark, d), ["feature"])
    return c.select("feature", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), A.r6("u").alias("u"), A.r6("ties").alias("ties"), A.r6("delta").alias("delta"))


def ag14_p(spark, d):
    c = stats.compare(_hjorth_long(spark, d), ["feature"])
    return c.select("feature", A.r6(stats.p_of_u(F.col("u"), F.col("n1"), F.col("n2"), F.col("ties"))).alias("p"))


def ag12(spark, d):
    """Shapiro-Wilk on the paired differences of each feature."""
    values = ag13(spark, d).select("feature", (F.col("a") - F.col("b")).alias("value"))
    return stats.shapiro_wilk(values, ["feature"]).select("feature", A.r6("p").alias("p"))


def sc03(spark, d):
    rows = _scores(spark, d).select(F.col("value"), (F.col("label") + 1.0).alias("weight"))
    return _round(M.geometric_mean(rows))


def jn07(spark, d):
    signals = _idx(spark, d)
    drawn = functools.reduce(lambda a, b: a.unionByName(b), (P.sample_pairs(signals, name) for name in P.SETS))
    return _round(P.attach(drawn, signals, "x").withColumn("d", A.euclidean(F.col("left.x"), F.col("right.x"))).select("pair_set", "i", "j", "d"), "pair_set", "i", "j")


QUERIES = {
    "jn01_all_rs": _pairs(lambda s: P.all_pairs(s, "RS")),
    "jn02_unique_rr": _pairs(lambda s: P.all_pairs(s, "RR")),
    "jn03_zip_rs": _pairs(lambda s: P.zip_pairs(s, "RS")),
    "jn04_consecutive": _pairs(lambda s: P.zip_pairs(s, "RR").unionByName(P.zip_pairs(s, "SS"))),
    "jn05_halves": _pairs(lambda s: P.zip_pairs(s, "RR", "halves").unionByName(P.zip_pairs(s, "SS", "halves"))),
    "jn06_chain": _pairs(lambda s: P.zip_pairs(s, "RR", "chain")),
    "jn07_sampled_pairs": jn07,
    "jn09_nearest_l2": _nearest("l2", ("RR", "RS", "SS")),
    "jn10_nearest_cosine": _nearest("cosine", ("RS",)),
    "jn11_nearest_dtw": pm12,
    "jn13_two_sided": _nearest("l2", ("RS", "SR", "RR")),
    "jn15_stratified_split": lambda spark, d: G.short(spark, d).where("role = 'real'").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / 2).cast("long").alias("members")),
    "jn03_zip_l2": lambda spark, d: _round(P.attach(P.zip_pairs(_idx(spark, d), "RS"), _idx(spark, d), "x").select("i", A.euclidean(F.col("left.x"), F.col("right.x")).alias("d")), "i"),
    "pm09_frobenius": pm09,
    "pm14_euclidean": lambda spark, d: P.total_distances(_idx(spark, d)).select("pair_set", "i", A.r6("total").alias("total")),
    "ag01_mean_sd": lambda spark, d: _hjorth_long(spark, d).groupBy("role", "feature").agg(A.r6(F.avg("value")).alias("mean"), A.r6(F.stddev_samp("value")).alias("sd")),
    "ag03_summary": lambda spark, d: _round(stats.summary(_hjorth_long(spark, d), ["feature"]), "feature", "role", "n"),
    "ag04_robust_sd": lambda spark, d: _round(stats.robust_sd(_hjorth_long(spark, d), ["role", "feature"]), "role", "feature"),
    "ag05_wasserstein": lambda spark, d: stats.compare(_hjorth_long(spark, d), ["feature"]).select("feature", A.r6("w1").alias("w1")),
    "ag11_hjorth_metrics": lambda spark, d: _round(M.hjorth_metrics(G.short(spark, d))),
    "ag12_shapiro": ag12,
    "ag13_signed_rank": lambda spark, d: _round(stats.signed_rank(ag13(spark, d), ["feature"]), "feature"),
    "ag13_paired_t": lambda spark, d: _round(stats.paired(ag13(spark, d), ["feature"]), "feature", "n"),
    "ag14_mann_whitney_p": ag14_p,
    "ag15_u_and_delta": _u,
    "ag18_distance_metrics": lambda spark, d: _round(M.distance_metrics(_idx(spark, d)), "metric", "real_idx", "synth_idx", "risk"),
    "ag20_distance_metrics_cosine": lambda spark, d: _round(M.distance_metrics(_idx(spark, d), "cosine", "zscore_per_signal"), "metric", "real_idx", "synth_idx", "risk"),
    "ag22_spatial": _spatial,
    "ag23_coverage": lambda spark, d: _round(M.coverage(_idx(spark, d))),
    "ag25_embedding_scores": ag25,
    "ag27_pca_geometry": ag27,
    "ag29_mean_pairwise": _mean_pairs,
    "ag30_intrinsic_diversity": lambda spark, d: _round(M.intrinsic_diversity(_idx(spark, d))),
    "ag32_burst_statistics": ag32,
    "ag36_threshold_sweep": ag36,
    "ag39_membership": ag39,
    "sc02_entropy_weights": sc02,
    "sc03_geometric_mean": sc03,
    "sc04_time_fidelity_score": lambda spark, d: _round(M.time_score(M.hjorth_metrics(G.short(spark, d))).select("score")),
    "sc05_band_similarity": sc05_bands,
    "sc09_spatial_score": lambda spark, d: _round(M.spatial(G.channels(spark, d)).select(F.least(F.greatest("f_spatial", F.lit(0.0)), F.lit(1.0)).alias("score"))),
    "sc11_diversity_score": sc11,
    "sc12_l2_ramp": sc12_l2,
}

_HJ = f"""{S}, d AS (SELECT signal_id, role, idx, v, v - lag(v) OVER w AS d1, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d2 FROM s WINDOW w AS (PARTITION BY signal_id ORDER BY t)),
h0 AS (SELECT signal_id, role, idx, stddev_pop(v) AS s0, stddev_pop(d1) AS s1, stddev_pop(d2) AS s2 FROM d GROUP BY ALL),
hj AS (SELECT signal_id, role, idx, s0 * s0 AS activity, s1 / (s0 + 1e-9) AS mobility, (s2 / (s1 + 1e-9)) / (s1 / (s0 + 1e-9) + 1e-9) AS complexity FROM h0),
hl AS (SELECT role, idx, feature, value FROM hj UNPIVOT (value FOR feature IN (activity, mobility, complexity)))"""
_METRICS = f"""{_HJ}, {w1("hl", "feature")}, sdr AS (SELECT feature, stddev_pop(value) AS sd FROM hl WHERE role = 'real' GROUP BY 1),
wn AS (SELECT feature, w1, w1 / (sd + 1e-9) AS wn FROM cmp JOIN sdr USING (feature)),
ww AS (SELECT {", ".join(f"max({c}) FILTER (feature = '{f}') AS {k}_{f}" for f in M.HJORTH for k, c in (("wd", "w1"), ("wdn", "wn")))}, avg(w1) AS avg_wd, avg(wn) AS avg_wdn FROM wn),
mm AS (SELECT {", ".join(f"avg({f}) FILTER (role = '{g}') AS {g}_{f}" for g in ("real", "synthetic") for f in M.HJORTH)},
  covar_samp(activity, activity) + 1e-6 AS a, covar_samp(activity, mobility) AS b, covar_samp(activity, complexity) AS c, covar_samp(mobility, mobility) + 1e-6 AS e, covar_samp(mobility, complexity) AS f, covar_samp(complexity, complexity) + 1e-6 AS i FROM hj),
ma AS (SELECT *, real_activity - synthetic_activity AS x, real_mobility - synthetic_mobility AS y, real_complexity - synthetic_complexity AS z FROM mm),
md AS (SELECT *, sqrt(greatest(((e*i-f*f)*x*x + (a*i-c*c)*y*y + (a*e-b*b)*z*z + 2*(c*f-b*i)*x*y + 2*(b*f-c*e)*x*z + 2*(b*c-a*f)*y*z) / (a*(e*i-f*f) - b*(b*i-c*f) + c*(b*f-c*e)), 0)) AS mahalanobis FROM ma)"""
_ROLES = "(VALUES ('RR', 'real', 'real'), ('RS', 'real', 'synthetic'), ('SS', 'synthetic', 'synthetic')) p(pair_set, ra, rb)"
_DIST = f"{SIG}, d AS (SELECT pair_set, a.idx AS i, b.idx AS j, list_distance(a.x, b.x) AS d FROM {_ROLES} JOIN sig a ON a.role = ra JOIN sig b ON b.role = rb AND (ra <> rb OR a.idx <> b.idx))"
_NN = "nn AS (SELECT pair_set, i, min(d) AS d, arg_min(j, (d, j)) AS j FROM {0} GROUP BY ALL)"
_Z = f"{S}, g AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM s WHERE role = 'real'), sigz AS (SELECT signal_id, role, idx, list_transform(x, lambda q: (q - m) / sd) AS x FROM sig, g)"
_ZS = f"{SIG}, sigz AS (SELECT signal_id, role, idx, list_transform(x, lambda q: (q - list_avg(x)) / list_stddev_pop(x)) AS x FROM sig)"


def _effect(base: str, distance: str, name: str) -> str:
    return f"""WITH {base}, d AS (SELECT rb, a.idx AS i, b.idx AS j, {distance} AS d FROM (VALUES ('real'), ('synthetic')) p(rb) JOIN sigz a ON a.role = 'real' JOIN sigz b ON b.role = rb AND (rb <> 'real' OR a.idx <> b.idx)),
nn AS (SELECT rb, i, min(d) AS d, arg_min(j, (d, j)) AS j FROM d GROUP BY ALL),
o AS (SELECT avg(d) FILTER (rb = 'synthetic') AS mean, min(d) FILTER (rb = 'synthetic') AS mn, arg_min(i, (d, i, j)) FILTER (rb = 'synthetic') AS real_idx, arg_min(j, (d, i, j)) FILTER (rb = 'synthetic') AS synth_idx, avg(d) FILTER (rb = 'real') AS rr_mean, stddev_samp(d) FILTER (rb = 'real') AS sd FROM nn),
e AS (SELECT *, (mean - rr_mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS d FROM o) {name}"""


_EFFECT_OUT = "SELECT '{0}' AS metric, " + ", ".join(r(a, b) for a, b in (("mean", "mean"), ("mn", "min"), ("rr_mean", "rr_mean"), ("d", "d"))) + ", real_idx, synth_idx, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS risk FROM e"
_L2Z, _COSZ = "list_distance(a.x, b.x) / sqrt(64)", "1 - list_cosine_similarity(a.x, b.x)"
_PAIRED = f"{_HJ}, pr AS (SELECT feature, a.value - b.value AS d FROM hl a JOIN hl b USING (feature, idx) WHERE a.role = 'real' AND b.role = 'synthetic')"
_SPATIAL = f"""{CHAN}, rho AS (SELECT a.sample_id, a.role, a.channel AS c1, b.channel AS c2, corr(a.v, b.v) AS rho FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.t = b.t AND a.channel < b.channel GROUP BY ALL),
sl AS (SELECT sample_id, role, list(rho ORDER BY c1, c2) AS x FROM rho GROUP BY sample_id, role),
sm AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY sample_id) - 1 AS idx FROM sl),
fd AS (SELECT pair_set, a.idx AS i, b.idx AS j, sqrt(2.0) * list_distance(a.x, b.x) AS d FROM {_ROLES} JOIN sm a ON a.role = ra JOIN sm b ON b.role = rb AND (ra <> rb OR a.idx < b.idx)),
sp AS (SELECT {", ".join(f"{f}(d) FILTER (pair_set = '{s}') AS {s.lower()}_{n}" for s in P.SETS for f, n in (("avg", "mean"), ("stddev_pop", "sd")))} FROM fd)"""
_U = "(rs_mean - rr_mean) / nullif(rr_sd, 0)"
_PLANE = f"""{SIG}, p AS (SELECT role, idx, x[1] AS a, x[2] AS b FROM sig),
o AS (SELECT {", ".join(f"avg({c}) FILTER (role = '{g}') AS m{g[0]}{c}" for g in ("real", "synthetic") for c in "ab")}, {", ".join(f"covar_samp({c}, {e}) FILTER (role = '{g}') AS c{g[0]}{c}{e}" for g in ("real", "synthetic") for c, e in ("aa", "ab", "bb"))} FROM p),
q AS (SELECT *, mra - msa AS da, mrb - msb AS db, craa + csaa + 1e-6 AS aa, crab + csab AS ab, crbb + csbb + 1e-6 AS bb FROM o),
sd AS (SELECT x.role, x.idx, avg(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) FILTER (x.role = y.role AND x.idx <> y.idx) AS own, avg(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) FILTER (x.role <> y.role) AS oth FROM p x CROSS JOIN p y GROUP BY ALL),
si AS (SELECT role, avg((oth - own) / greatest(own, oth)) AS s FROM sd GROUP BY role)"""

SQL = {
    "jn01_all_rs": f"WITH {SIG} SELECT 'RS' AS pair_set, a.idx AS i, b.idx AS j FROM sig a JOIN sig b ON a.role = 'real' AND b.role = 'synthetic'",
    "jn02_unique_rr": f"WITH {SIG} SELECT 'RR' AS pair_set, a.idx AS i, b.idx AS j FROM sig a JOIN sig b ON a.role = 'real' AND b.role = 'real' AND a.idx < b.idx",
    "jn03_zip_rs": f"WITH {SIG} SELECT 'RS' AS pair_set, a.idx AS i, b.idx AS j FROM sig a JOIN sig b ON a.role = 'real' AND b.role = 'synthetic' AND a.idx = b.idx",
    "jn04_consecutive": f"WITH {SIG} SELECT CASE a.role WHEN 'real' THEN 'RR' ELSE 'SS' END AS pair_set, a.idx AS i, b.idx AS j FROM sig a JOIN sig b ON a.role = b.role AND a.idx % 2 = 0 AND b.idx = a.idx + 1",
    "jn05_halves": f"WITH {SIG}, n AS (SELECT role, count(*) // 2 AS h FROM sig GROUP BY 1) SELECT CASE a.role WHEN 'real' THEN 'RR' ELSE 'SS' END AS pair_set, a.idx AS i, b.idx AS j FROM sig a JOIN n USING (role) JOIN sig b ON a.role = b.role AND a.idx < h AND b.idx = a.idx + h",
    "jn06_chain": f"WITH {SIG} SELECT 'RR' AS pair_set, a.idx AS i, b.idx AS j FROM sig a JOIN sig b ON a.role = 'real' AND b.role = 'real' AND b.idx = a.idx + 1",
    "jn07_sampled_pairs": f"""WITH {SIG}, k AS (SELECT count(*) FILTER (role = 'real') AS a, count(*) FILTER (role = 'synthetic') AS b FROM sig),
        sets AS (SELECT 'RR' AS pair_set, a AS n, a * (a - 1) // 2 AS total, 20000 AS cap FROM k UNION ALL SELECT 'SS', b, b * (b - 1) // 2, 20000 FROM k
                 UNION ALL SELECT 'RS', b, a * b, 40000 FROM k),
        steps AS (SELECT *, (SELECT min(1 + total * 618034 // 1000000 + x) FROM range(1000) g(x) WHERE gcd(1 + total * 618034 // 1000000 + x, total) = 1) AS step FROM sets),
        drawn AS (SELECT pair_set, n, unnest(range(least(cap, total))) * step % total AS p FROM steps),
        ij AS (SELECT pair_set, CASE WHEN pair_set = 'RS' THEN p // n ELSE p % n END AS one, CASE WHEN pair_set = 'RS' THEN p % n ELSE (p % n + p // n + 1) % n END AS other FROM drawn),
        ord AS (SELECT pair_set, CASE WHEN pair_set = 'RS' THEN one ELSE least(one, other) END AS i, CASE WHEN pair_set = 'RS' THEN other ELSE greatest(one, other) END AS j FROM ij)
        SELECT pair_set, i, j, {r('list_distance(x.x, y.x)', 'd')} FROM ord
        JOIN sig x ON x.idx = i AND x.role = CASE WHEN pair_set = 'SS' THEN 'synthetic' ELSE 'real' END JOIN sig y ON y.idx = j AND y.role = CASE WHEN pair_set = 'RR' THEN 'real' ELSE 'synthetic' END""",
    "jn09_nearest_l2": f"WITH {_DIST}, {_NN.format('d')} SELECT pair_set, i, j, {r('d / 8', 'd')} FROM nn",
    "jn10_nearest_cosine": f"WITH {SIG}, d AS (SELECT 'RS' AS pair_set, a.idx AS i, b.idx AS j, {_COSZ} AS d FROM sig a JOIN sig b ON a.role = 'real' AND b.role = 'synthetic'), {_NN.format('d')} SELECT pair_set, i, j, {r('d', 'd')} FROM nn",
    "jn13_two_sided": f"WITH {_DIST}, e AS (SELECT * FROM d WHERE pair_set <> 'SS' UNION ALL SELECT 'SR', j, i, d FROM d WHERE pair_set = 'RS'), {_NN.format('e')} SELECT pair_set, i, j, {r('d / 8', 'd')} FROM nn",
    "jn15_stratified_split": f"WITH {SIG} SELECT label, count(*) AS n, ceil(count(*) / 2)::BIGINT AS members FROM sig WHERE role = 'real' GROUP BY label",
    "jn03_zip_l2": f"WITH {SIG} SELECT a.idx AS i, {r('list_distance(a.x, b.x)', 'd')} FROM sig a JOIN sig b ON a.role = 'real' AND b.role = 'synthetic' AND a.idx = b.idx",
    "pm09_frobenius": f"WITH {_SPATIAL} SELECT pair_set, i, j, {r('d', 'd')} FROM fd",
    "pm14_euclidean": f"WITH {_DIST} SELECT pair_set, i, {r('sum(d)', 'total')} FROM d WHERE pair_set = 'RS' OR i < j GROUP BY pair_set, i",
    "ag01_mean_sd": f"WITH {_HJ} SELECT role, feature, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')} FROM hl GROUP BY role, feature",
    "ag03_summary": f"WITH {_HJ} SELECT feature, role, count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'sd')}, {r('median(value)', 'median')}, {r('quantile_cont(value, 0.25)', 'q1')}, {r('quantile_cont(value, 0.75)', 'q3')} FROM hl GROUP BY feature, role",
    "ag04_robust_sd": f"WITH {_HJ} SELECT role, feature, {r('1.4826 * mad(value)', 'sd')} FROM hl GROUP BY role, feature",
    "ag05_wasserstein": f"WITH {_HJ}, {w1('hl', 'feature')} SELECT feature, {r('w1', 'w1')} FROM cmp",
    "ag11_hjorth_metrics": f"WITH {_METRICS} SELECT "
    + ", ".join([*(r(f"{k}_{f}", f"{k}_{f}") for f in M.HJORTH for k in ("wd", "wdn")), *(r(f"{g}_{f}", f"{g}_{f}") for g in ("real", "synthetic") for f in M.HJORTH), *(r(f"(synthetic_{f} - real_{f}) / (real_{f} + 1e-9)", f"rel_diff_{f}") for f in M.HJORTH), *(r(c, c) for c in ("avg_wd", "avg_wdn", "mahalanobis"))])
    + " FROM ww, md",
    "ag13_signed_rank": f"WITH {_PAIRED}, rk AS (SELECT feature, d, rank() OVER w + (count(*) OVER e - 1) / 2.0 AS rk, count(*) OVER e AS t FROM pr WHERE d <> 0 WINDOW w AS (PARTITION BY feature ORDER BY abs(d)), e AS (PARTITION BY feature, abs(d))) SELECT feature, count(*)::DOUBLE AS n, {r('sum(CASE WHEN d > 0 THEN rk ELSE 0 END)', 'w_plus')}, {r('sum(CASE WHEN d < 0 THEN rk ELSE 0 END)', 'w_minus')}, {r('sum(t * t - 1)::DOUBLE', 'ties')} FROM rk GROUP BY feature",
    "ag13_paired_t": f"WITH {_PAIRED} SELECT feature, count(*) AS n, {r('avg(d)', 'mean')}, {r('stddev_samp(d)', 'sd')}, {r('avg(d) / stddev_samp(d) * sqrt(count(*))', 't')}, {r('avg(d) / stddev_samp(d)', 'cohens_d')} FROM pr GROUP BY feature",
    "ag15_u_and_delta": f"WITH {_HJ}, {w1('hl', 'feature')} SELECT feature, n1, n2, {r('u', 'u')}, {r('ties', 'ties')}, {r('delta', 'delta')} FROM cmp",
    "ag18_distance_metrics": _effect(_Z, _L2Z, _EFFECT_OUT.format("l2")),
    "ag20_distance_metrics_cosine": _effect(_ZS, _COSZ, _EFFECT_OUT.format("cosine")),
    "ag22_spatial": f"WITH {_SPATIAL} SELECT {', '.join(r(f'{s.lower()}_{n}', f'{s.lower()}_{n}') for s in P.SETS for n in ('mean', 'sd'))}, {r(_U, 'z_sc')}, {r(f'1 / (1 + abs({_U}))', 'f_spatial')} FROM sp",
    "ag23_coverage": f"WITH {_DIST}, rs AS (SELECT i, min(d) AS d FROM d WHERE pair_set = 'RS' GROUP BY 1), sr AS (SELECT j, min(d) AS d FROM d WHERE pair_set = 'RS' GROUP BY 1), rr AS (SELECT i, min(d) AS d FROM d WHERE pair_set = 'RR' GROUP BY 1), g AS (SELECT median(d) AS sigma FROM rr) SELECT {r('sigma', 'sigma')}, {r('2 * sigma', 'radius')}, {r('(SELECT avg((d <= 2 * sigma)::INT) FROM rs)', 'coverage')}, {r('(SELECT avg((d <= 2 * sigma)::INT) FROM sr)', 'outliers')} FROM g",
    "ag25_embedding_scores": f"WITH {_PLANE} SELECT {r('exp(-0.5 * (da * da * bb - 2 * da * db * ab + db * db * aa) / (aa * bb - ab * ab))', 'overlap')}, {r('least(greatest(1 - sqrt((craa - csaa) ** 2 + 2 * (crab - csab) ** 2 + (crbb - csbb) ** 2) / (sqrt(craa ** 2 + 2 * crab ** 2 + crbb ** 2) + sqrt(csaa ** 2 + 2 * csab ** 2 + csbb ** 2) + 1e-12), 0), 1)', 'cov_shape')}, {r('1 - abs((SELECT avg(s) FROM si))', 'mixing')} FROM q",
    "ag29_mean_pairwise": f"WITH {_DIST} SELECT pair_set, count(*) AS n, {r('avg(d)', 'mean')} FROM d WHERE pair_set = 'RS' OR i < j GROUP BY pair_set",
    "ag30_intrinsic_diversity": f"WITH {_DIST}, nn AS (SELECT pair_set, i, min(d) AS d FROM d WHERE pair_set <> 'RS' GROUP BY ALL), a AS (SELECT pair_set, avg(d) AS m, quantile_cont(d, 0.1) AS p10, quantile_cont(d, 0.5) AS p50 FROM nn GROUP BY 1), b AS (SELECT pair_set, avg(d) AS g FROM d WHERE pair_set <> 'RS' GROUP BY 1), o AS (SELECT * FROM a JOIN b USING (pair_set)) SELECT {', '.join(r(f'x.{c} / (y.{c} + 1e-12)', n) for c, n in (('m', 'uniqueness'), ('g', 'global_diversity'), ('p10', 'local_p10'), ('p50', 'local_p50')))} FROM o x, o y WHERE x.pair_set = 'SS' AND y.pair_set = 'RR'",
    "ag32_burst_statistics": f"""WITH {RUNS}, ib AS (SELECT *, (start - lag(start) OVER (PARTITION BY signal_id ORDER BY start)) / {G.FS} AS ibi FROM bu),
a0 AS (SELECT signal_id, count(*) AS n, avg(duration_s) AS md, median(duration_s) AS dd, avg(peak) AS mp, median(peak) AS dp, avg(ibi) AS mi, median(ibi) AS di, sum(duration_s) AS busy FROM ib GROUP BY 1),
f AS (SELECT role, coalesce(n, 0)::DOUBLE AS n_bursts, coalesce(n / 4.0, 0)::DOUBLE AS rate_hz, coalesce(md, 0) AS mean_duration, coalesce(dd, 0) AS median_duration, coalesce(mp, 0) AS mean_peak, coalesce(dp, 0) AS median_peak, mi AS mean_ibi, di AS median_ibi, coalesce(busy / 4.0, 0) AS duty_cycle FROM lng LEFT JOIN a0 USING (signal_id)),
fl AS (SELECT role, feature, value FROM f UNPIVOT (value FOR feature IN (n_bursts, rate_hz, mean_duration, median_duration, mean_peak, median_peak, mean_ibi, median_ibi, duty_cycle))), {w1("fl", "feature")},
m AS (SELECT feature, avg(value) FILTER (role = 'real') AS rm, avg(value) FILTER (role = 'synthetic') AS sm, stddev_pop(value) FILTER (role = 'real') AS sd FROM fl GROUP BY 1)
SELECT feature, {r("rm", "real_mean")}, {r("sm", "synthetic_mean")}, {r("w1 / (sd + 1e-12)", "wd_norm")} FROM m JOIN cmp USING (feature)""",
    "ag36_threshold_sweep": f"WITH {SIG}, v AS (SELECT label % 2 = 0 AS member, unnest(['v1', 'v2']) AS attack, round(unnest([x[1], x[2]]), 2) AS value FROM sig), t AS (SELECT DISTINCT attack, value AS t FROM v), a AS (SELECT attack, t, (avg((value >= t)::INT) FILTER (member) + avg((value < t)::INT) FILTER (NOT member)) / 2 AS acc FROM t JOIN v USING (attack) GROUP BY ALL) SELECT attack, {r('max(acc)', 'accuracy')} FROM a GROUP BY attack",
    "sc02_entropy_weights": f"WITH {SIG}, v AS (SELECT label, avg(abs(x[1])) AS value FROM sig GROUP BY 1) SELECT label, {r('value / sum(value) OVER ()', 'weight')} FROM v",
    "sc03_geometric_mean": f"WITH {SIG}, v AS (SELECT label, avg(abs(x[1])) AS value FROM sig GROUP BY 1) SELECT {r('exp(sum((label + 1.0) * ln(least(greatest(value, 1e-12), 1))) / sum(label + 1.0))', 'score')} FROM v",
    "sc04_time_fidelity_score": f"WITH {_METRICS} SELECT {r('0.25 * (1 / (1 + wdn_activity) + 1 / (1 + wdn_mobility) + 1 / (1 + wdn_complexity) + 1 / (1 + mahalanobis))', 'score')} FROM ww, md",
    "sc05_band_similarity": f"WITH {RELATIVE}, m AS (SELECT band, avg(rel_power * 100) FILTER (signal_id % 2 = 0) AS a, avg(rel_power * 100) FILTER (signal_id % 2 = 1) AS b FROM rel GROUP BY band) SELECT band, {r('a', 'real')}, {r('b', 'synthetic')}, {r('greatest(0.2, 1 - abs(a - b) / 20)', 'similarity')} FROM m",
    "sc09_spatial_score": f"WITH {_SPATIAL} SELECT {r(f'least(greatest(1 / (1 + abs({_U})), 0), 1)', 'score')} FROM sp",
    "sc12_l2_ramp": _effect(_Z, _L2Z, "SELECT " + r("least(greatest(d / 0.8, 0), 1)", "score") + " FROM e"),
}
