"""Fidelity, diversity and privacy measures over two sets of signals; each is a table of one or a few rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.ranks import quantiles
from tidemark.functions.scratch import stored
from tidemark.operators import features as E
from tidemark.operators import pairs as P
from tidemark.operators import transforms as T

HJORTH = ("activity", "mobility", "complexity")


def hjorth_features(signals: DataFrame) -> DataFrame:
    return signals.select("signal_id", "role", E.hjorth(F.col("x")).alias("h")).select("signal_id", "role", *(F.col(f"h.{c}").alias(c) for c in HJORTH))


def unpivoted(features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(role, feature, value)."""
    return features.select("role", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))))


def hjorth_metrics(signals: DataFrame) -> DataFrame:
    """One row: Wasserstein distances (also by the real deviation), Mahalanobis distance, means, relative differences."""
    h = hjorth_features(signals).persist()
    long = unpivoted(h, HJORTH)
    w = stats.compare(long, ["feature"]).select("feature", "w1")
    sd = long.where("role = 'real'").groupBy("feature").agg(F.stddev_pop("value").alias("sd"))
    wide = w.join(sd, "feature").groupBy().agg(*(F.max(F.when(F.col("feature") == c, v)).alias(f"{k}_{c}") for c in HJORTH for k, v in (("wd", F.col("w1")), ("wdn", F.col("w1") / (F.col("sd") + 1e-9)))))
    means = [F.avg(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("real", "synthetic") for c in HJORTH]
    cov = [F.covar_samp(a, b).alias(f"s{x}{y}") for x, a in enumerate(HJORTH) for y, b in enumerate(HJORTH) if x <= y]
    one = h.agg(*means, *cov)
    # the inverse of the pooled covariance, in closed form
    s = {(x, y): F.col(f"s{min(x, y)}{max(x, y)}") + (1e-6 if x == y else 0.0) for x in range(3) for y in range(3)}
    cof = {(x, y): s[(x + 1) % 3, (y + 1) % 3] * s[(x + 2) % 3, (y + 2) % 3] - s[(x + 1) % 3, (y + 2) % 3] * s[(x + 2) % 3, (y + 1) % 3] for x in range(3) for y in range(3)}
    det = sum((s[0, y] * cof[0, y] for y in range(1, 3)), s[0, 0] * cof[0, 0])
    gap = [F.col(f"real_{c}") - F.col(f"synthetic_{c}") for c in HJORTH]
    quad = sum((gap[x] * gap[y] * cof[x, y] for x in range(3) for y in range(3) if x or y), gap[0] * gap[0] * cof[0, 0]) / det
    out = one.withColumns({"mahalanobis": F.sqrt(F.greatest(quad, F.lit(0.0)))} | {f"rel_diff_{c}": (F.col(f"synthetic_{c}") - F.col(f"real_{c}")) / (F.col(f"real_{c}") + 1e-9) for c in HJORTH})
    avg = lambda k: (F.col(f"{k}_activity") + F.col(f"{k}_mobility") + F.col(f"{k}_complexity")) / 3
    both = wide.withColumns({"avg_wd": avg("wd"), "avg_wdn": avg("wdn"), "k": F.lit(1)}).join(out.withColumn("k", F.lit(1)), "k")
    return both.drop("k", *(f"s{x}{y}" for x in range(3) for y in range(x, 3)))


def time_score(metrics: DataFrame, weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """The weighted mean of 1 / (1 + d) over the Hjorth distances and the Mahalanobis distance."""
    ds = [F.col(f"wdn_{c}") for c in HJORTH] + [F.col("mahalanobis")]
    d0 = lambda d: F.when(d.isNull() | F.isnan(d) | (d < 0), 0.0).otherwise(d)
    return metrics.withColumn("score", sum((w / (1 + d0(d)) for w, d in zip(weights[1:], ds[1:], strict=True)), weights[0] / (1 + d0(ds[0]))))


def distance_metrics(signals: DataFrame, metric: str = "l2", normalise: str | None = "zscore_global", length_normalise: bool = True) -> DataFrame:
    """(metric, mean, min, real_idx, synth_idx, rr_mean, d, risk): nearest synthetic of each real signal, against its nearest real one."""
    found = P.nearest(T.normalise(signals, normalise), metric, length_normalise, ("RS", "RR"))
    rs, rr = (F.col("pair_set") == s for s in ("RS", "RR"))
    one = found.agg(
        F.avg(F.when(rs, F.col("d"))).alias("mean"), F.min(F.when(rs, F.struct("d", "i", "j"))).alias("m"), F.avg(F.when(rr, F.col("d"))).alias("rr_mean"), F.stddev_samp(F.when(rr, F.col("d"))).alias("sd")
    )
    d = (F.col("mean") - F.col("rr_mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return one.select(F.lit(metric).alias("metric"), "mean", F.col("m.d").alias("min"), F.col("m.i").alias("real_idx"), F.col("m.j").alias("synth_idx"), "rr_mean", d.alias("d")).withColumn("risk", risk(F.col("d")))


def risk(d):
    """A word for an effect size; below zero synthetic signals lie closer to real ones than those to each other."""
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def coverage(signals: DataFrame, k_sigma: float = 2.0) -> DataFrame:
    """(sigma, radius, coverage, outliers): shares of real signals with a synthetic one within the radius, and the reverse; the
    radius is k_sigma times the median distance between nearest real signals."""
    found = stored(P.nearest(signals, "l2", False, ("RS", "SR", "RR")), "coverage")
    middle = quantiles(found, ["pair_set"], "d", {"sigma": 0.5}).where("pair_set = 'RR'").first()
    sigma = middle["sigma"] if middle else None
    radius = k_sigma * (sigma if sigma is not None else float("nan"))
    share = lambda s: F.avg(F.when(F.col("pair_set") == s, (F.col("d") <= radius).cast("double")))
    return found.agg(F.lit(sigma).cast("double").alias("sigma"), F.lit(radius).alias("radius"), share("RS").alias("coverage"), share("SR").alias("outliers"))


def intrinsic_diversity(signals: DataFrame) -> DataFrame:
    """(uniqueness, global_diversity, local_p10, local_p50): synthetic over real."""
    found = stored(P.nearest(signals, "l2", False, ("RR", "SS")), "diversity")
    nn = found.groupBy("pair_set").agg(F.avg("d").alias("mean")).join(quantiles(found, ["pair_set"], "d", {"p10": 0.1, "p50": 0.5}), "pair_set")
    both = nn.join(P.mean_distances(signals).withColumnRenamed("mean", "pairs"), "pair_set")
    of = lambda s, c: F.max(F.when(F.col("pair_set") == s, F.col(c)))
    return both.agg(*((of("SS", c) / (of("RR", c) + 1e-12)).alias(n) for c, n in (("mean", "uniqueness"), ("pairs", "global_diversity"), ("p10", "local_p10"), ("p50", "local_p50"))))


def correlation_signals(channels: DataFrame) -> DataFrame:
    """(signal_id, role, idx, x): the correlations of each sample's channels, in the order of the pairs of channels that any sample has. A
    channel that a sample lacks correlates 0 with others, like a constant one, so all x are of one length."""
    rho = E.correlations(channels)
    every = rho.agg(F.array_sort(F.collect_set(F.struct("c1", "c2"))).alias("pairs"))
    own = rho.groupBy("sample_id", "role").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("c1", "c2").alias("key"), "rho"))).alias("own"))
    x = F.transform("pairs", lambda p: F.coalesce(F.try_element_at("own", p), F.lit(0.0)))
    return P.indexed(own.crossJoin(F.broadcast(every)).select(F.col("sample_id").alias("signal_id"), "role", x.alias("x")))  # one row of pairs


def spatial(channels: DataFrame) -> DataFrame:
    """One row: mean and deviation of the Frobenius distance between correlation matrices for RR, SS and RS; z and score."""
    d = P.mean_distances(correlation_signals(channels), sets=tuple(P.SETS), scale=math.sqrt(2.0))
    of = lambda s, c: F.max(F.when(F.col("pair_set") == s, F.col(c)))
    one = d.agg(*(of(s, n).alias(f"{s.lower()}_{n}") for s in P.SETS for n in ("mean", "sd")))
    z = (F.col("rs_mean") - F.col("rr_mean")) / F.nullif(F.col("rr_sd"), F.lit(0.0))
    return one.withColumn("z_sc", z).withColumn("f_spatial", 1 / (1 + F.abs("z_sc")))


def mean_frame(signals: DataFrame, k: int = 2) -> DataFrame:
    """signals with pc: k principal components of all signals together, less their mean."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = signals.withColumn("__v", array_to_vector("x"))
    fitted = PCA(k=k, inputCol="__v", outputCol="__pc").fit(rows)
    return fitted.transform(rows).withColumn("pc", vector_to_array("__pc")).drop("__v", "__pc")


def embedding_scores(embedded: DataFrame) -> DataFrame:
    """(overlap, mixing, cov_shape) of a plane embedding (role, idx, x: two numbers)."""
    p = embedded.select("role", F.element_at("x", 1).alias("a"), F.element_at("x", 2).alias("b"))
    of = lambda r, c: F.when(F.col("role") == r, F.col(c))
    one = p.agg(*(F.avg(of(r, c)).alias(f"m_{r}_{c}") for r in ("real", "synthetic") for c in "ab"), *(F.covar_samp(of(r, c), of(r, e)).alias(f"c_{r}_{c}{e}") for r in ("real", "synthetic") for c, e in ("aa", "ab", "bb")))
    c = {k: F.col(f"c_real_{k}") + F.col(f"c_synthetic_{k}") + (0.0 if k == "ab" else 1e-6) for k in ("aa", "ab", "bb")}
    da, db = (F.col(f"m_real_{k}") - F.col(f"m_synthetic_{k}") for k in "ab")
    quad = (da * da * c["bb"] - 2 * da * db * c["ab"] + db * db * c["aa"]) / (c["aa"] * c["bb"] - c["ab"] * c["ab"])
    frob = lambda f: F.sqrt(f("aa") ** 2 + 2 * f("ab") ** 2 + f("bb") ** 2)
    r, s = (lambda k, role=role: F.col(f"c_{role}_{k}") for role in ("real", "synthetic"))
    shape = F.least(F.greatest(1 - frob(lambda k: r(k) - s(k)) / (frob(r) + frob(s) + 1e-12), F.lit(0.0)), F.lit(1.0))

    def kernel(i, j, a, b, wanted):
        d = np.where(wanted, P.l2_matrix(a, b), 0.0)
        return {side: (k, d.sum(axis=axis), wanted.sum(axis=axis)) for side, k, axis in ((False, i, 1), (True, j, 0))}

    def gather(pair_set, found):
        """A row per signal and task, not per signal and two blocks."""
        held: dict[tuple[bool, int], list[np.ndarray]] = {}
        for result in found:
            for side, (i, s, n) in result.items():
                own = held.setdefault((side, int(i[0])), [i.copy(), np.zeros(len(i)), np.zeros(len(i), np.int64)])
                own[1] += s
                own[2] += n
        for (side, _), (i, s, n) in held.items():
            yield {"i": i, "s": s, "n": n, "flipped": np.full(len(i), side)}

    sums = P.pairwise(embedded, kernel, "i long, s double, n long, flipped boolean", size=256, gather=gather)
    own = F.when(F.col("pair_set") == "RR", "real").when(F.col("pair_set") == "SS", "synthetic").when(F.col("flipped"), "synthetic").otherwise("real")
    by = sums.groupBy(own.alias("role"), "i", (F.col("pair_set") == "RS").alias("other")).agg((F.sum("s") / F.sum("n")).alias("d"))
    near = by.groupBy("role", "i").agg(F.max(F.when(~F.col("other"), F.col("d"))).alias("a"), F.max(F.when(F.col("other"), F.col("d"))).alias("b"))
    silhouette = near.select("role", F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("s"))
    mixing = silhouette.agg((1 - F.abs((F.avg(of("real", "s")) + F.avg(of("synthetic", "s"))) / 2)).alias("mixing"), F.lit(1).alias("k"))
    return one.select(F.exp(-0.5 * quad).alias("overlap"), shape.alias("cov_shape"), F.lit(1).alias("k")).join(mixing, "k").drop("k")


def geometry(signals: DataFrame, **options) -> DataFrame:
    """(space, overlap, mixing, cov_shape): the scores of the plane of principal components, "pca", and of the neighbour graph's, "graph"."""
    from tidemark.operators.neighbours import plane

    spaces = {"pca": mean_frame(signals).select("role", "idx", F.col("pc").alias("x")), "graph": plane(signals, **options)}
    scored = (embedding_scores(stored(at, "geometry")).select(F.lit(name).alias("space"), "overlap", "mixing", "cov_shape") for name, at in spaces.items())
    return reduce(DataFrame.unionByName, scored)


def diversity_score(signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(component, value, weight) of twelve components and score, their weighted geometric mean: coverage and outliers, mixing, overlap
    and covariance shape in both planes, and four ratios of intrinsic diversity as min(r, 1 / r). Components that are null are
    left out; weights are given, or follow the entropy of the values."""
    one = stored(signals, "diversity-signals")
    found = {k: v for k, v in coverage(one).first().asDict().items() if k in ("coverage", "outliers")}
    for row in geometry(one).collect():  # two rows
        found |= {f"{row['space']}_{k}": row[k] for k in ("mixing", "overlap", "cov_shape")}
    for k, v in intrinsic_diversity(one).first().asDict().items():
        found[k] = min(v, 1 / v) if v and np.isfinite(v) and v > 0 else None
    kept = {k: float(v) for k, v in found.items() if v is not None and np.isfinite(v)}
    own = [weights[k] for k in kept] if weights else entropy_weights(list(kept.values()))
    rows = signals.sparkSession.createDataFrame([(k, v, float(w)) for (k, v), w in zip(kept.items(), own, strict=True)], "component string, value double, weight double")
    total = geometric_mean(rows).select(F.lit("score").alias("component"), F.col("score").alias("value"), F.lit(1.0).alias("weight"))
    return rows.unionByName(total)


def split(labelled: DataFrame, seed: int = 42) -> DataFrame:
    """The real signals (signal_id, role, label, ...) with member: half of each label (rounded up), drawn by an arithmetic hash of the
    id. Ranks come from ranges, so no label is gathered."""
    from tidemark.functions.ranks import numbered

    real = labelled.where("role = 'real'")
    order = P.arithmetic_hash(F.col("signal_id"), F.lit(1), seed).cast("double") * 1e9 + F.pmod("signal_id", F.lit(10**9))
    sizes = real.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / 2).alias("__half"))
    ranked = numbered(real.withColumn("__order", order), ["label"], "__order", "__rank").join(sizes, "label")
    return ranked.withColumn("member", F.col("__rank") < F.col("__half")).drop("__order", "__rank", "__half")


def membership(labelled: DataFrame, trees: int = 100, seed: int = 42) -> DataFrame:
    """Attacks on a forest trained on half of the real signals (signal_id, role, label, x): accuracies of telling members from others
    by correctness, confidence, entropy and modified entropy, and the share of synthetic signals that look like members."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    real = split(labelled, seed).select(*labelled.columns, "member")
    rows = real.unionByName(labelled.where("role <> 'real'").withColumn("member", F.lit(None).cast("boolean"))).withColumn("__v", array_to_vector("x"))
    model = RandomForestClassifier(featuresCol="__v", labelCol="label", numTrees=trees, seed=seed).fit(rows.where("member"))
    scored = model.transform(rows).select("member", "label", "prediction", vector_to_array("probability").alias("p"))
    return attacks(scored)


def attacks(scored: DataFrame) -> DataFrame:
    """The accuracies from class probabilities (member: true, false, or null for synthetic; label; prediction; p)."""
    log = lambda v: F.log(F.greatest(v, F.lit(1e-30)))
    py = F.element_at("p", F.col("label") + 1)
    entropy = -F.aggregate("p", F.lit(0.0), lambda a, v: a + v * log(v))
    modified = F.aggregate(F.transform("p", lambda v, i: F.when(i == F.col("label"), -(1 - v) * log(v)).otherwise(-v * log(1 - v))), F.lit(0.0), lambda a, v: a + v)
    rows = scored.select("member", (F.col("prediction") == F.col("label")).alias("correct"), F.array_max("p").alias("top"), F.inline(F.array(*(F.struct(F.lit(n).alias("attack"), v.alias("value")) for n, v in (("confidence", py), ("entropy", -entropy), ("modified_entropy", -modified)))))).persist()
    sweep = threshold_accuracy(rows.where("member is not null"))
    wide = sweep.agg(*(F.max(F.when(F.col("attack") == n, F.col("accuracy"))).alias(f"{n}_acc") for n in ("confidence", "entropy", "modified_entropy")), F.lit(1).alias("k"))
    one = rows.where("attack = 'confidence'")
    middle = quantiles(one.where("member"), ["attack"], "top", {"limit": 0.5}).first()
    limit = middle["limit"] if middle else None
    right = lambda m: F.avg(F.when(F.col("member") == m, F.col("correct").cast("double")))
    rest = one.agg(((right(True) + 1 - right(False)) / 2).alias("correctness_acc"), F.avg(F.when(F.col("member").isNull(), (F.col("top") > limit).cast("double"))).alias("synthetic_member_fraction"), F.lit(1).alias("k"))
    return rest.join(wide, "k").drop("k")


def relative_power(power: DataFrame) -> DataFrame:
    """(band, real_mean, synthetic_mean, diff: in percent, n, t, cohens_d, w: the smaller signed-rank sum, ties, n_ranks) from
    power (role, idx, band, rel_power); pairs are equal idx."""
    by = power.groupBy("band").agg(*(F.avg(F.when(F.col("role") == r, F.col("rel_power"))).alias(f"{r}_mean") for r in ("real", "synthetic")))
    by = by.select("band", *((100 * F.col(f"{r}_mean")).alias(f"{r}_mean") for r in ("real", "synthetic")))
    pairs = band_pairs(power)
    t = stats.paired(pairs, ["band"]).select("band", "n", "t", "cohens_d")
    w = stats.signed_rank(pairs, ["band"]).select("band", F.least("w_plus", "w_minus").alias("w"), "ties", F.col("n").alias("n_ranks"))
    return by.withColumn("diff", F.abs(F.col("real_mean") - F.col("synthetic_mean"))).join(t, "band", "left").join(w, "band", "left")


def band_pairs(power: DataFrame) -> DataFrame:
    a, b = (power.where(F.col("role") == r).select("idx", "band", F.col("rel_power").alias(c)) for r, c in (("real", "a"), ("synthetic", "b")))
    return a.join(b, ["idx", "band"])


def relative_power_tests(power: DataFrame, alpha: float = 0.05) -> DataFrame:
    """relative_power() with normality (p of Shapiro-Wilk on the differences), test, p and significant: the paired t-test where
    normality is over alpha, else Wilcoxon's signed ranks. Bands with fewer than two pairs are left out."""
    normal = stats.shapiro_wilk(band_pairs(power).select("band", (F.col("a") - F.col("b")).alias("value")), ["band"]).select("band", F.col("p").alias("normality"))
    student = F.udf(lambda t, n: None if t is None else float(stats.student_p(t, n - 1)), "double")
    ranks = F.udf(lambda w, n, ties: None if w is None else stats.wilcoxon_p(w, n, ties), "double")
    by = relative_power(power).join(normal, "band", "left").where("n >= 2")
    usual = F.coalesce(F.col("normality") > alpha, F.lit(False))
    p = F.when(usual, student("t", "n")).otherwise(ranks("w", "n_ranks", "ties"))
    return by.withColumns({"test": F.when(usual, "Paired t-test").otherwise("Wilcoxon"), "p": p}).withColumn("significant", F.col("p") < alpha)


def privacy_score(labelled: DataFrame, weights: dict[str, float] | None = None, normalise: str | None = "zscore_global", trees: int = 100) -> DataFrame:
    """(component, value, weight) of l2, dtw, mir and score: how far synthetic signals (signal_id, role, idx, label, x) stay from the real
    ones. l2, dtw: the effect size of nearest distances, 0 to 0.8 to 0 to 1; mir: 2 (1 - accuracy of the confidence attack,
    clipped to [0.5, 1]). Components that are null are left out of the score."""
    parts = [distance_metrics(labelled.select("role", "idx", "x"), m, normalise).select(F.lit(m).alias("component"), ramp(F.col("d")).alias("value")) for m in ("l2", "dtw")]
    accuracy = F.least(F.greatest(F.col("confidence_acc"), F.lit(0.5)), F.lit(1.0))
    parts.append(membership(labelled.drop("idx"), trees).select(F.lit("mir").alias("component"), (2 * (1 - accuracy)).alias("value")))
    rows = reduce(DataFrame.unionByName, parts)
    known = {"l2": 1.0, "dtw": 1.0, "mir": 1.0} | (weights or {})
    weight = F.create_map(*(F.lit(v) for kv in known.items() for v in kv))[F.col("component")]
    rows = rows.withColumn("weight", F.when(F.col("value").isNotNull(), weight))
    total = rows.agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))
    return rows.unionByName(total.select(F.lit("score").alias("component"), "value", F.lit(1.0).alias("weight")))


def threshold_accuracy(rows: DataFrame) -> DataFrame:
    """(attack, accuracy): the best (true positive + true negative rate) / 2 of the rule value >= t over all values t."""
    counted = rows.groupBy("attack", F.col("value").alias("v")).agg(F.count_if("member").alias("a"), F.count_if(~F.col("member")).alias("b"))
    from tidemark.functions.ranks import running

    run = running(counted, ["attack"], "v", ["a", "b"]).join(counted.groupBy("attack").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2")), "attack")
    tpr, tnr = 1 - (F.col("run_a") - F.col("a")) / F.col("n1"), (F.col("run_b") - F.col("b")) / F.col("n2")
    return run.groupBy("attack").agg(F.max((tpr + tnr) / 2).alias("accuracy"))


def entropy_weights(values: list[float]) -> list[float]:
    """Weights in proportion to the values, or equal where those say nothing."""
    x = np.clip(np.asarray(values, float), 1e-12, None)
    p = x / x.sum()
    utility = 1 + (p * np.log(p)).sum() / np.log(len(p)) if len(p) > 1 else 1.0
    w = p * utility if utility > 0 else np.ones(len(p))
    return (w / w.sum()).tolist()


def geometric_mean(scores: DataFrame) -> DataFrame:
    """(score) of (value, weight) without nulls; weights are brought to a sum of one, values to [1e-12, 1]."""
    kept = scores.where("value is not null and not isnan(value)")
    v = F.log(F.least(F.greatest("value", F.lit(1e-12)), F.lit(1.0)))
    return kept.agg(F.exp(F.sum(F.col("weight") * v) / F.sum("weight")).alias("score"))


def similarity_of_ratio(r):
    """min(r, 1 / r)."""
    return F.exp(-F.abs(F.log(F.greatest(r, F.lit(1e-12)))))


def ramp(d, top: float = 0.8):
    return F.least(F.greatest(d / top, F.lit(0.0)), F.lit(1.0))


