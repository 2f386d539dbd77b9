"""Pairs of signals: real-real (RR), real-synthetic (RS), synthetic-synthetic (SS).

Pairings by position are equi-joins on idx. All-against-all metrics run over blocks: signals are packed into
matrices of some hundred rows and stored once; every partition of blocks is read beside every other, so nothing that grows with
the pairs is shuffled, and a kernel works on two matrices. What is per signal (spectra, residuals) is computed before, once per signal.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import release, stored
from tidemark.sources.signals import indexed  # noqa: F401  also read as pairs.indexed

SETS = {"RR": ("real", "real"), "RS": ("real", "synthetic"), "SS": ("synthetic", "synthetic")}


def zip_pairs(signals: DataFrame, pair_set: str, strategy: str = "consecutive") -> DataFrame:
    """(pair_set, i, j) of idx. RS: equal positions. RR, SS: "consecutive" (0, 1), (2, 3)...; "halves" (k, k + n // 2); "chain" (k, k + 1)."""
    own = signals.select("role", "idx")
    if pair_set == "RS":
        i, j = (own.where(F.col("role") == r).select(F.col("idx").alias(c)) for r, c in (("real", "i"), ("synthetic", "j")))
        return i.join(j, F.col("i") == F.col("j")).select(F.lit("RS").alias("pair_set"), "i", "j")
    own = own.where(F.col("role") == SETS[pair_set][0])
    match strategy:
        case "consecutive":
            step, fit = F.lit(1), F.pmod("idx", F.lit(2)) == 0
        case "chain":
            step, fit = F.lit(1), F.lit(True)
        case "halves":
            half = own.count() // 2
            step, fit = F.lit(half), F.col("idx") < half
        case _:
            raise ValueError(f"unknown pairing {strategy!r}")
    i = own.where(fit).select(F.col("idx").alias("i"), (F.col("idx") + step).alias("j"))
    return i.join(own.select(F.col("idx").alias("j")), "j").select(F.lit(pair_set).alias("pair_set"), "i", "j")


def all_pairs(signals: DataFrame, pair_set: str, block: int = 1024) -> DataFrame:
    """(pair_set, i, j): RS every pair, RR and SS i < j. Blocks of idx are stored once; every partition of blocks is read beside every
    other, and each two blocks write their pairs where they meet, so no row is sorted or shuffled for a pair."""
    left, right = SETS[pair_set]
    own = signals.where(F.col("role").isin(left, right)).select("role", "idx", F.expr(f"idx div {block}").alias("b"))
    packed = own.groupBy("role", "b").agg(F.collect_list("idx").alias("own"))  # a block's idx at most
    packed = stored(packed.repartition(max(8, signals.sparkSession.sparkContext.defaultParallelism)), "pair-blocks")
    a = packed.where(F.col("role") == left).select(F.col("b").alias("p"), F.col("own").alias("a"))
    b = packed.where(F.col("role") == right).select(F.col("b").alias("q"), F.col("own").alias("b"))
    same = left == right
    met = a.join(b.hint("shuffle_replicate_nl"), F.col("p") <= F.col("q") if same else F.lit(True))
    out = met.withColumn("i", F.explode("a")).select("i", F.explode("b").alias("j"))
    return (out.where("i < j") if same else out).select(F.lit(pair_set).alias("pair_set"), "i", "j")


def arithmetic_hash(i: Column, j: Column, seed: int = 0) -> Column:
    """A deterministic order for samples of pairs, the same in any engine."""
    return (i * 7919 + j * 104729 + seed * 15485863 + i * j * 31) % 1000003


#: Pairs in a sample of each set.
SAMPLE_CAPS = {"RR": 20_000, "RS": 40_000, "SS": 20_000}


def sample_pairs(signals: DataFrame, pair_set: str, cap: int | None = None) -> DataFrame:
    """(pair_set, i, j): cap of all pairs (RS: any, RR and SS: i < j), all if there are no more; none twice.

    Only the drawn pairs are formed. Draw k takes pair number k * step modulo the number of pairs; step has no divisor in
    common with it, so numbers do not recur, and lies near its golden section, which spreads them evenly.
    Pairs within a role are numbered by distance around the circle of its signals.
    """
    counts = {r["role"]: r["count"] for r in signals.groupBy("role").count().collect()}
    n, m = (counts.get(role, 0) for role in SETS[pair_set])
    total = n * m if pair_set == "RS" else n * (n - 1) // 2
    step = next(s for s in itertools.count(1 + total * 618_034 // 1_000_000) if math.gcd(s, total) == 1) if total else 1
    draws = min(SAMPLE_CAPS[pair_set] if cap is None else cap, total)
    number = F.expr(f"cast(cast(id as decimal(10, 0)) * cast({step} as decimal(20, 0)) % cast({max(total, 1)} as decimal(20, 0)) as long)")
    k = signals.sparkSession.range(draws).select(number.alias("p"))
    if pair_set == "RS":
        i, j = F.expr(f"p div {max(m, 1)}"), F.expr(f"p % {max(m, 1)}")
    else:
        one, other = F.expr(f"p % {max(n, 1)}"), F.expr(f"(p % {max(n, 1)} + p div {max(n, 1)} + 1) % {max(n, 1)}")
        i, j = F.least(one, other), F.greatest(one, other)
    return k.select(F.lit(pair_set).alias("pair_set"), i.alias("i"), j.alias("j"))


def sample_with_replacement(spark, n: int, draws: int) -> DataFrame:
    """(k, i, j): for each of so many draws two numbers under n, each by 60 bits of a hash of its own; draws of a number with itself are
    left out."""
    draw = lambda side: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(side))), 1, 15), 16, 10).cast("long") % max(n, 1)
    out = spark.range(draws if n else 0).select(F.col("id").alias("k"), draw("i").alias("i"), draw("j").alias("j"))
    return out.where("i <> j")


def pairs(signals: DataFrame, pair_set: str, mode: str = "all_vs_all", strategy: str = "consecutive") -> DataFrame:
    """mode "zip", "all_vs_all" or "auto" (zip if both roles have as many signals)."""
    if mode == "auto":
        counts = {r["role"]: r["count"] for r in signals.groupBy("role").count().collect()}
        mode = "zip" if len(set(counts.values())) == 1 and len(counts) == 2 else "all_vs_all"
    if mode not in ("zip", "all_vs_all"):
        raise ValueError(f"unknown mode {mode!r}")
    return zip_pairs(signals, pair_set, strategy) if mode == "zip" else all_pairs(signals, pair_set)


def attach(pair_rows: DataFrame, signals: DataFrame, *columns: str) -> DataFrame:
    """pair_rows with left and right structs of the given columns."""
    out = pair_rows
    for side, place in (("left", 0), ("right", 1)):
        role = F.create_map(*(F.lit(v) for k, r in SETS.items() for v in (k, r[place])))[F.col("pair_set")]
        own = signals.select(F.col("role").alias("__role"), F.col("idx").alias("__idx"), F.struct(*columns).alias(side))
        out = out.join(own, (role == F.col("__role")) & (F.col("i" if side == "left" else "j") == F.col("__idx"))).drop("__role", "__idx")
    return out


def blocks(signals: DataFrame, size: int) -> DataFrame:
    """(role, block, idx, data): signals (role, idx, x) as matrices of up to `size` rows; all of one length."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("idx").combine_chunks()
        data = np.stack(group.column("x").combine_chunks().to_numpy(zero_copy_only=False)).astype(float)
        return pa.table({"role": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int64()), "idx": pa.array([group.column("idx").to_numpy().astype(np.int64).tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

    slim = signals.select("role", "idx", "x", F.expr(f"idx div {size}").alias("block"))
    return slim.groupBy("role", "block").applyInArrow(run, "role string, block long, idx binary, data binary")


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict]


def pairwise(signals: DataFrame, kernel: Kernel, schema: str, sets: tuple[str, ...] = ("RR", "RS", "SS"), size: int = 256, both_ways: bool = False, own: bool = False, gather: Callable[[str, Iterator[dict]], Iterator[dict]] | None = None, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows (pair_set, schema) of kernel(i, j, A, B, wanted) for every pair of blocks. What prepare() makes of matrices
    takes their places; it is made in the task, once for the blocks that follow each other beside A, so that signals travel and not what
    is made of them.

    i, j: idx of the rows of A and B; wanted: which pairs count (all of RS; of RR and SS those with i < j, or i <> j if
    both_ways, or i <= j if own). The kernel returns columns by name; gather(pair_set, results) may take a task's results together.
    """
    packed = stored(blocks(signals, size).repartition(max(8, signals.sparkSession.sparkContext.defaultParallelism)), "blocks")
    out = None
    for pair_set in sets:
        left, right = SETS[pair_set]
        same = left == right
        a = packed.where(F.col("role") == left).select(F.col("block").alias("p"), F.col("idx").alias("i"), F.col("data").alias("a"))
        b = packed.where(F.col("role") == right).select(F.col("block").alias("q"), F.col("idx").alias("j"), F.col("data").alias("b"))

        def results(batches: Iterator[pa.RecordBatch], same=same) -> Iterator[dict]:
            last, made = None, None
            for batch in batches:
                for i, a, j, b in zip(*(batch.column(c) for c in ("i", "a", "j", "b")), strict=True):
                    i, j = (np.frombuffer(v.as_buffer(), np.int64) for v in (i, j))
                    a, b = (np.frombuffer(v.as_buffer(), float).reshape(len(k), -1) for v, k in ((a, i), (b, j)))
                    near = np.less_equal if own else np.not_equal if both_ways else np.less
                    wanted = near(i[:, None], j[None]) if same else np.ones((len(i), len(j)), bool)
                    if not wanted.any():
                        continue
                    if prepare:
                        if last != i[0]:
                            last, made = i[0], prepare(a)
                        a, b = made, prepare(b)
                    yield kernel(i, j, a, b, wanted)

        def run(batches: Iterator[pa.RecordBatch], results=results, pair_set=pair_set) -> Iterator[pa.RecordBatch]:
            found = results(batches)
            yield from map(pa.RecordBatch.from_pydict, gather(pair_set, found) if gather else found)

        met = a.join(b.hint("shuffle_replicate_nl"), F.lit(True) if both_ways or not same else F.col("p") <= F.col("q"))
        found = met.select("i", "a", "j", "b").mapInArrow(run, schema).withColumn("pair_set", F.lit(pair_set))
        out = found if out is None else out.unionByName(found)
    return out


def l2_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; close pairs by their differences."""
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d = np.maximum(na[:, None] + nb[None] - 2 * (a @ b.T), 0)
    for i, j in np.argwhere(d < 1e-5 * (na[:, None] + nb[None])):
        d[i, j] = ((a[i] - b[j]) ** 2).sum()
    return np.sqrt(d)


def cosine_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return 1 - np.clip(unit(a) @ unit(b).T, -1, 1)


def dtw_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic time warping, absolute differences, no window: all pairs at once, one diagonal after the other."""
    n, m, t, u = len(a), len(b), a.shape[1], b.shape[1]
    two, one = np.full((n, m, t + 1), np.inf), np.full((n, m, t + 1), np.inf)
    two[:, :, 0] = 0.0  # cell (0, 0)
    for k in range(2, t + u + 1):
        lo, hi = max(1, k - u), min(t, k - 1)
        rows = np.arange(lo, hi + 1)
        cost = np.abs(a[:, None, rows - 1] - b[None, :, k - rows - 1])
        now = np.full((n, m, t + 1), np.inf)
        now[:, :, rows] = cost + np.minimum(np.minimum(one[:, :, rows - 1], one[:, :, rows]), two[:, :, rows - 1])
        two, one = one, now
    return one[:, :, t]


#: name: (kernel, whether distances are divided by the root of the length, signals in a block)
METRICS = {"l2": (l2_matrix, True, 256), "cosine": (cosine_matrix, False, 256), "dtw": (dtw_matrix, True, 32)}


def nearest(signals: DataFrame, metric: str = "l2", length_normalise: bool = True, sets: tuple[str, ...] = ("RS", "RR")) -> DataFrame:
    """(pair_set, i, d, j): the nearest other signal of each left signal; the first of equals. SR: of each synthetic signal among real ones.

    Euclidean and cosine distances are pruned by pivots; warping distances by bounds, see neighbours.py and warping.py."""
    from tidemark.operators.neighbours import nearest_k
    from tidemark.operators.warping import nearest_warped

    if metric == "dtw":
        found = nearest_warped(signals, sets)
    else:
        found = nearest_k(signals, 1, sets, metric == "cosine", METRICS[metric][2])
    scale = METRICS[metric][1] and length_normalise
    width = signals.select(F.size("x").alias("w")).first() if scale else None
    return found.select("pair_set", "i", (F.col("d") / math.sqrt(width["w"]) if width else F.col("d")).alias("d"), "j")


def distances(signals: DataFrame, metric: str = "l2", sets: tuple[str, ...] = ("RR", "RS", "SS")) -> DataFrame:
    """(pair_set, i, j, d) of all pairs."""
    matrix, _, size = METRICS[metric]

    def kernel(i, j, a, b, wanted):
        d = matrix(a, b)
        x, y = np.nonzero(wanted)
        return {"i": i[x], "j": j[y], "d": d[x, y]}

    return pairwise(signals, kernel, "i long, j long, d double", sets, size)


def moments(values: np.ndarray) -> dict[str, np.ndarray]:
    """n, mean and m2, the sum of squared deviations, as one row."""
    mean = values.mean() if len(values) else 0.0
    return {"n": np.array([len(values)]), "mean": np.array([float(mean)]), "m2": np.array([float(((values - mean) ** 2).sum())])}


def pooled(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, mean, m2) of rows of moments() taken together."""
    totals = parts.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("__in"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("__sq"))
    between = F.greatest(F.col("__sq") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    return totals.select(*keys, "n", "mean", (F.col("__in") + between).alias("m2"))


def mean_distances(signals: DataFrame, metric: str = "l2", sets: tuple[str, ...] = ("RR", "SS"), scale: float = 1.0) -> DataFrame:
    """(pair_set, n, mean, sd: of the population) of scaled distances over all pairs; a row per pair of blocks leaves the kernel."""
    matrix, _, size = METRICS[metric]
    found = pairwise(signals, lambda i, j, a, b, wanted: moments(scale * matrix(a, b)[wanted]), "n long, mean double, m2 double", sets, size)
    return pooled(found, "pair_set").select("pair_set", "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("sd"))


def total_distances(signals: DataFrame, metric: str = "l2", sets: tuple[str, ...] = ("RR", "RS", "SS")) -> DataFrame:
    """(pair_set, i, total) over all pairs; a row per signal and block leaves the kernel, and is added up within its task."""
    matrix, _, size = METRICS[metric]

    def kernel(i, j, a, b, wanted):
        some = wanted.any(axis=1)
        return {"i": i[some], "s": np.where(wanted, matrix(a, b), 0.0).sum(axis=1)[some]}

    return pairwise(signals, kernel, "i long, s double", sets, size).groupBy("pair_set", "i").agg(F.sum("s").alias("total"))


#: Values that a task holds before it sends them on, and that a range takes.
HELD, RANGE = 1 << 21, 1 << 20
#: Values that are shuffled together; beyond, each key takes a round of its own.
SHUFFLED = 1 << 28


def _counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    order = np.argsort(values, kind="stable")
    v, c = values[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, int)
    return v[starts], np.add.reduceat(c, starts) if len(v) else c


def _weighted(v: np.ndarray, c: np.ndarray) -> tuple[int, float, float]:
    n = int(c.sum())
    mean = float((v * c).sum() / n)
    return n, mean, float((c * (v - mean) ** 2).sum())


def _packed(values: np.ndarray) -> bytes:
    """Values in order as the steps between their bit patterns, byte by byte: steps are small, so compression takes the upper bytes away."""
    return np.diff(values.view(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()).view(float)


def compared(signals: DataFrame, kernel: Callable, keys: list[str], size: int, own: bool = False, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, pair_set, n, mean, sd, u, delta, n1, n2, ties): summaries of the values of all pairs, and RR against RS by Mann-Whitney's U
    and Cliff's delta, as stats.compare() has them. kernel(i, j, A, B, wanted) returns {key: (values, counts)} of finite values; with several
    keys it also takes the argument keys, those to return.

    Pairs are formed once. A task sends its values of RR and RS on as sorted arrays, by ranges of some million values. The ranges come
    from the values of the first block of each role (any ranges give the same result); what lies in lower ranges is a small table.
    """
    first = pairwise(signals.where(F.col("idx") < size), lambda *block: {"key": list((got := kernel(*block))), "v": [np.asarray(v[0], float).tobytes() for v in got.values()]}, "key string, v binary", ("RR", "RS"), size, own=own, prepare=prepare)
    drawn: dict[str, list] = {k: [] for k in keys}
    for r in first.collect():  # two pairs of blocks
        drawn[r["key"]].append(np.frombuffer(r["v"], float))
    sides = {r["role"]: r["count"] for r in signals.groupBy("role").count().collect()}
    n, m = sides.get("real", 0), sides.get("synthetic", 0)
    steps = np.linspace(0, 1, min(4096, (n * m + n * n // 2) // RANGE + 1) + 1)[1:-1]
    cuts = {k: np.quantile(np.concatenate(v), steps) if len(steps) and sum(map(len, v)) else np.zeros(0) for k, v in drawn.items()}

    def gather(pair_set: str, found: Iterator[dict]) -> Iterator[dict]:
        held: dict[str, list] = {}

        def sent() -> Iterator[dict]:
            for key, parts in held.items():
                v, c = _counted(*(np.concatenate(p) for p in zip(*parts, strict=True)))
                if not len(v):
                    continue
                if pair_set == "SS":
                    rows = [(-1, *_weighted(v, c), b"", b"")]
                else:
                    ends = [0, *np.searchsorted(v, cuts[key], "right"), len(v)]
                    rows = [(b, *_weighted(v[x:y], c[x:y]), _packed(v[x:y]), c[x:y].tobytes() if (c[x:y] > 1).any() else b"") for b, (x, y) in enumerate(itertools.pairwise(ends)) if y > x]
                yield {"key": [key] * len(rows)} | dict(zip(("bin", "n", "mean", "m2", "v", "c"), map(list, zip(*rows, strict=True)), strict=True))

        total = 0
        for result in found:
            for key, (v, c) in result.items():
                held.setdefault(key, []).append((v, c))
                total += len(v)
            if total >= HELD:
                yield from sent()
                held, total = {}, 0
        yield from sent()

    schema = "key string, bin long, n long, mean double, m2 double, v binary, c binary"

    def rank(key: tuple, group: pa.Table) -> pa.Table:
        sides, out = {}, {c: [] for c in ("key", "bin", "pair_set", "n", "mean", "m2", "less", "more", "ties")}
        for name in SETS:
            rows = [r for r in group.to_pylist() if r["pair_set"] == name]
            if not rows:
                continue
            counts = np.array([r["n"] for r in rows], float)
            mean = (counts * [r["mean"] for r in rows]).sum() / counts.sum()
            m2 = sum(r["m2"] for r in rows) + (counts * (np.array([r["mean"] for r in rows]) - mean) ** 2).sum()
            if rows[0]["v"]:
                v = [_unpacked(r["v"]) for r in rows]
                sides[name] = _counted(np.concatenate(v), np.concatenate([np.frombuffer(r["c"], np.int64) if r["c"] else np.ones(len(x), np.int64) for r, x in zip(rows, v, strict=True)]))
            for c, value in zip(out, (key[0].as_py(), key[1].as_py(), name, int(counts.sum()), mean, m2, 0.0, 0.0, 0.0), strict=True):
                out[c].append(value)
        if "RR" in sides and "RS" in sides:
            (v, c), (w, e) = sides["RR"], sides["RS"]
            run = np.concatenate([[0], np.cumsum(e)])
            below, upto = run[np.searchsorted(w, v, "left")], run[np.searchsorted(w, v, "right")]
            out["less"][0], out["more"][0] = float((c * below.astype(float)).sum()), float((c * (run[-1] - upto).astype(float)).sum())
        if sides:
            both = _counted(*(np.concatenate(p) for p in zip(*sides.values(), strict=True)))[1].astype(float)
            out["ties"][0] = float((both**3 - both).sum())
        return pa.table({c: pa.array(v, {"key": pa.string(), "bin": pa.int64(), "pair_set": pa.string(), "n": pa.int64()}.get(c, pa.float64())) for c, v in out.items()})

    rounds = [keys] if len(keys) == 1 or (n * m + n * n // 2) * len(keys) <= SHUFFLED else [[key] for key in keys]
    tables = []
    for chosen in rounds:  # one key's values are on disk at a time
        packed = pairwise(signals, kernel if len(rounds) == 1 else functools.partial(kernel, keys=tuple(chosen)), schema, tuple(SETS), size, own=own, gather=gather, prepare=prepare)
        tables.append(stored(packed.groupBy("key", "bin").applyInArrow(rank, "key string, bin long, pair_set string, n long, mean double, m2 double, less double, more double, ties double"), "ranges"))
        del packed
        if len(rounds) > 1:
            release(signals.sparkSession)
    parts = functools.reduce(DataFrame.unionByName, tables)
    by = pooled(parts, "key", "pair_set").select("key", "pair_set", "n", "mean", F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0))).alias("sd"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("pair_set") == s, F.col("n"))), F.lit(0)).cast("double")
    bins = parts.where("bin >= 0").groupBy("key", "bin").agg(of("RR").alias("a"), of("RS").alias("b"), F.sum("less").alias("less"), F.sum("more").alias("more"), F.sum("ties").alias("ties"))
    before = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bins = bins.withColumn("under", F.coalesce(F.sum("b").over(before), F.lit(0.0))).withColumn("total", F.sum("b").over(Window.partitionBy("key")))
    less, more = F.sum(F.col("a") * F.col("under") + F.col("less")), F.sum(F.col("a") * (F.col("total") - F.col("under") - F.col("b")) + F.col("more"))
    n1, n2 = F.sum("a"), F.sum("b")
    tests = bins.groupBy("key").agg(((less - more) / (n1 * n2)).alias("delta"), ((n1 * n2 + less - more) / 2).alias("u"), n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), F.sum("ties").alias("ties")).where("n1 > 0 and n2 > 0")
    return by.join(tests, "key", "left")
