"""Exact nearest neighbours by pivots, and the neighbour-graph embedding in the plane that rests on them.

Signals are dealt to the nearest of a bounded number of pivots (a cell), and within a cell by their distance to it (a slab).
Rows of a slab are packed into units, small matrices. A query's k-th distance within its own unit, or a bound from the cells'
radii, limits where closer signals can lie: by the triangle inequality a slab whose distances to its pivot are all farther
than that limit from the query's own distance to it is never met. Units are stored in blocks; every partition of queries is read
beside every partition of blocks, so no query is sent to the slabs it asks, and a task keeps only its k nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored

#: At most so many pivots, and slabs to a cell.
PIVOTS, SLABS = 256, 16
#: Units that meet at a time.
SPAN = 8
ROLES = {"RR": ("real", "real"), "RS": ("real", "synthetic"), "SR": ("synthetic", "real"), "SS": ("synthetic", "synthetic")}


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Queries:
    """A block of queries with the k nearest that it has met, and how far a nearer one can lie."""

    def __init__(self, block: int, i: np.ndarray, x: np.ndarray, to_pivots: np.ndarray, near: np.ndarray, reach: np.ndarray, k: int):
        self.block, self.i, self.x, self.to_pivots, self.k = block, i, x, to_pivots, k
        self.near, self.reach = near.copy(), reach.copy()  # in the metric; where the triangle inequality holds
        self.row, self.j, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    @staticmethod
    def _over(limit: np.ndarray) -> np.ndarray:
        return limit + 1e-9 * (1 + np.where(np.isfinite(limit), limit, 0))

    def open(self, cell: int, lo: float, hi: float) -> np.ndarray:
        """The queries to which a row of the cell, between lo and hi from its pivot, may be near."""
        own, limit = self.to_pivots[:, cell], self._over(self.reach)
        return np.flatnonzero((own - hi <= limit) & (lo - own <= limit))

    def add(self, few: np.ndarray, d: np.ndarray, j: np.ndarray, y: np.ndarray, exact, flat) -> None:
        limit = self._over(self.near[few])
        passed = d <= limit[:, None]
        if d.shape[1] > self.k and passed.sum() > 8 * self.k * len(few):
            limit = np.minimum(limit, self._over(np.partition(d, self.k - 1, axis=1)[:, self.k - 1]))
            passed = d <= limit[:, None]
        r, c = np.nonzero(passed & np.isfinite(d))
        if not len(r):
            return
        row, j, d = np.concatenate([self.row, few[r]]), np.concatenate([self.j, j[c]]), np.concatenate([self.d, exact(self.x[few[r]], y[c])])
        order = np.lexsort((j, d, row))
        row, j, d = row[order], j[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.near[row[last]] = np.minimum(self.near[row[last]], d[last])
        self.reach[row[last]] = np.minimum(self.reach[row[last]], flat(d[last]))
        kept = place < self.k
        self.row, self.j, self.d = row[kept], j[kept], d[kept]

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"i": self.i[self.row], "j": self.j, "d": self.d})


def nearest_k(signals: DataFrame, k: int = 1, sets: tuple[str, ...] = ("RR",), cosine: bool = False, size: int = 256, compared: Accumulator | None = None) -> DataFrame:
    """(pair_set, i, j, d): the k nearest other signals of each signal (role, idx, x), equal distances by j; Euclidean, or one minus
    the cosine. All signals are of one length. `compared` counts the pairs whose distance is computed to decide."""
    from tidemark.operators.pairs import cosine_matrix, l2_matrix

    rows = stored(signals.select("role", F.col("idx").cast("long").alias("idx"), "x"), "neighbours")
    n = rows.count()
    first = rows.select(F.size("x").alias("w")).first()
    if not first:
        return rows.select(F.lit("RR").alias("pair_set"), F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(0.0).alias("d"))
    width = first["w"]
    metric = cosine_matrix if cosine else l2_matrix

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows to the rows beside them, the same wherever a pair meets."""
        if not cosine:
            return np.sqrt(((a - b) ** 2).sum(axis=1))
        return 1 - np.clip((placed(a) * placed(b)).sum(axis=1), -1, 1)

    def placed(x: np.ndarray) -> np.ndarray:
        """Where the triangle inequality holds and distances have the order of the metric's."""
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if cosine else x

    def flat(d: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * d, 0)) if cosine else d

    n_pivots = max(1, min(PIVOTS, n // (4 * size)))
    drawn = rows.orderBy(F.xxhash64("role", "idx"), "role", "idx").limit(n_pivots).select("x").collect()
    pivots = placed(np.array([r["x"] for r in drawn], float))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = l2_matrix(placed(_matrix(batch.column("x"), width)), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1) if len(d) else np.zeros(0))], ["role", "idx", "x", "cell", "dist"])

    assigned = stored(rows.mapInArrow(assign, "role string, idx long, x array<double>, cell int, dist double"), "neighbours-cells")
    steps = [(s + 1) / SLABS for s in range(SLABS - 1)]
    cuts = assigned.groupBy("cell").agg(F.percentile_approx("dist", steps, 1000).alias("cuts"), F.greatest(F.lit(1), F.least(F.lit(SLABS), F.expr(f"count(1) div {4 * size}"))).alias("slabs"))
    cuts = rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # once: approximate quantiles may differ when computed again
    slab = F.expr(f"size(filter(cuts, c -> c < dist)) * slabs div {SLABS}").cast("int")
    dealt = assigned.join(F.broadcast(cuts), "cell").withColumn("slab", slab).drop("cuts", "slabs")  # a row a pivot
    counts = dealt.groupBy("role", "cell", "slab").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    known = counts.collect()  # PIVOTS x SLABS x 2 rows at most
    places, filled = [], {}
    for r in sorted(known, key=lambda r: (r["role"], r["cell"], r["slab"])):  # neighbouring slabs share a block
        places.append((r["role"], r["cell"], r["slab"], -(-r["n"] // size), filled.get(r["role"], 0)))
        filled[r["role"]] = places[-1][4] + r["n"]
    sized = rows.sparkSession.createDataFrame(places, "role string, cell int, slab int, chunks int, before long")
    chunk = F.pmod(F.xxhash64("idx"), F.col("chunks")).cast("int")
    dealt = dealt.join(F.broadcast(sized), ["role", "cell", "slab"]).withColumn("chunk", chunk).withColumn("block", F.expr(f"(before + chunk * {size}) div {SPAN * size}"))

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        order = np.argsort(group.column("idx").to_numpy())
        x = _matrix(group.column("x").combine_chunks(), width)[order]
        own = {"role": key[0].as_py(), "cell": key[1].as_py(), "slab": key[2].as_py(), "chunk": key[3].as_py(), "block": key[4].as_py(), "idx": group.column("idx").to_numpy()[order].tobytes(), "x": x.tobytes()}
        return pa.Table.from_pylist([own], schema=pa.schema([("role", pa.string()), ("cell", pa.int32()), ("slab", pa.int32()), ("chunk", pa.int32()), ("block", pa.int64()), ("idx", pa.binary()), ("x", pa.binary())]))

    keys = ("role", "cell", "slab", "chunk", "block")
    units = stored(dealt.select(*keys, "idx", "x").groupBy(*keys).applyInArrow(pack, "role string, cell int, slab int, chunk int, block long, idx binary, x binary"), "neighbours-units")
    parts = max(8, rows.sparkSession.sparkContext.defaultParallelism)

    def decode(i: pa.Scalar, x: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(x.as_buffer(), float).reshape(-1, width)

    def joined(key: tuple, group: pa.Table) -> pa.Table:
        """The units of a block in a row, in the order of their cells and slabs."""
        group = group.sort_by([("cell", "ascending"), ("slab", "ascending"), ("chunk", "ascending")])
        idx = [np.frombuffer(v, np.int64) for v in group.column("idx").to_pylist()]
        own = {"block": key[0].as_py(), "cells": group.column("cell").to_numpy().astype(np.int64).tobytes(), "slabs": group.column("slab").to_numpy().astype(np.int64).tobytes(), "sizes": np.array([len(v) for v in idx], np.int64).tobytes(), "idx": b"".join(group.column("idx").to_pylist()), "x": b"".join(group.column("x").to_pylist())}
        own["near"] = b"".join(group.column("near").to_pylist()) if "near" in group.column_names else b""
        return pa.Table.from_pylist([own], schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("cells", "slabs", "sizes", "idx", "x", "near"))]))

    block = "block long, cells binary, slabs binary, sizes binary, idx binary, x binary, near binary"
    targets = {among: stored(units.where(F.col("role") == among).drop("role").groupBy("block").applyInArrow(joined, block).repartition(parts), "neighbours-targets") for among in {ROLES[s][1] for s in sets}}
    out = None
    for pair_set in sets:
        of, among = ROLES[pair_set]
        same = of == among
        asked = units.where(F.col("role") == of).drop("role")
        held = units.where(F.col("role") == among).select("cell", "slab", "chunk", F.col("idx").alias("ti"), F.col("x").alias("tx"))
        slabs = [r for r in known if r["role"] == among]
        bounds = {(r["cell"], r["slab"]): (r["lo"], r["hi"]) for r in slabs}
        whole = {c: (sum(r["n"] for r in slabs if r["cell"] == c), max(r["hi"] for r in slabs if r["cell"] == c)) for c in {r["cell"] for r in slabs}}
        full = np.array([c for c, (m, _) in whole.items() if m > k], int)
        radius = np.array([whole[c][1] for c in full.tolist()])

        def distance(i, x, j, y, same=same):
            d = metric(x, y)
            if compared is not None:
                compared.add(d.size)
            return np.where(i[:, None] == j[None], np.inf, d) if same else d

        def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Beside each query the k-th distance within its own unit, or infinity."""
            for batch in batches:
                near = []
                for r in range(batch.num_rows):
                    i, x = decode(batch.column("idx")[r], batch.column("x")[r])
                    kth = np.full(len(i), np.inf)
                    if batch.column("ti")[r].is_valid:
                        d = distance(i, x, *decode(batch.column("ti")[r], batch.column("tx")[r]))
                        if d.shape[1] >= k:
                            kth = np.partition(d, k - 1, axis=1)[:, k - 1]
                    near.append(kth.tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cell", "slab", "chunk", "block", "idx", "x")), pa.array(near, pa.binary())], ["cell", "slab", "chunk", "block", "idx", "x", "near"])

        def meet(batches: Iterator[pa.RecordBatch], bounds=bounds, full=full, radius=radius, distance=distance) -> Iterator[pa.RecordBatch]:
            """The k nearest of a block's queries among the blocks that follow each other beside it; limits sink on the way."""
            own = None
            for batch in batches:
                for r in range(batch.num_rows):
                    if own is None or batch.column("block")[r].as_py() != own.block:
                        if own is not None:
                            yield own.found()
                        i, x = decode(batch.column("idx")[r], batch.column("x")[r])
                        to_pivots = l2_matrix(placed(x), pivots)
                        near = np.frombuffer(batch.column("near")[r].as_buffer(), float)
                        reach = np.minimum(flat(near), (to_pivots[:, full] + radius).min(axis=1) if len(full) else np.inf)
                        own = _Queries(batch.column("block")[r].as_py(), i, x.copy(), to_pivots, near, reach, k)
                    cells, slabs, sizes = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in ("cells", "slabs", "sizes"))
                    j, y = decode(batch.column("ti")[r], batch.column("tx")[r])
                    lo, hi = np.array([bounds[key] for key in zip(cells.tolist(), slabs.tolist(), strict=True)]).T
                    ends = np.cumsum(sizes)
                    for u in range(len(cells)):
                        few = own.open(cells[u], lo[u], hi[u])
                        if len(few):
                            to = slice(ends[u] - sizes[u], ends[u])
                            own.add(few, distance(own.i[few], own.x[few], j[to], y[to]), j[to], y[to], exact, flat)
            if own is not None:
                yield own.found()

        queries = asked.join(held, ["cell", "slab", "chunk"], "left").select(*keys[1:], "idx", "x", "ti", "tx").mapInArrow(limits, "cell int, slab int, chunk int, block long, idx binary, x binary, near binary")
        left = stored(queries.groupBy("block").applyInArrow(joined, block).repartition(parts), "neighbours-queries").select("block", "idx", "x", "near")
        right = targets[among].select("cells", "slabs", "sizes", F.col("idx").alias("ti"), F.col("x").alias("tx"))
        found = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(meet, "i long, j long, d double")
        best = found.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("r") <= k)
        best = best.select(F.lit(pair_set).alias("pair_set"), "i", "j", "d")
        out = best if out is None else out.unionByName(best)
    return out


def curve(spread: float = 1.0, min_dist: float = 0.1) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), fitted by least squares to 1 up to min_dist and a decay of the given spread beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p, damping = np.array([1.0, 1.0]), 1e-2
    value = lambda p: 1 / (1 + p[0] * d ** (2 * p[1]))
    for _ in range(200):
        f = value(p)
        slopes = -(f**2)[:, None] * np.stack([d ** (2 * p[1]), 2 * p[0] * np.log(d) * d ** (2 * p[1])], axis=1)
        step = np.linalg.solve(slopes.T @ slopes + damping * np.eye(2), slopes.T @ (want - f))
        better = ((want - value(p + step)) ** 2).sum() < ((want - f) ** 2).sum()
        p, damping = (p + step, damping / 3) if better else (p, damping * 5)
    return float(p[0]), float(p[1])


def fuzzy_graph(neighbours: DataFrame, k: int) -> DataFrame:
    """(i, j, w) for i < j from (i, j, d), the k nearest others of each: memberships exp(-(d - rho) / sigma), with rho the distance of
    the nearest apart from copies and sigma such that they sum to log2(k + 1); both directions united as w + v - w v."""
    lists = neighbours.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("near"))  # k entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            sizes = near.value_lengths().to_numpy()
            entries = near.flatten()
            d = np.full((len(sizes), k), np.inf)
            there = np.arange(k)[None] < sizes[:, None]
            d[there] = entries.field("d").to_numpy()
            rho = np.where(np.isfinite(d) & (d > 0), d, np.inf).min(axis=1, initial=np.inf)
            excess = np.maximum(d - np.where(np.isfinite(rho), rho, 0)[:, None], 0)
            low, high = np.full(len(d), 1e-12), np.full(len(d), 1e12)
            for _ in range(100):  # in ratio, since sigma may be of any size
                middle = np.sqrt(low * high)
                over = np.exp(-excess / middle[:, None]).sum(axis=1) > math.log2(k + 1)
                low, high = np.where(over, low, middle), np.where(over, middle, high)
            w = np.exp(-excess / high[:, None])[there]
            yield pa.RecordBatch.from_pydict({"i": np.repeat(batch.column("i").to_numpy(), sizes), "j": entries.field("j").to_numpy(), "w": w})

    directed = lists.mapInArrow(run, "i long, j long, w double").where("w > 0")
    pairs = directed.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")
    return pairs.groupBy("i", "j").agg((F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.product("w")).otherwise(0.0)).alias("w"))


#: Vertices that one task lays out in a round.
VERTICES = 4096


def layout(graph: DataFrame, start: DataFrame, min_dist: float = 0.1, epochs: int = 300, rounds: int = 10, negatives: int = 5, seed: int = 42, vertices: int = VERTICES) -> DataFrame:
    """(i, a, b): places in the plane for start (i, a, b), drawn together along the graph's edges (i < j, w) and apart from vertices
    drawn at random. Each round deals the vertices anew; a task moves its own, with the neighbours in other tasks where the
    last round left them, for its share of the epochs. Fewer vertices than a task holds take one round."""
    pa_, pb_ = curve(min_dist=min_dist)
    both = stored(graph.unionByName(graph.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")), "plane-edges")
    top = both.agg(F.max("w")).first()[0] or 1.0
    at = stored(start.select("i", "a", "b"), "plane")
    parts = max(1, -(-at.count() // vertices))
    rounds = 1 if parts == 1 else rounds
    def mover(turn: int):
        first, last = (epochs * t // rounds for t in (turn, turn + 1))

        def move(key: tuple, own: pa.Table, edges: pa.Table) -> pa.Table:
            own, edges = own.sort_by("i"), edges.sort_by([("i", "ascending"), ("j", "ascending")])
            i = own.column("i").to_numpy()
            y = np.stack([own.column(c).to_numpy() for c in "ab"], axis=1)
            if not len(i):
                return own.select(["i", "a", "b"])
            rng = np.random.default_rng([seed, turn, key[0].as_py()])
            head, other = np.searchsorted(i, edges.column("i").to_numpy()), edges.column("j").to_numpy()
            tail = np.minimum(np.searchsorted(i, other), len(i) - 1)
            inside = i[tail] == other
            fixed = np.stack([edges.column(c).to_numpy() for c in ("ja", "jb")], axis=1)
            rate = edges.column("w").to_numpy() / top
            for e in range(first, last):
                alpha = 1.0 - e / epochs
                drawn = np.flatnonzero(np.floor((e + 1) * rate) > np.floor(e * rate))
                h = head[drawn]
                target = np.where(inside[drawn, None], y[tail[drawn]], fixed[drawn])
                gap = y[h] - target
                d2 = np.maximum((gap**2).sum(axis=1), 1e-12)
                pull = -2 * pa_ * pb_ * d2 ** (pb_ - 1) / (1 + pa_ * d2**pb_)
                change = np.zeros_like(y)
                np.add.at(change, h, np.clip(pull[:, None] * gap, -4, 4))
                for _ in range(negatives):
                    away = rng.integers(0, len(i), len(h))
                    gap = y[h] - y[away]
                    d2 = (gap**2).sum(axis=1)
                    push = 2 * pb_ / ((0.001 + d2) * (1 + pa_ * d2**pb_))
                    np.add.at(change, h, np.where((away == h)[:, None], 0.0, np.clip(push[:, None] * gap, -4, 4)))
                y = y + alpha * change
            return pa.table({"i": i, "a": y[:, 0], "b": y[:, 1]})

        return move

    for turn in range(rounds):
        part = F.pmod(F.xxhash64("i", F.lit(seed + turn)), F.lit(parts)).alias("part")
        edges = both.join(at.select(F.col("i").alias("j"), F.col("a").alias("ja"), F.col("b").alias("jb")), "j").select("i", "j", "w", "ja", "jb", part)
        grouped = at.withColumn("part", F.pmod(F.xxhash64("i", F.lit(seed + turn)), F.lit(parts))).groupBy("part")
        at = stored(grouped.cogroup(edges.groupBy("part")).applyInArrow(mover(turn), "i long, a double, b double"), "plane")
    return at


def plane(signals: DataFrame, n_neighbours: int = 15, min_dist: float = 0.1, seed: int = 42, **options) -> DataFrame:
    """(role, idx, x: two numbers): signals (role, idx, x) laid out by their neighbour graph, from their principal components on."""
    from tidemark.operators.measures import mean_frame

    both = signals.select("role", "idx", "x", (2 * F.col("idx") + F.when(F.col("role") == "real", 0).otherwise(1)).alias("i"))
    both = stored(both, "plane-signals")
    near = stored(nearest_k(both.select(F.lit("real").alias("role"), F.col("i").alias("idx"), "x"), n_neighbours - 1), "plane-neighbours")
    pc = mean_frame(both).select("i", F.get("pc", F.lit(0)).alias("a"), F.get("pc", F.lit(1)).alias("b"))
    most = pc.agg(F.max(F.greatest(F.abs("a"), F.abs("b")))).first()[0] or 1.0
    jitter = lambda s: F.pmod(F.xxhash64("i", F.lit(s)), F.lit(1_000_003)) / 1_000_003 * 1e-3  # noqa: E731  copies don't coincide
    start = pc.select("i", *((10 * F.col(c) / most + jitter(seed + s)).alias(c) for s, c in enumerate("ab")))
    at = layout(fuzzy_graph(near.select("i", "j", "d"), n_neighbours - 1), start, min_dist, seed=seed, **options)
    return both.select("role", "idx", "i").join(at, "i").select("role", "idx", F.array("a", "b").alias("x"))
