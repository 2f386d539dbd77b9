"""Nearest neighbours by dynamic time warping, exact, with bounds first.

The warping distance of signals of one length is at most the sum of absolute differences sample by sample, and at least the
larger of two bounds: what the first and last samples and the extremes cost, and what lies outside the other signal's range.
A first pass over pairs of blocks, in matrix operations only, finds each signal's limit: the warped distance of the signal that is
closest sample by sample. A second pass warps only pairs whose bounds lie below the limit, and gives a pair up once every cell
of two neighbouring diagonals exceeds it; limits sink on the way. It warps in whole numbers of 16 bits first, which is never over the
distance by more than half a unit a sample; only pairs that may lie below the limit by that are warped in full.
"""

from __future__ import annotations

import numpy as np
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored

#: Signals in a block, and pairs that are warped together.
BLOCK, TOGETHER = 256, 2048


def _excess(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """By how much the samples of each row of x exceed each h, added up."""
    falling = np.sort(-x, axis=1)
    sums = np.pad(np.cumsum(-falling, axis=1), ((0, 0), (1, 0)))
    counts = np.stack([np.searchsorted(row, -h) for row in falling])
    return np.take_along_axis(sums, counts, axis=1) - counts * h


def lower_bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all pairs of rows: no warping path costs less."""
    if not a.shape[1] or not b.shape[1]:
        return np.zeros((len(a), len(b)))
    outside = np.zeros((len(a), len(b)))
    ends = np.abs(a[:, None, 0] - b[None, :, 0]) + (np.abs(a[:, None, -1] - b[None, :, -1]) if a.shape[1] > 1 or b.shape[1] > 1 else 0.0)
    for x, y, turn in ((a, b, False), (b, a, True)):
        over = _excess(x, y.max(axis=1)) + _excess(-x, -y.min(axis=1))
        outside = np.maximum(outside, over.T if turn else over)
    return np.maximum(ends, outside)


def _diagonals(a: np.ndarray, b: np.ndarray, limit: np.ndarray, slack: float, top: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(columns whose warping cost may be within limit + slack a step, the cost there, cells computed) of the columns of a and of b
    beside them. Whole numbers are cut off at top now and then, so that four more steps don't run over."""
    (t, n), u = a.shape, len(b)
    whole = a.dtype.kind == "i"
    alive, cells, back = np.arange(n), 0, np.ascontiguousarray(b[::-1])
    two, one, now = (np.full((t + 1, n), top, a.dtype) for _ in range(3))
    cost, most = np.empty((t, n), a.dtype), two.copy() if whole else None
    two[0] = 0  # cell (0, 0)
    for k in range(2, t + u + 1):
        lo, hi = max(1, k - u), min(t, k - 1)
        gap, new = cost[: hi - lo + 1], now[lo : hi + 1]
        np.abs(np.subtract(a[lo - 1 : hi], back[u - k + lo : u - k + hi + 1], out=gap), out=gap)
        np.minimum(one[lo - 1 : hi], one[lo : hi + 1], out=new)
        np.minimum(new, two[lo - 1 : hi], out=new)
        new += gap
        cells += len(alive) * len(gap)
        two, one, now = one, now, two
        if k == 2:
            now[0] = top
        if whole and k % 4 == 0:
            for kept in (one, two):
                np.minimum(kept, most, out=kept)
        if k % 8 == 0 and k < t + u:  # every path crosses one of two neighbouring diagonals
            least = np.minimum(two[max(1, k - 1 - u) : min(t, k - 2) + 1].min(axis=0), one[lo : hi + 1].min(axis=0))
            open_ = least <= limit + slack * k
            if open_.mean() < 0.8:
                alive, limit = alive[open_], limit[open_]
                if not len(alive):
                    break
                a, back, two, one, now = (np.compress(open_, v, axis=1) for v in (a, back, two, one, now))
                cost, most = np.empty((t, len(alive)), a.dtype), most[:, : len(alive)].copy() if whole else None
    within = one[t] <= limit + slack * (t + u) if len(alive) else np.zeros(0, bool)
    return alive[within], one[t][within] if len(alive) else np.zeros(0), cells


def warped(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, int]:
    """(distances of rows of a to the rows of b beside them, infinite where they exceed the limit; cells computed)."""
    out, total = np.full(len(a), np.inf), 0
    for at in range(0, len(a), TOGETHER):
        some = slice(at, at + TOGETHER)
        kept, d, cells = _diagonals(np.ascontiguousarray(a[some].T), b[some].T, limit[some], 0.0, np.inf)
        out[at + kept], total = d, total + cells
    return out, total


def near_pairs(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, limit: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(p, q, d, cells) of the pairs (p, q) of rows of a and b whose warped distance d is within limit[p], or other[q] if given. Limits
    sink to the distances found."""
    of = lambda k: limit[p[k]] if other is None else np.maximum(limit[p[k]], other[q[k]])
    over = lambda v: v + 1e-9 * (1 + v)
    steps, most, low, high = a.shape[1] + b.shape[1], 0.0, min(a.min(), b.min()), max(a.max(), b.max())
    if len(p):
        most = float(limit[p].max()) if other is None else float(max(limit[p].max(), other[q].max()))
    unit = (32000 - 2 * steps) / (over(most) + 4 * (high - low) + 1e-300) if np.isfinite(most) and np.isfinite(high - low) else 0.0
    if unit * (over(most) + high - low) > 16 * steps:  # fine enough to tell pairs apart
        ia, ib = (np.ascontiguousarray(np.rint((v - low) * unit).astype(np.int16).T) for v in (a, b))
        top = int(over(most) * unit) + 2 * steps
    else:
        ia = None
    found, total = [], 0
    for at in range(0, len(p), TOGETHER):
        k = np.arange(at, min(at + TOGETHER, len(p)))
        if ia is not None:
            kept, _, cells = _diagonals(ia.take(p[k], axis=1), ib.take(q[k], axis=1), over(of(k)) * unit, 1.0, top)
            k, total = k[kept], total + cells
        if len(k):
            d, cells = warped(a[p[k]], b[q[k]], over(of(k)))
            total += cells
            k, d = k[np.isfinite(d)], d[np.isfinite(d)]
            np.minimum.at(limit, p[k], d)
            if other is not None:
                np.minimum.at(other, q[k], d)
            found.append((k, d))
    k, d = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0))
    return p[k], q[k], d, total


def nearest_warped(signals: DataFrame, sets: tuple[str, ...] = ("RS", "RR"), size: int = BLOCK, work: Accumulator | None = None) -> DataFrame:
    """(pair_set, i, d, j): the nearest other signal of each left signal by warping, absolute differences, no window; the first of
    equals. `work` counts the cells that are computed."""
    from tidemark.operators.neighbours import ROLES
    from tidemark.operators.pairs import pairwise

    signals = stored(signals.select("role", "idx", "x"), "warping-signals")  # read by every pass, so plans stay short
    out = None
    for pair_set in sets:
        of, among = ROLES[pair_set]
        same = of == among
        own = signals.where(F.col("role").isin(of, among)).select("role", "idx", "x")
        kind = "RR" if same else "RS"
        if pair_set in ("SS", "SR"):  # as the real side
            own = own.withColumn("role", F.when(F.col("role") == of, "real").otherwise("synthetic"))

        def limits(i, j, a, b, wanted):
            """Of signals on both sides within a role, since warping is symmetric."""
            gap = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
            gap = np.where(wanted, gap, np.inf)
            out = {"i": [], "limit": []}
            for k, x, y, g in ((i, a, b, gap), (j, b, a, gap.T))[: 1 + same]:
                some = np.flatnonzero(np.isfinite(g).any(axis=1))
                exact, cells = warped(x[some], y[g[some].argmin(axis=1)], np.full(len(some), np.inf))
                if work is not None:
                    work.add(cells)
                out["i"].append(k[some])
                out["limit"].append(exact)
            return {c: np.concatenate(v) for c, v in out.items()}

        upper = stored(pairwise(own, limits, "i long, limit double", (kind,), size).groupBy("i").agg(F.min("limit").alias("limit")), "warping-limits")
        limited = own.join(upper.select(F.lit("real").alias("role"), F.col("i").alias("idx"), "limit"), ["role", "idx"], "left")
        # the limit travels as the signal's last number
        packed = limited.select("role", "idx", F.concat("x", F.array(F.coalesce("limit", F.lit(0.0)))).alias("x"))
        held = {}

        def search(i, j, a, b, wanted, same=same, held=held):
            if held.get("first") != i[0]:  # a task meets a block of i with its blocks of j one after the other
                held |= {"first": i[0], "limit": a[:, -1].copy()}
            limit, other, a, b = held["limit"], b[:, -1].copy() if same else None, a[:, :-1], b[:, :-1]
            most = np.maximum(limit[:, None], other[None]) if same else limit[:, None]
            p, q, d, cells = near_pairs(a, b, *np.nonzero(wanted & (lower_bounds(a, b) <= most + 1e-9 * (1 + most))), limit, other)
            if work is not None:
                work.add(cells)
            of, at, d = (np.concatenate([x, y]) for x, y in ((i[p], j[q]), (j[q], i[p]), (d, d))) if same else (i[p], j[q], d)
            order = np.lexsort((at, d, of))
            of, at, d = of[order], at[order], d[order]
            first = np.unique(of, return_index=True)[1]
            return {"i": of[first], "d": d[first], "j": at[first]}

        found = pairwise(packed, search, "i long, d double, j long", (kind,), size)
        best = found.groupBy("i").agg(F.min(F.struct("d", "j")).alias("m")).select(F.lit(pair_set).alias("pair_set"), "i", "m.d", "m.j")
        out = best if out is None else out.unionByName(best)
    return out
