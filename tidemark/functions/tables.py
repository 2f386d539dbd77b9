"""Table functions for SQL: bursts and windows of signals given as rows of samples.

    SELECT * FROM bursts(TABLE(samples) PARTITION BY signal_id ORDER BY (t), 128.0, 0.6)

Spark sorts and partitions the samples; a function sees one signal after the other and keeps one signal at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F


def burst_runs(v: np.ndarray, limit: float, least: int, gap: int) -> list[tuple[int, int]]:
    """First and last places of runs at or over the limit: those of fewer than `least` places go, then runs join over `gap` places."""
    over = np.flatnonzero(np.diff(np.concatenate([[0], (v >= limit).astype(np.int8), [0]])))
    runs = [(int(a), int(b) - 1) for a, b in over.reshape(-1, 2) if b - a >= least]
    out: list[tuple[int, int]] = []
    for a, b in runs:
        if out and a - out[-1][1] - 1 <= gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class Bursts:
    """Rows (signal_id, start, end, peak, duration_s) of samples (signal_id, t, v) of one signal at a time, t from 0 on: arguments are the
    rate, the share of samples under the threshold, and the least duration and the gap to join over in milliseconds."""

    def __init__(self) -> None:
        self.own, self.values, self.rest = None, [], (1.0, 0.75, 20.0, 50.0)

    def eval(self, row: Row, fs: float, share: float = 0.75, min_ms: float = 20.0, merge_ms: float = 50.0):
        self.own, self.rest = row["signal_id"], (float(fs), float(share), float(min_ms), float(merge_ms))
        self.values.append(row["v"])

    def terminate(self) -> Iterator[tuple]:
        if not self.values:
            return
        v = np.array(self.values, float)
        fs, share, min_ms, merge_ms = self.rest
        for a, b in burst_runs(v, float(np.quantile(v, share)), round(min_ms / 1000 * fs), round(merge_ms / 1000 * fs)):
            yield self.own, a, b, float(v[a : b + 1].max()), (b - a + 1) / fs


class Windows:
    """Rows (signal_id, window, x) of samples (signal_id, t, v): stretches of so many samples, each beginning `step` after the one before; what
    does not fill a window is left out. No more than a window is kept."""

    def __init__(self) -> None:
        self.held: list[float] = []
        self.window = self.skip = 0

    def eval(self, row: Row, size: int, step: int):
        if self.skip:
            self.skip -= 1
            return
        self.held.append(row["v"])
        if len(self.held) == size:
            yield row["signal_id"], self.window, list(self.held)
            self.window += 1
            self.held, self.skip = self.held[step:], max(0, step - size)


def register(spark: SparkSession) -> None:
    """Makes bursts() and windows() known to the session's SQL."""
    spark.udtf.register("bursts", F.udtf(Bursts, returnType="signal_id long, start long, end long, peak double, duration_s double"))
    spark.udtf.register("windows", F.udtf(Windows, returnType="signal_id long, window long, x array<double>"))
