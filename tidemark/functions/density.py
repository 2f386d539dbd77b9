"""Kernel density estimates on grids: Gaussian kernels, Scott's bandwidth, linear binning, and a convolution of the bins.

Values are reduced to a bounded number of weighted grid points first, in one aggregate with partial sums; what is convolved
after that has a row per grid point, whatever the number of values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import finite

#: Bandwidths that a grid goes beyond the values.
MARGIN = 3.0


def _bandwidth(column: str, dimensions: int):
    """Scott's rule; null for fewer than two values or no spread."""
    return F.nullif(F.stddev_samp(column), F.lit(0.0)) * F.pow(F.count(column), F.lit(-1.0 / (dimensions + 4)))


def kernel_density(values: DataFrame, keys: list[str], points: int = 128) -> DataFrame:
    """(keys, role, k, x, density) from (keys, role, value): the density of each role at the points of one grid for all roles of a key.
    Values that are not finite are left out; a role without spread has no density."""
    kept = values.where(finite(F.col("value"))).select(*keys, "role", "value")
    own = kept.groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("n"), _bandwidth("value", 1).alias("h"), F.min("value").alias("low"), F.max("value").alias("high")).where("h is not null")
    grid = own.groupBy(*keys).agg((F.min("low") - MARGIN * F.max("h")).alias("low"), (F.max("high") + MARGIN * F.max("h")).alias("high"))
    grid = own.select(*keys, "role", "n", "h").join(grid.select(*keys, "low", ((F.col("high") - F.col("low")) / (points - 1)).alias("step")), keys)
    place = (F.col("value") - F.col("low")) / F.col("step")
    near = kept.join(grid.select(*keys, "role", "low", "step"), [*keys, "role"]).select(*keys, "role", F.floor(place).alias("g"), (place - F.floor(place)).alias("part"))
    halves = F.array(F.struct(F.col("g").alias("g"), (1 - F.col("part")).alias("w")), F.struct((F.col("g") + 1).alias("g"), F.col("part").alias("w")))
    bins = near.select(*keys, "role", F.inline(halves)).groupBy(*keys, "role", "g").agg(F.sum("w").alias("w"))
    z = (F.col("k") - F.col("g")) * F.col("step") / F.col("h")
    spread = bins.join(grid, [*keys, "role"]).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    by = spread.groupBy(*keys, "role", "k").agg(F.first(F.col("low") + F.col("k") * F.col("step")).alias("x"), F.sum(F.col("w") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))
    return by


def plane_density(points: DataFrame, size: int = 48) -> DataFrame:
    """(role, ka, kb, a, b, density) from points (role, a, b): each role's density on one grid of size x size, with a bandwidth for each
    axis; bins are convolved along one axis, then along the other."""
    kept = points.where(finite(F.col("a")) & finite(F.col("b"))).select("role", "a", "b")
    own = kept.groupBy("role").agg(F.count(F.lit(1)).alias("n"), *(_bandwidth(c, 2).alias(f"h{c}") for c in "ab"), *(f(c).alias(f"{n}{c}") for c in "ab" for n, f in (("low", F.min), ("high", F.max)))).where("ha is not null and hb is not null")
    ends = own.agg(*((F.min(f"low{c}") - MARGIN * F.max(f"h{c}")).alias(f"low{c}") for c in "ab"), *((F.max(f"high{c}") + MARGIN * F.max(f"h{c}")).alias(f"high{c}") for c in "ab"), F.lit(1).alias("one"))
    grid = own.select("role", "n", "ha", "hb", F.lit(1).alias("one")).join(ends.select("one", "lowa", "lowb", *(((F.col(f"high{c}") - F.col(f"low{c}")) / (size - 1)).alias(f"step{c}") for c in "ab")), "one").drop("one")
    at = {c: (F.col(c) - F.col(f"low{c}")) / F.col(f"step{c}") for c in "ab"}
    near = kept.join(grid, "role").select("role", *(F.floor(at[c]).alias(f"g{c}") for c in "ab"), *((at[c] - F.floor(at[c])).alias(f"p{c}") for c in "ab"))
    share = lambda c, d: F.col(f"p{c}") if d else 1 - F.col(f"p{c}")
    corners = F.array(*(F.struct((F.col("ga") + i).alias("ga"), (F.col("gb") + j).alias("gb"), (share("a", i) * share("b", j)).alias("w")) for i in (0, 1) for j in (0, 1)))
    rows = near.select("role", F.inline(corners)).groupBy("role", "ga", "gb").agg(F.sum("w").alias("w"))
    for c, other in (("a", "gb"), ("b", "ka")):
        z = (F.col(f"k{c}") - F.col(f"g{c}")) * F.col(f"step{c}") / F.col(f"h{c}")
        weight = F.exp(-0.5 * z * z) / (F.col(f"h{c}") * math.sqrt(2 * math.pi))
        spread = rows.join(grid, "role").select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(f"k{c}"))
        rows = spread.groupBy("role", other, f"k{c}").agg(F.sum(F.col("w") * weight).alias("w"))
    out = rows.join(grid, "role")
    return out.select("role", "ka", "kb", *((F.col(f"low{c}") + F.col(f"k{c}") * F.col(f"step{c}")).alias(c) for c in "ab"), (F.col("w") / F.col("n")).alias("density"))
