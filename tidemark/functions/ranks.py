"""Ranks and running sums over a whole ordering, without a window that spans it.

Values are split into ranges at approximate quantiles; sums of the ranges before a range are a small table, and
windows only run within a range. Results are exact whatever the quantiles are, as long as all branches of a plan see the same ones:
an approximate quantile depends on the order in which partitions are merged, so the cuts are stored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored

#: Ranges that an ordering is split into.
RANGES = 32


def _ranged(df: DataFrame, keys: list[str], order: str, ranges: int) -> DataFrame:
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, [(i + 1) / ranges for i in range(ranges - 1)], 1000).alias("__cuts"))
    joined = df.join(stored(cuts, "cuts"), keys)
    return joined.withColumn("__bin", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts")


def numbered(df: DataFrame, keys: list[str], order: str, to: str = "idx", ranges: int = RANGES) -> DataFrame:
    """df with `to`: the number from 0 on in the order of `order` among equal keys. Rows without an order come first."""
    ranged = _ranged(df, keys, order, ranges).withColumn("__bin", F.coalesce("__bin", F.lit(-1)))
    counts = ranged.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = ranged.withColumn("__own", F.row_number().over(Window.partitionBy(*keys, "__bin").orderBy(order)))
    return own.join(before, [*keys, "__bin"]).withColumn(to, F.col("__before") + F.col("__own") - 1).drop("__bin", "__before", "__own")


def running(df: DataFrame, keys: list[str], order: str, sums: list[str], ranges: int = RANGES) -> DataFrame:
    """df, whose `order` is distinct among equal keys, with run_<c> for each c of sums (up to and with the row) and
    next_<order>, the next greater value (null at the end)."""
    ranged = _ranged(df, keys, order, ranges)
    totals = ranged.groupBy(*keys, "__bin").agg(*(F.sum(c).alias(f"__{c}") for c in sums), F.min(order).alias("__first"))
    bins = Window.partitionBy(*keys).orderBy("__bin")
    before = bins.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__bin", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums), F.lead("__first").over(bins).alias("__after"))
    inside = Window.partitionBy(*keys, "__bin").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumns({f"__run_{c}": F.sum(c).over(upto) for c in sums} | {"__next": F.lead(order).over(inside)})
    out = own.join(totals, [*keys, "__bin"])
    return out.withColumns({f"run_{c}": F.col(f"__{c}") + F.col(f"__run_{c}") for c in sums} | {f"next_{order}": F.coalesce("__next", "__after")}).drop("__bin", "__after", "__next", *(f"__{c}" for c in sums), *(f"__run_{c}" for c in sums))


def quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column a name of shares): exact quantiles, linear between the two values next to (n - 1) times the share; null where a
    key has no values. Equal values are counted first; ranks come from ranges, so no task holds a key's values."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    totals = df.groupBy(*keys).agg(F.count(column).alias("__total"))
    placed = totals.join(running(counted, keys, "__v", ["__c"]), keys, "left")

    def value(share: float):
        position = F.lit(share) * (F.col("__total") - 1)
        at = lambda rank: F.max(F.when((F.col("run___c") - F.col("__c") <= rank) & (rank < F.col("run___c")), F.col("__v")))
        low, high = at(F.floor(position)), at(F.ceil(position))
        return low + (high - low) * F.max(position - F.floor(position))

    return placed.groupBy(*keys).agg(*(value(share).alias(name) for name, share in shares.items()))
