"""Connected components of an edge table by alternating large and small stars, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint


#: Edges in a partition between rounds, at least.
EDGES = 50_000


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 24))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    Every round replaces the edges by stars round the smallest neighbour. No neighbour list is ever
    gathered: minima come from partial aggregates and go back by joins that AQE can split. An empty
    edge table gives an empty result. Loops and repeated edges are dropped first.
    """
    hi, lo = F.greatest(F.col(a), F.col(b)).alias("hi"), F.least(F.col(a), F.col(b)).alias("lo")
    now = checkpoint(edges.select(hi, lo).where("hi <> lo").distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        own = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(own, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = checkpoint(moved.unionByName(own.select("hi", F.col("m").alias("lo"))).distinct())
        before, state = state, _state(new)
        # few edges in few partitions; the round's shuffle files go as soon as the driver has collected its garbage
        now = new.coalesce(max(1, -(-state[0] // EDGES)))
        edges.sparkSession._jvm.System.gc()
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
