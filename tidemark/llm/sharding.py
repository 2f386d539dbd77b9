"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled within their source by a seeded hash, the row of rank r among n in its source gets the
fractional rank (r - 1/2) / n, and the order by fractional rank interleaves all sources in proportion: any
stretch of it holds the mixture. Shards are cut from that order.

No window ever spans a whole source or the whole table. Ranks are counted in two steps: the hash splits a source into
ranges of bounded size, as sampled bounds split the interleaved order; the ranges are counted, and a row's rank is its
rank in its range plus the counts of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Rows aimed at in one range; 16 bits of the hash choose the range.
RANGE_ROWS, HASH_RANGES = 4096, 1 << 16
#: Rows aimed at in one range of the interleaved order.
PLACE_ROWS = 50_000


def _numbered(rows: DataFrame, ranges: list[str], within: list[str], order: list[Column], to: str, total: str) -> DataFrame:
    """rows with `to`, the number from 1 on in the order of (ranges, order) among equal `within`, and `total`, their count."""
    keys = [*within, *ranges]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), total: F.sum("__n").over(Window.partitionBy(*within))}).drop("__n")
    ranked = rows.withColumn("__own", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(counts, keys).withColumn(to, F.col("__before") + F.col("__own")).drop("__before", "__own")


def interleave(rows: DataFrame, shards: int, stratum: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: str = "tidemark") -> DataFrame:
    """(doc_id, source, size, text_crc32, position, shard, slot) for every row.

    position runs from 0 over the whole table. Shard sizes differ by one row at most. A null stratum is a
    stratum of its own; a null text counts as empty; rows with equal id and text are interchangeable. Very long texts
    only add to their row's size. Columns that are not named here may have any name. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = rows.select(
        F.col(id_col).alias("doc_id"),
        F.col(stratum).cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    slim = materialize(slim.withColumns({"stratum": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), "key": key}), "interleave")
    n = slim.count()
    ranges = max(1, min(HASH_RANGES, -(-n // RANGE_ROWS)))
    part = F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * ranges / HASH_RANGES).cast("int")
    ranked = _numbered(slim.withColumn("__r", part), ["__r"], ["stratum"], [F.col("key"), F.col("doc_id"), F.col("size")], "__rank", "__of")
    ranked = ranked.withColumn("fraction", (2 * F.col("__rank") - 1) / (2 * F.col("__of"))).drop("__r")
    order = [F.col("fraction"), F.col("stratum"), F.col("key"), F.col("doc_id"), F.col("size")]
    # ranges of the whole order: many sources of one row have the same fraction
    placed = ranked.repartitionByRange(max(1, -(-n // PLACE_ROWS)), *order).withColumns({"__f": F.spark_partition_id(), "__all": F.lit(0)})
    placed = materialize(placed, "interleave-ranges")
    placed = _numbered(placed, ["__f"], ["__all"], order, "__place", "__total").withColumn("position", F.col("__place") - 1)
    shard = F.expr(f"(position * {shards}) div __total")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "position", "shard", F.expr(f"position - (shard * __total + {shards - 1}) div {shards}").cast("long").alias("slot")
    )


SHARDS = 24


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document's shard under the law `rows`."""
    out = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of the UTF-8 bytes, bit by bit from the reflected polynomial; then the same ranks by plain windows.
ORACLE_SQL = """
WITH RECURSIVE steps(b, k, c) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
bytes AS (
  SELECT doc_id, source, text, coalesce(octet_length(encode(text)), 0) + 8 AS size,
         list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','), lambda x: x <> ''), lambda x: ('0x' || x)::BIGINT) AS bs
  FROM documents
), summed AS (
  SELECT doc_id, source, size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table
), keyed AS (
  SELECT *, coalesce('=' || source, '') AS stratum, md5('tidemark:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32::VARCHAR) AS key FROM summed
), ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, size) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY stratum)) AS fraction FROM keyed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, key, doc_id, size) - 1 AS position, count(*) OVER () AS total FROM ranked
), cut AS (SELECT *, position * 24 // total AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       (position - (shard * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
