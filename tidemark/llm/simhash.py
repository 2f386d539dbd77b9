"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some 64-bit word lies within r bits of both. So
every distinct fingerprint emits its whole ball of radius r = 2 (1 + 64 + 2016 = 2081 variants) and
fingerprints that meet at a variant are linked.

Shuffling 2081 rows a fingerprint would cost over 30 KB each, so variants are dealt by a hash that is linear
over XOR: route(f ^ m) = route(f) ^ route(m). A map task therefore knows which buckets the variants of f
fall into without listing them, and sends f itself once to each of those buckets (64 at the default); the
reduce task writes out exactly the variants that belong to its bucket, sorts them, and finds the meetings. Every
variant is formed once, in the bucket it hashes to. Buckets are even whatever the data, because the
fingerprints are distinct and every one of them spreads over all buckets. Within a bucket the variants are
handled in passes of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_hash, unused
from tidemark.llm.components import connected_components

BITS, DISTANCE = 64, 4
#: Variants that a reduce task holds at once, and fingerprints that one bucket may get.
PASS, BUCKET = 1 << 22, 1 << 24


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The majority bits of the XXH64 of all word shingles; 0 without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and splits at \x20 \x09-\x0D
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    k = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, fp): fp is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key string, fp long")


def ball(radius: int = DISTANCE // 2) -> np.ndarray:
    """All words of at most `radius` set bits."""
    masks = [0]
    last = [0]
    for _ in range(radius):
        last = sorted({m | 1 << i for m in last for i in range(BITS) if not m >> i & 1})
        masks += last
    return np.array(masks, np.uint64)


def _columns() -> np.ndarray:
    """The images of the 64 unit words under the linear hash: 32 mixed bits each."""
    x = np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(32)


def route(words: np.ndarray) -> np.ndarray:
    """The linear hash: route(a ^ b) == route(a) ^ route(b)."""
    out = np.zeros(len(words), np.uint64)
    for i, column in enumerate(_columns()):
        out ^= ((words >> np.uint64(i)) & np.uint64(1)) * column
    return out


def route_bits(n: int, size: int) -> int:
    """Fewest bits, 6 at least, at which no bucket gets over BUCKET fingerprints."""
    bits = 6
    while n * min(1 << bits, size) / (1 << bits) > BUCKET:
        bits += 1
    return bits


def meetings(fps: np.ndarray, bucket: int, bits: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links between fingerprints whose balls meet at a variant of this bucket: from the smallest
    fingerprint at each variant to all others there, each verified; without repeats."""
    more = max(0, math.ceil(math.log2(max(1, len(fps) * len(masks) / (1 << bits) / PASS))))
    low = np.uint64((1 << (bits + more)) - 1)
    codes = (route(fps) & low).astype(np.int64)
    order = np.argsort(codes, kind="stable")
    fps = fps[order]
    counts = np.bincount(codes, minlength=1 << (bits + more))
    starts = np.cumsum(counts) - counts
    of_mask = (route(masks) & low).astype(np.int64)
    found_a, found_b = [], []
    for sub in range(1 << more):
        group = of_mask ^ (bucket | sub << bits)
        sizes = counts[group]
        total = int(sizes.sum())
        if total < 2:
            continue
        source = np.repeat(starts[group] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        variants = fps[source] ^ np.repeat(masks, sizes)
        ordered = np.sort(variants)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        mix = lambda v: ((v * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64)
        marked = np.zeros(1 << 24, bool)
        marked[mix(twice)] = True
        keep = marked[mix(variants)]
        variants, members = variants[keep], fps[source[keep]]
        order = np.argsort(variants, kind="stable")
        variants, members = variants[order], members[order]
        first = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
        least = np.repeat(np.minimum.reduceat(members, first), np.diff(np.r_[first, len(members)]))
        far = (members != least) & (np.bitwise_count(members ^ least) <= DISTANCE)
        found_a.append(least[far])
        found_b.append(members[far])
    if not found_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links to keep so that what they connect stays connected: a spanning forest of them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] = parent.setdefault(up, up)
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def links(distinct_fps: DataFrame, n: int) -> DataFrame:
    """(a, b): verified links that connect all fingerprints within DISTANCE bits. distinct_fps has one column, fp."""
    masks = ball()
    bits = route_bits(n, len(masks))
    low = np.uint64((1 << bits) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = np.unique(route(masks) & low)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 4096):
                fps = every[at : at + 4096]
                buckets = ((route(fps) & low)[:, None] ^ to[None, :]).astype(np.int32).ravel()
                order = np.argsort(buckets, kind="stable")
                own = np.repeat(fps, len(to))[order]
                keys, first = np.unique(buckets[order], return_index=True)
                parts = np.split(own, first[1:])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["bucket", "fps"])

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(group.column("fps").to_pylist()), np.uint64)
        a, b = meetings(fps, key[0].as_py(), bits, masks)
        keep = spanning(a, b)
        return pa.table({"a": a[keep].view(np.int64), "b": b[keep].view(np.int64)})

    sent = distinct_fps.mapInArrow(send, "bucket int, fps binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp, component_id) for every row of docs.

    Null texts and texts without words have fingerprint 0 and link like others. component_id is the
    smallest doc_id that is reachable over links of at most 4 differing bits; null ids are ignored, so it is
    null only where a whole component has none. Repeated rows stay. An empty table gives an empty result.
    """
    own = materialize(fingerprints(docs, id_col, text_col), "simhash")
    least = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(links(least.select("fp"), least.count()))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "text_key", "fp", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component in found (doc_id, text_key, component_id): of its smallest (doc_id, text); all columns of docs,
    unchanged, whatever their names. Of equal rows one stays."""
    best = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("s"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("t"))
    own, key = unused("__tm_id", docs.columns), unused("__tm_key", docs.columns)
    best = best.select(F.coalesce("t", "s").alias("s")).select(F.col("s.doc_id").alias(own), F.col("s.text_key").alias(key))
    keyed = docs.withColumns({own: F.col(id_col).cast("long"), key: text_hash(text_col)})
    kept = keyed.alias("d").join(best.alias("w"), F.col(f"d.{own}").eqNullSafe(F.col(f"w.{own}")) & (F.col(f"d.{key}") == F.col(f"w.{key}")), "left_semi")
    return kept.dropDuplicates([own, key]).select(*docs.columns)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """one_of_each of the components of near_duplicates."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
