"""Near-duplicates by the similarity of their word shingles: every pair of texts with a Jaccard similarity of 0.8 or more.

Sets at similarity 4/5 share a shingle among the first |x| - ceil(4|x|/5) + 1 of each, whatever the order of shingles,
as long as it is one order for all. The order is by counts in a sketch of the corpus, rare first, so that few sets meet
at a shingle. Sets that meet are compared in full. Fingerprints come first: texts whose fingerprints meet in op2's balls are compared
and linked where the similarity holds, and the rounds find what balls don't reach. In each round the sets at a shingle are compared with one of
them only, and what is linked is not compared again; after ROUNDS rounds, or as soon as they are few, all pairs that are still unlinked are
compared. Those meet by classes of length, so sets of unlike lengths at a frequent shingle form no pair.
Nothing is estimated: the sketch sets the order, and with it the cost, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, discard, lean, materialize, text_hash
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import fingerprint, one_of_each
from tidemark.llm.simhash import links as ball_links

SHINGLE = 5
#: Counters of the sketch, in blocks; one text in so many is counted; words whose hashes are kept at once.
COUNTERS, BLOCK, SAMPLE, WORDS = 1 << 20, 1 << 16, 8, 1 << 16
#: Rounds with one of the sets at a shingle, after which all unlinked pairs are compared; pairs a row that these may form to be compared sooner.
ROUNDS, PAIRS = 3, 4
#: Sets at a shingle up to which each meets all others; where there are more, sets meet by classes of length, so many to a doubling.
LIGHT, CLASSES = 8, 16
BITMAP = 512
_FACTORS = (np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of all word shingles, in order; a text of fewer words is one shingle. known keeps words' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, 42)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mixed(out + hashes[i : i + n] * _FACTORS[i])
    return np.unique(out)


def _sketch(texts: DataFrame) -> np.ndarray:
    """Counters, by their low bits, of the shingles of a sample of texts (one column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = {}, np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                np.add.at(counts, shingles(text, known) & np.uint64(COUNTERS - 1), 1)
        small = np.minimum(counts, 255).astype(np.uint8)
        if small.any():
            parts = [small[at : at + BLOCK].tobytes() for at in range(0, COUNTERS, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.uint32)
        for batch in batches:
            for part in batch.column("counts").to_pylist():
                total += np.frombuffer(part, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())], names=["block", "counts"])

    out = np.zeros(COUNTERS, np.uint16)
    for block, part in texts.mapInArrow(lean(count), "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(part, np.uint16)
    return out


def _sets(texts: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(doc_id, text_key, id, n, bits, prefix, fp) from (doc_id, text_key, text): id stands for the set of shingles, n is its size, fp is
    op2's fingerprint over the same shingles."""
    counts = texts.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            ids, sizes, bits, prefixes, fps = [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingles(text, known)
                ids.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                sizes.append(len(s))
                odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % BITMAP, minlength=BITMAP) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
                first = len(s) - (4 * len(s) + 4) // 5 + 1 if len(s) else 0
                order = np.lexsort((s, counts.value[s & np.uint64(COUNTERS - 1)]))[:first]
                prefixes.append(s[order].view(np.int64))
                fps.append(fingerprint(text, SHINGLE))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=["doc_id", "text_key", "id", "n", "bits", "prefix", "fp"],
            )

    return texts.mapInArrow(lean(run), "doc_id long, text_key string, id long, n long, bits array<long>, prefix array<long>, fp long")


#: Bits by which the texts of sets that are compared in full are found again, whatever their number; others pass a join later.
MARKS = 1 << 23


def _marks(hashes: DataFrame) -> np.ndarray:
    """Which of MARKS places the hashes (one long column) fall on, eight to a byte."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(MARKS, bool)
        for batch in batches:
            seen[batch.column(0).to_numpy() & (MARKS - 1)] = True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.flatnonzero(seen) >> 16).astype(np.int32)), pa.array([np.packbits(x).tobytes() for x in seen.reshape(-1, 1 << 16) if x.any()], pa.binary())], names=["block", "bits"])

    def unite(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << 13, np.uint8)
        for batch in batches:
            for part in batch.column("bits").to_pylist():
                out |= np.frombuffer(part, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["block", "bits"])

    out = np.zeros((MARKS >> 16, 1 << 13), np.uint8)
    for block, part in hashes.mapInArrow(lean(mark), "block int, bits binary").groupBy("block").applyInArrow(unite, "block int, bits binary").collect():
        out[block] = np.frombuffer(part, np.uint8)
    return out.ravel()


def _alike(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (a, b) of pairs whose sets have a similarity of 0.8 or more."""
    bits = sets.select("id", "n", "bits")
    both = pairs.join(bits.toDF("a", "na", "ba"), "a").join(bits.toDF("b", "nb", "bb"), "b")
    # a bit that differs stands for one shingle at least that only one of the sets has
    apart = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = materialize(both.where((5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (9 * apart <= F.col("na") + F.col("nb"))).select("a", "b"), "similar-pairs")
    asked = both.select(F.col("a").alias("id")).unionByName(both.select(F.col("b").alias("id"))).distinct()
    marks = texts.sparkSession.sparkContext.broadcast(_marks(sets.join(asked, "id", "left_semi").select(F.xxhash64("least.text_key", "least.doc_id").alias("h"))))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            place = batch.column(0).to_numpy() & (MARKS - 1)
            asked = np.flatnonzero(marks.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
            if not len(asked):
                continue
            ids, found = [], []
            for text in batch.column(1).take(pa.array(asked)).cast(pa.binary()).to_pylist():
                s = shingles(text, known)
                ids.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                found.append((s >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(found, pa.binary())], names=["id", "s"])

    full = texts.select(F.xxhash64("text_key", "doc_id").alias("h"), "text").mapInArrow(lean(hashed), "id long, s binary")
    stored = full = materialize(full.join(asked, "id", "left_semi"), "similar-sets")
    if full.count() > full.select("id").distinct().count():  # equal rows, or others that the marks let pass
        full = full.dropDuplicates(["id"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                merged = np.sort(np.concatenate([x, y]))
                keep.append(9 * int((merged[1:] == merged[:-1]).sum()) >= 4 * len(merged))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = both.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b").select("a", "b", "x", "y")
    found = checkpoint(joined.mapInArrow(lean(compare), "a long, b long"))
    discard(stored, both)
    return found


def _ball_pairs(own: DataFrame) -> DataFrame:
    """(a, b): pairs of sets (id, fp) that connect all whose fingerprints op2's method links; one pair a link, and one for each further
    set of a fingerprint."""
    by = own.select("fp", "id").distinct()
    least = materialize(by.groupBy("fp").agg(F.min("id").alias("least")), "similar-fingerprints")
    met = ball_links(least.select("fp"), least.count())
    across = met.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select("x", "y")
    within = by.join(least, "fp").select(F.col("least").alias("x"), F.col("id").alias("y"))
    pairs = across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    out = materialize(pairs, "similar-balls")
    discard(least)
    return out


def _dealt(now: DataFrame) -> DataFrame:
    """(token, slot, long, id, n, at, root): where rows of now (token, id, n, at, root, k) meet. The longer of two sets (long = 1) goes to the
    classes of all lengths that the shorter may have, by its own length and by what is left of it from the shingle on; the shorter (0)
    to its own class. At a shingle of few sets there is one class."""
    length = lambda n: F.floor(F.log2(n) * CLASSES).cast("int")
    few, own = F.col("k") <= LIGHT, ["id", "n", "at", "root"]
    rows = now.select("token", *own, "k", F.expr("(4 * n + 4) div 5").alias("low"), F.expr("least(n, (5 * n - 9 * at) div 4)").alias("high"))
    longer = rows.where("low <= high").select("token", F.explode(F.when(few, F.array(F.lit(-1))).otherwise(F.sequence(length("low"), length("high")))).alias("slot"), F.lit(1).alias("long"), *own)
    shorter = rows.where("9 * at <= n").select("token", F.when(few, F.lit(-1)).otherwise(length("n")).alias("slot"), F.lit(0).alias("long"), *own)
    return longer.unionByName(shorter)


def _places(dealt: DataFrame) -> tuple[DataFrame, int]:
    """(token, slot) where unlinked sets meet, and the number of pairs they form there."""
    by = dealt.groupBy("token", "slot", "root").agg(F.sum("long").alias("x"), F.sum(1 - F.col("long")).alias("y"))
    formed = by.groupBy("token", "slot").agg((F.sum("x") * F.sum("y") - F.sum(F.col("x") * F.col("y"))).alias("formed"))
    places = materialize(formed.where("formed > 0"), "similar-places")
    return places.select("token", "slot"), places.agg(F.sum("formed")).first()[0] or 0


def _unlinked_pairs(dealt: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b): all unlinked sets that may reach the similarity, by pairs of roots, so that linked pairs are not even formed."""
    met = dealt.join(places, ["token", "slot"])
    a, b = (met.where(F.col("long") == long).select("token", "slot", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "at", "root"))) for s, long in (("a", 1), ("b", 0)))
    apart = a.select("token", "slot", "root_a").distinct().join(b.select("token", "slot", "root_b").distinct(), ["token", "slot"]).where("root_a <> root_b")
    pairs = apart.join(a, ["token", "slot", "root_a"]).join(b, ["token", "slot", "root_b"])
    # what is left of both sets from their first common shingle on must reach the similarity
    pairs = pairs.where("(n_a > n_b or n_a = n_b and id_a > id_b) and 5 * n_b >= 4 * n_a and 9 * least(n_a - at_a, n_b - at_b) >= 4 * (n_a + n_b)")
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """(doc_id, text_key, component_id) for every row of docs: component_id is the same for rows that are connected by pairs
    of similarity 0.8 or more. Texts without words, null ones among them, are alike. Repeated rows have a row each. Texts of any
    length are read whole, other columns not at all. An empty table gives an empty result. Scratch tables are deleted. Without `whole` only
    the pairs that fingerprints find are linked."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    sketch = _sketch(texts.where(F.pmod(F.crc32("text_key"), F.lit(SAMPLE)) == 0).select("text"))
    own = materialize(_sets(texts, sketch), "similar")
    sets = materialize(own.groupBy("id").agg(F.min(F.struct("text_key", "doc_id")).alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")), "similar-distinct")
    compared = _ball_pairs(own)
    links = _alike(compared, sets, texts)
    roots = checkpoint(connected_components(links).withColumnRenamed("node", "id"))
    rows = sets.select("id", "n", F.posexplode("prefix").alias("at", "token")).where(F.lit(whole))
    met = rows.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    rows = materialize(rows.join(met, "token"), "similar-met")
    before, stored = rows, [compared]
    for number in range(ROUNDS + 1):
        now = rows.select("id", "n", "at", "token").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        by = now.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(F.xxhash64("id", F.lit(number)).alias("h"), "id", "n", "at", "root")).alias("p"))
        open_ = by.groupBy("token").agg(F.sum("k").alias("k"), F.min("p").alias("p"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        open_ = materialize(open_.select("token", "p", "k"), "similar-open")
        if open_.isEmpty():
            break
        now = materialize(now.join(open_, "token"), "similar-unlinked")
        discard(before, open_)
        rows = before = now  # sets at other shingles are linked, and stay so
        dealt = _dealt(now)
        places, formed = _places(dealt)
        stored.append(places)
        last = number == ROUNDS or formed <= PAIRS * now.count()
        if last:
            pairs = _unlinked_pairs(dealt, places)
        else:
            # what is left of both sets from their first common shingle on must reach the similarity
            pairs = now.where("root <> p.root and 5 * least(n, p.n) >= 4 * greatest(n, p.n) and 9 * least(n - at, p.n - p.at) >= 4 * (n + p.n)").select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
        pairs = materialize(pairs.distinct().join(compared, ["a", "b"], "left_anti"), "similar-candidates")
        stored.append(pairs)
        compared = compared.unionByName(pairs)
        links = links.unionByName(_alike(pairs, sets, texts))
        roots = checkpoint(connected_components(links).withColumnRenamed("node", "id"))
        if last:
            break
    out = own.join(roots, "id", "left")
    out = materialize(out.select("doc_id", "text_key", F.coalesce("root", "id").alias("component_id")), "similar-components")
    discard(own, sets, before, *stored)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: of its smallest (doc_id, text); all columns of docs, unchanged."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)
