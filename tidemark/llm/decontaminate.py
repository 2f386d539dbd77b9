"""Benchmark decontamination by the q-gram lemma.

If a region of a document is within e edits of a passage of m characters, the two share at least
m + 1 - q (e + 1) q-grams, all on diagonals (place in the document less place in the passage) that differ by e at
most. So hits of passage q-grams are counted in diagonal bands that overlap by half; only bands that reach the
bound are looked at again, by an alignment restricted to the band. Nothing that is within the budget is missed.

The benchmark is a query set. It is cut into blocks of bounded size; each block's q-gram index is broadcast and
all documents pass it, so one text is never joined to another and a benchmark of any size works.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import unused

#: q, edits allowed per character of the passage, characters of benchmark text in one block.
Q, RATE, BLOCK_CHARS = 8, 0.1, 1 << 21
#: Hits of q-grams that are listed at once.
HITS = 1 << 21


_SPACE = np.zeros(12290, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, *range(8192, 8203), 8232, 8233, 12288]] = True


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points with white space runs as one space, and for each its place in the text."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = text.lower()
    if len(low) == len(text):
        lowered = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    else:  # a letter whose lower case has another length keeps its case
        lowered = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text], np.uint32)
    space = _SPACE[np.minimum(codes, 12289)]
    out = np.where(space, np.uint32(32), lowered)
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    where = np.flatnonzero(keep)
    out = out[where]
    lo, hi = (1 if len(out) and out[0] == 32 else 0), len(out) - (1 if len(out) > 1 and out[-1] == 32 else 0)
    return out[lo:hi], where[lo:hi]


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram: a polynomial, put together from those of half the length, then mixed."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    out, done, part, size = None, 0, codes.astype(np.uint64) + np.uint64(1), 1
    while True:
        power = np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64))
        if q & size:
            out, done = (part, size) if out is None else (out[: len(out) - size] * power + part[done : done + len(out) - size], done + size)
        if done == q:
            break
        part, size = part[:-size] * power + part[size:], 2 * size
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """The edits allowed: rate * m, but no more than leave the lemma a bound of one q-gram; -1: too short to search."""
    return min(int(rate * m), (m - q) // q) if m >= q else -1


def within(region: np.ndarray, passage: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of passage in region on diagonals low to high; None if over `most` edits.

    Cells of a row are the diagonals; a step along the row is solved by a running minimum.
    """
    width, n = high - low + 1, len(region)
    far = 1 << 29
    ramp = np.arange(width)
    at = low + ramp  # places in region before the first character of passage
    cost = np.where((at >= 0) & (at <= n), 0, far)
    start = at.copy()
    # region with room at both ends, so that every row of the band is one slice
    room = np.full(max(0, -low) + n + max(0, high + len(passage) - n) + 1, -1, np.int64)
    base = max(0, -low)
    room[base : base + n] = region
    skip, from_skip = np.empty_like(cost), np.empty_like(start)
    for i, c in enumerate(passage.tolist()):
        first = low + i  # region[first + r] is aligned to passage[i] on diagonal r
        here = room[base + first : base + first + width]
        step = cost + (here != c)
        step[here < 0] = far
        skip[:-1], skip[-1] = cost[1:] + 1, far  # passage[i] has no partner: one diagonal down
        from_skip[:-1], from_skip[-1] = start[1:], 0
        origin = np.where(skip < step, from_skip, start)
        best = np.minimum(step, skip)
        lo, hi = max(0, -first - 1), min(width, n - first)  # diagonals whose end lies in region
        best[:lo], best[max(hi, 0) :] = far, far
        # region characters without a partner: along the row, one edit a step
        slant = best - ramp
        lead = np.minimum.accumulate(slant)
        source = np.maximum.accumulate(np.where(slant == lead, ramp, 0))
        cost, start = lead + ramp, origin[source]
        cost[:lo], cost[max(hi, 0) :] = far, far
        if cost.min() > most:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(start[k]), int(at[k] + len(passage))


@dataclass
class Index:
    """q-grams of a block of passages: sorted hashes, and for each the passages and places it stands at."""

    items: list
    codes: list[np.ndarray]
    hashes: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    hashed: list[np.ndarray]
    sizes: np.ndarray
    most: np.ndarray
    bound: np.ndarray
    q: int

    @classmethod
    def of(cls, passages: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> Index:
        kept = [(k, c) for k, t in passages if budget(len(c := normalise(t)[0]), q, rate) >= 0]
        hashed = [grams(c, q) for _, c in kept]
        every = np.concatenate([np.empty(0, np.uint64), *hashed])
        item = np.repeat(np.arange(len(kept)), [len(h) for h in hashed])
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(h)) for h in hashed)])
        order = np.argsort(every, kind="stable")
        hashes, first, count = np.unique(every[order], return_index=True, return_counts=True)
        seen = np.zeros(1 << 22, bool)
        seen[(hashes >> np.uint64(42)).astype(np.int64)] = True
        sizes = np.array([len(c) for _, c in kept], np.int64)
        most = np.array([budget(m, q, rate) for m in sizes.tolist()], np.int64)
        return cls([k for k, _ in kept], [c for _, c in kept], hashes, first, count, item[order], place[order].astype(np.int64), seen, hashed, sizes, most, sizes + 1 - q * (most + 1), q)

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits), places in the text, one for every passage and band that is within the budget."""
        codes, where = normalise(text)
        hashes = grams(codes, self.q)
        if not len(hashes) or not len(self.hashes):
            return []
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(42)).astype(np.int64)])
        index = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[index] == hashes[at]
        out: dict[int, list[tuple[int, int, int]]] = {}
        for k, band in self._bands(at[hit], index[hit]):
            e, m, passage = int(self.most[k]), int(self.sizes[k]), self.codes[k]
            lo = band * (e + 1)
            places, diagonal = self._shared(hashes, k, lo, 2 * (e + 1))
            if places < self.bound[k]:
                continue
            if diagonal >= 0 and np.array_equal(codes[diagonal : diagonal + m], passage):
                out.setdefault(k, []).append((0, diagonal, diagonal + m))
                continue
            left = max(0, lo - e)
            if found := within(codes[left : max(left, lo + 2 * (e + 1) + m + e)], passage, lo - left - e, lo - left + 2 * (e + 1) + e, e):
                out.setdefault(k, []).append((found[0], left + found[1], left + found[2]))
        return [(self.items[k], int(where[s]), int(where[e - 1]) + 1 if e > s else int(where[s]), edits) for k, of in sorted(out.items()) for edits, s, e in _apart(of)]

    def _bands(self, at: np.ndarray, index: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, band) of the bands with as many hits as the bound; bands are 2 (e + 1) diagonals wide at steps of e + 1, so any
        e + 1 neighbouring diagonals lie in one. Hits are listed HITS at a time: a text that repeats a common q-gram has many."""
        counts = self.count[index]
        ends = np.cumsum(counts)
        first, keys, votes = 0, [], []
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HITS, "right")))
            own = counts[first:last]
            slot = np.repeat(self.first[index[first:last]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            item = self.item[slot]
            band = np.floor_divide(np.repeat(at[first:last], own) - self.place[slot], (self.most + 1)[item]) + (1 << 31)
            key, n = np.unique(np.concatenate([item << 32 | band, item << 32 | (band - 1)]), return_counts=True)
            keys.append(key)
            votes.append(n)
            first = last
        if not keys:
            return
        key, n = keys[0], votes[0]
        if len(keys) > 1:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, np.concatenate(votes))
        for x in key[n >= self.bound[key >> 32]].tolist():
            yield x >> 32, (x & 0xFFFFFFFF) - (1 << 31)

    def _shared(self, hashes: np.ndarray, k: int, low: int, width: int) -> tuple[int, int]:
        """How many q-grams of passage k the text has on these diagonals, each counted once, and the diagonal that has the most."""
        own = self.hashed[k]
        size = len(own)
        found, best, most = np.zeros(size, bool), low, -1
        step = max(1, (1 << 20) // size)
        for d in range(low, low + width, step):
            rows = min(step, low + width - d)
            part = np.zeros(size + rows - 1, np.uint64)
            lo, hi = max(0, d), min(len(hashes), d + len(part))
            if lo >= hi:
                continue
            inside = np.zeros(len(part), bool)
            part[lo - d : hi - d], inside[lo - d : hi - d] = hashes[lo:hi], True
            same = (np.lib.stride_tricks.sliding_window_view(part, size) == own) & np.lib.stride_tricks.sliding_window_view(inside, size)
            found |= same.any(axis=0)
            votes = same.sum(axis=1)
            if votes.max() > most:
                best, most = d + int(votes.argmax()), int(votes.max())
        return int(found.sum()), best


def _apart(regions: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of regions (edits, start, end) of which one covers more than half of another, that with the fewest edits; in order."""
    longest = max(e - s for _, s, e in regions)
    kept: list[tuple[int, int, int]] = []  # (start, end, edits), by start; few of them overlap
    for edits, s, e in sorted(set(regions)):
        near = kept[bisect.bisect_left(kept, (s - longest,)) : bisect.bisect_left(kept, (e,))]
        if all(2 * (min(e, t) - max(s, r)) <= min(e - s, t - r) for r, t, _ in near):
            bisect.insort(kept, (s, e, edits))
    return [(edits, s, e) for s, e, edits in kept]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The passages in blocks of at most `size` characters (or one passage), read one partition at a time."""
    block, chars = [], 0
    for row in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        if block and chars + len(row[1]) > size:
            yield block
            block, chars = [], 0
        block.append((row[0], row[1]))
        chars += len(row[1])
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, key_col: str | None = None) -> DataFrame:
    """(doc_id, item_id, start, end, edits) for every region of a document within the edit budget of a passage.

    Whole texts are searched. Null and empty texts have no regions; passages under q characters are not searched
    for; repeated rows each give their regions. A passage that stands in a text several times gives a region each time. No
    documents or no benchmark: an empty result. If key_col is given, that column is carried instead of the id. Other columns
    are not read and may have any name.
    """
    spark = docs.sparkSession
    kind = docs.schema[key_col or id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, start long, end long, edits int"
    slim = docs.select(F.col(key_col or id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col(text_col).isNotNull())
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(Index.of(block, q, rate))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                ids, rows = [], []
                for i, text in enumerate(batch.column(1)):
                    for found in index.find(text.as_py()):
                        ids.append(i)
                        rows.append(found)
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(ids)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32())],
                        names=["doc_id", "item_id", "start", "end", "edits"],
                    )

        out = out.unionByName(slim.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without any region within the budget of a passage; all columns, unchanged, whatever their names.

    Texts are joined by their digest, so repeated ids and null ids do no harm; copies are looked up once. Null and empty texts stay.
    """
    mark = unused("__tm_key", docs.columns)
    keyed = docs.withColumn(mark, F.coalesce(F.md5(F.col(text_col)), F.lit("")))
    hit = contaminated(keyed, benchmark, id_col, text_col, key_col=mark).select(F.col("doc_id").alias(mark)).distinct()
    return keyed.join(hit, mark, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document region that leaks a benchmark passage."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items)
