"""Packing by lexical retrieval: sequences of at most 4096 tokens whose documents share rare terms.

Documents are cut at multiples of the window; whole windows are sequences of their own and the rests are packed.
Terms are token ids, so document frequencies are at most a vocabulary long and are the only thing that every task gets.
Pieces are dealt to shards of bounded size by their rarest term (a term with more pieces than a shard holds is
spread evenly over several), each shard has its own inverted index with BM25 weights from the statistics of all
pieces, and packs its pieces: the longest unused piece is the seed, all of its terms are looked up, its best unused
neighbours that still fit are added, and what they leave is filled with the longest unused piece that fits.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, materialize

WINDOW, END_ID = 4096, 2
#: Pieces aimed at in one shard; BM25's constants; runs that a worker remembers; characters of text looked up at once.
SHARD, K1, B, CACHE, SLICE = 4096, 1.2, 0.75, 150_000, 1 << 22
#: Chunks that a worker remembers with their ids, and bytes of these.
CHUNKS, CHUNK_BYTES = 1 << 19, 1 << 25
#: Terms of a shard that are held as columns of a matrix.
COLUMNS = 384
TOKENIZER = "word_bpe_49k.json"

#: White space beyond \t-\r and the space, as the tokenizer has it (Unicode White_Space); no token crosses it.
_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: The tokenizer's own split of a chunk, and the texts that its normalizer only lower-cases.
_RUNS, _PLAIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), re.compile("[\0-\u024f\u2010-\u2027\u2030-\u205e]*")
#: Byte-level models write a byte without a visible character of its own as one from 256 on, in the order of the bytes.
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Encoder:
    """Token ids of texts. The chunks between white space are remembered with their ids as one Arrow array, so frequent ones are looked up
    without Python; so are the runs of letters or signs in them. What is remembered is bounded; when it is full only what the texts at
    hand use stays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs: dict[str, bytes] = {}
        self.known, self.ids, self.sizes = pa.array([], pa.string()), np.empty(0, np.uint16), np.empty(0, np.int64)

    def _run(self, run: str) -> bytes:
        if len(self.runs) >= CACHE:
            self.runs.clear()
        form = run if run.isascii() and run.isprintable() else run.encode("utf-8").decode("latin-1").translate(_BYTES)
        out = self.runs[run] = array("H", [t.id for t in self.model.tokenize(form)]).tobytes()
        return out

    def _chunk(self, low: str) -> bytes:
        runs = self.runs
        if low.isalpha():
            return runs.get(low) or self._run(low)
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return (runs.get(low[:-1]) or self._run(low[:-1])) + (runs.get(low[-1]) or self._run(low[-1]))
        return b"".join([runs.get(r) or self._run(r) for r in _RUNS.findall(low)])

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        """The places of distinct chunks among those known, which they join."""
        if len(self.known) > CHUNKS or self.known.nbytes > CHUNK_BYTES or len(self.ids) > CHUNK_BYTES:
            stay = pc.is_in(self.known, value_set=chunks).to_numpy(zero_copy_only=False)
            self.known, self.ids, self.sizes = self.known.filter(pa.array(stay)), self.ids[np.repeat(stay, self.sizes)], self.sizes[stay]
        place = pc.fill_null(pc.index_in(chunks, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        fresh = chunks.take(pa.array(new))
        found = list(map(self._chunk, fresh.to_pylist()))
        place[new] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, fresh])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint16)])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, found), np.int64, len(found)) >> 1])
        return place

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text; the distinct chunks of all plain ones are looked up once."""
        plain, whole = [], {}
        for i, text in enumerate(texts):
            if text and ("<|" in text or not (text.isascii() or _PLAIN.fullmatch(text))):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
                text = None
            plain.append(_SPACES.sub(" ", (text or "").lower()).encode("utf-8", "surrogatepass"))
        sizes, coded = _words(plain)
        code = self._learn(coded.dictionary)[coded.indices.to_numpy()]
        own, begin = self.sizes[code], (np.cumsum(self.sizes) - self.sizes)[code]
        ends = np.cumsum(own)
        ids = self.ids[np.repeat(begin - (ends - own), own) + np.arange(int(own.sum()))]
        out = np.split(ids, np.r_[0, ends][np.cumsum(sizes)[:-1]])
        return [whole.get(i, own) for i, own in enumerate(out)] if whole else out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The worker's encoder: tasks that follow in the same process find what earlier ones have learned."""
    return Encoder(path)


def _words(texts: list[bytes]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The number of words between white space in each text, and all words in order."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _IS_SPACE[data]
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    last = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    sizes = np.diff(np.searchsorted(first, ends), prepend=0)
    offsets = np.r_[0, np.cumsum(last - first)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[~space]))
    return sizes, words.dictionary_encode()


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first, texts) of a batch, SLICE characters at a time (or one text)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield at, texts.slice(at, to - at).to_pylist()
        at = to


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, terms binary, tfs binary"


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, window: int) -> DataFrame:
    """Every document's pieces. Rests (under a window) carry their distinct ids and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(path)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, texts in slices(batch.column(1)):
                rows = []
                for doc, ids in zip(docs[first:], own_encoder.encode(texts), strict=False):
                    ids = np.append(ids, np.uint16(END_ID))
                    for at in range(0, len(ids), window):
                        own = ids[at : at + window]
                        terms = tfs = None
                        if len(own) < window:
                            found, counts = np.unique(own, return_counts=True)
                            terms, tfs = found.tobytes(), counts.astype(np.uint16).tobytes()
                        rows.append((doc, at, len(own), crc(own), len(ids), terms, tfs))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lean(run), PIECE)


def document_frequencies(cut: DataFrame, vocabulary: int) -> np.ndarray:
    """In how many rests each term occurs; as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            every = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(every, np.uint16), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "df"])

    out = np.zeros(vocabulary, np.int64)
    for row in cut.where("terms is not null").select("terms").mapInArrow(lean(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["term"]] = row["df"]
    return out


class Shard:
    """The inverted index of some pieces, which are numbered by length: only those that still fit a window are scored."""

    def __init__(self, lengths: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = n = len(lengths)
        self.lengths = lengths
        sizes = np.fromiter(map(len, terms), np.int64, n)
        self.every, tf = np.concatenate([np.empty(0, np.uint16), *terms]), np.concatenate([np.empty(0, np.uint16), *tfs]).astype(np.float64)
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        owner = np.repeat(np.arange(n), sizes)
        weight = idf[self.every] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean_length))
        # terms of many pieces are columns of a matrix, others have posting lists
        found, count = np.unique(self.every, return_counts=True)
        common = found[np.argsort(-count, kind="stable")[:COLUMNS]]
        self.column = np.full(1 << 16, -1, np.int32)
        self.column[common] = np.arange(len(common))
        at = self.column[self.every]
        self.matrix = np.zeros((n, len(common)), np.float32)
        self.matrix[owner[at >= 0], at[at >= 0]] = weight[at >= 0]
        order = np.argsort(self.every, kind="stable")  # by term, then by piece
        order = order[at[order] < 0]
        self.owner, self.weight = owner[order].astype(np.int32), weight[order]
        self.place = self.every[order].astype(np.int64) * n + self.owner

    def scores(self, seed: int, below: int) -> np.ndarray:
        """BM25 of the pieces 0 to below - 1 for all terms of the seed."""
        own = self.every[self.begin[seed] : self.end[seed]]
        column = self.column[own]
        asked = np.zeros(self.matrix.shape[1], np.float32)
        asked[column[column >= 0]] = 1
        base = own[column < 0].astype(np.int64) * self.n
        first, last = np.searchsorted(self.place, base), np.searchsorted(self.place, base + below)
        count = last - first
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.bincount(self.owner[at], self.weight[at], minlength=below) + self.matrix[:below] @ asked


def pack_shard(lengths: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int) -> list[list[int]]:
    """Sequences of piece numbers. Every piece lies in exactly one."""
    by_length = np.argsort(lengths, kind="stable")
    lengths = lengths[by_length]
    index = Shard(lengths, [terms[i] for i in by_length], [tfs[i] for i in by_length], idf, mean_length)
    unused = np.ones(len(lengths), bool)
    rest = list(range(len(lengths)))  # the unused ones, shortest first
    out = []

    def take(i: int) -> int:
        unused[i] = False
        del rest[bisect.bisect_left(rest, i)]
        return int(lengths[i])

    while rest:
        seed = rest[-1]
        row, left = [seed], window - take(seed)
        below = int(np.searchsorted(lengths, left, "right"))
        if rest and rest[0] < below:
            scores = index.scores(seed, below)
            near = np.flatnonzero((scores > 0) & unused[:below])
            near = near[np.argsort(-scores[near], kind="stable")]
            while len(near := near[lengths[near] <= left]):
                row.append(int(near[0]))
                left -= take(row[-1])
                near = near[1:]
            while rest and (at := bisect.bisect_left(rest, int(np.searchsorted(lengths, left, "right")))):
                row.append(rest[at - 1])
                left -= take(row[-1])
        out.append(by_length[row].tolist())
    return out


RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: its document is the one token END_ID. Rows with null or repeated ids are packed like
    others. An empty table gives an empty result. tokenizer: the path of a tokenizer file, on every machine.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    vocabulary = Encoder(path).tokenizer.get_vocab_size()
    if vocabulary > 1 << 16:
        raise ValueError("ids of more than 16 bits")
    spark = docs.sparkSession
    cut = materialize(pieces(docs, id_col, text_col, path, window), "pack-pieces")
    n, rests, tokens = cut.agg(F.count(F.lit(1)), F.count("terms"), F.sum(F.when(F.col("terms").isNotNull(), F.col("length")))).first()
    df = document_frequencies(cut, vocabulary)
    idf = np.log(1 + (rests - df + 0.5) / (df + 0.5))
    mean_length = max(1.0, (tokens or 0) / max(1, rests))
    shards = max(1, -(-n // SHARD))
    rarity = spark.sparkContext.broadcast(np.where(df > 0, df, np.iinfo(np.int64).max))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = rarity.value
        for batch in batches:
            key = [-1 if t is None else int(o[np.argmin(rare[o])]) for t in batch.column("terms").to_pylist() for o in [np.frombuffer(t or b"", np.uint16)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int32())], names=[*batch.schema.names, "route"])

    routed = cut.mapInArrow(lean(route), PIECE + ", route int")
    # as many rows as terms at most; offsets of the terms' stretches in one line of all pieces
    counts = {r["route"]: r["count"] for r in routed.groupBy("route").count().toLocalIterator()}
    starts, at = np.zeros(vocabulary + 1, np.int64), 0
    sizes = np.zeros(vocabulary + 1, np.int64)
    for k in sorted(counts):
        starts[k + 1], sizes[k + 1] = at, counts[k]
        at += counts[k]
    spans = spark.sparkContext.broadcast((starts, sizes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sizes = spans.value
        for batch in batches:
            key = batch.column("route").to_numpy() + 1
            share = batch.column("share").to_numpy()
            shard = np.minimum(((starts[key] + share * sizes[key]) / max(1, n) * shards).astype(np.int64), shards - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(shard.astype(np.int32))], names=[*batch.schema.names[:7], "shard"])

    share = F.shiftrightunsigned(F.xxhash64("doc_id", "start", "ids_crc32"), 12) / F.lit(float(1 << 52))
    dealt = routed.withColumn("share", share).mapInArrow(lean(deal), PIECE + ", shard int")

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        terms = group.column("terms").to_pylist()
        length = group.column("length").to_numpy()
        rest = np.array([i for i, t in enumerate(terms) if t is not None], np.int64)
        full = [[i] for i, t in enumerate(terms) if t is None]
        tfs = group.column("tfs").to_pylist()
        packed = pack_shard(length[rest], [np.frombuffer(terms[i], np.uint16) for i in rest], [np.frombuffer(tfs[i], np.uint16) for i in rest], idf, mean_length, window)
        rows = full + [rest[r].tolist() for r in packed]
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k, row in enumerate(rows):
            sequence[row] = key[0].as_py() << 32 | k
            offset[row] = np.cumsum(length[row]) - length[row]
        return group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("shard").applyInArrow(fill, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every piece of every document, and its place."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
