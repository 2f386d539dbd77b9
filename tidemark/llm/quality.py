"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over character 4-grams of normalised text, one model per language, trained on trusted documents but for one in
CALIBRATE, which set the thresholds. Counts, discounts, contexts and continuation counts are tables, joined by n-gram; no
process ever holds the model. Documents are packed into blocks of some megabytes of text. A block asks for the log
probability of each distinct n-gram in it once (a row per n-gram and block instead of one per occurrence), the
requests are joined to the model, and the answers go back to the block, which sums them by document.
The threshold of a language is a quantile of its held-out trusted documents' scores (perplexities allowed for length) and a margin.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import delete, discard, lean, materialize, shared_dir, small, unused

#: Characters in one block; rows of requests sent at once; the quantile of held-out scores and how far over it, as a factor, a
#: document may lie (for good text of kinds that are rare among the trusted); the allowance for the scatter of short texts: a
#: score is the perplexity divided by exp(SHORT / sqrt(symbols)).
BLOCK_CHARS, ROWS, QUANTILE, MARGIN, SHORT = 8_000_000, 1 << 16, 0.995, 1.1, 3.0
#: Symbols of a block that are worked on at once (or one document).
CHUNK = 1 << 18
#: One trusted document in so many is kept out of the model and sets the threshold: text that a model has seen scores too well.
CALIBRATE = 5
START, END = 2, 3
_SPACES, _DIGITS = re.compile(r"\s+"), re.compile(r"\d")
ORDER = 4


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit symbols of all texts and the number of each: white space runs are one space, digits are 0, characters
    beyond the basic plane share a symbol; every text has three start symbols and an end symbol."""
    pad = chr(START) * (ORDER - 1)
    clean = [pad + _DIGITS.sub("0", _SPACES.sub(" ", t or "").strip()) + chr(END) for t in texts]
    sizes = np.fromiter(map(len, clean), np.int64, len(clean))
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(codes, 0xFFFF).astype(np.uint16), sizes


def _marked(values: np.ndarray, size: int) -> np.ndarray:
    """The distinct values, under size, in order."""
    seen = np.zeros(size, bool)
    seen[values] = True
    return np.flatnonzero(seen)


def number(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 4-grams as longs, index of the one that ends at each symbol from the fourth on)."""
    chars = np.flatnonzero(np.bincount(codes, minlength=1 << 16))
    small = np.zeros(1 << 16, np.int64)
    small[chars] = np.arange(len(chars))
    c = small[codes]
    pair = c[:-1] * len(chars) + c[1:]
    used = _marked(pair, len(chars) ** 2) if len(chars) ** 2 <= 1 << 22 else np.unique(pair)
    first = chars[used // len(chars)].astype(np.uint64)
    second = chars[used % len(chars)].astype(np.uint64)
    if len(chars) ** 2 <= 1 << 22:
        to = np.zeros(len(chars) ** 2, np.int32)
        to[used] = np.arange(len(used))
        pair = to[pair].astype(np.int64)
    else:
        pair = np.searchsorted(used, pair)
    four = pair[:-2] * len(used) + pair[2:]
    if len(used) ** 2 <= 1 << 22:
        kinds = _marked(four, len(used) ** 2)
        to = np.zeros(len(used) ** 2, np.int32)
        to[kinds] = np.arange(len(kinds))
        index = to[four]
    else:
        kinds, index = np.unique(four, return_inverse=True)
    a, b = kinds // len(used), kinds % len(used)
    grams = first[a] << np.uint64(48) | second[a] << np.uint64(32) | first[b] << np.uint64(16) | second[b]
    return grams.view(np.int64), index


def pack(docs: DataFrame) -> DataFrame:
    """(block, lang, ids, content): documents (doc_id, text_key, lang, text) in compressed blocks of one language each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        held: dict[str, tuple[list, int]] = {}

        def out(lang: str, parts: list) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=options) as w:
                w.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([lang]), pa.array([whole.column("doc_id").to_pylist()], pa.list_(whole.schema.field("doc_id").type)), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "lang", "ids", "content"])

        for batch in batches:
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                rows = batch.filter(pc.equal(langs, lang)).drop_columns(["lang"])
                at = 0
                sizes = np.cumsum(pc.binary_length(rows.column("text").cast(pa.binary())).to_numpy(zero_copy_only=False))
                while at < rows.num_rows:
                    parts, chars = held.pop(lang, ([], 0))
                    base = int(sizes[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(sizes, base + BLOCK_CHARS - chars, "right")))
                    parts, chars = [*parts, rows.slice(at, to - at)], chars + int(sizes[min(to, len(sizes)) - 1]) - base
                    at = to
                    if chars >= BLOCK_CHARS or at < rows.num_rows:
                        yield out(lang, parts)
                    else:
                        held[lang] = (parts, chars)
        for lang, (parts, _) in held.items():
            yield out(lang, parts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(run), f"block long, lang string, ids array<{kind}>, content binary")


def store(blocks: DataFrame) -> str:
    """Writes the blocks once, bucketed by block: no later join moves them. Returns the table's name."""
    spark = blocks.sparkSession
    name = f"kn_blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(parts, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return name


def _chunks(content: bytes) -> Iterator[tuple[int, pa.Table]]:
    """(number of the first document, documents) of a block, some CHUNK characters at a time."""
    rows = pa.ipc.open_stream(content).read_all()
    ends = np.cumsum(pc.utf8_length(rows.column("text")).to_numpy())
    at = 0
    while at < rows.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield at, rows.slice(at, to - at)
        at = to


def requests(blocks: DataFrame) -> DataFrame:
    """(block, lang, gram, trusted): the distinct 4-grams of each block, and their count in trusted documents.

    blocks: (block, lang, content, places); places: the trusted documents of the block, each as twice its number, plus one if it is
    kept out of the model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, content, places in zip(*batch.columns, strict=True):
                taught = {p >> 1 for p in places.as_py() or [] if not p & 1}
                parts = []
                for first, rows in _chunks(content.as_py()):
                    codes, sizes = symbols(rows.column("text").to_pylist())
                    grams, index = number(codes)
                    trusted = np.repeat(np.fromiter((first + k in taught for k in range(len(sizes))), bool, len(sizes)), sizes)[ORDER - 1 :]
                    inside = np.ones(len(codes), bool)
                    ends = np.cumsum(sizes)
                    for k in range(ORDER - 1):  # 4-grams that would begin in the text before
                        inside[ends[:-1] + k] = False
                    inside = inside[ORDER - 1 :]
                    asked = np.zeros(len(grams), bool)
                    asked[index[inside]] = True
                    parts.append((grams[asked], np.bincount(index[inside & trusted], minlength=len(grams))[asked]))
                if not parts:
                    continue
                grams, index = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                counts = np.bincount(index, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                del parts, index
                for at in range(0, len(grams), ROWS):
                    own = grams[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.repeat(block, len(own)), pa.repeat(lang, len(own)), pa.array(own), pa.array(counts[at : at + ROWS])], names=["block", "lang", "gram", "trusted"])

    return blocks.mapInArrow(lean(run), "block long, lang string, gram long, trusted long")


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of one order from its counts (lang, n): the modified Kneser-Ney discounts."""
    n = [F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4)]
    by = counts.groupBy("lang").agg(*(c.alias(f"n{k}") for k, c in zip((1, 2, 3, 4), n, strict=True)))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    ratio = lambda a, b: F.when(F.col(a) > 0, F.col(b) / F.col(a)).otherwise(0.0)
    raw = [1 - 2 * y * ratio("n1", "n2"), 2 - 3 * y * ratio("n2", "n3"), 3 - 4 * y * ratio("n3", "n4")]
    return by.select("lang", *(F.least(F.greatest(d, F.lit(0.05)), F.lit(k * 0.95)).alias(f"d{k}") for k, d in zip((1, 2, 3), raw, strict=True)))


def model(counts: DataFrame, scratch: list[DataFrame]) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order k: (lang, gram, p: the discounted part) and (lang, context, gamma: the weight of the lower order).

    counts: (lang, gram, n) of 4-grams. Lower orders count the distinct symbols before a gram. Their tables are added to scratch.
    """
    out = {}
    for k in range(ORDER, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))
        discounts = small(_discounts(counts), f"kn-discounts-{k}")
        # a gram's context is all but its last symbol; the discounts are one row a language
        c = counts.join(discounts, "lang").withColumn("context", F.shiftrightunsigned("gram", 16))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        contexts = c.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(d).alias("held"))
        probs = c.withColumn("d", d).join(contexts.select("lang", "context", "total"), ["lang", "context"]).select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("p"))
        out[k] = (probs, contexts.select("lang", "context", (F.col("held") / F.col("total")).alias("gamma")))
        if k > 1:
            counts = materialize(counts.groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"kn-{k - 1}")
            scratch.append(counts)
    return out


def log_probabilities(asked: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, gram, logp) for distinct (lang, gram), stored: from the lowest order up, p + gamma * (p of the lower order).

    Below single symbols lies the uniform distribution over 2**16. Languages without a model have no row. asked: (lang, gram), repeats
    allowed. Each order is a table of the distinct grams that are asked for at it, which the next one joins: one plan of all orders would be
    large enough to fill the driver's memory while Spark plans it anew after each of its stages.
    """
    low = lambda k: F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")
    shorter = materialize(asked.select("lang", low(ORDER - 1)).distinct(), "kn-asked")
    known = small(tables[1][1].select("lang").distinct(), "kn-langs")
    lower = None
    for k in range(1, ORDER + 1):
        probs, contexts = tables[k]
        step = (asked if k == ORDER else shorter.select("lang", low(k))).select("lang", "gram").distinct()
        step = step.withColumn("q", F.lit(1.0 / (1 << 16))) if lower is None else step.withColumn("l", low(k - 1)).join(lower.select("lang", F.col("gram").alias("l"), "q"), ["lang", "l"])
        step = step.withColumn("c", F.shiftrightunsigned("gram", 16)).join(probs.select("lang", "gram", "p"), ["lang", "gram"], "left").join(contexts.select("lang", F.col("context").alias("c"), "gamma"), ["lang", "c"], "left")
        q = F.coalesce("p", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("q")
        done = [] if lower is None else [lower]
        if k < ORDER:
            lower = materialize(step.select("lang", "gram", q.alias("q")), f"kn-q{k}")
        else:
            done.append(shorter)
            lower = materialize(step.join(known, "lang", "left_semi").select("lang", "gram", F.log(q).alias("logp")), "kn-scores")
        discard(*done)
    return lower


def perplexities(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", calibrate: int = CALIBRATE) -> DataFrame:
    """(doc_id, text_key, lang, trusted, held_out, n_symbols, perplexity) for every row of docs.

    trusted_ids: (doc_id). One in `calibrate` of them is not in the model (0: all are). Null texts are empty (their perplexity is that of the end symbol), null languages are
    the language ''. Perplexity is null in languages without trusted text. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    ids = trusted_ids.select(F.col("doc_id").alias("id")).distinct().withColumn("out", (F.pmod(F.xxhash64("id"), F.lit(calibrate)) == 0).cast("int") if calibrate else F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    name = store(pack(rows.select("doc_id", F.md5("text").alias("text_key"), "lang", "text")))
    blocks = spark.table(name)
    places = blocks.select("block", F.posexplode("ids").alias("place", "id")).join(ids, "id").groupBy("block").agg(F.collect_list(2 * F.col("place") + F.col("out")).alias("places"))
    marked = blocks.join(places, "block", "left").select("block", "lang", "content", "places")
    scratch: list[DataFrame] = []

    def kept(df: DataFrame, table: str) -> DataFrame:
        scratch.append(materialize(df, table))
        return scratch[-1]

    def collect(key: tuple, group: pa.Table) -> pa.Table:
        grams = group.column("gram").to_numpy()
        order = np.argsort(grams)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "grams": pa.array([grams[order].tobytes()], pa.binary()), "logps": pa.array([group.column("logp").to_numpy()[order].tobytes()], pa.binary())})


    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, content, places, known, logps in zip(*batch.columns, strict=True):
                marks = {p >> 1: p & 1 for p in places.as_py() or []}
                have = values = None
                if known.as_py() is not None:
                    have, values = np.frombuffer(known.as_py(), np.int64), np.frombuffer(logps.as_py(), np.float64)
                for first, rows in _chunks(content.as_py()):
                    codes, sizes = symbols(rows.column("text").to_pylist())
                    ppl = np.full(len(sizes), np.nan)
                    if have is not None:
                        grams, index = number(codes)
                        at = np.minimum(np.searchsorted(have, grams), len(have) - 1)
                        value = np.where(have[at] == grams, values[at], 0.0)[index]
                        ends = np.cumsum(sizes)
                        sums = np.r_[0.0, np.cumsum(value)]
                        total = sums[ends - (ORDER - 1)] - sums[ends - sizes]
                        ppl = np.exp(-total / (sizes - (ORDER - 1)))
                    mark = [marks.get(first + k) for k in range(len(sizes))]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id").combine_chunks(), rows.column("text_key").combine_chunks(), pa.array([lang.as_py()] * len(sizes), pa.string()), pa.array([m is not None for m in mark]), pa.array([m == 1 for m in mark]), pa.array(sizes - ORDER, pa.int64()), pa.array(ppl, from_pandas=True)],
                        names=["doc_id", "text_key", "lang", "trusted", "held_out", "n_symbols", "perplexity"],
                    )

    kind = docs.schema[id_col].dataType.simpleString()
    try:
        asked = kept(requests(marked), "kn-requests")
        counts = kept(asked.where("trusted > 0").groupBy("lang", "gram").agg(F.sum("trusted").alias("n")), "kn-4")
        scored = log_probabilities(asked.select("lang", "gram"), model(counts, scratch))
        scratch.append(scored)
        answers = asked.select("block", "lang", "gram").join(scored, ["lang", "gram"])
        answered = answers.select("block", "gram", "logp").groupBy("block").applyInArrow(collect, "block long, grams binary, logps binary")
        joined = marked.join(answered, "block", "left").select("lang", "content", "places", "grams", "logps")
        out = materialize(joined.mapInArrow(lean(score), f"doc_id {kind}, text_key string, lang string, trusted boolean, held_out boolean, n_symbols long, perplexity double"), "kn-perplexities")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, f"{shared_dir(spark)}/{name}")
        discard(*scratch)
    return out


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, calibrate: int = CALIBRATE) -> DataFrame:
    """perplexities() with `score`, `threshold` and `kept`.

    The threshold is the quantile, times the margin, of the scores of the language's held-out trusted documents, or of all trusted ones where none is
    held out. Rows without a perplexity or threshold are kept: nothing speaks against them. Null and empty texts score as their
    end symbol, very long ones are read whole, repeated rows get equal results. An empty table, or one without trusted
    documents, gives no thresholds. Columns of docs other than the three named are not read and may have any name.
    """
    scored = perplexities(docs, trusted_ids, id_col, text_col, lang_col, calibrate)
    scored = scored.withColumn("score", F.col("perplexity") * F.exp(-SHORT / F.sqrt(F.col("n_symbols") + 1)))
    at = lambda rows: F.percentile_approx(F.when(rows, F.col("score")), quantile, 10000)
    limits = scored.where("trusted").groupBy("lang").agg((F.coalesce(at(F.col("held_out")), at(F.lit(True))) * margin).alias("threshold"))
    return scored.join(small(limits, "kn-thresholds"), "lang", "left").withColumn("kept", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)))


def filter_documents(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the classifier keeps, unchanged, with columns of any name. Rejected rows are matched by id, language
    and text digest, nulls included."""
    i, lang, k = (unused(c, docs.columns) for c in ("__tm_i", "__tm_l", "__tm_k"))
    out = classify(docs, trusted_ids, id_col, text_col, lang_col).where(~F.col("kept")).select(F.col("doc_id").alias(i), F.col("lang").alias(lang), F.col("text_key").alias(k)).distinct()
    key = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    same = (key == F.col(k)) & F.col(id_col).eqNullSafe(F.col(i)) & (F.coalesce(F.col(lang_col).cast("string"), F.lit("")) == F.col(lang))
    return docs.join(out, same, "left_anti")


def trusted(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: perplexity, threshold and verdict of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs, trusted(labels))
    return out.select("doc_id", "lang", "trusted", "n_symbols", F.round("perplexity", 6).alias("perplexity"), F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "kept")
