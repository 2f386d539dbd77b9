"""Ranked lexical search by the Best Position Algorithm.

Documents are read once per block of queries into a forward index of the queries' terms, stored in the shared folder; counts
over it give the statistics of all documents. A task then takes the index in shards of bounded size. In a shard every term has
an impact list, postings by falling impact. Queries read their lists from the top, some positions at a time; a document that is
seen for the first time is scored by direct accesses to its postings in all lists, which also tell its positions there. A list's
best position is the end of the positions seen without a gap. No unseen document can score more than the impacts at the best
positions add up to, so a query stops once that sum lies strictly below its k-th score (equal scores could still go to a smaller id).

A task keeps the best k of each query over its shards, so a later shard starts with the k-th score of those before. No posting
is shuffled: a term that stands in every document is spread over all tasks. Results of the tasks are merged in two steps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Bytes of query text in a block, which every task gets whole.
BLOCK_BYTES = 8_000_000
#: Postings of a shard, one document more or less.
SHARD_POSTINGS = 1 << 20
#: Positions that are read from each list in the first round; twice as many in each one after.
FIRST_READ = 64
#: Parts in which the tasks' results are merged first.
MERGE_PARTS = 16

#: A term is a run of letters A-Z (lowered), a-z, digits and characters beyond ASCII: all other bytes become spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Shard:
    """Impact lists of some documents: postings (term, document, impact) with their places in the lists and by document."""

    def __init__(self, n_docs: int, n_terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """doc ascends."""
        self.n_docs = n_docs
        order = np.lexsort((doc, -impact, term))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.list_start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.doc_start = np.searchsorted(doc, np.arange(n_docs + 1))
        self.term, self.impact = term, impact
        self.place = np.empty(len(order), np.int64)  # of each posting of a document, in the lists
        self.place[order] = np.arange(len(order))

    def direct(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, posting) of all postings of docs, by direct access."""
        start, size = self.doc_start[docs], self.doc_start[docs + 1] - self.doc_start[docs]
        owner = np.repeat(np.arange(len(docs)), size)
        return owner, np.arange(size.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)


def best_positions(shard: Shard, terms: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, sorted accesses): among others every document of the shard that can be in the best k and scores `floor` or
    more, scores above 0 only."""
    start, end = shard.list_start[terms], shard.list_start[terms + 1]
    start, end, terms = (v[end > start] for v in (start, end, terms))
    wanted = np.zeros(len(shard.list_start), bool)
    wanted[terms] = True
    seen_place, seen_doc = np.zeros(len(shard.list_doc), bool), np.zeros(shard.n_docs, bool)
    best = start.copy()  # the first place of each list that is not seen
    docs, scores, depth, step, accesses, kth = [], [], 0, FIRST_READ, 0, floor
    while len(terms):
        read = np.concatenate([np.arange(min(s + depth, e), min(s + depth + step, e)) for s, e in zip(start, end, strict=True)])
        depth, step, accesses = depth + step, 2 * step, accesses + len(read)
        new = np.unique(shard.list_doc[read])
        new = new[~seen_doc[new]]
        seen_doc[new] = True
        owner, posting = shard.direct(new)
        in_query = wanted[shard.term[posting]]
        owner, posting = owner[in_query], posting[in_query]
        seen_place[shard.place[posting]] = True
        total = np.zeros(len(new), np.int64)
        np.add.at(total, owner, shard.impact[posting])
        docs.append(new[total > 0])
        scores.append(total[total > 0])
        for i, (b, e) in enumerate(zip(best, end, strict=True)):
            gap = np.flatnonzero(~seen_place[b:e][: 4 * depth]) if b < e else []
            while b < e and not len(gap):
                b = min(b + 4 * depth, e)
                gap = np.flatnonzero(~seen_place[b:e][: 4 * depth])
            best[i] = b + gap[0] if len(gap) else e
        # the impact at the last place seen without a gap; nothing is left of a list that is seen whole
        most = int(shard.list_impact[best[best < end] - 1].sum())
        found = np.concatenate(scores)
        if len(found) >= k:
            kth = max(kth, int(np.partition(found, len(found) - k)[len(found) - k]))
        if most < kth or (best >= end).all():
            break
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    docs, scores = np.concatenate(docs), np.concatenate(scores)
    return docs[scores >= kth], scores[scores >= kth], accesses


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A posting's part of the score; weight: of its term, n: terms of its document, n_docs and n_terms: of the collection."""
    m = 50 + (50 * n * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): documents with a term, their number of terms, and numbers and occurrences of those in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = terms_of(text.as_py())
                if found:
                    tf = {number[t]: c for t, c in Counter(found).items() if t in number}
                    rows.append((doc_id.as_py(), len(found), list(tf), list(tf.values())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], ["doc_id", "n", "terms", "tfs"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _best(score: np.ndarray, absent: np.ndarray, doc_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((doc_id, absent, -score))[:k]
    return score[order], absent[order], doc_id[order]


def searched(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(q, doc_id, score): of every task the best k of each query (numbers of terms), from forward()'s table."""
    shared = index.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        none = np.zeros(0, np.int64)
        top = [(none, np.zeros(0, bool), none)] * len(asked)

        def search(rows: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(rows).combine_chunks()
            ids = table.column("doc_id")
            absent, doc_id = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
            sizes = table.column("terms").combine_chunks().value_lengths().to_numpy()
            term, tf = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "tfs"))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            shard = Shard(len(sizes), len(weight), doc, term, impacts(tf, table.column("n").to_numpy()[doc], weight[term], n_docs, n_terms))
            for q, terms in enumerate(asked):
                score, gone, own = top[q]
                docs, scores, _ = best_positions(shard, terms, k, int(score[-1]) if len(score) == k else 0)
                if len(docs):
                    top[q] = _best(np.concatenate([score, scores]), np.concatenate([gone, absent[docs]]), np.concatenate([own, doc_id[docs]]), k)

        held, postings = [], 0
        for batch in batches:
            sizes = np.cumsum(batch.column("terms").value_lengths().to_numpy())
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                to = min(batch.num_rows, int(np.searchsorted(sizes, before + SHARD_POSTINGS - postings)) + 1)
                held.append(batch.slice(at, to - at))
                postings, at = postings + int(sizes[to - 1] - before), to
                if postings >= SHARD_POSTINGS:
                    search(held)
                    held, postings = [], 0
        if held:
            search(held)
        for q, (score, gone, own) in enumerate(top):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q), pa.int32()), pa.array(own, pa.int64(), mask=gone), pa.array(score, pa.int64())], ["q", "doc_id", "score"])

    return index.mapInArrow(run, "q int, doc_id long, score long")


def _search_block(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """search() for the items (item_id, text) of one block; each is a query of its own, whatever its id."""
    spark = docs.sparkSession
    asked = [sorted(set(terms_of(item["text"]))) for item in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for terms in asked for t in terms}))}
    index = materialize(forward(docs, vocabulary, id_col, text_col), "lexical-index")
    one = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not one["docs"]:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for row in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
        df[row["t"]] = row["count"]
    weights = np.floor(1000 * np.log((2.0 * one["docs"] + 2) / (2.0 * df + 1))).astype(np.int64)
    queries = [np.array([vocabulary[t] for t in terms], np.int64) for terms in asked]
    found = searched(index, queries, weights, one["docs"], one["terms"], k)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))
    few = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, item["item_id"]) for q, item in enumerate(items)], "q int, item_id long")
    return ranked.join(names, "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of every query; equal scores by ascending id, a null id
    last.

    Null and empty texts have no terms: such documents don't count, such queries find nothing. Repeated rows are documents or
    queries of their own. Texts of any length are read whole. Empty tables give an empty result. Other columns are not read.
    Queries come in blocks of about 8 MB of text, a query more or less, and documents are read once a block.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("item_id"), F.col(query_text).cast("string").cast("binary").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else asked
        items = [r for r in own.collect() if terms_of(r["text"])]  # one block
        out += [_search_block(docs, items, k, id_col, text_col)] if items else []
    out = [o for o in out if o is not None]
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the fifty best documents of every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
WITH asked AS (SELECT q, item_id, unnest(list_distinct({_SQL_TERMS.format("text")})) AS term FROM (SELECT *, row_number() OVER () AS q FROM benchmark)),
tokens AS (SELECT r, doc_id, unnest({_SQL_TERMS.format("text")}) AS term FROM (SELECT *, row_number() OVER () AS r FROM documents)),
postings AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM postings GROUP BY r),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, total WHERE term IN (SELECT term FROM asked) GROUP BY term, nn),
scored AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (r), total GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
