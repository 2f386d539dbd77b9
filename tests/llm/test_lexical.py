import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import lexical as L

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    tfs = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in tfs), sum(c.total() for c in tfs)
    df = Counter(t for c in tfs for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, _), c in zip(docs, tfs, strict=True):
            m = c and 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            scores += [(-score, doc_id is None, doc_id)] if score > 0 else []
        out += [(item_id, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "naïve", "x_y", "日本", "A1", "ſ"]
    draw = lambda n: " ".join(rng.choice(words[: rng.choice([3, 10, 46])]) for _ in range(n))
    docs = [(i, draw(rng.randrange(0, 30))) for i in range(400)]
    docs += [(1000 + i, "same w1 w2 copy") for i in range(90)] + [(5, docs[5][1])] * 3
    docs += [(None, "w1 w2 copy same"), (2000, None), (2001, ""), (2002, " -- \x00 !"), (2003, "w1 " * 50_000)]
    items = [(i, draw(rng.randrange(1, 40))) for i in range(25)] + [(3, "copy"), (3, "copy same"), (90, None), (91, ""), (92, "unknown only"), (93, "SAME été ÉTÉ w1 w1")]
    return docs, items


@pytest.mark.parametrize(("block", "postings"), [(8_000_000, 1 << 20), (300, 50)])
def test_against_plain_loops(spark, monkeypatch, block, postings):
    monkeypatch.setattr(L, "BLOCK_BYTES", block)
    monkeypatch.setattr(L, "SHARD_POSTINGS", postings)
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, n int, rank string").repartition(3)
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, q int")
    out = L.search(df, queries, k=20).select("item_id", "rank", "doc_id", "score")
    assert Counter(map(tuple, out.collect())) == brute(docs, items, 20)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.search(docs.limit(0), items).count() == 0 == L.search(docs, items.limit(0)).count()
    assert L.search(docs, items).columns == L.search(docs, items.limit(0)).columns


def test_kernel_stops_early_and_right():
    rng = np.random.default_rng(3)
    for trial in range(40):
        n_docs, n_terms = int(rng.integers(1, 900)), 8
        dense = rng.random((n_docs, n_terms)) < rng.choice([0.1, 0.9])
        doc, term = np.nonzero(dense)
        impact = (rng.pareto(1.0, len(doc)) * 50 + (trial % 3 == 0)).astype(np.int64) if trial % 2 else rng.integers(0, 3, len(doc))
        shard = L.Shard(n_docs, n_terms, doc, term, impact)
        asked = np.flatnonzero(rng.random(n_terms) < 0.6)
        docs, scores, _ = L.best_positions(shard, asked, 10)
        full = np.zeros((n_docs, n_terms), np.int64)
        full[doc, term] = impact
        want = full[:, asked].sum(axis=1)
        assert (want[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
        limit = np.sort(want)[::-1][9] if n_docs >= 10 else 0
        assert set(np.flatnonzero((want >= limit) & (want > 0))) <= set(docs.tolist())


def test_best_positions_save_accesses():
    """Lists in the same order: the best positions rise together, and few places are read."""
    n = 20_000
    doc = np.repeat(np.arange(n), 2)
    impact = np.repeat(np.arange(n)[::-1] + 1, 2)
    shard = L.Shard(n, 2, doc, np.tile([0, 1], n), impact)
    docs, _, accesses = L.best_positions(shard, np.array([0, 1]), 10)
    assert set(range(10)) <= set(docs.tolist()) and accesses <= 4 * L.FIRST_READ


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(L.ORACLE_SQL)
    assert Counter(map(tuple, L.query(spark, sf_dir).select(want.columns).collect())) == Counter(want.fetchall())
