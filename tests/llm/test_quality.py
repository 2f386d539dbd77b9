import math
from collections import Counter

import numpy as np

from tidemark.llm import quality as Q


def brute_model(texts):
    """log p of every 4-gram by the textbook formulas, from dictionaries."""
    grams = Counter()
    for t in texts:
        codes, _ = Q.symbols([t])
        grams.update(tuple(codes[i : i + 4].tolist()) for i in range(len(codes) - 3))
    orders = {4: grams}
    for k in (3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    disc, total, held = {}, {}, {}
    for k, c in orders.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        raw = [i - (i + 1) * y * (n[i + 1] / n[i] if n[i] else 0) for i in (1, 2, 3)]
        disc[k] = [min(max(d, 0.05), 0.95 * i) for d, i in zip(raw, (1, 2, 3), strict=True)]
        total[k], held[k] = Counter(), Counter()
        for g, v in c.items():
            total[k][g[:-1]] += v
            held[k][g[:-1]] += disc[k][min(v, 3) - 1]

    def p(g):
        q = 1 / (1 << 16)
        for k in range(1, 5):
            own = g[4 - k :]
            if total[k][own[:-1]]:
                v = orders[k].get(own, 0)
                q = (max(v - disc[k][min(v, 3) - 1], 0) if v else 0) / total[k][own[:-1]] + held[k][own[:-1]] / total[k][own[:-1]] * q
        return q

    return p


def test_number_is_the_grams():
    codes, sizes = Q.symbols(["ab\t 12é", None, "😀b"])
    grams, index = Q.number(codes)
    want = [int(codes[i]) << 48 | int(codes[i + 1]) << 32 | int(codes[i + 2]) << 16 | int(codes[i + 3]) for i in range(len(codes) - 3)]
    assert [int(g) for g in grams.view(np.uint64)[index]] == want
    assert sizes.tolist() == [3 + 6 + 1, 4, 3 + 2 + 1]


def test_perplexities_match_brute_force(spark, sf_dir):
    base = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).collect()]
    docs = [(i, t, "en" if i % 3 else "fr", 1.0) for i, t in enumerate(base)]
    docs += [(100, None, "en", 1.0), (101, "", "en", 1.0), (102, "zz", None, 1.0), (103, "a", "xx", 1.0), (104, "the " * 20000, "en", 1.0), (5, base[5], "fr" if 5 % 3 == 0 else "en", 1.0), (None, "no id", "en", 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    trusted = spark.createDataFrame([(i,) for i in range(0, 30, 2)] + [(2,)], "doc_id long")
    out = Q.classify(df, trusted, calibrate=0).collect()
    assert len(out) == len(docs)
    models = {g: brute_model([t for i, t, lang, _ in docs if i is not None and i < 30 and i % 2 == 0 and lang == g]) for g in ("en", "fr")}
    texts = {(i, lang or ""): t for i, t, lang, _ in docs}
    for r in out:
        if r.lang not in models:
            assert r.perplexity is None and r.kept
            continue
        codes, _ = Q.symbols([texts[r.doc_id, r.lang]])
        logs = [math.log(models[r.lang](tuple(codes[i : i + 4].tolist()))) for i in range(len(codes) - 3)]
        assert math.isclose(r.perplexity, math.exp(-sum(logs) / len(logs)), rel_tol=1e-9)
        assert r.trusted == (r.doc_id is not None and r.doc_id < 30 and r.doc_id % 2 == 0)
    kept = Q.filter_documents(df, trusted)
    out = Q.classify(df, trusted).collect()
    assert kept.columns == df.columns
    assert kept.count() == sum(r.kept for r in out)


def test_model_is_a_distribution():
    p = brute_model(["the cat sat", "the dog sat"])
    ctx = tuple(map(ord, "the"))
    seen = {ord(c) for c in "the catsdog"} | {2, 3}
    mass = sum(p((*ctx, c)) for c in seen) + (65536 - len(seen)) * p((*ctx, 40000))
    assert math.isclose(mass, 1, rel_tol=1e-9)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert Q.classify(df, df.select("doc_id")).count() == 0
    one = spark.createDataFrame([(1, "text", "en")], df.schema)
    assert [r.kept for r in Q.classify(one, df.select("doc_id")).collect()] == [True]


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1 and toxic = 0")
    kept = {(r.quality, r.kept): r["count"] for r in Q.classify(docs, Q.trusted(train)).join(held, "doc_id").groupBy("quality", "kept").count().collect()}
    good = kept.get((1, True), 0) / (kept.get((1, True), 0) + kept.get((1, False), 0))
    bad = kept.get((0, False), 0) / (kept.get((0, True), 0) + kept.get((0, False), 0))
    assert good > 0.97 and bad > 0.7


def test_plans_stay_small(spark, monkeypatch):
    """No stored table comes from one plan of all orders: Spark plans it anew after each stage, in the driver's memory."""
    seen, stored = {}, Q.materialize

    def watched(df, name):
        seen[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return stored(df, name)

    monkeypatch.setattr(Q, "materialize", watched)
    docs = spark.createDataFrame([(k, f"some text {k}", "en") for k in range(9)], "doc_id long, text string, lang string")
    assert Q.perplexities(docs, docs.select("doc_id"), calibrate=0).where("perplexity > 1").count() == 9
    assert "kn-scores" in seen and max(seen.values()) <= 8, seen
