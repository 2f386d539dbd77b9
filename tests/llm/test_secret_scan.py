import hashlib
import math
import random
import re
import string
from collections import Counter

import duckdb

from tidemark.llm import secret_scan as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base(text):
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def blanked(text):
    for a, _, b, _ in base(text):
        text = text[:a] + " " * (b - a) + text[b:]
    return text


def brute(texts):
    """All spans by plain loops; spans of different base kinds don't overlap in part here."""
    counts = {True: Counter(), False: Counter()}
    for text in texts:
        tokens = [(t[3], True) for t in base(text)] + [(t, False) for t in re.findall(S.TRAINED, blanked(text)) if not re.search(S.UNLABELLED, t)]
        for token, secret in tokens:
            counts[secret].update(zip(token, token[1:]))
    totals = {k: Counter() for k in counts}
    for k, c in counts.items():
        for (a, _), n in c.items():
            totals[k][a] += n

    def share(secret, a, b, uniform):
        return (1 - uniform) * counts[secret][a, b] / totals[secret][a] + uniform / S.SYMBOLS if totals[secret][a] else 1 / S.SYMBOLS

    def llr(token):
        return sum(math.floor(1000 * math.log(share(True, a, b, S.RANDOM_UNIFORM) / share(False, a, b, S.ORDINARY_UNIFORM))) for a, b in zip(token, token[1:]) if totals[True][a] or totals[False][a])

    out = []
    for text in texts:
        judged = [(m.start(), 3, m.end()) for m in re.finditer(S.JUDGED, blanked(text)) if re.search("[A-Za-z]", m[0]) and llr(m[0]) >= S.THRESHOLD]
        out.append((sorted([f[:3] for f in base(text)] + judged)))
    return out


def said(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 6))) for _ in range(60)]
    draw = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    texts = []
    for i in range(n):
        parts = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 300))]
        parts = [p.title() if rng.random() < 0.1 else p.upper() if rng.random() < 0.02 else p for p in parts]
        planted = {
            0: f"{rng.choice(['PassWord', 'token', 'API_KEY', 'apikey', 'Secret'])}{rng.choice(['', ' '])}{rng.choice('=:')} '{draw(string.hexdigits[:16], 40)}'",
            1: "AKIA" + draw(string.ascii_uppercase + string.digits, rng.choice([11, 12, 16])),
            2: draw(string.hexdigits[:16], rng.choice([31, 32, 64])),
            3: "xk_" + draw(string.ascii_letters + string.digits, 36),
            4: "token: short7x",
            5: "𝒳é ſecret=ignored12345678 toKen=ignored12345678",
            6: draw(string.digits, 24),
        }.get(i % 9)
        if planted:
            parts.insert(rng.randrange(len(parts) + 1), planted)
        texts.append(" ".join(parts))
    return texts


def test_against_plain_loops(spark):
    texts = corpus()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, None, "x"), (7, "", "x"), (7, texts[7], "x"), (7, texts[7], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    every = [r[1] or "" for r in rows]
    want = brute(every)
    assert sum(k == 3 for spans in want for _, k, _ in spans) >= 20
    out = S.scan(docs, S.table_of(S.train(S.labelled_samples(docs)))).select("doc_id", S.joined(S.F.col("found")).alias("spans")).collect()
    assert Counter((r.doc_id, r.spans) for r in out) == Counter((r[0], said(w)) for r, w in zip(rows, want, strict=True))


def test_held_out_strings(spark):
    """A model of one half of the corpus judges strings and identifiers that it has not seen."""
    ratios = S.table_of(S.train(S.labelled_samples(spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string"))))
    rng = random.Random(1)
    strange = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(24)) for _ in range(300)]
    usual = [t for text in corpus(seed=6) for t in re.findall(S.JUDGED, blanked(text)) if re.fullmatch("[a-z]+", t)]
    judged = S.scan(spark.createDataFrame([(i, t) for i, t in enumerate(strange + usual)], "doc_id long, text string"), ratios).collect()
    hit = {r.doc_id for r in judged if r.found}
    assert sum(i in hit for i in range(300)) >= 285
    assert sum(i >= 300 for i in hit) <= len(usual) // 100


def test_long_text_and_empty_table(spark):
    token = 'token = "' + "deadbeef01" * 4 + '" '
    docs = spark.createDataFrame([(1, "é" * 3 + token * 3000)], "doc_id long, text string")
    ratios = [0] * 128 * 128
    row = S.scan(docs, ratios).first()
    assert [(e.start, e.end) for e in row.found if e.kind == 0] == [(3 + k * len(token), 3 + k * len(token) + 49) for k in range(3000)]
    assert S.scan(docs.limit(0), ratios).count() == 0 and S.train(S.labelled_samples(docs.limit(0))).count() == 0


def test_query_against_sql(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(corpus())) + [(None, None), (3, "")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = S.query(spark, str(tmp_path))
    want = con.sql(S.ORACLE_SQL)
    assert Counter(map(tuple, out.select(want.columns).collect())) == Counter(want.fetchall())
    assert all(r.base_sha256 == hashlib.sha256(",".join(x for x in r.spans.split(",") if x[:1] != "m").encode()).hexdigest() for r in out.collect())
