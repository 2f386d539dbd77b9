import hashlib
import re
import uuid
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import rules as R
from tidemark.llm import sharding as H
from tidemark.llm import warc as W
from tidemark.llm.common import shared_dir


def test_interleave_keeps_the_mixture(spark):
    rows = [(i, f"t{i}" if i % 7 else None, "hot" if i % 3 == 0 else f"s{i % 5}" if i % 11 else None, 1) for i in range(600)] + [(3, "t3", "hot", 1)] * 5 + [(None, "x", "hot", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    out = H.interleave(df, 24).collect()
    assert len(out) == len(rows)
    per = Counter(r.shard for r in out)
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(per[s]))
    total = Counter(r.source for r in out)
    for source, n in total.items():
        for s in per:
            assert abs(sum(r.source == source and r.shard == s for r in out) - n * per[s] / len(rows)) <= 2
    for r in out:
        assert (r.size, r.text_crc32) == (8, 0) if r.doc_id is not None and r.doc_id % 7 == 0 else r.text_crc32 == zlib.crc32((f"t{r.doc_id}" if r.doc_id is not None else "x").encode())
    again = {(r.doc_id, r.position) for r in H.interleave(df.repartition(5), 24).collect()}
    assert again == {(r.doc_id, r.position) for r in out}


def test_interleave_few_and_none(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert [(r.shard, r.slot) for r in H.interleave(df, 24).collect()] == [(0, 0)]
    assert H.interleave(df.limit(0), 24).count() == 0


def test_warc_round_trip(spark):
    same = "<p>" + "é" * 60
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nb" * 3
    pages = [(1, "http://a/", same), (2, "http://b/", same), (3, None, None), (4, "u\r\nX: y", ""), (5, "v", "short"), (6, "v", "short"), (7, "w", tricky), (8, "w", tricky), (9, "z", "x" * 300_000), (11, "z2", "x" * 300_000), (10, "z3", "y" * 66_000), (None, "n", same), (None, "n", same), (2, "http://b/", same)]
    df = spark.createDataFrame([(i, u, "2024-01-01T00:00:00Z", h, "clash") for i, u, h in pages], "record_id long, target_uri string, date string, payload string, copies string")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    W.archive(df, path)
    back = W.read_archives(spark, path).collect()
    assert len(back) == len(pages)
    first = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h, i)
    by = sorted(back, key=lambda r: (r.record_id is None, r.record_id or 0))
    for r, (i, _, h) in zip(by, sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)), strict=True):
        data = (h or "").encode()
        assert (r.record_id, r.payload_bytes, r.payload_digest) == (i, len(data), hashlib.sha256(data).hexdigest())
        revisit = len(data) >= 100 and i is not None and first[h] < i
        assert (r.record_type, r.refers_to) == (("revisit", first[h]) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == data


def test_warc_of_nothing(spark):
    df = spark.createDataFrame([], "record_id long, target_uri string, date string, payload string")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    W.archive(df, path)
    assert W.resolve(df).count() == 0 and W.read_archives(spark, path).count() == 0


def test_warc_parse_rejects_damage():
    with pytest.raises(ValueError):
        list(W.parse(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n"))


def slow_measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def _measured(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, measured int, failed string").selectExpr("*", "1 AS __words", "2 AS kept")
    out = R.ledger(df).orderBy("doc_id").collect()
    return [tuple(getattr(r.measured, c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in out], out


def test_measures_of_edges(spark):
    eight = " ".join("abcdefgh")
    texts = [None, "", " \t\n", "a", eight, f"{eight} {eight}", f"{eight} x {eight}", " ".join(["w"] * 30), "a\na\n\n a\na ", "é#*$%&|<>\x85\xa0 b", "😀 " * 20, "x" * 200_000, " ".join(map(str, range(20000))) + " " + " ".join(map(str, range(9)))]
    got, _ = _measured(spark, texts)
    assert got == [slow_measures(t) for t in texts]


@given(st.lists(st.text(alphabet="ab \n\t#", max_size=80), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None)
def test_measures_of_random_texts(spark, texts):
    assert _measured(spark, texts)[0] == [slow_measures(t) for t in texts]


def test_policies_and_ablation(spark):
    texts = ["w" + str(i) + " " + " ".join(f"x{k}" for k in range(30)) for i in range(4)] + ["few words", "*** " * 40, None]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "id long, content string, measured int, failed int")
    entries = R.ledger(df, "id", "content")
    for policy, mask in R.POLICIES.items():
        rows = entries.collect()
        assert {(r.doc_id, r.kept, r.policy) for r in R.apply_policy(entries, policy).collect()} == {(r.doc_id, not r.failed & mask, policy) for r in rows}
        want = {n: (sum(bool(r.failed & R.BIT[n]) for r in rows), sum(r.failed & mask == R.BIT[n] for r in rows)) for n in R.BIT if R.BIT[n] & mask}
        assert {r.rule: (r.n_failed, r.n_only) for r in R.ablate(entries, policy).collect()} == want
    kept = {r.doc_id: r.kept for r in R.apply_policy(entries).collect()}
    assert kept == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert R.ledger(df.limit(0), "id", "content").count() == 0
    assert {r.n_failed for r in R.ablate(R.ledger(df.limit(0), "id", "content")).collect()} == {0}


def test_ablation_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(R.ABLATION_SQL)
    got = R.ablation_query(spark, sf_dir).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and len(want.fetchall()) == 7
