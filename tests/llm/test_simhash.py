import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import simhash as S
from tidemark.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute(fps: dict) -> dict:
    """Component by smallest key, over all pairs."""
    parent = {k: k for k in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= S.DISTANCE:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def slow_fingerprint(text):
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aBcÉ \t\n\x0b\x1f\xa0", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == slow_fingerprint(text)


def test_route_is_linear():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 500), dtype=np.uint64)
    assert (S.route(a ^ b) == S.route(a) ^ S.route(b)).all()
    assert len(S.ball()) == 1 + 64 + 64 * 63 // 2


def test_buckets_hold_all_meetings():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for b in base for k in (1, 2, 3, 4, 5)]
    fps = np.unique(np.array([*map(int, base), *near], np.uint64))
    masks, bits = S.ball(), 6
    found = set()
    for bucket in range(1 << bits):
        a, b = S.meetings(fps, bucket, bits, masks)
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    want = {k: v for k, v in brute({int(f): int(f) for f in fps}).items()}
    got = {int(f): int(f) for f in fps}
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    changed = True
    while changed:
        changed = False
        for a, b in found:
            m = min(got[a], got[b])
            if got[a] != m or got[b] != m:
                got[a] = got[b] = m
                changed = True
    assert got == want


def test_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).select("doc_id", "text").collect()
    texts = [(r[0], r[1]) for r in docs]
    texts += [(1000, texts[3][1]), (1001, None), (1002, ""), (1003, " \n"), (1004, texts[5][1] + " tail"), (None, texts[3][1]), (1000, texts[3][1]), (1005, "one two"), (1006, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in texts], SCHEMA)
    rows = S.near_duplicates(df).collect()
    assert len(rows) == len(texts)
    want = brute({k: S.fingerprint((t or "").encode()) for k, t in ((i if i is not None else -1, t) for i, t in texts)})
    smallest = {}
    for k, r in want.items():
        if k >= 0:
            smallest[r] = min(smallest.get(r, 10**9), k)
    for r in rows:
        k = r.doc_id if r.doc_id is not None else -1
        assert r.component_id == smallest[want[k]]
    kept = S.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(smallest.values()))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(df).count() == 0
    assert S.deduplicate(df).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "loops"])
def test_components(spark, shape):
    edges = {"chain": [(i, i + 1) for i in range(40)], "star": [(50, i) for i in range(40)], "loops": [(1, 1), (2, 3), (3, 2), (2, 3)]}[shape]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == ({2: 2, 3: 2} if shape == "loops" else dict.fromkeys({x for e in edges for x in e}, 0))
