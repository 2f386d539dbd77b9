import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank int, tree string, digest string, id string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    return [(i >> up & 1, level[(i >> up) ^ 1] if (i >> up) ^ 1 < len(level) else "") for up, level in enumerate(tree[:-1])]


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by["" if r[2] is None else "=" + r[2]].append(r)
    trees, kept = {}, {}
    for k in sorted(by, key=str.encode):
        kept[k] = sorted(by[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = levels([leaf(r) for r in kept[k]])
    crown = levels([t[-1][0] for t in trees.values()])
    out = []
    for j, (k, tree) in enumerate(trees.items()):
        for i, r in enumerate(kept[k]):
            steps = path(tree, i) + path(crown, j)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, int(hit))
            for right, sibling in steps:
                folded = h(sibling, folded) if right else h(folded, sibling)
            out.append((r[0], leaf(r), tree[-1][0], crown[-1][0], h(*(s for _, s in steps)), folded, folded == crown[-1][0]))
    return out


def rows_of(n, langs):
    rows = [(i * 3 % n, f"s{i % 4}" if i % 5 else None, langs[0] if i % 3 else langs[i % len(langs)], i if i % 6 else None, f"té{i}" * (i % 3)) for i in range(n)]
    return rows + rows[:5] + [(None, None, None, None, None), (None, "", "", 0, ""), (n, "x", langs[0], 5, "long " * 30_000)]


COLUMNS = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize(("bits", "n", "langs"), [(2, 90, ["en", "de", None, "", "é", "zz", "z", "y", "x", "w"]), (1, 9, ["en", None]), (12, 40, ["en", "de"]), (3, 1, ["en"])])
def test_manifest_against_plain_loops(spark, bits, n, langs):
    rows = rows_of(n, langs)
    df = spark.createDataFrame([(*r, 1, "t", "d", "i") for r in rows], SCHEMA).repartition(3)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    out = M.manifest(df.drop("id"), tampered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, bits=bits)
    assert Counter(map(tuple, out.select(COLUMNS).collect())) == Counter(brute(rows))


def test_empty_and_untampered(spark):
    df = spark.createDataFrame([(1, "s", "en", 3, "abc", 1, "t", "d", "i")], SCHEMA)
    assert M.manifest(df.limit(0)).count() == 0
    row = M.manifest(df).first()
    assert row.verified and row.leaf == row.subroot == row.root and row.proof_sha256 == h("")


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(M.ORACLE_SQL)
    assert Counter(map(tuple, M.query(spark, sf_dir).select(want.columns).collect())) == Counter(want.fetchall())


@given(st.integers(1, 13))
@settings(deadline=None, max_examples=13)
def test_addresses(levels):
    """Every node has a place of its own, and the subtrees below half the height lie in one stretch each."""
    places = [M.address(levels, d, np.arange(1 << d)) for d in range(levels)]
    assert sorted(np.concatenate(places)) == list(range((1 << levels) - 1))
    top = levels // 2
    for j in range(1 << top if levels > 1 else 0):
        own = np.concatenate([places[d][j << (d - top) : (j + 1) << (d - top)] for d in range(top, levels)])
        assert own.max() - own.min() == len(own) - 1


def test_a_block_keeps_its_nodes():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    nodes = M.build(leaves, 4)
    tree = levels([x.hex() for x in leaves])
    assert nodes[:32].hex() == tree[-1][0]
    for i, p in enumerate(M.siblings(nodes, 4, 11, np.arange(11))):
        assert [s[1:].hex() for s in p] == [s for _, s in path(tree, i)]
        assert M.fold(leaves[i], p) == nodes[:32]
