import random

import numpy as np

from tidemark.llm import simhash
from tidemark.llm import similar as S

SCHEMA = "doc_id long, text string, fp string"


def brute(texts: list) -> list[int]:
    """The component of each text, by its first member, over all pairs."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if not a and not sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def corpus() -> list:
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice((30, 120, 300)))]
        texts.append(" ".join(base))
        for k in (1, 2, 4, 8, 12):
            near = list(base)
            for _ in range(k):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
    return texts


def test_every_pair_is_found(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    want = brute(texts)
    kept = S.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_rounds_do_not_change_the_result(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    for rounds in (0, 1):
        monkeypatch.setattr(S, "ROUNDS", rounds)
        assert sorted(r.doc_id for r in S.deduplicate(df).collect()) == sorted(set(brute(texts)))


def test_stage_removes_near_copies_that_simhash_leaves(spark, sf_dir):
    import corpus_pipeline
    from tidemark.llm import simhash

    words = [f"w{i}" for i in range(200)]
    near = list(words)
    for i in range(20, 200, 60):
        near[i] = "other"
    a, b = " ".join(words), " ".join(near)
    assert (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > simhash.DISTANCE
    df = spark.createDataFrame([(1, a, ""), (2, b, "")], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.deduplicated(spark, df, sf_dir).collect()] == [1]


def test_empty(spark):
    assert S.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_link_first(spark):
    """Copies with a word changed are linked by their fingerprints alone; equal fingerprints without the similarity are not linked."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    base = [word() for _ in range(600)]
    near = [*base[:-1], "changed"]
    phrase = ["one", "two", "three", "four", "five", "six", "seven"] * 200
    one, other = (" ".join([*phrase, *(word() for _ in range(25))]) for _ in range(2))
    assert simhash.fingerprint(one.encode(), 5) == simhash.fingerprint(other.encode(), 5)
    docs = spark.createDataFrame(list(enumerate([" ".join(base), " ".join(near), one, other, None, ""])), "doc_id long, text string")
    for whole in (False, True):
        got = {r.doc_id: r.component_id for r in S.near_duplicates(docs, whole=whole).collect()}
        assert got[0] == got[1] and got[4] == got[5] and len({got[0], got[2], got[3], got[4]}) == 4


def test_unlike_lengths_form_no_pair(spark):
    """At a frequent shingle few of all pairs are formed, and all that may reach the similarity are; linked ones are not."""
    rng = random.Random(5)
    sets = [(i, int(50 * 1.02 ** rng.randrange(250)), rng.randrange(3) and rng.randrange(8), rng.choice((i, 7))) for i in range(300)]
    few = [(i, n, at, i) for i, n, at, _ in sets[:6]]
    rows = [(token, i, n, at, root, len(own)) for token, own in ((1, sets), (2, few)) for i, n, at, root in own]
    dealt = S._dealt(spark.createDataFrame(rows, "token long, id long, n long, at int, root long, k long"))
    places, formed = S._places(dealt)
    want = set()
    for own in (sets, few):
        for a, m, i, r in own:
            for b, n, j, s in own:
                if a < b and r != s and 5 * min(m, n) >= 4 * max(m, n) and 9 * min(m - i, n - j) >= 4 * (m + n):
                    want.add((a, b))
    assert {(r.a, r.b) for r in S._unlinked_pairs(dealt, places).collect()} == want
    assert len(want) <= formed < 300 * 299 / 2 / 5
