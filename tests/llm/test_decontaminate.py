import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontaminate as D


def edit_distance_in(text, passage):
    """The least edits of passage against any region of text (all cells)."""
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (c != t)))
        prev = row
    return min(prev)


def plain(text):
    return "".join(map(chr, D.normalise(text)[0]))


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        match rng.randrange(3):
            case 0:
                s[k] = rng.choice("abcdefg")
            case 1:
                del s[k]
            case _:
                s.insert(k, rng.choice("abcdefg"))
    return "".join(s)


def test_normalise():
    codes, where = D.normalise("  Ab\n\t C ")
    assert "".join(map(chr, codes)) == "ab c" and where.tolist() == [2, 3, 4, 7]
    assert plain(None) == plain("") == plain(" \n") == ""
    assert plain("İX\u2003y") == "İx y"


@given(st.text("ab", max_size=24), st.text("ab", min_size=1, max_size=10))
@settings(max_examples=200, deadline=None)
def test_alignment(text, passage):
    t, p = (np.array([ord(c) for c in x], np.uint32) for x in (text, passage))
    best = edit_distance_in(text, passage)
    found = D.within(t, p, -len(p) - 1, len(t) + 1, len(p))
    assert found and found[0] == best
    _, s, e = found
    s, e = max(s, 0), max(e, 0)
    assert edit_distance_in(text[s:e], passage) == best


def test_no_region_within_the_budget_is_missed():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [(i, prose(rng.randrange(3, 40))) for i in range(30)] + [(30, "short"), (31, "")]
    index = D.Index.of(passages)
    for trial in range(60):
        k, p = passages[trial % 30]
        e = D.budget(len(plain(p)))
        text = prose(rng.randrange(0, 80)) + " " + edited(rng, p.upper(), rng.randrange(0, e + 2)) + " " + prose(rng.randrange(0, 80))
        got = {i: edits for i, _, _, edits in index.find(text)}
        for i, q in passages[:30]:
            m = plain(q)
            best = edit_distance_in(plain(text), m)
            assert (i in got) == (best <= D.budget(len(m)))
            if i in got:
                assert got[i] == best
    assert index.find(None) == index.find("") == []


def test_places(spark):
    item = "The quick brown fox jumps over the lazy dog near the old river bank today."
    docs = [(1, f"Intro text. {item} End."), (2, None), (3, ""), (4, "clean text with nothing of the kind " * 50), (None, item), (1, f"Intro text. {item} End."), (5, f"{item} mid {item}"), (6, "w " * 100_000 + item.replace(" ", "\n"))]
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "x")], "item_id long, text string")
    out = D.contaminated(df, bench).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 1, 5, 5, 6]
    for r in out:
        text = next(t for i, t in docs if i == r.doc_id)
        assert " ".join(text[r.start : r.end].split()) == item and r.edits == 0
    kept = D.decontaminate(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == df.columns
    assert D.contaminated(df.limit(0), bench).count() == 0
    assert D.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_blocks_agree(spark):
    rng = random.Random(5)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [len(b) for b in D.blocks(bench, "item_id", "text", 130)] == [2, 2, 2, 2, 1]


def test_a_passage_that_is_repeated_without_a_gap_gives_every_region():
    rng = random.Random(9)
    for m in (12, 40, 100, 333):
        passage = "".join(rng.choice("abcdefghijklmnop") for _ in range(m))
        index = D.Index.of([(7, passage)])
        for times in (1, 2, 3, 5):
            for gap in ("", " x ", "qr" * 20):
                text = "zz" + gap.join([passage] * times) + "yy"
                assert [(r[0], r[3]) for r in index.find(text)] == [(7, 0)] * times
                assert [text[s:e] for _, s, e, _ in index.find(text)] == [passage] * times
    passage = "".join(rng.choice("abcdefghijklmnop") for _ in range(200))
    changed = passage[:50] + "#" + passage[51:120] + passage[122:]
    found = D.Index.of([(1, passage)]).find(changed + passage + changed)
    assert [f[3] for f in found] == [3, 0, 3]


def test_common_grams_do_not_pile_up(monkeypatch):
    monkeypatch.setattr(D, "HITS", 1000)
    passages = [(i, "a" * (60 + i)) for i in range(40)] + [(99, "the quick brown fox jumps over the lazy dog tonight")]
    found = D.Index.of(passages).find("a" * 3000 + " the quick brown fox jumps over the lazy dog tonight " + "a" * 500)
    assert {f[0] for f in found} == {*range(40), 99}
