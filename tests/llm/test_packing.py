import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing as P


def test_encoder_equals_whole_texts(spark, sf_dir):
    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", " ", "it's we'll DON'T", "a<|endoftext|>b c", "e\u0301 \u0301x", "Ça\u2003va\u3000!?", "x\x1fy \x85z\u200bq", "İstanbul ΣΑΣ", "a\u00a0b", "3.14%%% *** ###", "漢字かな 한국어"]
    encoder = P.Encoder(public_tokenizers.path(P.TOKENIZER))
    want = [t.encode(text, add_special_tokens=False).ids for text in texts]
    assert [ids.tolist() for ids in encoder.encode(texts)] == want  # one call
    assert [encoder.encode([text])[0].tolist() for text in texts] == want  # many calls, all remembered
    assert encoder.encode([None, ''])[1].tolist() == []


def test_encoder_remembers_chunks(monkeypatch):
    """Chunks are tokenized once, though more distinct runs pass than are remembered; one that forgets chunks gives the same ids."""
    path = public_tokenizers.path(P.TOKENIZER)
    t = Tokenizer.from_file(path)
    texts = [" ".join(f"{chr(97 + i)}word{chr(97 + k)}, don't" for i in range(20)) for k in (0, 1, 0, 1, 2, 0)]
    want = [t.encode(text, add_special_tokens=False).ids for text in texts]
    monkeypatch.setattr(P, "CACHE", 4)
    encoder, seen = P.Encoder(path), []
    whole = encoder._chunk
    encoder._chunk = lambda chunk: seen.append(chunk) or whole(chunk)
    assert [encoder.encode([text])[0].tolist() for text in texts] == want
    assert len(seen) == len(set(seen)) == 61
    for name, most in (("CHUNKS", 25), ("CHUNK_BYTES", 200)):
        with monkeypatch.context() as small:
            small.setattr(P, name, most)
            encoder = P.Encoder(path)
            assert [encoder.encode([text])[0].tolist() for text in texts] == want
            assert len(encoder.known) <= 3 * 21


def test_pack(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [(9001, None), (9002, ""), (None, "no id"), (5, texts[5][1]), (9003, "word " * 4095), (9004, "word " * 4096), (9005, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, start int")
    out = P.pack(df).collect()
    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    want = []
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            want.append((i if i is not None else -1, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == sorted(want)
    rows = {}
    for r in out:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for row in rows.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(length for row in rows.values() for _, length in row) > 0.95 * 4096 * len(rows) - 4096
    assert P.pack(df.limit(0)).count() == 0


def test_neighbours_share_terms():
    rng = np.random.default_rng(0)
    topics = [np.arange(k * 100, k * 100 + 100, dtype=np.uint16) for k in range(6)]
    terms = [np.sort(rng.choice(topics[i % 6], 40, replace=False)) for i in range(120)]
    tfs = [np.ones(40, np.uint16)] * 120
    lengths = np.full(120, 400, np.int64)
    df = np.bincount(np.concatenate(terms), minlength=600)
    rows = P.pack_shard(lengths, terms, tfs, np.log(1 + (120 - df + 0.5) / (df + 0.5)), 400.0, 4096)
    assert sorted(i for row in rows for i in row) == list(range(120))
    assert np.mean([len({i % 6 for i in row}) == 1 for row in rows]) > 0.5


def plain_packing(lengths, terms, tfs, idf, mean, window):
    """The definition: BM25 for all terms of the seed, against every unused piece that fits."""
    unused, rows = sorted(range(len(lengths)), key=lambda i: (lengths[i], i)), []
    while unused:
        seed = unused.pop()
        row, left, own = [seed], window - lengths[seed], set(terms[seed].tolist())
        score = {}
        for i in unused:
            norm = P.K1 * (1 - P.B + P.B * lengths[i] / mean)
            score[i] = sum(idf[t] * f * (P.K1 + 1) / (f + norm) for t, f in zip(terms[i].tolist(), tfs[i].tolist(), strict=True) if t in own)
        near = [i for i in sorted(unused, key=lambda i: (-score[i], lengths[i], i)) if score[i] > 0]
        for i in near:
            if lengths[i] <= left:
                row.append(i)
                unused.remove(i)
                left -= lengths[i]
        while fits := [i for i in unused if lengths[i] <= left]:
            row.append(fits[-1])
            unused.remove(fits[-1])
            left -= lengths[fits[-1]]
        rows.append(row)
    return rows


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_the_definition(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 90))
    lengths = rng.integers(1, rng.choice([60, 4096]), n)
    terms = [np.unique(rng.integers(0, 300, min(int(x), int(rng.integers(1, 60))))).astype(np.uint16) for x in lengths]
    tfs = [rng.integers(1, 5, len(t)).astype(np.uint16) for t in terms]
    df = np.bincount(np.concatenate(terms), minlength=300)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)) * rng.uniform(0.99, 1.01, 300)  # hardly any ties
    args = (lengths, terms, tfs, idf, float(lengths.mean()), 4096)
    assert P.pack_shard(*args) == plain_packing(*args)
