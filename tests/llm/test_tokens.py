"""Tokens, packing, token files and mixing."""

import itertools
import random
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from raregrain.llm.mixing import fit_counts, mix
from raregrain.llm.packing import pack_documents, sequence_ids, sum_of_squares
from raregrain.llm.queries import TOKEN_BITS, TOKENIZER
from raregrain.llm.tokens import Encoder
from raregrain.llm.wavelet import WaveletMatrix, open_shard, read_documents, shard_bytes, write_token_shards

TEXTS = [
    "Hello, World! it's we'll O'Neil's don't", "éÀß ñandú Ünïcödé ΣΑΣ İstanbul ǅ", "12345 a1b2 3.14 €5 x²", "<|endoftext|> <|startoftext|>x", "a <|endoftext|> b", "É<|endoftext|>'s<|startoftext|><|startoftext|>, <|ENDOFTEXT|> <|endoftext|",
    "nbsp here thin space line sep \x1c\x85", "emoji 😀😀 👩‍👩‍👧 é ́lead", "...!!! --- ''' 's 't 're", "", None, " \t\n", "汉字かな 한국어", "a" * 3000, "mañana. (Über) [x]{y}",
]
WIDE = "doc_id bigint, text string, source string, key string, piece string, length string, item string, size string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "a", "b", "c", "d", "e") for i, t, s in rows], WIDE)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(library):
    rnd = random.Random(0)
    letters = "abcXYZéÉßñ 's.,!?\n\t0129-_#😀 ́Σςİ"
    texts = TEXTS + ["".join(rnd.choice(letters) for _ in range(60)) for _ in range(400)]
    for part in (pa.array(texts), pa.array(texts).slice(3, 50)):
        offsets, ids = Encoder(TOKENIZER).encode(part, 7)
        got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        assert got == [library(t) + [7] for t in part.to_pylist()]


def test_packing(spark, library):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(100, "word " * 5000, "s"), (None, "x y", "s"), (1, TEXTS[1], "s")]
    got = pack_documents(docs_of(spark, rows), TOKENIZER, capacity=64, shard_pieces=8).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array(library(t) + [0], "<u4")
        want += [(str(i), n, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64])) for n, a in enumerate(range(0, len(ids), 64))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 2


def test_sequences_hold_the_ids(spark, library):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)]
    got = [r.ids for r in sequence_ids(docs_of(spark, rows), TOKENIZER, capacity=256).collect()]
    assert sum(map(len, got)) == sum(len(library(t)) + 1 for t in TEXTS) and max(map(len, got)) <= 256


def test_sum_of_squares_is_tight():
    rnd = np.random.default_rng(2)
    lengths = np.concatenate((rnd.integers(1, 300, 3000), rnd.integers(300, 2048, 300)))
    bins, offsets = sum_of_squares(lengths, 2048)
    assert bins.max() + 1 <= -(-lengths.sum() // 2048) + 1
    assert (np.bincount(bins, lengths) <= 2048).all() and len(set(zip(bins, offsets))) == len(lengths)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    rnd = np.random.default_rng(n)
    ids = rnd.choice(np.array([0, 1, 5, 300, 49407, 49406, 777]), n)
    keys, lengths, m = open_shard(shard_bytes([None, 4], np.array([n // 2, n - n // 2]), ids, 16))
    assert keys == [None, 4] and lengths.tolist() == [n // 2, n - n // 2]
    assert (m.decode() == ids).all()
    if n:
        places = rnd.integers(0, n, 50)
        assert (m.access(places) == ids[places]).all()
    for token in (0, 5, 49407, 6):
        found = np.flatnonzero(ids == token)
        assert [m.rank(token, p) for p in (0, n // 3, n)] == [(ids[:p] == token).sum() for p in (0, n // 3, n)]
        picks = range(0, len(found), max(1, len(found) // 5))
        assert [m.select(token, k) for k in picks] == [found[k] for k in picks] and m.select(token, len(found)) == -1
    assert isinstance(m, WaveletMatrix)


def test_token_files(spark, library):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(None, "null key", None), (50, "b " * 900, None)]
    path = tempfile.mkdtemp(prefix="run-") + "/shards"
    write_token_shards(docs_of(spark, rows), path, TOKENIZER, TOKEN_BITS, shard_tokens=100)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_documents(spark, path).collect())
    at, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library(t) + [1], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert got == want
    assert spark.read.parquet(path).count() >= 3


def test_fit_counts_is_exact():
    rnd = random.Random(4)
    for _ in range(60):
        lengths = rnd.sample(range(0, 40), 4)
        counts = [rnd.randrange(1, 4) for _ in lengths]
        sums = {sum(l * k for l, k in zip(lengths, ks)) for ks in itertools.product(*[range(c + 1) for c in counts])}
        budget = rnd.randrange(0, max(sums) + 5)
        taken = fit_counts(np.array(lengths), np.array(counts), budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        assert (taken * lengths).sum() == max(s for s in sums if s <= budget)
    lengths = np.arange(1, 500)
    taken = fit_counts(lengths, np.full(499, 100), 5_000_017, limit=1000)
    assert (taken * lengths).sum() == 5_000_017 and taken.max() <= 100


def test_mix(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 2, 3, 50, 200])), rnd.choice(["a", "b", "b", "b", "é", None])) for i in range(3000)]
    rows += [(5000 + i, "same text here", "b") for i in range(4000)] + [(None, None, "b"), (9001, "one two three", "c"), (9001, "one two three", "c")]
    frame = docs_of(spark, rows)
    got = mix(frame).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by_key = {r[0]: r[2] for r in rows}
    for r in got:
        s = by_key[r.doc_id]
        sizes[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    names = sorted(n for n in sizes if n is not None) + [None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if 2 * sizes[n] <= level * weight[n]}
        if not full:
            want |= {n: level * weight[n] for n in open_}
            break
        want |= {n: 2.0 * sizes[n] for n in full}
        left -= sum(2 * sizes[n] for n in full)
        open_ -= full
    for n in names:
        assert target[n] == pytest.approx(want[n]) and abs(taken[n] - want[n]) <= 1
    again = mix(frame.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)


def test_empty_tables(spark):
    none = docs_of(spark, [(1, "a", "b")]).where("false")
    assert pack_documents(none, TOKENIZER).collect() == [] and mix(none).collect() == []
    path = tempfile.mkdtemp(prefix="run-") + "/none"
    write_token_shards(none, path, TOKENIZER, TOKEN_BITS)
    assert read_documents(spark, path).collect() == []
    assert [r.target for r in mix(docs_of(spark, [(1, None, "a")])).collect()] == [0.0]
