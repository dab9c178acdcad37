"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from raregrain.llm import resample as module
from raregrain.llm.resample import Buckets, chunks, resample

SCHEMA = "doc_id bigint, text string, n string, words string, buckets string, weight string, rank string, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], SCHEMA)


def features(text, least, most):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(w), [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, least=1, most=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, least, most)[1]))
    for text in target:
        t.update(map(bucket, features(text, least, most)[1]))
    S, T = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))

    out, able = [], []
    for i, text in rows:
        words, found = features(text, least, most)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if words >= min_words:
            able.append((-score, i is None, i or 0, len(out)))
        out.append([i, len(found), weight, score, None])
    for rank, (*_, at) in enumerate(sorted(able)[: len(able) * percent // 100], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {f.dataType.typeName() for f in df.schema} == {"long"}
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n=150, seed=1):
    rnd = random.Random(seed)
    words = ["the", "THE", "École", "日本", "a1b", "x", "it's"] + [f"v{i}" for i in range(80)]
    rows = [(i * 3, "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\x00", "\x7f", "`{"]) for _ in range(rnd.randint(0, 60)))) for i in range(n)]
    return rows + [(7001, None), (7002, ""), (7003, "…"), (7004, "!?"), (None, "x " * 30), (7005, "the x " * 40), (7006, "the x " * 40)]


TARGET = ["the x and v3", None, "", "École v5 v5 v7 it's"]


@pytest.mark.parametrize("least,most,buckets", [(1, 1, 10_000), (1, 2, 10_000), (2, 3, 97), (1, 1, 70_000)])
def test_against_a_plain_computation(spark, least, most, buckets):
    rows, target = corpus(), spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id bigint, text string")
    got_rows = got(resample(docs_of(spark, rows), target, least=least, most=most, buckets=buckets, percent=30))
    assert got_rows == brute(rows, TARGET, least, most, buckets, percent=30)


def test_draws_a_tenth_and_counts_repeats(spark):
    rows = corpus(300) + [(5, "the x v1 " * 10)] * 3
    target = spark.createDataFrame([(1, "the x")], "item_id bigint, text string")
    found = got(resample(docs_of(spark, rows), target))
    assert [r[:4] for r in found] == [r[:4] for r in brute(rows, ["the x"])]
    able = sum(features(t, 1, 1)[0] >= 20 for _, t in rows)
    assert sorted(r[4] for r in found if r[4] is not None) == list(range(1, able // 10 + 1))


def test_empty_tables(spark):
    target = spark.createDataFrame([], "item_id bigint, text string")
    assert got(resample(docs_of(spark, []), target)) == []
    rows = corpus(30)
    assert got(resample(docs_of(spark, rows), target)) == brute(rows, [])


@pytest.mark.parametrize("least,most", [(1, 1), (1, 3), (3, 3)])
def test_long_texts_are_split_between_words(monkeypatch, least, most):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["word", "É", "z" * 40, "q7"]) + rnd.choice([" ", "\n\n", "-", "."]) for _ in range(5000)) + "tail"
    assert "".join(chunks(text, 64)) == text
    whole = Buckets(least, most, 10_000)(text.encode())
    monkeypatch.setattr(module.chunks, "__defaults__", (64,))
    words, found = Buckets(least, most, 10_000)(text.encode())
    assert words == whole[0] == features(text, 1, 1)[0]
    assert Counter(found) == Counter(whole[1]) == Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text, least, most)[1])
