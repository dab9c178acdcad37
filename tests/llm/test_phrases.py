"""Collocations against a brute-force count, and the tile counter against a plain one."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from raregrain.llm import phrases
from raregrain.llm.phrases import cell_key, collocations, tile_counts

SCHEMA = "doc_id bigint, text string, lang string, block bigint, id string, a string, seq string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, 1, "x", "y", "z") for i, (t, lang) in enumerate(rows)], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, most=4, least=30, top=2000, scale=2_000_000, cover=80):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    covered = {}
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, w[i : i + k])
                covered[part] = max(covered.get(part, 0), a)
    out = {}
    for (lang, w), a in candidates.items():
        if 100 * covered.get((lang, w), -1) >= cover * a:
            continue
        cuts = [(scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, docs=120):
    rnd = random.Random(seed)
    words = ["The", "of", "new", "york", "City", "é", "École", "tab", "x", "ﬀ", "…"] + [f"w{i}" for i in range(30)]
    marks = [" ", " ", " ", " ", " ", "\t", ". ", ",", "\n", "\x0b", " ? "]
    rows = []
    for _ in range(docs):
        text = "".join(rnd.choices(words, range(len(words) + 3, 3, -1))[0] + rnd.choice(marks) for _ in range(rnd.randint(0, 120)))
        rows.append((text.replace("new", "New York city"), rnd.choice(["en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", "en"), (" \t\n", None), ("alone", "de")]


@pytest.mark.parametrize("most,least,top", [(4, 30, 2000), (2, 5, 7), (5, 3, 50)])
def test_against_brute_force(spark, most, least, top):
    rows = corpus(most)
    assert got(collocations(docs_of(spark, rows), most=most, least=least, top=top)) == brute(rows, most, least, top)


def test_many_small_blocks_and_a_long_text(spark, monkeypatch):
    rows = corpus(11) + [("new york city . " * 20_000, "en"), ("a " * 50_000, "de")]
    assert got(collocations(docs_of(spark, rows).repartition(13))) == brute(rows)
    monkeypatch.setattr(phrases, "HELD", 8)
    assert got(collocations(docs_of(spark, rows).repartition(3))) == brute(rows)


def test_hot_copies_and_repeats(spark):
    rows = [("red green blue", "en")] * 400 + [("red green", "en")] * 40 + [("green blue", "en")] * 700 + corpus(3, 20)
    assert got(collocations(docs_of(spark, rows))) == brute(rows)


def test_nothing_to_find(spark):
    for rows in ([], [(None, None), ("", "en"), ("...", "en")], [("one two", "en")] * 29):
        assert got(collocations(docs_of(spark, rows))) == []



def test_score_is_exact_for_large_counts(spark, monkeypatch):
    a, l, r = 10**13 + 7, 3 * 10**13 + 1, 4 * 10**13 + 3
    runs = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", l), ("en", 1, "y", r)], "lang string, k int, phrase string, a bigint")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n bigint")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *args: (runs, totals))
    assert got(collocations(None)) == [("en", 1, "x y", a, l, r, 10**15, 2_000_000 * a // (l + r))]


@pytest.mark.parametrize("share", [1, 8, 10**9])
def test_dense_and_sparse_tiles_agree(share):
    rng = np.random.default_rng(1)
    x, y = (np.minimum(rng.zipf(1.3, 200_000), 5_000_000).astype(np.int64) - 1 for _ in range(2))
    x[:2], y[:2] = 2**31 - 1, (0, 2**31 - 1)
    keys, counts = tile_counts(cell_key(x, y), share)
    want = Counter(zip(x.tolist(), y.tolist()))
    order = sorted(want, key=lambda p: cell_key(*(np.array([v], np.int64) for v in p))[0])
    assert counts.tolist() == [want[p] for p in order] and (np.diff(keys) > 0).all()
