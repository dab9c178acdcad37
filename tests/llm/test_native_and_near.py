"""Exact groups, near-duplicate groups and connected components against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from raregrain.llm import common
from raregrain.llm.common import components, with_row_key
from raregrain.llm.exact import exact_groups
from raregrain.llm.simhash import links, near_groups, shingle_fingerprint

SCHEMA = "doc_id bigint, text string, digest string, row string, fp string, key string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


ROWS = [(5, "One TWO"), (1, "one two"), (9, "ÉCOLE"), (3, "éCOLE"), (4, "École"), (2, None), (8, ""), (None, "alone"), (None, "one two"), (7, "x" * 50_000), (6, "X" * 50_000), (5, "One TWO"), (11, "ﬀ"), (12, "FF")]


@pytest.mark.parametrize("digest", [lambda s: s, lambda s: F.substring(s, 1, 0), lambda s: F.lit(b"one")])
@pytest.mark.parametrize("hot_share", [1e-4, 0.2])
def test_exact_groups(spark, digest, hot_share):
    got = exact_groups(docs_of(spark, ROWS), digest=digest, hot_share=hot_share, salts=3).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[lower(t)].append(i)
    want = sorted(
        (str(i), str(max((k for k in groups[lower(t)] if k is not None), default=None)), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest())
        for i, t in ROWS
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def reference_fingerprint(text):
    words = [w for w in lower(text).encode().split() if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(grams))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_fingerprint_bits():
    for text in ("", " \t\n", "a", "A b", "one two three", "Ünï code space X Y z z z", "a " * 400 + "b c d e"):
        assert shingle_fingerprint(text.encode(), 3, 42) == reference_fingerprint(text)


def test_links_find_every_pair(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base:
        for n in (1, 2, 2, 3):
            values.add(b ^ sum(1 << i for i in rnd.sample(range(64), n)))
    values |= {0, 1, 3, 7, 1 << 63, (1 << 63) | 1}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    got = {tuple(sorted(r)) for r in links(spark.createDataFrame([(v,) for v in values], "fp bigint")).collect()}
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_near_groups(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(60):
        text = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 40, 300]))]
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(text[:-1] + ["end"]))]
    rows += [(len(rows), None), (len(rows) + 1, " \n "), (7, "w1 w2 w3"), (None, "w1 w2 w3")]
    fps = [reference_fingerprint(t or "") for _, t in rows]
    roots = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = {r: min(i for (i, _), q in zip(rows, roots) if q == r and i is not None) for r in set(roots)}
    want = sorted((str(i), f"{fp:016x}", least[r]) for (i, _), fp, r in zip(rows, fps, roots))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in near_groups(docs_of(spark, rows)).collect()) == want


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 90)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    roots = union(500, pairs)
    got = {(r.node, r.root) for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {(x, roots[x]) for x in nodes}


def test_row_keys(spark):
    unique = docs_of(spark, [(3, "a"), (1, "b")])
    assert {(r.doc_id, r.n) for r in with_row_key(unique, "doc_id", "text", "n").collect()} == {(3, 3), (1, 1)}
    twice = docs_of(spark, [(3, "a"), (None, "c"), (1, "b"), (3, "a")])
    rows = sorted(with_row_key(twice, "doc_id", "text", "n").collect(), key=lambda r: r.n)
    assert [r.doc_id for r in rows] == [None, 1, 3, 3] and len({r.n for r in rows}) == 4


def test_empty_tables(spark):
    none = docs_of(spark, ROWS).where("false")
    assert exact_groups(none).collect() == [] and near_groups(none).collect() == []


def test_components_end_when_all_are_stars(spark, monkeypatch):
    """No round is spent on finding that nothing changes: stars take none, a chain one write less than before."""
    written = []
    monkeypatch.setattr(common, "store", lambda df, name, _store=common.store: written.append(name) or _store(df, name))
    stars = spark.createDataFrame([(5, 1), (1, 6), (6, 1), (9, 8), (7, 7)], "a bigint, b bigint")
    assert sorted(tuple(r) for r in common.components(stars).collect()) == [(1, 1), (5, 1), (6, 1), (8, 8), (9, 8)]
    assert written == ["edges"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 50), (60, 55)], "a bigint, b bigint")
    assert sorted(tuple(r) for r in common.components(chain).collect()) == [(i, 0) for i in range(41)] + [(50, 50), (55, 50), (60, 50)]
    assert common.components(spark.createDataFrame([(3, 3)], "a bigint, b bigint")).count() == 0
