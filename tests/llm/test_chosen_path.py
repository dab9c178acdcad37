"""Chosen-path near-duplicate groups against all pairs."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from raregrain.llm import chosen_path
from raregrain.llm.chosen_path import near_groups, trees_for

SCHEMA = "doc_id bigint, text string, key string, n string, part string, node string, same string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, *"abcde") for i, t in rows], SCHEMA)


def shingles(text, size=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size=4, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            root[find(b)] = find(a)
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[find(x)].append(rows[x][0])
    return sorted(((i, len(s), min(groups[find(x)])) for x, ((i, _), s) in enumerate(zip(rows, sets))))


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def edited(rnd, words, share, vocabulary):
    return [rnd.choice(vocabulary) if rnd.random() < share else w for w in words]


def corpus(seed, groups=25):
    """Bases with copies on both sides of the threshold, exact copies, chains of edits, and odd texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], None
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 40, 150, 400]))]
        for _ in range(rnd.randint(1, 8)):
            rows.append(" ".join(edited(rnd, base, rnd.choice([0, 0.005, 0.02, 0.03, 0.05, 0.2]), vocabulary)))
        rows.append(" ".join(base).upper())
    chain = [rnd.choice(vocabulary) for _ in range(200)]
    for _ in range(30):
        chain = edited(rnd, chain, 0.01, vocabulary)
        rows.append("\t".join(chain))
    rows += [None, "", " \n", "one", "ONE", "one two", "one two three four", "One two\nthree four", "É a b c", "é a b c", "x " * 60_000, "x " * 59_000]
    rnd.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize("leaf,depth,block", [(48, 4, 256), (2, 2, 5), (4, 3, 16)])
def test_against_all_pairs(spark, leaf, depth, block):
    rows = corpus(leaf)
    assert got(near_groups(docs_of(spark, rows), leaf=leaf, depth=depth, block=block)) == brute(rows)


def test_a_third_of_all_rows_nearly_alike(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    rows = [" ".join(edited(rnd, base, rnd.choice([0.01, 0.02, 0.04]), vocabulary)) for _ in range(250)]
    rows += [" ".join(base)] * 150 + [" ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(400)]
    rows = list(enumerate(rows))
    assert got(near_groups(docs_of(spark, rows).repartition(7), leaf=8, depth=3, block=16)) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, one pair of texts each: none is lost."""
    rnd = random.Random(4)
    rows = []
    for g in range(400):
        base = [f"g{g}x{i}" for i in range(103)]
        # one changed word in the middle takes 4 of 100 shingles: 2 changes give 92 / 108, just above 0.8
        other = list(base)
        for at in rnd.sample(range(10, 90, 9), 2):
            other[at] = "changed"
        rows += [" ".join(base), " ".join(other)]
    rows = list(enumerate(rows))
    found = got(near_groups(docs_of(spark, rows)))
    assert sum(c == i for i, _, c in found) == 400


def test_null_and_repeated_keys(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (3, text), (3, text + " tail"), (9, "other words than those there"), (None, None), (4, None)]
    out = near_groups(docs_of(spark, rows)).collect()
    kept = [r for r in out if r.component_id == 3]
    assert len(kept) == 3 and sum(r.kept for r in kept) == 1 and next(r for r in kept if r.kept).doc_id == 3
    assert sorted(str(r.component_id) for r in out if r.component_id != 3) == ["4", "9", "None"]
    assert near_groups(docs_of(spark, [])).count() == 0
    assert got(near_groups(docs_of(spark, [(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_trees_and_tokens():
    assert trees_for(0.8, 0.9999, 6) == 15 and trees_for(0.8, 0.9, 1) == 2
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:810], rng.integers(0, 2**63, 90, dtype=np.uint64))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    equal = (chosen_path.minwise(a) == chosen_path.minwise(b)).mean()
    assert abs(equal - true) < 0.2


def test_full_sets_take_their_cells_along(spark):
    """Cells travel with the texts, so that sets need no exchange by key to meet them."""
    texts = spark.createDataFrame([(1, "a B c d e"), (2, "x"), (3, "a b c d e")], "key bigint, text string")
    wanted = spark.createDataFrame([(1, 10), (3, 11)], "key bigint, cell bigint")
    found = {r.key: (r.cell, bytes(r.shingles)) for r in chosen_path.full_sets(texts, wanted, 4).collect()}
    assert sorted(found) == [1, 3] and [found[k][0] for k in (1, 3)] == [10, 11]
    assert found[1][1] == found[3][1] and len(found[1][1]) == 2 * 8
