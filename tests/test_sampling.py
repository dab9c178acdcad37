import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from raregrain.operators import ranking, sampling
from raregrain.sources.sinks import with_chunk


def h(key, seed):
    return int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(4000).select("id", (F.col("id") % 50 == 0).cast("int").alias("y")).repartition(5)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows are copies of one row."""
    return spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("id"), F.lit(0).alias("y")).repartition(5)


def test_hash_key(rows):
    from raregrain.functions.hashing import hash_key

    assert all(r.h == h(r.id, 9) for r in rows.select("id", hash_key("id", 9).alias("h")).collect())


def test_with_position_is_rank_in_hash_order(rows):
    got = ranking.with_position(rows, "id", 42, ["y"]).collect()
    for y in (0, 1):
        part = sorted((r for r in got if r.y == y), key=lambda r: r.position)
        assert [r.position for r in part] == list(range(1, len(part) + 1))
        assert [r.id for r in part] == sorted((r.id for r in part), key=lambda i: (h(i, 42), i))


def test_with_position_splits_a_hot_key(hot):
    got = ranking.with_position(hot, "id", 42, hot_rows=100).collect()
    assert sorted(r.position for r in got) == list(range(1, 3001))
    assert Counter(r.id for r in got)[7] == 1000
    unique = [r for r in got if r.id != 7]
    assert [r.id for r in sorted(unique, key=lambda r: r.position)] == sorted((r.id for r in unique), key=lambda i: (h(i, 42), i))


def test_null_stratum_is_a_stratum(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(40)], "id bigint, y int")
    got = ranking.with_position(df, "id", 1, ["y"]).groupBy("y").agg(F.max("position").alias("m")).collect()
    assert {r.y: r.m for r in got} == {None: 20, 1: 20}
    parts = sampling.stratified_split(df, "y", 0.5).groupBy("y").agg(F.sum("is_train").alias("s")).collect()
    assert {r.y: r.s for r in parts} == {None: 10, 1: 10}


@pytest.mark.parametrize("ratio", [0.0, 0.3, 0.7, 1.0])
def test_stratified_split_is_exact(rows, ratio):
    got = sampling.stratified_split(rows, "y", ratio).groupBy("y", "is_train").count().collect()
    sizes = {(r.y, r.is_train): r["count"] for r in got}
    for y, n in ((0, 3920), (1, 80)):
        assert sizes.get((y, 1), 0) == math.ceil(ratio * n)
        assert sizes.get((y, 0), 0) == n - math.ceil(ratio * n)


def test_split_keeps_copies_together(hot):
    got = sampling.stratified_split(hot, "y", 0.5).collect()
    sides = defaultdict(set)
    for r in got:
        sides[r.id].add(r.is_train)
    assert len(got) == 3000 and all(len(s) == 1 for s in sides.values())


def test_kfold_even_and_disjoint(rows):
    got = sampling.kfold(rows, "y", 5).collect()
    assert len({r.id for r in got}) == 4000
    sizes = Counter((r.y, r.fold) for r in got)
    assert all(sizes[0, f] == 784 and sizes[1, f] == 16 for f in range(5))


def test_more_folds_than_rows(spark):
    got = sampling.kfold(spark.range(3).withColumn("y", F.lit(1)), "y", 5).collect()
    assert len(got) == 3 and len({r.fold for r in got}) == 3


@pytest.mark.parametrize("top_k", [0, 10_000])
def test_sample_n(rows, top_k):
    got = sampling.sample_n(rows, 777, top_k_rows=top_k).collect()
    assert sorted(r.id for r in got) == sorted(sorted(range(4000), key=lambda i: (h(i, 42), i))[:777])


def test_sample_n_beyond_table(rows):
    assert sampling.sample_n(rows, 9999, top_k_rows=0).count() == 4000


def test_samples_ignore_layout(rows):
    a = sampling.sample_rows(rows, 0.2, 1, "id").collect()
    b = sampling.sample_rows(rows.repartition(3, "id"), 0.2, 1, "id").collect()
    assert sorted(a) == sorted(b) and 600 < len(a) < 1000
    by_class = sampling.sample_by_class(rows, "y", {0: 0.1, 1: 1.0}, key="id").groupBy("y").count().collect()
    sizes = {r.y: r["count"] for r in by_class}
    assert sizes[1] == 80 and 300 < sizes[0] < 480
    assert sampling.sample_by_class(rows, "y", {1: 1.0}, key="id").count() == 80
    assert sampling.sample_rows(rows, 0.2).count() > 0 and sampling.sample_by_class(rows, "y", {1: 1.0}).count() == 80


def test_splits_cover(rows):
    first, second = sampling.split_two(rows, 0.8)
    assert first.count() + second.count() == 4000 and first.join(second, "id").count() == 0
    assert {r.split for r in sampling.split_n(rows, 8).select("split").distinct().collect()} == set(range(1, 9))


def test_shuffle_is_reproducible(rows):
    order = [r.id for r in sampling.shuffle_rows(rows).collect()]
    assert order == sorted(range(4000), key=lambda i: (h(i, 42), i))
    assert [r.id for r in sampling.order_by_id(rows).collect()] == list(range(4000))


@pytest.mark.parametrize("size", [8, 33])
def test_balanced_batches(rows, size):
    got = sampling.balanced_batches(rows, "y", size).collect()
    half1, half0 = size // 2, size - size // 2
    per = defaultdict(Counter)
    for r in got:
        per[r.batch_no][r.y] += 1
    assert set(per) == set(range(math.ceil(3920 / half0)))
    assert all(c[1] == half1 for c in per.values())
    assert sum(c[0] for c in per.values()) == 3920
    assert all(per[b][0] == half0 for b in range(len(per) - 1))
    uses = Counter(r.id for r in got if r.y == 1)
    assert max(uses.values()) - min(uses.values()) <= 1 and len(uses) == 80


def test_balanced_batches_need_both_classes(rows):
    with pytest.raises(ValueError):
        sampling.balanced_batches(rows.where("y = 0"))


def test_minibatches_keep_the_last(rows):
    sizes = sorted(r.n_rows for r in sampling.minibatch_stats(rows, size=1024).collect())
    assert sizes == [928, 1024, 1024, 1024]


def test_running_sums(rows):
    got = ranking.running_sums(rows, [F.col("id")], {"n": F.lit(1), "s": "y"}).collect()
    assert all(r.n == r.id + 1 and r.s == r.id // 50 + 1 for r in got)


def test_chunks_are_full_despite_copies(hot):
    sizes = {r.chunk_no: r["count"] for r in with_chunk(hot, "id", 700).groupBy("chunk_no").count().collect()}
    assert sizes == {1: 700, 2: 700, 3: 700, 4: 700, 5: 200}


def test_spread(rows):
    assert sampling.spread(rows, 3).rdd.getNumPartitions() == 3
    assert sampling.spread(rows).count() == 4000 and sampling.first_rows(rows, 5).count() == 5


def test_position_order_does_not_depend_on_the_split(spark):
    """Hot keys, copies with and without the same content, all thresholds: one order."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 0, 9).otherwise(F.col("id") + 100)
    rows = spark.range(3000).select(key.alias("id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 5).alias("v")).repartition(6)
    want = None
    for hot_rows in (10**9, 300, 0):
        got = ranking.with_position(rows, "id", 42, ["y"], hot_rows=hot_rows).collect()
        for y in (0, 1):
            part = sorted((r for r in got if r.y == y), key=lambda r: r.position)
            assert [r.position for r in part] == list(range(1, len(part) + 1))
            assert [r.id for r in part] == sorted((r.id for r in part), key=lambda i: (h(i, 42), i))
        want = want or sorted(got)
        assert sorted(got) == want


@pytest.mark.parametrize("n", [1, 500, 1000, 1500, 2999, 3000, 5000])
def test_sample_n_is_exact_among_copies(spark, n):
    rows = spark.range(3000).select((F.col("id") % 10).alias("id"), (F.col("id") % 4).alias("v")).repartition(4)
    cut = sampling.sample_n(rows, n, top_k_rows=0).collect()
    assert len(cut) == min(n, 3000) and sorted(cut) == sorted(sampling.sample_n(rows, n).collect())
