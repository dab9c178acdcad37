"""Level-wise forest against trees grown row by row with the same draws, and its law."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from raregrain.operators import share_forest
from raregrain.operators.anomaly import average_path, fit_isolation_forest
from raregrain.operators.share_forest import fit_share_forest, grow, samples


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 1, (240, 5)), 2)
    x[:12] += 6
    x[:, 3] = 7.0  # constant
    x[100:140] = x[100]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    return df.select("id", "x", array_to_vector("x").alias("vectors")).persist()


def sampled(points, trees, size, seed=42):
    return samples(points.select(F.col("id").alias("key"), "x"), trees, size, seed)


@pytest.mark.parametrize("size", [1, 2, 100, 239, 240])
def test_samples_have_the_exact_size(points, size):
    sizes = {r.tree: r["count"] for r in sampled(points, 4, size).groupBy("tree").count().collect()}
    assert sizes == dict.fromkeys(range(4), size)


def test_copies_of_a_bootstrap_add_up(points):
    copies = share_forest._with_copies(sampled(points, 3, 120), 3, 120, 42)
    rows = copies.groupBy("tree").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.m == 120 and 60 < r.n < 90 for r in rows) and len(rows) == 3


@pytest.mark.parametrize("tried", [1, 2, 8])
def test_nodes_against_their_rows(points, tried):
    """Every node of the stored trees is what its rows ask for."""
    trees, size = 3, 120
    sample = sampled(points, trees, size).select("tree", "x", F.lit(1).cast("bigint").alias("m"))
    nodes = {(r.tree, r.node): r for r in grow(sample, trees, size, 5, 4, 42, tried).collect()}
    limit, seen, used = math.ceil(math.log2(size)), set(), {}
    for tree in range(trees):
        x = np.array([r.x for r in sample.where(F.col("tree") == tree).collect()])
        todo = [(1, x)]
        while todo:
            node, held = todo.pop()
            seen.add((tree, node))
            r = nodes[tree, node]
            level = node.bit_length() - 1
            if r.feature < 0:
                chosen = used.get(tree, set())
                constant = all(np.ptp(held[:, f]) == 0 for f in chosen)
                assert len(held) == 1 or level == limit or constant
                assert r.depth == pytest.approx(level + float(average_path(len(held))))
                continue
            used.setdefault(tree, set()).add(r.feature)
            low, high = held[:, r.feature].min(), held[:, r.feature].max()
            assert r.feature != 3 and low < high and low <= r.split <= high
            right = held[:, r.feature] > r.split
            todo += [(2 * node, held[~right]), (2 * node + 1, held[right])]
    assert seen == set(nodes) and all(len(f) <= 4 for f in used.values())


def test_scores_by_joins_equal_shipped_ones(points):
    model = fit_share_forest(points, trees=10, max_samples=0.5, max_features=0.8, bootstrap=True)
    shipped = {r.id: r.outlier_score for r in model.score(points).collect()}
    joined = {r.id: r.outlier_score for r in model.score(points, max_nodes=0).collect()}
    assert shipped.keys() == joined.keys() and max(abs(shipped[i] - joined[i]) for i in shipped) < 1e-12


def test_same_law_as_the_fixed_count(points):
    share = fit_share_forest(points, trees=150, max_samples=0.5, contamination=0.05)
    fixed = fit_isolation_forest(points, trees=150, max_samples=120, contamination=0.05)
    a = np.array([r.outlier_score for r in share.score(points).orderBy("id").collect()])
    b = np.array([r.outlier_score for r in fixed.score(points).orderBy("id").collect()])
    assert np.abs(a - b).max() < 0.06 and abs(a.mean() - b.mean()) < 0.01 and np.corrcoef(a, b)[0, 1] > 0.98
    flagged = [r.id for r in share.transform(points).where("predicted_label = 1").collect()]
    assert len(set(flagged) & set(range(12))) >= 10 and len(flagged) <= 18
    again = fit_share_forest(points.repartition(5), trees=150, max_samples=0.5, contamination=0.05)
    assert again.threshold == pytest.approx(share.threshold, abs=1e-12)


def test_edges(points):
    for bad in (0, 1.5, -1):
        with pytest.raises(ValueError, match="share"):
            fit_share_forest(points, max_samples=bad)
    with pytest.raises(ValueError, match="no rows"):
        fit_share_forest(points.where("id < 0"))
    same = fit_share_forest(points.where("id between 100 and 139"), trees=3, max_samples=0.5)
    assert same.nodes.count() == 3
    one = fit_share_forest(points.where("id = 1"), trees=2, max_samples=0.2)
    assert one.score(points).count() == 240
