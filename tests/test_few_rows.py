"""Small chunks are fitted in memory: the same trees as Spark's, a few Spark jobs for many chunks, and runs that were stopped go on."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from raregrain.operators import boosting
from raregrain.operators.few_rows import FewRows
from raregrain.operators.stats import class_weights
from raregrain.sources.sinks import write_chunks
from raregrain.streaming import incremental


def _points(spark, n, seed=0, nulls=False, spread=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 6))
    x = x if spread else np.round(x, 2)
    x[:, 4] = np.where(rng.random(n) < 0.6, 0, x[:, 4])
    x[:, 5] = rng.integers(0, 3, n)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, n) > 0.8).astype(int)
    rows = [(i, None if nulls and i % 17 == 0 else int(y[i]), None if nulls and i % 13 == 0 else x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, binds int, x array<double>")
    return df.select("id", "binds", F.when(F.col("x").isNotNull(), array_to_vector("x")).alias("vectors"))


def _few(df):
    weighted = df.select(F.col("binds").cast("double").alias("y"), F.when(F.col("vectors").isNotNull(), boosting.as_array(df, "vectors")).alias("x"), F.lit(0.0).alias("margin"))
    return FewRows.of(weighted.toArrow(), "x", "y", "margin")


@pytest.mark.parametrize("n,seed,tree", [(200, 1, {}), (25, 2, {}), (900, 3, {"maxDepth": 4, "minInstancesPerNode": 12}), (200, 4, {"maxBins": 7, "minInfoGain": 0.01})])
def test_trees_of_few_rows_are_those_of_spark(spark, n, seed, tree):
    df = _points(spark, n, seed, nulls=seed == 3).coalesce(1).persist()
    weighted = class_weights(df, "binds")
    want = boosting.boost(weighted, 4, weight="sample_weights", step=0.3, **tree)
    few = _few(df)
    got = boosting.boost(few, 4, step=0.3, **tree)
    discrete = ["round", "node", "feature", "lower", "upper"]
    assert got.nodes[discrete].equals(want.nodes[discrete])
    assert np.allclose(got.nodes[["weight", "threshold", "value"]], want.nodes[["weight", "threshold", "value"]], atol=1e-9)
    log = sorted(tuple(r) for r in boosting.round_metrics(weighted, want, weight="sample_weights").collect())
    assert np.allclose(log, boosting.round_metrics(few, got).to_pandas().to_numpy(), rtol=1e-9)


def _jobs(spark, run):
    """Spark jobs that ``run`` takes."""
    tracker = spark.sparkContext.statusTracker()
    before = max(tracker.getJobIdsForGroup(None) or [0])
    out = run()
    return out, max(tracker.getJobIdsForGroup(None)) - before


def test_many_small_chunks_take_few_jobs(spark, tmp_path, monkeypatch):
    df = _points(spark, 1200, 5)
    write_chunks(df, str(tmp_path / "c"), 30)
    args = (spark, str(tmp_path / "c"), df.schema)
    model, jobs = _jobs(spark, lambda: incremental.train_boosted(*args, str(tmp_path / "few"), 2, step=0.3))
    assert model.rounds == 80 and jobs < 3 * 40
    monkeypatch.setattr(incremental, "MOST_ROWS", 29)  # all chunks but none are large now
    large = incremental.train_boosted(*args, str(tmp_path / "many"), 2, step=0.3)
    logs = [sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{k}/log").select("chunk_no", "n_rows", "round", "logloss", "aucpr").collect()) for k in ("few", "many")]
    # splits of exactly equal gain are told apart by rounding, so that later trees may differ
    assert large.rounds == 80 and [r[:3] for r in logs[0]] == [r[:3] for r in logs[1]] and np.allclose(logs[0][:2], logs[1][:2])
    assert abs(np.mean([r[3] for r in logs[0]]) - np.mean([r[3] for r in logs[1]])) < 0.05
    stored = boosting.BoostedTrees.load(spark, incremental.model_path(str(tmp_path / "few"), 7))
    assert stored.rounds == 14 and stored.nodes.equals(model.nodes[model.nodes["round"] <= 14])


def test_large_and_small_chunks_take_turns(spark, tmp_path):
    at = str(tmp_path / "c")
    for no, n in enumerate((40, 120, 30, 35, 110), 1):
        _points(spark, n, no).coalesce(1).write.parquet(f"{at}/chunk_no={no}")
    kept = incremental.MOST_ROWS
    incremental.MOST_ROWS = 100
    try:
        model = incremental.train_boosted(spark, at, _points(spark, 1).schema, str(tmp_path / "m"), 2, step=0.3)
    finally:
        incremental.MOST_ROWS = kept
    log = spark.read.parquet(f"{tmp_path}/m/log").collect()
    assert model.rounds == 10 and sorted((r.chunk_no, r.n_rows, r["round"]) for r in log) == [(c, n, 2 * c - 2 + i) for c, n in enumerate((40, 120, 30, 35, 110), 1) for i in (1, 2)]


def test_ensemble_of_small_chunks(spark, tmp_path, monkeypatch):
    """One job fits many chunks and one pass scores with all models; the probabilities are those of Spark's own classifier."""
    from pyspark.ml.classification import GBTClassificationModel

    from raregrain.operators import classifiers

    df = _points(spark, 2400, 6, spread=True)
    write_chunks(df, str(tmp_path / "c"), 200)

    def fit(rows):
        return classifiers.fit_gbt(rows, weight="sample_weights", maxIter=3, maxDepth=3)

    def train(name, **more):
        return incremental.train_ensemble(spark, str(tmp_path / "c"), df.schema, str(tmp_path / name), fit, label="binds", **more)

    paths, jobs = _jobs(spark, lambda: train("few", fit_few=fit))
    assert len(paths) == 12 and jobs < 60
    assert train("few", fit_few=fit) == paths  # nothing is left to fit
    assert sorted((r.chunk_no, r.n_rows) for r in spark.read.parquet(f"{tmp_path}/few/log").collect()) == [(i, 200) for i in range(1, 13)]
    monkeypatch.setattr(incremental, "MOST_ROWS", 199)
    plain = train("plain", fit_few=fit)
    assert plain == [incremental.model_path(str(tmp_path / "plain"), i) for i in range(1, 13)]
    scores = []
    for some in (paths, plain, [*paths[:5], *plain[5:]]):
        models = incremental.load_models(GBTClassificationModel.load, some)
        scores.append({r.id: r.p1 for r in incremental.score_ensemble(df, models).collect()})
    assert len(scores[0]) == 2400
    for other in scores[1:]:  # but for splits of equal gain, which rounding tells apart
        apart = np.abs([other[i] - p for i, p in scores[0].items()])
        assert apart.mean() < 0.002 and apart.max() < 0.05, (apart.mean(), apart.max(), np.mean(apart < 1e-9))
    with pytest.raises(Exception, match="labels and features"):
        holes = _points(spark, 40, 7, nulls=True)
        monkeypatch.setattr(incremental, "MOST_ROWS", 10_000)
        write_chunks(holes, str(tmp_path / "h"), 40)
        incremental.train_ensemble(spark, str(tmp_path / "h"), holes.schema, str(tmp_path / "holes"), fit, label="binds", fit_few=fit)


def test_boosted_chunks_with_holes(spark, tmp_path):
    """Rows without a label or features take no part in a fit, but count."""
    holes = _points(spark, 200, 8, nulls=True)
    write_chunks(holes, str(tmp_path / "c"), 100)
    model = incremental.train_boosted(spark, str(tmp_path / "c"), holes.schema, str(tmp_path / "m"), 2, step=0.3)
    log = spark.read.parquet(f"{tmp_path}/m/log").collect()
    assert model.rounds == 4 and sorted((r.chunk_no, r.n_rows, r["round"]) for r in log) == [(1, 100, 1), (1, 100, 2), (2, 100, 3), (2, 100, 4)]


def test_perceptron_of_small_chunks_is_that_of_spark(spark, tmp_path, monkeypatch):
    df = _points(spark, 600, 9, spread=True)
    write_chunks(df, str(tmp_path / "c"), 200)

    def train(name):
        return incremental.train_incremental(spark, str(tmp_path / "c"), df.schema, str(tmp_path / name), [6, 4, 2], max_iter=15)

    few, jobs = _jobs(spark, lambda: train("few"))
    assert jobs < 60
    assert sorted(p.name for p in (tmp_path / "few/models").iterdir()) == ["Final_ckpt", "_1_ckpt", "_2_ckpt", "_3_ckpt"]
    scores = few.transform(df).select("prediction").distinct().count()
    assert scores == 2
    monkeypatch.setattr(incremental, "MOST_ROWS", 199)
    plain = train("plain")
    assert np.allclose(few.weights, plain.weights, rtol=1e-5, atol=1e-5)
    logs = [sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{k}/log").select("chunk_no", "n_rows", "n_fit_0", "n_fit_1", "logloss", "aucpr").collect()) for k in ("few", "plain")]
    assert len(logs[0]) == 3 and np.allclose(*logs, rtol=1e-5)
