"""Continued boosting against Spark's own boosted classifier, metrics per round, several-class curves."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from raregrain.operators import classifiers
from raregrain.operators import evaluate as ev
from raregrain.operators.boosting import BoostedTrees, boost, round_metrics
from raregrain.sources.sinks import write_chunks
from raregrain.streaming import incremental


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, 600) > 1).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), float(1 + i % 3)) for i in range(600)], "id bigint, binds int, x array<double>, w double")
    return df.select("id", "binds", "w", array_to_vector("x").alias("vectors")).persist()


def margins(model, df):
    return {r.id: r.m for r in df.select("id", model.margins(df).alias("m")).collect()}


@pytest.mark.parametrize("weight", [None, "w"])
def test_equals_the_plain_fit_round_by_round(points, weight):
    model = boost(points, 6, weight=weight, step=0.3, cut_every=2)
    found = margins(model, points)
    for rounds in (1, 3, 6):
        plain = classifiers.fit_gbt(points, weight=weight, maxIter=rounds, maxDepth=3, stepSize=0.3, cacheNodeIds=False)
        want = plain.transform(points).select("id", vector_to_array("rawPrediction").alias("raw")).collect()
        assert max(abs(found[r.id][rounds - 1] - r.raw[1]) for r in want) < 1e-9


def test_continues_from_a_stored_ensemble(spark, points, tmp_path):
    whole = boost(points, 5, step=0.3)
    half = boost(points, 2, step=0.3)
    half.save(spark, str(tmp_path / "half"))
    rest = boost(points, 3, BoostedTrees.load(spark, str(tmp_path / "half")), step=0.3)
    assert rest.rounds == 5 and rest.nodes.drop(columns="value").equals(whole.nodes.drop(columns="value"))
    assert np.allclose(rest.nodes["value"], whole.nodes["value"], atol=1e-9)


def test_round_metrics(points):
    model = boost(points, 4, weight="w", step=0.3)
    rows = {r["round"]: r for r in round_metrics(points, model, weight="w").collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert [rows[i].logloss for i in range(1, 5)] == sorted((r.logloss for r in rows.values()), reverse=True)
    scored = model.transform(points)
    assert rows[4].logloss == pytest.approx(ev.log_loss(scored, "binds", "p1", weight="w").first()[0])
    unweighted = {r["round"]: r for r in round_metrics(points, model, 3).collect()}
    assert sorted(unweighted) == [3, 4]
    assert unweighted[4].aucpr == pytest.approx(ev.average_precision(scored, "binds", "p1").first()[0])


def test_edges(spark, points):
    holes = points.unionByName(points.limit(3).withColumn("vectors", F.lit(None).cast(points.schema["vectors"].dataType)))
    model = boost(holes, 2, step=0.3)
    assert np.allclose(model.nodes["value"], boost(points, 2, step=0.3).nodes["value"])
    assert holes.where("vectors IS NULL").select(model.margins(holes).alias("m")).where("m IS NOT NULL").isEmpty()
    with pytest.raises(ValueError, match="no labelled rows"):
        boost(points.where("id < 0"), 2)
    ones = points.where("binds = 1")
    only = boost(ones, 2)
    assert round_metrics(ones, only).where("aucpr = 1").count() == 2
    none = round_metrics(points.where("binds = 0"), only)
    assert none.where("aucpr IS NULL").count() == 2


def test_chunks_continue_and_resume(spark, points, tmp_path):
    path = str(tmp_path / "chunks")
    write_chunks(points.select("id", "binds", "vectors"), path, 200)
    schema = points.select("id", "binds", "vectors").schema
    whole = incremental.train_boosted(spark, path, schema, str(tmp_path / "whole"), 3, step=0.3)
    assert whole.rounds == 9
    log = spark.read.parquet(f"{tmp_path}/whole/log")
    assert sorted((r.chunk_no, r["round"], r.n_rows) for r in log.collect()) == [(c, 3 * (c - 1) + i, 200) for c in (1, 2, 3) for i in (1, 2, 3)]

    class Lost(Exception):
        pass

    def lost(*args, **kwargs):
        raise Lost

    root = str(tmp_path / "broken")
    kept = incremental.round_metrics
    calls = []

    def third(*args, **kwargs):
        calls.append(1)
        return lost() if len(calls) == 3 else kept(*args, **kwargs)

    incremental.round_metrics = third
    try:
        with pytest.raises(Lost):
            incremental.train_boosted(spark, path, schema, root, 3, step=0.3)
    finally:
        incremental.round_metrics = kept
    resumed = incremental.train_boosted(spark, path, schema, root, 3, step=0.3)
    assert resumed.nodes.equals(whole.nodes)
    assert spark.read.parquet(f"{root}/log").count() == 9


def test_average_precision_by_class(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 300)
    p = np.round(rng.random((300, 4)) + np.eye(4)[y], 1)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, p)], "y int, probability array<double>")
    got = {r["class"]: r for r in ev.average_precision_by_class(df).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[3].support == 0 and got[3].average_precision is None
    areas = []
    for c in range(3):
        one = df.select((F.col("y") == c).cast("int").alias("y"), F.get("probability", F.lit(c)).alias("score"))
        areas.append(ev.average_precision(one).first()[0])
        assert got[c].average_precision == pytest.approx(areas[-1]) and got[c].support == (y == c).sum()
    mean = ev.mean_average_precision(ev.average_precision_by_class(df)).first()
    assert mean.macro == pytest.approx(np.mean(areas))
    assert mean.weighted == pytest.approx(np.average(areas, weights=np.bincount(y)))
    single = ev.average_precision_by_class(df.where("y = 1")).collect()
    assert all(r.average_precision is None for r in single)
    assert ev.average_precision_by_class(df.where("y > 9")).count() == 0
