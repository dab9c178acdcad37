"""Small chunks and ranges by the hundred: what each costs must not be a queue of Spark jobs, and results stay the same."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from __spark_entry__ import queries
from raregrain.operators import boosting, classifiers, evaluate, feed, sampling
from raregrain.sources import sinks
from raregrain.streaming import incremental


def _vectors(spark, n):
    x = F.array(F.sin("id"), F.cos("id"), (F.col("id") % 5 == 0).cast("double"))
    y = ((F.col("id") % 5 == 0) != (F.col("id") % 11 == 0)).cast("int")
    return spark.range(n).select("id", array_to_vector(x).alias("vectors"), y.alias("binds"))


def _counted(monkeypatch, module, name):
    calls, kept = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *args, **kwargs: calls.append(1) or kept(*args, **kwargs))
    return calls


def test_feed_of_independent_ranges(spark, tmp_path):
    path, progress = str(tmp_path / "b"), str(tmp_path / "p")
    feed.lay_out_batches(spark.range(1050), path, size=100, every=2)
    seen = []

    def each(rows, number):
        if number == 3 and not stopped:
            stopped.append(number)
            raise RuntimeError("lost")
        seen.append((number, rows.count()))

    stopped = []
    with pytest.raises(RuntimeError):
        feed.feed_batches(spark, path, progress, each, at_once=3)
    assert feed._position(spark, progress) == 3 and {0, 1, 2} <= {n for n, _ in seen}
    seen.clear()
    assert feed.feed_batches(spark, path, progress, each, at_once=3) == 3
    assert sorted(seen) == [(3, 200), (4, 200), (5, 50)]
    assert feed.feed_batches(spark, path, progress, each) == 0


def test_feed_reads_notes_that_were_tables(spark, tmp_path):
    path, progress = str(tmp_path / "b"), str(tmp_path / "p")
    feed.lay_out_batches(spark.range(500), path, size=100, every=2)
    sinks.write_pred_chunks(spark.createDataFrame([(0, 1), (1, 1)], "chunk_no bigint, finished int"), progress)
    seen = []
    assert feed.feed_batches(spark, path, progress, lambda rows, number: seen.append(number)) == 1 and seen == [2]


def test_a_range_is_noted_without_a_job(spark, tmp_path):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    for i in range(3):
        feed._note(spark, str(tmp_path / "p"), i)
    assert feed._position(spark, str(tmp_path / "p")) == 3
    assert sorted(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == sorted(before)


def test_counted_chunks_share_micro_batches(spark, tmp_path, monkeypatch):
    events = spark.range(15_500).select(F.col("id").alias("event_id"), F.when(F.col("id") % 7 == 0, "error").otherwise("view").alias("event_type"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    calls = _counted(monkeypatch, incremental, "write_pred_chunks")
    got = sorted(tuple(r) for r in queries()["stream_chunk_counts"](spark, str(tmp_path)).collect())
    assert len(calls) == 1
    assert got == [(c + 1, len(ids), sum(i % 7 == 0 for i in ids)) for c in range(6) for ids in [range(3000 * c, min(3000 * c + 3000, 15_500))]]


def test_scored_chunks_share_micro_batches(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 64).tolist(), i % 10) for i in range(900)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    calls = _counted(monkeypatch, incremental, "write_pred_chunks")
    got = queries()["stream_score"](spark, str(tmp_path)).collect()
    assert len(calls) == 1 and sorted(r.id for r in got) == list(range(900)) and all(r.agrees for r in got)


def test_files_without_a_folder_keep_a_number_each(spark, tmp_path):
    df = spark.range(90).withColumn("y", F.lit(1))
    df.repartition(3).write.parquet(str(tmp_path / "c"))
    incremental.count_chunks(incremental.read_chunks(spark, str(tmp_path / "c"), df.schema), str(tmp_path / "out"), str(tmp_path / "progress"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.chunk_no for r in got) == [1, 2, 3] and sum(r.n_rows for r in got) == 90


def test_ensemble_in_passes(spark, tmp_path, monkeypatch):
    from pyspark.ml.classification import LogisticRegressionModel

    rows = _vectors(spark, 350)
    sinks.write_chunks(rows, str(tmp_path / "c"), 50)

    def fit(df):
        if "lost" in state and df.where("id = 170").count():
            raise RuntimeError("lost")
        return classifiers.fit_logistic(df, maxIter=3)

    state = {"lost"}
    with pytest.raises(RuntimeError):
        incremental.train_ensemble(spark, str(tmp_path / "c"), rows.schema, str(tmp_path / "e"), fit, at_once=2)
    assert sorted(incremental._finished(spark, str(tmp_path / "e/progress"))) == [1, 2, 3]
    state.clear()
    paths = incremental.train_ensemble(spark, str(tmp_path / "c"), rows.schema, str(tmp_path / "e"), fit, at_once=2)
    assert paths == [incremental.model_path(str(tmp_path / "e"), i) for i in range(1, 8)]
    assert sorted((r.chunk_no, r.n_rows) for r in spark.read.parquet(str(tmp_path / "e/log")).collect()) == [(i, 50) for i in range(1, 8)]
    models = incremental.load_models(LogisticRegressionModel.load, paths)
    whole = {r.id: r.p1 for r in incremental.score_ensemble(rows, models).collect()}
    monkeypatch.setattr(incremental, "MODELS_A_PASS", 3)
    calls = _counted(monkeypatch, incremental, "freeze")
    assert {r.id: r.p1 for r in incremental.score_ensemble(rows, models).collect()} == whole and len(calls) == 2


def test_nodes_read_from_the_model_equal_those_of_its_files(spark, tmp_path):
    rows = _vectors(spark, 300).withColumn("t", F.col("binds").cast("double"))
    model = DecisionTreeRegressor(featuresCol="vectors", labelCol="t", maxDepth=4, seed=1).fit(rows)
    model.write().save(str(tmp_path / "round-2"))
    assert model.numNodes > 3
    assert boosting._walked_nodes(model, 2, 0.3).equals(boosting._tree_nodes(spark, {2: str(tmp_path / "round-2")}, {2: 0.3}))


def test_margins_do_not_depend_on_slices(spark, monkeypatch):
    rows = _vectors(spark, 120)
    model = boosting.boost(rows, 4, step=0.3)
    whole = {r.id: r.m for r in rows.select("id", model.margins(rows, 2).alias("m")).collect()}
    assert all(len(m) == 3 for m in whole.values())
    monkeypatch.setattr(boosting, "_CELLS", 9)
    assert {r.id: r.m for r in rows.select("id", model.margins(rows, 2).alias("m")).collect()} == whole


def test_metrics_of_few_rows_equal_those_of_many(spark):
    rows = _vectors(spark, 200).withColumn("w", 1.0 + F.col("id") % 3)
    model = boosting.boost(rows, 3, weight="w", step=0.3)
    few, many = (sorted(tuple(r) for r in boosting.round_metrics(rows, model, weight="w", n_rows=n).collect()) for n in (200, None))
    assert np.allclose(few, many, rtol=1e-12) and len(few) == 3
    scored = model.transform(rows)
    assert evaluate.average_precision(scored, "binds", "p1", 200).first()[0] == pytest.approx(evaluate.average_precision(scored, "binds", "p1").first()[0])
    copies = [sampling.resample_weighted(rows, "w", ["binds"], rows=n).select("id", "copy").collect() for n in (200, None)]
    assert sorted(copies[0]) == sorted(copies[1]) and len(copies[0]) > 200


def test_a_chunk_ends_while_the_next_is_in_work(spark, tmp_path):
    """Ends run in order, each before its note; a failed one leaves its chunk and those behind it unnoted."""
    sinks.write_chunks(spark.range(50), str(tmp_path / "c"), 10)
    ended = []

    def each(df, no, before):
        def end():
            if no == 4 and len(ended) == 3:
                ended.append(0)
                raise RuntimeError("lost")
            ended.append(no)

        return end

    at = (spark, str(tmp_path / "c"), spark.range(1).schema, str(tmp_path / "p"), each)
    with pytest.raises(RuntimeError):
        incremental.walk_chunks(*at)
    assert sorted(incremental._finished(spark, str(tmp_path / "p"))) == [1, 2, 3]
    assert incremental.walk_chunks(*at) == [1, 2, 3, 4, 5] and ended == [1, 2, 3, 0, 4, 5]
