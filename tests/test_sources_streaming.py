import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from raregrain.operators import classifiers
from raregrain.sources import chunks, readers, sinks
from raregrain.streaming import incremental


@pytest.fixture()
def path(tmp_path):
    return lambda name: str(tmp_path / name)


def test_write_modes(spark, path):
    df = spark.range(10)
    sinks.write_table(df, path("t"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_table(df, path("t"))
    sinks.append_table(df, path("t"))
    assert readers.read_table(spark, path("t")).count() == 20
    sinks.write_table(df, path("t"), "overwrite")
    assert readers.read_table(spark, path("t"), ["id"]).count() == 10
    assert readers.table_info(readers.read_table(spark, path("t"))).first().n_rows == 10


def test_reads_only_named_columns(spark, path):
    sinks.write_table(spark.range(5).withColumn("b", F.lit(1)), path("t"))
    plan = readers.read_table(spark, path("t"), ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:int>" in plan


def test_single_part_file(spark, path):
    sinks.write_table(spark.range(8).coalesce(1), path("t"))
    part = next(f for f in os.listdir(path("t")) if f.endswith(".parquet"))
    assert readers.read_table(spark, f"{path('t')}/{part}").count() == 8


def test_exact_chunks(spark, path):
    sinks.write_chunks(spark.range(1050).repartition(6), path("c"), 400)
    rows = spark.read.parquet(path("c")).groupBy("chunk_no").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    assert sorted(map(tuple, rows.collect())) == [(1, 400, 0, 399), (2, 400, 400, 799), (3, 250, 800, 1049)]
    listed = chunks.list_chunks(spark, path("c")).collect()
    assert sorted((r.chunk_no, r.n_rows) for r in listed) == [(1, 400), (2, 400), (3, 250)]
    assert [r.file for r in sorted(listed)] == sorted(r.file for r in listed)


def test_cheap_chunks(spark, path):
    sinks.write_chunks(spark.range(1000).coalesce(1), path("c"), 300, exact=False)
    assert sorted(r.n_rows for r in chunks.list_chunks(spark, path("c")).collect()) == [100, 300, 300, 300]


def test_listing_ignores_other_files(spark, path):
    sinks.write_table(spark.range(3).coalesce(1), path("t"))
    with open(f"{path('t')}/notes.txt", "w") as f:
        f.write("x")
    assert chunks.list_chunks(spark, path("t")).count() == 1


def test_csv_and_lines(spark, path):
    df = spark.createDataFrame([(1, 0.25, "a b"), (2, 0.5, "c")], "id bigint, binds double, t string")
    sinks.write_predictions_csv(df, path("csv"))
    assert sorted(map(tuple, readers.read_csv(spark, path("csv"), "id bigint, binds double").collect())) == [(1, 0.25), (2, 0.5)]
    sinks.write_lines(df, "t", path("lines"))
    assert sorted(r.value for r in spark.read.text(path("lines")).collect()) == ["a b", "c"]
    with pytest.raises(ValueError):
        readers.read_csv(spark, "x.zip", "id int")


def test_libsvm(spark, path):
    os.makedirs(path("s"))
    with open(f"{path('s')}/a.txt", "w") as f:
        f.write("1 1:0.5 4:2\n0 2:1\n")
    rows = readers.read_libsvm(spark, path("s"), 4).collect()
    assert [(r.label, r.features.toArray().tolist()) for r in rows] == [(1.0, [0.5, 0, 0, 2.0]), (0.0, [0, 1.0, 0, 0])]


def test_batches_are_bounded(spark):
    import pyarrow as pa

    sizes = readers.map_batches(spark.range(0, 1000, 1, 2), lambda b: pa.RecordBatch.from_pydict({"n": [b.num_rows]}), "n bigint", 64)
    got = [r.n for r in sizes.collect()]
    assert sum(got) == 1000 and max(got) == 64


def test_prediction_chunks(spark, path):
    df = spark.range(9).select("id", (F.col("id") % 3).cast("int").alias("chunk_no"))
    sinks.write_pred_chunks(df, path("p"))
    sinks.write_pred_chunks(df.where("chunk_no = 1"), path("p"))
    assert sinks.load_pred_chunks(spark, path("p")).count() == 9
    with open(f"{path('p')}/chunk_no=1/broken.parquet", "wb") as f:
        f.write(b"not parquet at all")
    assert sinks.load_readable_pred_chunks(spark, path("p"))[0].count() == 9


def _vectors(spark, n, start=0):
    x = F.array(F.sin("id"), F.cos("id"), (F.col("id") % 5 == 0).cast("double"))
    return spark.range(start, start + n).select("id", array_to_vector(x).alias("vectors"), ((F.col("id") % 5 == 0) != (F.col("id") % 11 == 0)).cast("int").alias("binds"))


def test_chunk_counts_equal_batch(spark, path):
    df = spark.range(700).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    sinks.write_chunks(df, path("c"), 200)
    incremental.count_chunks(incremental.read_chunks(spark, path("c"), df.schema), path("out"), path("progress"))
    got = spark.read.parquet(path("out"))
    assert {r.chunk_no: r.n_rows for r in got.collect()} == {1: 200, 2: 200, 3: 200, 4: 100}
    assert got.agg(F.sum("n_positive")).first()[0] == 100


def test_incremental_training_resumes(spark, path):
    schema = _vectors(spark, 1).schema
    layers = [3, 4, 2]

    def train():
        return incremental.train_incremental(spark, path("c"), schema, path("m"), layers, max_iter=10)

    sinks.append_table(_vectors(spark, 100).coalesce(1), path("c"))
    sinks.append_table(_vectors(spark, 100, 100).coalesce(1), path("c"))
    second = train()
    assert sorted(os.listdir(path("m/models"))) == ["Final_ckpt", "_1_ckpt", "_2_ckpt"]
    assert train().weights == second.weights  # nothing new, nothing retrained
    sinks.append_table(_vectors(spark, 50, 200).coalesce(1), path("c"))
    third = train()
    log = {r.chunk_no: r for r in spark.read.parquet(path("m/log")).collect()}
    assert [log[i].n_rows for i in (1, 2, 3)] == [100, 100, 50]
    assert log[2].logloss < log[1].logloss and third.weights != second.weights


def test_incremental_scoring_equals_batch(spark, path):
    rows = _vectors(spark, 250)
    model = classifiers.fit_logistic(rows, maxIter=20)
    sinks.write_chunks(rows, path("c"), 100)
    stream = incremental.read_chunks(spark, path("c"), rows.schema)
    incremental.score_incremental(model, stream, path("out"), path("progress"), label="binds")
    got = spark.read.parquet(path("out"))
    want = classifiers.predict(rows, model)
    assert got.select("chunk_no").distinct().count() == 3
    assert sorted((r.id, r.p1) for r in got.collect()) == sorted((r.id, r.p1) for r in want.collect())


def test_ensemble_is_the_mean(spark, path):
    rows = _vectors(spark, 200)
    sinks.write_chunks(rows, path("c"), 100)
    from pyspark.ml.classification import LogisticRegressionModel

    paths = incremental.train_ensemble(spark, path("c"), rows.schema, path("e"), lambda df: classifiers.fit_logistic(df, maxIter=5))
    models = [LogisticRegressionModel.load(p) for p in paths]
    assert len(models) == 2
    single = [{r.id: r.p1 for r in classifiers.predict(rows, m).collect()} for m in models]
    for r in incremental.score_ensemble(rows, models).collect():
        assert r.p1 == pytest.approx((single[0][r.id] + single[1][r.id]) / 2)


def test_workers_need_no_installed_package(tmp_path):
    """The entry module works from any folder, although workers cannot import the package."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = textwrap.dedent(f"""
        import importlib.util
        from pyspark.sql import SparkSession
        spec = importlib.util.spec_from_file_location("contract", {repo!r} + "/__spark_entry__.py")
        module = importlib.util.module_from_spec(spec); spec.loader.exec_module(module)
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        print("rows", module.entry(spark).count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 6" in out.stdout, out.stderr[-2000:]


def test_checkpoint_folder_comes_from_the_session(spark, monkeypatch):
    from raregrain import session

    assert session.checkpoint_root(spark) == spark.sparkContext.getCheckpointDir()


def test_chunks_are_numbered_by_their_folder(spark, tmp_path):
    df = spark.range(1200).withColumn("chunk_no", (F.col("id") / 100).cast("int") + 1)
    df.repartition(4, "chunk_no").write.partitionBy("chunk_no").parquet(str(tmp_path / "c"))
    listed = {r.chunk_no: r.file for r in chunks.list_chunks(spark, str(tmp_path / "c")).collect()}
    assert all(f"chunk_no={n}/" in listed[n] for n in range(1, 13))


def test_damaged_prediction_chunks(spark, tmp_path):
    path = tmp_path / "p"
    spark.range(100).withColumn("chunk_no", (F.col("id") / 25).cast("int")).write.partitionBy("chunk_no").parquet(str(path))
    bad = next((path / "chunk_no=2").glob("*.parquet"))
    bad.write_bytes(b"damaged")
    (bad.parent / f".{bad.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        sinks.load_pred_chunks(spark, str(path)).count()
    rows, skipped = sinks.load_readable_pred_chunks(spark, str(path))
    assert rows.count() < 100 and [r.file.rsplit("/", 1)[1] for r in skipped.collect()] == [bad.name]


def test_training_follows_the_chunk_numbers(spark, path):
    """Parallel writers and any file times: the same chunks in the same order, the same model."""
    rows = _vectors(spark, 330)
    sinks.write_chunks(rows.repartition(4), path("c"), 30)
    files = [f[0] for _no, f in incremental.chunk_files(spark, path("c"))]
    assert [no for no, _f in incremental.chunk_files(spark, path("c"))] == list(range(1, 12))
    weights = []
    for run, step in enumerate((5, 7)):
        for i, file in enumerate(files):
            os.utime(file.removeprefix("file:"), (10**9 + i * step % 11,) * 2)
        model = incremental.train_incremental(spark, path("c"), rows.schema, path(f"m{run}"), [3, 2], max_iter=2)
        weights.append(list(model.weights))
    assert weights[0] == weights[1]
    log = spark.read.parquet(path("m0/log")).collect()
    assert sorted((r.chunk_no, r.n_rows) for r in log) == [(i, 30) for i in range(1, 12)]


def test_scores_carry_the_number_of_their_chunk(spark, path):
    rows = _vectors(spark, 330)
    model = classifiers.fit_logistic(rows, maxIter=5)
    sinks.write_chunks(rows, path("c"), 30)
    stream = incremental.read_chunks(spark, path("c"), rows.schema)
    incremental.score_incremental(model, stream, path("out"), path("progress"))
    got = spark.read.parquet(path("out")).collect()
    assert len(got) == 330 and all(r.chunk_no == r.id // 30 + 1 for r in got)
