"""Streaming vocabulary after any split into files and after a restart; running class share."""

import pytest
from pyspark.sql import functions as F

from raregrain.operators.stats import running_share
from raregrain.operators.vocabulary import build_vocab
from raregrain.streaming.vocabulary import load_vocab, update_vocab

TEXTS = ["C(=O)N", "c1ccc", None, "", "Böß日本", "NNNN", "C" * 5000, "x\ty"]


def files(spark, path, per=1):
    return spark.readStream.schema("t string, u string").option("maxFilesPerTrigger", per).option("recursiveFileLookup", True).parquet(path)


@pytest.mark.parametrize("per", [1, 3])
def test_equals_the_batch_count_after_every_run(spark, tmp_path, per):
    rows = spark.createDataFrame([(t, TEXTS[-i]) for i, t in enumerate(TEXTS)], "t string, u string")
    path, out, state = (str(tmp_path / n) for n in ("files", "out", "state"))
    for run in range(3):
        rows.repartition(run + 1).write.parquet(f"{path}/{run}")
        update_vocab(files(spark, path, per), ["t", "u"], out, state)
        seen = spark.read.option("recursiveFileLookup", True).parquet(path)
        assert sorted(map(tuple, load_vocab(spark, out).collect())) == sorted(map(tuple, build_vocab(seen, ["t", "u"]).collect()))
    before = load_vocab(spark, out).collect()
    update_vocab(files(spark, path, per), ["t", "u"], out, state)
    assert load_vocab(spark, out).collect() == before


def test_a_lost_part_is_written_again(spark, tmp_path, monkeypatch):
    from raregrain.streaming import vocabulary

    path, out, state = (str(tmp_path / n) for n in ("files", "out", "state"))
    spark.createDataFrame([(t, t) for t in TEXTS], "t string, u string").repartition(3).write.parquet(path)
    write, calls = vocabulary.write_pred_chunks, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        write(*args)

    monkeypatch.setattr(vocabulary, "write_pred_chunks", failing)
    with pytest.raises(Exception, match="lost"):
        update_vocab(files(spark, path), ["t"], out, state)
    update_vocab(files(spark, path), ["t"], out, state)
    assert load_vocab(spark, out).collect() == build_vocab(spark.read.parquet(path), ["t"]).collect()


def test_running_share(spark):
    batches = spark.createDataFrame([(2, 10, 0), (0, 3, 1), (1, 0, 0), (3, 7, 7)], "batch_id bigint, n_rows bigint, n_positive bigint")
    got = [tuple(r) for r in running_share(batches).orderBy("batch_id").collect()]
    assert got == [(0, 2, 1, 66.67, 33.33), (1, 2, 1, 66.67, 33.33), (2, 12, 1, 92.31, 7.69), (3, 12, 8, 60.0, 40.0)]
    assert running_share(batches.where(F.col("batch_id") == 1)).first().pct_0 is None
