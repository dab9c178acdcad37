import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from raregrain.operators import evaluate as ev

TOY = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.3), (0, 1, 0.6), (0, 0, 0.1)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "y int, prediction int, score double")


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        y = int(rng.random() < 0.1)
        rows.append((y, 0, min(1.0, max(0.0, rng.gauss(0.6 if y else 0.4, 0.2)))))
    rows += [(1, 0, i / 99) for i in range(100)]
    return spark.createDataFrame([(y, int(s > 0.5), s) for y, _, s in rows], "y int, prediction int, score double").repartition(7)


def value(df):
    return df.first()[0]


def test_toy_areas(toy):
    assert value(ev.auc_roc(toy, score="prediction")) == pytest.approx(0.583333, abs=1e-6)
    assert value(ev.auc_pr(toy, score="prediction", start="first")) == pytest.approx(0.475)
    assert value(ev.auc_pr(toy, start="first")) == pytest.approx(0.791667, abs=1e-6)
    assert value(ev.average_precision(toy)) == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_toy_counts(toy):
    assert tuple(ev.confusion(toy).first()) == (1, 1, 2, 1)
    assert sorted(map(tuple, ev.confusion_rows(toy).collect())) == [(0, 2, 1), (1, 1, 1)]
    assert value(ev.accuracy(toy)) == 0.6
    assert tuple(ev.precision_recall(toy).first()) == (0.5, 0.5)
    assert value(ev.weighted_precision(toy)) == pytest.approx(0.5 * 0.4 + (2 / 3) * 0.6)
    stats = ev.model_statistics(toy).first()
    assert (stats.accuracy, stats.precision, stats.recall) == (0.6, 0.5, 0.5) and stats.auc == pytest.approx(5 / 6)


def test_areas_match_library(noisy):
    for name, mine in (("areaUnderROC", ev.auc_roc(noisy)), ("areaUnderPR", ev.auc_pr(noisy, start="first"))):
        want = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="score", metricName=name, numBins=0)
        assert value(mine) == pytest.approx(want.evaluate(noisy), abs=1e-9)


def test_average_precision_brute_force(noisy):
    rows = [(r.score, r.y) for r in noisy.collect()]
    positives = sum(y for _, y in rows)
    total = tp = seen = 0
    for score in sorted({s for s, _ in rows}, reverse=True):
        here = [y for s, y in rows if s == score]
        tp, seen = tp + sum(here), seen + len(here)
        total += sum(here) / positives * tp / seen
    assert value(ev.average_precision(noisy)) == pytest.approx(total, abs=1e-12)


def test_perfect_and_undefined(spark):
    perfect = spark.createDataFrame([(i % 2, i % 2, float(i % 2)) for i in range(10)], "y int, prediction int, score double")
    assert value(ev.average_precision(perfect)) == 1.0 and value(ev.auc_roc(perfect)) == 1.0 and value(ev.auc_pr(perfect)) == 1.0
    single = perfect.where("y = 0")
    assert value(ev.auc_roc(single)) is None and value(ev.average_precision(single)) is None
    assert tuple(ev.precision_recall(single).first()) == (0.0, 0.0)
    assert value(ev.log_loss(perfect)) == pytest.approx(0, abs=1e-12)


def test_log_loss_weighted(spark):
    df = spark.createDataFrame([(1, 0.8, 2.0), (0, 0.4, 1.0)], "y int, score double, w double")
    a, b = -math.log(0.8), -math.log(0.6)
    assert value(ev.log_loss(df)) == pytest.approx((a + b) / 2)
    assert value(ev.log_loss(df, weight="w")) == pytest.approx((2 * a + b) / 3)


def hard_ap(y, p):
    tp, fp, pos = int((p & y).sum()), int((p & ~y).sum()), int(y.sum())
    prevalence = pos / len(y)
    return prevalence if tp + fp == 0 else tp / (tp + fp) * tp / pos + (1 - tp / pos) * prevalence


def test_threshold_search_brute_force(noisy):
    rows = noisy.collect()
    y = np.array([bool(r.y) for r in rows])
    s = np.array([r.score for r in rows])
    grid = np.linspace(0, 1, 100)
    assert ev.thresholds() == grid.tolist()
    want = [hard_ap(y, s > t) for t in grid]
    got = sorted(map(tuple, ev.threshold_table(noisy).collect()))
    for (i, t, tp, fp, ap), w in zip(got, want):
        assert t == grid[i] and tp == int(((s > t) & y).sum()) and fp == int(((s > t) & ~y).sum())
        assert ap == pytest.approx(w, abs=1e-12)
    best = ev.best_threshold(noisy).first()
    assert best.threshold == grid[int(np.argmax(want))] and best.ap == pytest.approx(max(want))


def test_threshold_without_positives(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.9)], "y int, score double")
    assert tuple(ev.best_threshold(df).first()) == (0.0, 0.0)


def test_evaluate_before_after(noisy):
    parts = noisy.withColumn("split", (F.xxhash64("score") % 2 == 0).cast("int"))
    rows = {(r.split, r.stage): r for r in ev.evaluate_before_after(parts, "split", 1).collect()}
    assert len(rows) == 4
    best = ev.best_threshold(parts.where("split = 1")).first().threshold
    for split in (0, 1):
        part = parts.where(F.col("split") == split)
        before = rows[split, "before"]
        cm = ev.confusion(part).first()
        assert (before.tp, before.fp) == (cm.tp, cm.fp) and before.auc_hard == pytest.approx(value(ev.auc_roc(part, score="prediction")))
        after = rows[split, "after"]
        hard = part.withColumn("prediction", (F.col("score") > best).cast("int"))
        assert after.threshold == best and after.ap_hard == pytest.approx(value(ev.average_precision(hard, score="prediction")))
        assert after.accuracy == pytest.approx(value(ev.accuracy(hard)))


def test_class_report_three_classes(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 2)]
    rows = {r["class"]: r for r in ev.class_report(spark.createDataFrame(pairs, "y int, prediction int")).collect()}
    assert (rows["0"].precision, rows["0"].recall, rows["0"].support) == (0.5, 0.5, 2)
    assert rows["1"].precision == pytest.approx(2 / 3) and rows["1"].recall == 1.0
    assert rows["accuracy"].f1 == pytest.approx(4 / 6) and rows["accuracy"].precision is None
    assert rows["macro avg"].recall == pytest.approx((0.5 + 1 + 0.5) / 3)
    assert rows["weighted avg"].support == 6


def test_outliers(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "id int, predicted_label int")
    assert {r.id for r in ev.outliers(df).collect()} == {1, 3}
    assert {r.predicted_label: r.n_rows for r in ev.prediction_counts(df).collect()} == {0: 1, 1: 2}
