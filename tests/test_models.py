import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from raregrain.functions.vectors import argmax_vector
from raregrain.operators import anomaly, classifiers, tuning
from raregrain.operators import evaluate as ev
from raregrain.operators.sampling import kfold


@pytest.fixture(scope="module")
def points(spark):
    """Two well separated groups, a tenth of the rows in class 1."""
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 10 == 0), (rng.normal(0, 1, 4) + 4 * (i % 10 == 0)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, binds int, x array<double>")
    return df.select("id", "binds", array_to_vector("x").alias("vectors")).persist()


def test_metric_names_are_checked():
    for name in classifiers.BINARY_METRICS + classifiers.MULTICLASS_METRICS:
        assert classifiers.evaluator(name).getMetricName() == name
    with pytest.raises(ValueError):
        classifiers.evaluator("averagePrecision")


def test_booster_params():
    mapped = classifiers.booster_params({"eta": 0.1, "max_depth": 3, "lambda": 5, "alpha": 5, "num_boost_round": 100}, ["lambda", "alpha"])
    assert mapped == {"stepSize": 0.1, "maxDepth": 3, "maxIter": 100}
    with pytest.raises(ValueError):
        classifiers.booster_params({"max_depth": 31})
    with pytest.raises(ValueError, match="max_dpeth"):
        classifiers.booster_params({"max_dpeth": 3})
    assert classifiers.booster_params({"min_child_weight": 2.5, "scale_pos_weight": 9}) == {"minInstancesPerNode": 3}


def test_booster_weighs_class_1(points):
    params = {"num_boost_round": 2, "max_depth": 2, "scale_pos_weight": 3.0}
    weighted = points.withColumn("w", F.when(F.col("binds") == 1, 3.0).otherwise(1.0))
    want = classifiers.fit_gbt(weighted, weight="w", maxIter=2, maxDepth=2)
    assert classifiers.fit_booster(points, params).toDebugString.split("\n")[1:] == want.toDebugString.split("\n")[1:]


@pytest.mark.parametrize(
    "fit",
    [
        classifiers.fit_logistic,
        lambda df: classifiers.fit_random_forest(df, trees=5),
        lambda df: classifiers.fit_gbt(df, maxIter=3),
        lambda df: classifiers.fit_unbalanced_booster(df, maxIter=3),
        lambda df: classifiers.fit_booster(df, {"eta": 0.3, "max_depth": 2, "n_estimators": 3}),
        lambda df: classifiers.fit_mlp(df, [4, 3, 2], max_iter=50),
    ],
)
def test_classifiers_separate(points, fit):
    out = classifiers.predict(points, fit(points), keep=["binds"])
    assert out.columns == ["id", "binds", "prediction", "p1"]
    assert ev.accuracy(out, "binds").first()[0] > 0.97
    assert [r.id for r in out.collect()] == list(range(400))


def test_kmeans_finds_the_groups(points):
    out = classifiers.fit_kmeans(points).transform(points)
    assert sorted(r["count"] for r in out.groupBy("cluster").count().collect()) == [40, 360]


def test_mlp_warm_start_improves(points):
    first = classifiers.fit_mlp(points, [4, 3, 2], max_iter=5)
    again = classifiers.fit_mlp(points, [4, 3, 2], max_iter=5, initial_weights=first.weights)

    def loss(model):
        return ev.log_loss(classifiers.predict(points, model, keep=["binds"]), "binds", "p1").first()[0]

    assert loss(again) < loss(first)


def test_save_and_predict(points, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    model = classifiers.fit_logistic(points)
    classifiers.save_model(model, str(tmp_path / "m"))
    loaded = LogisticRegressionModel.load(str(tmp_path / "m"))
    assert classifiers.predict(points, loaded).collect() == classifiers.predict(points, model).collect()


def test_random_params_are_distinct_and_seeded():
    estimator = classifiers.gbt()
    space = {"maxDepth": [1, 2, 3, 4], "stepSize": [0.1, 0.2, 0.3], "subsamplingRate": [0.5, 1.0]}
    draws = tuning.random_params(estimator, space, 10, seed=1)
    keys = [tuple(m.values()) for m in draws]
    assert len(set(keys)) == 10 and keys == [tuple(m.values()) for m in tuning.random_params(estimator, space, 10, seed=1)]
    assert len(tuning.random_params(estimator, space, 1000)) == 24 == len(tuning.param_grid(estimator, space))
    huge = {name: list(range(1, 31)) for name in ("maxDepth", "maxIter", "minInstancesPerNode", "maxBins", "maxMemoryInMB")}
    assert len(tuning.random_params(estimator, huge, 5)) == 5


def test_searches(spark, points):
    folded = kfold(points, "binds", 3)
    search = tuning.grid_search(folded, classifiers.logistic(maxIter=20), {"regParam": [0.0, 50.0], "elasticNetParam": [1.0]}, folds=3, fold_col="fold")
    results = {r.params: r.metric for r in tuning.search_results(spark, search).collect()}
    assert len(results) == 2 and max(results.values()) > 0.99
    best = {r.param: r.value for r in tuning.best_params(spark, search).collect()}
    assert best["regParam"] == "0.0"
    holdout = tuning.holdout_search(points, classifiers.logistic(maxIter=20), {"regParam": [0.0, 50.0]}, draws=2)
    assert tuning.search_results(spark, holdout).count() == 2


def test_logistic_cv(points):
    model = classifiers.fit_logistic_cv(points, reg_params=(0.0, 0.1), folds=3, maxIter=20)
    assert max(model.avgMetrics) > 0.99


def test_isolation_forest_finds_planted_outliers(points):
    far = points.limit(5).select((F.col("id") + 1000).alias("id"), "binds", array_to_vector(F.array(*[F.lit(40.0)] * 4)).alias("vectors"))
    rows = points.unionByName(far)
    model = anomaly.fit_isolation_forest(rows, trees=60, max_samples=128, contamination=5 / 405)
    out = model.transform(rows)
    top = out.orderBy(F.col("outlier_score").desc()).limit(5).collect()
    assert {r.id >= 1000 for r in top} == {True}
    assert {r.id for r in ev.outliers(out).collect()} >= {r.id for r in top}
    scores = [r.outlier_score for r in out.collect()]
    assert all(0 < s < 1 for s in scores)
    again = anomaly.fit_isolation_forest(rows.repartition(3), trees=60, max_samples=128, contamination=5 / 405)
    assert again.threshold == pytest.approx(model.threshold)


@pytest.mark.parametrize("n", [64, 100, 3000, 20000])
def test_isolation_forest_samples_are_exact_at_every_size(spark, n):
    rows = spark.range(n).select(F.col("id").alias("key"), F.array(F.col("id").cast("double")).alias("x"))
    samples = anomaly._tree_samples(rows, 20, 64, n, 1).collect()
    per = {t: sorted(r.x[0] for r in samples if r.tree == t) for t in range(20)}
    assert all(len(v) == len(set(v)) == 64 for v in per.values())
    if n > 100:
        assert len({tuple(v) for v in per.values()}) == 20
        assert abs(sum(map(sum, per.values())) / 1280 / n - 0.5) < 0.05


def test_isolation_forest_samples_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"), F.array(F.lit(1.0)).alias("x"))
    samples = anomaly._tree_samples(rows, 5, 50, 3000, 1)
    assert {r["count"] for r in samples.groupBy("tree").count().collect()} == {50}


def test_isolation_forest_limits_are_on_settings_alone(points, monkeypatch):
    monkeypatch.setattr(anomaly, "MAX_TREE_ROWS", 100)
    for wrong in (0.5, 0, 101):
        with pytest.raises(ValueError):
            anomaly.fit_isolation_forest(points, trees=2, max_samples=wrong)
    assert anomaly.fit_isolation_forest(points, trees=2, max_samples=100).sample_size == 100


def test_average_path():
    assert anomaly.average_path(1) == 0 and anomaly.average_path(2) == 1
    assert float(anomaly.average_path(256)) == pytest.approx(10.24, abs=0.01)


@pytest.mark.parametrize("method", ["isotonic", "platt"])
@pytest.mark.parametrize("sign", [1, -1])
def test_calibration(spark, method, sign):
    rng = np.random.default_rng(0)
    rows = [(float(sign * x), int(rng.random() < x)) for x in rng.random(800)]
    df = spark.createDataFrame(rows, "s double, y int")
    out = anomaly.calibrate(df, "s", method=method, higher_is_anomalous=sign == 1)(df).collect()
    ordered = sorted(out, key=lambda r: sign * r.s)
    p = [r.p1 for r in ordered]
    assert all(a <= b + 1e-9 for a, b in zip(p, p[1:])) and p[-1] - p[0] > 0.5
    assert all(abs(r.p0 + r.p1 - 1) < 1e-9 for r in out)
    with pytest.raises(ValueError):
        anomaly.calibrate(df, "s", method="other")


def test_argmax_first_wins(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([5.0, 1.0, 5.0],)], "v array<double>")
    assert [r[0] for r in df.select(argmax_vector(df, "v")).collect()] == [1.0, 0.0]
