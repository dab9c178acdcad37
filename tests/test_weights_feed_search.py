"""Weighted resampling, the resumable feed, fold calibration, spread search points, and floors of model queries."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from raregrain.operators import anomaly, classifiers, feed, sampling, tuning
from raregrain.operators.stats import class_weights
from raregrain.plans import model_queries
from raregrain.plans.fixtures import learnable


def hash_order(i, seed=42):
    return int(hashlib.md5(f"{'' if i is None else i}:{seed}".encode()).hexdigest()[:8], 16)


def test_resample_weighted_against_running_sums(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 7 == 0), float(w)) for i, w in enumerate(np.round(rng.exponential(1.3, 500), 4))]
    rows += [(1000, 0, None), (1001, 1, -2.0), (1002, 1, float("nan")), (1003, 0, 0.0), (1004, 1, 40.0)]
    df = spark.createDataFrame(rows, "id bigint, y int, w double")
    got = {}
    for r in sampling.resample_weighted(df.repartition(5), "w", ["y"]).collect():
        got.setdefault(r.id, []).append(r.copy)
    for y in (0, 1):
        units = {i: round(w * sampling.WEIGHT_UNITS) if w and w > 0 else 0 for i, label, w in rows if label == y}
        total = sum(units.values())
        target = (total + sampling.WEIGHT_UNITS // 2) // sampling.WEIGHT_UNITS
        upto = 0
        for i in sorted(units, key=lambda i: (hash_order(i), i)):
            before, upto = upto, upto + units[i]
            n = math.floor(Fraction(upto * target, total)) - math.floor(Fraction(before * target, total))
            assert sorted(got.get(i, [])) == list(range(1, n + 1))
            assert abs(n - units[i] / sampling.WEIGHT_UNITS) < 1.01


def test_resample_weighted_balances_and_keeps_copies(spark):
    rows = spark.createDataFrame([(i % 40, int(i % 10 == 0), "a") for i in range(400)], "id bigint, y int, copies string")
    out = sampling.resample_weighted(class_weights(rows, "y"), "sample_weights", ["y"])
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {0: 200, 1: 200}
    assert sampling.resample_weighted(rows.where("y > 5").withColumn("w", F.lit(1.0)), "w").count() == 0
    assert sampling.resample_weighted(rows.withColumn("w", F.lit(1.5)), "w").count() == 600


class Stop(Exception):
    pass


@pytest.mark.parametrize("stop", [0, 1, 3])
def test_feed_resumes(spark, tmp_path, stop):
    rows = spark.range(1050).withColumn("x", F.col("id") * 2)
    path, progress = str(tmp_path / "b"), str(tmp_path / "p")
    feed.lay_out_batches(rows, path, size=100, every=3)
    seen = []

    def each(df, number):
        if stop is not None and len({n for n, *_ in seen}) == stop:
            raise Stop
        seen.extend((number, batch, [r.id for r in found]) for batch, found in feed.local_batches(df))

    with pytest.raises(Stop):
        feed.feed_batches(spark, path, progress, each)
    stop = None
    feed.feed_batches(spark, path, progress, each)
    assert [b for _, b, _ in seen] == list(range(11)) and [n for n, *_ in seen] == [b // 3 for b in range(11)]
    assert [len(r) for *_, r in seen] == [100] * 10 + [50]
    order = sorted(range(1050), key=lambda i: (hash_order(i), i))
    assert [sorted(r) for *_, r in seen] == [sorted(order[b * 100 : b * 100 + 100]) for b in range(11)]
    assert feed.feed_batches(spark, path, progress, each) == 0


def test_sigmoid_is_fitted_on_points_and_applied_as_an_expression(spark):
    """A row costs no vectors, and copies of a row weigh as many as they are."""
    rows = [(i, float(s), int(i % 5 * 2 < s)) for i, s in enumerate([0, 1, 2, 3, 4, 5, 6] * 30)]
    df = spark.createDataFrame(rows, "id bigint, score double, y int")
    grouped = df.groupBy("score", "y").agg(F.count(F.lit(1)).alias("n"))
    one, two = anomaly.calibrate(df, "score", method="platt"), anomaly.calibrate(grouped, "score", method="platt", weight="n")
    plan = one(df)._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "EXP(" in plan.upper()
    for a, b in zip(one(df).orderBy("id").collect(), two(df).orderBy("id").collect()):
        assert a.p1 == pytest.approx(b.p1, abs=1e-9) and a.p0 + a.p1 == pytest.approx(1, abs=1e-12)
    sums = one(df).agg(F.sum("p1"), F.sum("y")).first()
    assert sums[0] == pytest.approx(sums[1], rel=1e-4)
    with pytest.raises(Exception, match="no probability"):
        one(spark.createDataFrame([(1, None)], "id bigint, score double")).collect()


def test_fold_calibration_against_plain_fits(spark):
    rng = np.random.default_rng(4)
    score = rng.normal(0, 1, 900)
    y = (score + rng.normal(0, 1, 900) > 1).astype(int)
    df = spark.createDataFrame([(i, int(a), float(s)) for i, (a, s) in enumerate(zip(y, score))], "id bigint, y int, score double")
    calibrate, marked = anomaly.calibrate_folds(df, "score", folds=5)
    got = {r.id: r.p1 for r in calibrate(df).collect()}
    folds = {r.id: r.fold for r in marked.collect()}

    def sigmoid(x, t):  # Newton's method
        a, b = 0.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-(a * x + b)))
            w = p * (1 - p)
            grad = np.array([((t - p) * x).sum(), (t - p).sum()])
            hess = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]])
            da, db = np.linalg.solve(hess, grad)
            a, b = a + da, b + db
        return 1 / (1 + np.exp(-(a * score + b)))

    fold = np.array([folds[i] for i in range(900)])
    want = np.mean([sigmoid(score[fold == f], y[fold == f]) for f in range(5)], axis=0)
    assert max(abs(got[i] - want[i]) for i in range(900)) < 1e-4
    for r in calibrate.fits(marked).collect():
        assert r.n_rows == (fold == r.fold).sum() and r.n_positive == y[fold == r.fold].sum()
        assert r.sum_p1 == pytest.approx(r.n_positive, rel=1e-3)
    with pytest.raises(ValueError, match="both classes"):
        anomaly.calibrate_folds(df.where("y = 0 OR id < 3"), "score")


def test_isotonic_folds(spark):
    df = spark.createDataFrame([(i, int(i % 10 < i // 30), float(i // 30)) for i in range(300)], "id bigint, y int, score double")
    calibrate, marked = anomaly.calibrate_folds(df, "score", method="isotonic", folds=3)
    assert all(0 <= r.p1 <= 1 for r in calibrate(marked).collect())


def test_spread_points():
    space = {"a": tuning.Between(0, 1), "b": tuning.Between(1e-4, 1, log=True), "c": tuning.Between(5, 9, whole=True), "d": ["x", "y"]}
    points = tuning.spread_points(space, 200, seed=1)
    assert points == tuning.spread_points(space, 200, seed=1) != tuning.spread_points(space, 200, seed=2)
    assert points[:8] == tuning.spread_points(space, 8, seed=1)
    a = np.sort([p["a"] for p in points])
    assert np.abs(a - (np.arange(200) + 0.5) / 200).max() < 0.05
    logs = np.sort(np.log10([p["b"] for p in points]))
    assert np.abs(logs - (-4 + 4 * (np.arange(200) + 0.5) / 200)).max() < 0.2
    assert set(p["c"] for p in points) == {5, 6, 7, 8, 9} and {p["d"] for p in points} == {"x", "y"}
    assert 80 < sum(p["d"] == "x" for p in points) < 120
    for bad in (lambda: tuning.Between(2, 1), lambda: tuning.Between(0, 1, log=True)):
        with pytest.raises(ValueError):
            bad()


def test_a_constant_turns_model_queries_red(spark, sf):
    rows = learnable(spark, sf)
    constant = classifiers.fit_logistic(rows.withColumn("vectors", F.col("vectors")), regParam=1e6, elasticNetParam=1.0)
    assert max(abs(constant.coefficients.toArray())) == 0
    tested = model_queries._tested(spark, sf, lambda df: constant).first()
    assert tested.agrees and not tested.separates
    assert not model_queries._with_floor(classifiers.predict(rows, constant, keep=["binds"])).first().separates
    results = spark.createDataFrame([(0, "regParam=1e6", rows.agg(F.avg("binds")).first()[0])], "point int, params string, metric double")
    assert not model_queries._points(results).first().beats_share
