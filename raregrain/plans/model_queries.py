"""Models, searches, the isolation forest and incremental jobs.

A fit's numbers have no SQL twin, but the label follows from the features, so that every fit has a floor that no
constant reaches: an area of one half, a share of positives, a loss of ln 2. Beside it stand what is determined: rows and
classes scored, points searched, chunks, whether predictions follow from scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raregrain.operators import anomaly, boosting, classifiers, evaluate, tuning
from raregrain.operators.sampling import WEIGHT_UNITS, kfold, stratified_split
from raregrain.operators.stats import class_counts, class_weights, mean_metrics
from raregrain.plans.fixtures import LEARNABLE_SQL as VECTORS_SQL
from raregrain.plans.fixtures import SCORED_SQL, scored
from raregrain.plans.fixtures import learnable as vectors
from raregrain.plans.registry import query
from raregrain.plans.sampling_queries import FOLD_SQL, RANKED_SQL
from raregrain.plans.source_queries import scratch
from raregrain.session import freeze
from raregrain.sources.sinks import load_pred_chunks, write_chunks
from raregrain.streaming import incremental


#: Trees that a chunk adds, and the loss of a constant prediction on rows whose classes are balanced.
_ROUNDS = 3
_CONSTANT_LOSS = "0.69314"


#: Area under ROC that a fit has to pass; a constant has one half.
_FLOOR = 0.7


def _separates(scored: DataFrame, label: str = "y") -> Column:
    """Whether the area under ROC of ``p1`` passes the floor; one number, read back."""
    return F.lit((evaluate.auc_roc(scored, label, "p1").first()[0] or 0.0) > _FLOOR)


def _classes(scored: DataFrame) -> DataFrame:
    """Rows of both classes among scored rows, whether predictions follow from ``p1``, and whether ``p1`` tells them apart."""
    scored = freeze(scored)
    counts = evaluate.confusion(scored, "binds").select((F.col("tp") + F.col("fn")).alias("n_positive"), (F.col("fp") + F.col("tn")).alias("n_negative"))
    agrees = scored.select(_agrees()).agg(F.bool_and("agrees")).first()[0]
    return counts.withColumns({"agrees": F.lit(agrees), "separates": _separates(scored, "binds")})


def _classes_sql(train: float) -> str:
    return f"""WITH {VECTORS_SQL}, sizes AS (
 SELECT binds, cast(count(*) - ceil(cast({train} as double) * count(*)) as bigint) AS n FROM vectors GROUP BY binds)
 SELECT cast(coalesce(sum(n) FILTER (binds = 1), 0) as bigint) AS n_positive,
 cast(coalesce(sum(n) FILTER (binds = 0), 0) as bigint) AS n_negative, true AS agrees, true AS separates FROM sizes"""


_TESTED_SQL = _classes_sql(0.7)


def _tested(spark: SparkSession, sf_dir: str, fit) -> DataFrame:
    """Fit on a stratified 70 %, judged on the rest."""
    rows = freeze(stratified_split(vectors(spark, sf_dir), "binds", 0.7))
    model = fit(rows.where("is_train = 1"))
    return _classes(classifiers.predict(rows.where("is_train = 0"), model, keep=["binds"], ordered=False))


#: Area under PR that every point of a search has to pass; a constant has the share of positives, a tenth.
_PR_FLOOR = 0.2


def _points(results: DataFrame) -> DataFrame:
    """Points of a search and whether each passes the floor."""
    return results.select("point", "params", (F.col("metric") > _PR_FLOOR).alias("beats_share"))


def _agrees() -> Column:
    """Whether a probability is one and the prediction follows from it."""
    p1 = F.col("p1")
    return (p1.between(0, 1) & ((p1 > 0.5).cast("double") == F.col("prediction"))).alias("agrees")


def _with_floor(scored: DataFrame) -> DataFrame:
    """``id``, whether its prediction follows from ``p1``, and whether ``p1`` tells the classes apart over all rows."""
    scored = freeze(scored)
    return scored.select("id", "binds", _agrees(), _separates(scored, "binds").alias("separates"))


@query("kmeans")
def _(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return class_counts(classifiers.fit_kmeans(rows).transform(rows), "cluster")


@query("random_forest", _TESTED_SQL)
def _(spark, sf_dir):
    return _tested(spark, sf_dir, lambda df: classifiers.fit_random_forest(df, trees=20))


@query("gbt", _TESTED_SQL)
def _(spark, sf_dir):
    return _tested(spark, sf_dir, lambda df: classifiers.fit_gbt(df, maxIter=5))


@query("gbt_weighted", _TESTED_SQL)
def _(spark, sf_dir):
    def fit(df):
        return classifiers.fit_gbt(class_weights(df, "binds"), weight="sample_weights", maxIter=5)

    return _tested(spark, sf_dir, fit)


@query("booster", _TESTED_SQL)
def _(spark, sf_dir):
    params = {"eta": 0.1, "max_depth": 3, "num_boost_round": 5, "subsample": 1.0, "gamma": 0, "lambda": 5, "seed": 42}
    return _tested(spark, sf_dir, lambda df: classifiers.fit_booster(df, params, ignore=["lambda"]))


@query("unbalanced_booster", _TESTED_SQL)
def _(spark, sf_dir):
    return _tested(spark, sf_dir, lambda df: classifiers.fit_unbalanced_booster(df, maxIter=5))


@query("logistic", _TESTED_SQL)
def _(spark, sf_dir):
    return _tested(spark, sf_dir, classifiers.fit_logistic)


@query("logistic_cv", "SELECT cast(i as integer) AS point, 'regParam=' || r AS params, true AS beats_share FROM (VALUES (0, '0.01'), (1, '0.1')) t(i, r)")
def _(spark, sf_dir):
    rows = kfold(vectors(spark, sf_dir), "binds", 10).persist()
    model = classifiers.fit_logistic_cv(rows, reg_params=(0.01, 0.1), folds=10, fold_col="fold", maxIter=50)
    return _points(tuning.search_results(spark, model))


@query("mlp", _TESTED_SQL)
def _(spark, sf_dir):
    return _tested(spark, sf_dir, lambda df: classifiers.fit_mlp(df, [64, 32, 16, 2], max_iter=30))


@query("batch_score", f"WITH {VECTORS_SQL} SELECT id, binds, true AS agrees, true AS separates FROM vectors")
def _(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _with_floor(classifiers.predict(rows, classifiers.fit_logistic(rows, maxIter=50), keep=["binds"]))


@query(
    "grid_search",
    "SELECT cast(row_number() over (order by d, s) - 1 as integer) AS point, 'maxDepth=' || d || ', stepSize=' || s AS params, true AS beats_share "
    "FROM (VALUES ('2'), ('3')) a(d), (VALUES ('0.1'), ('0.2')) b(s)",
)
def _(spark, sf_dir):
    rows = vectors(spark, sf_dir).persist()
    space = {"maxDepth": [2, 3], "stepSize": [0.1, 0.2]}
    return _points(tuning.search_results(spark, tuning.grid_search(rows, classifiers.gbt(maxIter=3), space, folds=2)))


@query("random_search")
def _(spark, sf_dir):
    rows = kfold(vectors(spark, sf_dir), "binds", 3).persist()
    space = {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]}
    model = tuning.random_search(rows, classifiers.logistic(maxIter=30), space, draws=4, folds=3, fold_col="fold")
    return tuning.search_results(spark, model)


@query("holdout_search")
def _(spark, sf_dir):
    space = {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}
    model = tuning.holdout_search(vectors(spark, sf_dir).persist(), classifiers.logistic(maxIter=30), space, draws=4)
    return tuning.search_results(spark, model)


_RANGES = {
    "regParam": tuning.Between(1e-5, 0.1, log=True), "elasticNetParam": tuning.Between(0.0, 0.2),
    "maxIter": tuning.Between(20, 50, whole=True), "tol": tuning.Between(1e-8, 1e-4, log=True),
}

#: The root of x**5 = x + 1.
_ROOT = "cast(1.1673039782614187 as double)"


@query(
    "range_search",
    f"""WITH dims AS (SELECT j, floor(4294967296 / pow({_ROOT}, j)) AS step, cast('0x' || substr(md5('42:' || j), 1, 8) as bigint) AS start
 FROM range(1, 5) t(j)), parts AS (SELECT i, j, cast((start + i * cast(step as bigint)) % 4294967296 as double) / 4294967296 AS u FROM dims, range(1, 9) r(i)),
 wide AS (SELECT i, max(u) FILTER (j = 1) AS a, max(u) FILTER (j = 2) AS b, max(u) FILTER (j = 3) AS c, max(u) FILTER (j = 4) AS d FROM parts GROUP BY i)
 SELECT cast(i - 1 as integer) AS point, round(cast(1e-5 as double) * pow(cast(0.1 as double) / cast(1e-5 as double), a), 9) AS "regParam",
 round(cast(0.2 as double) * b, 9) AS "elasticNetParam", cast(floor(20 + 30 * c + 0.5) as bigint) AS "maxIter",
 round(cast(1e-8 as double) * pow(cast(1e-4 as double) / cast(1e-8 as double), d), 12) AS tol, true AS beats_share FROM wide""",
)
def _(spark, sf_dir):
    rows = vectors(spark, sf_dir).persist()
    share = rows.agg(F.avg("binds")).first()[0]
    model = tuning.range_search(rows, classifiers.logistic(), _RANGES, draws=8)
    tried = [{p.name: v for p, v in m.items()} for m in model.getEstimatorParamMaps()]
    points = [(i, t["regParam"], t["elasticNetParam"], t["maxIter"], t["tol"], m) for i, (t, m) in enumerate(zip(tried, model.validationMetrics))]
    table = spark.createDataFrame(points, "point int, regParam double, elasticNetParam double, maxIter bigint, tol double, metric double")
    rounded = [F.round(c, d).alias(c) for c, d in (("regParam", 9), ("elasticNetParam", 9), ("tol", 12))]
    return table.select("point", *rounded, "maxIter", (F.col("metric") > 1.5 * share).alias("beats_share"))


@query("best_params")
def _(spark, sf_dir):
    space = {"regParam": [0.01, 0.1]}
    model = tuning.grid_search(vectors(spark, sf_dir).persist(), classifiers.logistic(maxIter=30), space, folds=2)
    return tuning.best_params(spark, model)


@query("isolation_forest")
def _(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    model = anomaly.fit_isolation_forest(rows, trees=50, contamination=0.1)
    return model.transform(rows).select("id", "binds", F.round("outlier_score", 6).alias("outlier_score"), "predicted_label")


@query("isolation_forest_bootstrap")
def _(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    model = anomaly.fit_isolation_forest(rows, trees=50, max_samples=256, max_features=0.7, bootstrap=True, contamination=0.1)
    return evaluate.prediction_counts(model.transform(rows))


_FOLDS = 5


@query(
    "calibrate_platt",
    f"""WITH {RANKED_SQL}, folded AS (SELECT y, {FOLD_SQL} AS fold FROM ranked)
 SELECT cast(fold as integer) AS fold, count(*) AS n_rows, cast(sum(y) as bigint) AS n_positive, true AS sums_agree FROM folded GROUP BY fold""",
)
def _(spark, sf_dir):
    """Rows and positives of every fit; a sigmoid fitted without penalty gives its rows as many positives as they have."""
    calibrate, marked = anomaly.calibrate_folds(scored(spark, sf_dir), "score", folds=_FOLDS)
    agree = F.abs(F.col("sum_p1") - F.col("n_positive")) < 0.01 * F.col("n_positive")
    return calibrate.fits(marked).select("fold", "n_rows", "n_positive", agree.alias("sums_agree"))


@query("calibrate_platt_scores", f"WITH {SCORED_SQL} SELECT id, true AS is_mean, true AS keeps_order, true AS separates, true AS folds_differ FROM scored")
def _(spark, sf_dir):
    """The probability is the mean of the folds' own, never falls with the score, and tells the classes apart."""
    # the folds take several passes, and the ids are computed
    calibrate, marked = anomaly.calibrate_folds(freeze(scored(spark, sf_dir)), "score", folds=_FOLDS)
    out = calibrate(marked)
    for i, one in enumerate(calibrate.maps):
        out = one(out.withColumnsRenamed({"p0": "mean0", "p1": "mean1"})).drop("p0").withColumnsRenamed({"p1": f"own{i}", "mean0": "p0", "mean1": "p1"})
    out = freeze(out)
    mean = sum((F.col(f"own{i}") for i in range(_FOLDS)), F.lit(0.0)) / _FOLDS
    is_mean = (F.abs(F.col("p1") - mean) < 1e-12) & (F.abs(F.col("p0") + F.col("p1") - 1) < 1e-12)
    steps = out.groupBy("score").agg(F.min("p1").alias("low"), F.max("p1").alias("high"))  # a few hundred scores
    before = F.lag("high").over(Window.partitionBy(F.lit(0)).orderBy("score"))
    rises = steps.select("score", ((F.col("low") == F.col("high")) & (F.col("low") >= F.coalesce(before, F.lit(0.0)))).alias("keeps_order"))
    differ = out.agg(F.max(F.abs(F.col("own0") - F.col("own1"))) > 0).first()[0]
    said = [is_mean.alias("is_mean"), "keeps_order", _separates(out).alias("separates"), F.lit(differ).alias("folds_differ")]
    return out.join(rises, "score").select("id", *said)


#: Isotonic regression by its min-max formula over the distinct scores.
_ISOTONIC_SQL = f"""WITH {SCORED_SQL}, points AS (
 SELECT score, cast(sum(y) as bigint) AS pos, count(*) AS n, row_number() over (order by score) AS i FROM scored GROUP BY score),
 sums AS (SELECT i, score, sum(pos) over (order by i) AS p, sum(n) over (order by i) AS c, pos, n FROM points),
 runs AS (SELECT a.i AS lo, b.i AS hi, (b.p - a.p + a.pos) / cast(b.c - a.c + a.n as double) AS mean
  FROM sums a JOIN sums b ON a.i <= b.i),
 least_ AS (SELECT r.lo, s.i, min(r.mean) AS m FROM runs r JOIN sums s ON r.lo <= s.i AND s.i <= r.hi GROUP BY r.lo, s.i),
 fitted AS (SELECT i, max(m) AS p1 FROM least_ GROUP BY i)
 SELECT id, round(1 - p1, 6) AS p0, round(p1, 6) AS p1 FROM scored JOIN sums USING (score) JOIN fitted USING (i)"""


@query("calibrate_isotonic", _ISOTONIC_SQL)
def _(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return anomaly.calibrate(rows, "score")(rows).select("id", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


def _vector_chunks(spark: SparkSession, sf_dir: str):
    path = scratch(spark, "vectors")
    rows = vectors(spark, sf_dir)
    write_chunks(rows, path, 200)
    return spark, path, rows.schema


@query(
    "stream_incremental_fit",
    f"""WITH {VECTORS_SQL}, numbered AS (SELECT binds, (row_number() over (order by id) - 1) // 200 + 1 AS c FROM vectors),
 sizes AS (SELECT c, count(*) AS n, count(*) FILTER (binds = 0) AS n0, count(*) FILTER (binds = 1) AS n1 FROM numbered GROUP BY c),
 units AS (SELECT *, cast(round(n / (2.0::double * n0) * {WEIGHT_UNITS}) as bigint) AS u0, cast(round(n / (2.0::double * n1) * {WEIGHT_UNITS}) as bigint) AS u1 FROM sizes)
 SELECT cast(c as integer) AS chunk_no, n AS n_rows, (n0 * u0 + {WEIGHT_UNITS // 2}) // {WEIGHT_UNITS} AS n_fit_0,
 (n1 * u1 + {WEIGHT_UNITS // 2}) // {WEIGHT_UNITS} AS n_fit_1, true AS beats_constant, true AS beats_share FROM units""",
)
def _(spark, sf_dir):
    root = scratch(spark, "incremental")
    incremental.train_incremental(*_vector_chunks(spark, sf_dir), root, [64, 16, 2], max_iter=20)
    better = [(F.col("logloss") < float(_CONSTANT_LOSS)).alias("beats_constant"), (F.col("aucpr") > 0.2).alias("beats_share")]
    return spark.read.parquet(f"{root}/log").select("chunk_no", "n_rows", "n_fit_0", "n_fit_1", *better)


@query("stream_score", f"WITH {VECTORS_SQL} SELECT id, binds, true AS agrees, true AS separates FROM vectors")
def _(spark, sf_dir):
    rows, out = vectors(spark, sf_dir), scratch(spark, "scores")
    model = classifiers.fit_logistic(rows, maxIter=30)
    stream = incremental.read_chunks(*_vector_chunks(spark, sf_dir), incremental.TOGETHER)
    incremental.score_incremental(model, stream, f"{out}/rows", f"{out}/progress", label="binds")
    return _with_floor(load_pred_chunks(spark, f"{out}/rows"))


@query("chunk_ensemble", _classes_sql(0.0))
def _(spark, sf_dir):
    from pyspark.ml.classification import GBTClassificationModel

    root = scratch(spark, "ensemble")
    def fit(df):
        return classifiers.fit_gbt(df, weight="sample_weights", maxIter=3, maxDepth=3)

    paths = incremental.train_ensemble(*_vector_chunks(spark, sf_dir), root, fit, label="binds", fit_few=fit)
    models = incremental.load_models(GBTClassificationModel.load, paths)
    return _classes(incremental.score_ensemble(vectors(spark, sf_dir), models, keep=["binds"]))


def _boosted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "boosted")
    incremental.train_boosted(*_vector_chunks(spark, sf_dir), root, _ROUNDS, step=0.3)
    return spark.read.parquet(f"{root}/log")


@query(
    "boosted_chunks",
    f"""WITH {VECTORS_SQL}, sizes AS (
 SELECT cast((i - 1) // 200 + 1 as integer) AS chunk_no, count(*) AS n_rows FROM (SELECT row_number() over (order by id) AS i FROM vectors) GROUP BY 1)
 SELECT chunk_no, n_rows, cast((chunk_no - 1) * {_ROUNDS} + r as integer) AS round, true AS falls, true AS beats_constant, true AS beats_share
 FROM sizes, range(1, {_ROUNDS} + 1) t(r)""",
)
def _(spark, sf_dir):
    log = _boosted_log(spark, sf_dir)
    before = F.lag("logloss").over(Window.partitionBy("chunk_no").orderBy("round"))
    falls = F.col("logloss") < F.coalesce(before, F.lit(float("inf")))
    # with balanced classes a constant has a loss of ln 2 and an area of one half
    return log.select(
        "chunk_no", "n_rows", "round", falls.alias("falls"), (F.col("logloss") < float(_CONSTANT_LOSS)).alias("beats_constant"),
        (F.col("aucpr") > 0.55).alias("beats_share"),
    )


@query(
    "mean_round_metrics",
    f"""WITH {VECTORS_SQL} SELECT cast(c as integer) AS chunk_no, true AS between_ends, true AS beats_constant, true AS beats_share FROM (
 SELECT (row_number() over (order by id) - 1) // 200 + 1 AS c FROM vectors) GROUP BY c""",
)
def _(spark, sf_dir):
    log = _boosted_log(spark, sf_dir)
    ends = log.groupBy("chunk_no").agg(F.min("logloss").alias("low"), F.max("logloss").alias("high"))
    return mean_metrics(log).join(ends, "chunk_no").select(
        "chunk_no", ((F.col("mean_logloss") > F.col("low")) & (F.col("mean_logloss") < F.col("high"))).alias("between_ends"),
        (F.col("mean_logloss") < float(_CONSTANT_LOSS)).alias("beats_constant"), (F.col("mean_aucpr") > 0.55).alias("beats_share"),
    )


@query("boost_rounds", "SELECT cast(r as integer) AS round, true AS falls, true AS beats_constant, true AS beats_share, true AS last_agrees FROM range(1, 7) t(r)")
def _(spark, sf_dir):
    rows = freeze(class_weights(vectors(spark, sf_dir), "binds"))
    model = boosting.boost(rows, 6, weight="sample_weights", step=0.3)
    metrics = boosting.round_metrics(rows, model, weight="sample_weights")
    scored = model.transform(rows)
    own = evaluate.log_loss(scored, "binds", "p1", weight="sample_weights").first()[0]
    before = F.lag("logloss").over(Window.partitionBy(F.lit(0)).orderBy("round"))  # one row per round
    return metrics.select(
        "round", (F.col("logloss") < F.coalesce(before, F.lit(float("inf")))).alias("falls"),
        (F.col("logloss") < float(_CONSTANT_LOSS)).alias("beats_constant"), (F.col("aucpr") > 0.55).alias("beats_share"),
        F.coalesce((F.col("round") != model.rounds) | (F.abs(F.lit(own) - F.col("logloss")) < 1e-9), F.lit(True)).alias("last_agrees"),
    )


@query("boosted_score", f"WITH {VECTORS_SQL} SELECT id, binds, true AS agrees, true AS separates FROM vectors")
def _(spark, sf_dir):
    rows = freeze(class_weights(vectors(spark, sf_dir), "binds"))
    return _with_floor(boosting.boost(rows, 6, weight="sample_weights", step=0.3).transform(rows, ["id", "binds"]))
