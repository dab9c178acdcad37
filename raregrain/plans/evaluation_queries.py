"""Evaluation of the deterministic scored table; doubles rounded to six decimals."""

from __future__ import annotations

from pyspark.sql import functions as F

from raregrain.operators import evaluate
from raregrain.operators.sampling import with_split
from raregrain.plans.fixtures import SCORED_SQL, hash_sql, scored
from raregrain.plans.registry import query

_COUNTS = """count(*) FILTER (y = 1 AND prediction = 1) AS tp, count(*) FILTER (y = 0 AND prediction = 1) AS fp,
 count(*) FILTER (y = 0 AND prediction = 0) AS tn, count(*) FILTER (y = 1 AND prediction = 0) AS fn"""
_CM = f"{SCORED_SQL}, cm AS (SELECT {_COUNTS} FROM scored)"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / cast({b} as double) ELSE 0 END"


def _rounded(df):
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema if f.dataType.typeName() == "double"})


@query("confusion", f"WITH {_CM} SELECT * FROM cm")
def _(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir))


@query(
    "confusion_rows",
    f"WITH {_CM} SELECT 0 AS actual, tn AS predicted_0, fp AS predicted_1 FROM cm UNION ALL SELECT 1, fn, tp FROM cm",
)
def _(spark, sf_dir):
    return evaluate.confusion_rows(scored(spark, sf_dir))


@query("accuracy", f"WITH {SCORED_SQL} SELECT round(avg(cast(y = prediction as double)), 6) AS accuracy FROM scored")
def _(spark, sf_dir):
    return _rounded(evaluate.accuracy(scored(spark, sf_dir)))


@query(
    "precision_recall",
    f"WITH {_CM} SELECT round({_ratio('tp', '(tp + fp)')}, 6) AS precision, round({_ratio('tp', '(tp + fn)')}, 6) AS recall FROM cm",
)
def _(spark, sf_dir):
    return _rounded(evaluate.precision_recall(scored(spark, sf_dir)))


@query(
    "weighted_precision",
    f"""WITH {_CM} SELECT round({_ratio('tp', '(tp + fp)')} * (tp + fn) / cast(tp + fp + tn + fn as double)
 + {_ratio('tn', '(tn + fn)')} * (tn + fp) / cast(tp + fp + tn + fn as double), 6) AS weighted_precision FROM cm""",
)
def _(spark, sf_dir):
    return _rounded(evaluate.weighted_precision(scored(spark, sf_dir)))


@query(
    "class_report",
    f"""WITH {_CM}, per AS (
 SELECT '0' AS class, tn AS tp, tn + fn AS predicted, tn + fp AS support FROM cm UNION ALL SELECT '1', tp, tp + fp, tp + fn FROM cm),
 pr AS (SELECT class, tp, support, {_ratio('tp', 'predicted')} AS p, {_ratio('tp', 'support')} AS r FROM per),
 f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, cast(sum(support) over () as double) AS total FROM pr),
 lines AS (
 SELECT class, p AS precision, r AS recall, f1, support FROM f UNION ALL
 SELECT 'macro avg', avg(p), avg(r), avg(f1), cast(sum(support) as bigint) FROM f UNION ALL
 SELECT 'weighted avg', sum(p * support / total), sum(r * support / total), sum(f1 * support / total), cast(sum(support) as bigint) FROM f UNION ALL
 SELECT 'accuracy', NULL, NULL, sum(tp / total), cast(sum(support) as bigint) FROM f)
 SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM lines""",
)
def _(spark, sf_dir):
    return _rounded(evaluate.class_report(scored(spark, sf_dir)))


def _steps_sql(score: str) -> str:
    return f"""{SCORED_SQL}, groups AS (
 SELECT {score} AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1),
 steps AS (SELECT s, pos, neg, sum(pos) over w AS tp, sum(neg) over w AS fp, sum(pos) over () AS np, sum(neg) over () AS nn
 FROM groups WINDOW w AS (ORDER BY s DESC))"""


def _auc_sql(score: str) -> str:
    return f"""WITH {_steps_sql(score)} SELECT round(1 - sum(cast(pos as double) * (fp - neg + neg / 2.0::double)) / (max(np) * cast(max(nn) as double)), 6) AS auc_roc
 FROM steps"""


def _ap_sql(score: str) -> str:
    return f"""WITH {_steps_sql(score)} SELECT round(sum(pos * (tp / cast(tp + fp as double))) / cast(max(np) as double), 6) AS average_precision
 FROM steps"""


def _pr_sql(score: str, start: str) -> str:
    return f"""WITH {_steps_sql(score)}, curve AS (SELECT s, pos, np, tp / cast(tp + fp as double) AS p FROM steps),
 pairs AS (SELECT pos, np, p, coalesce(lag(p) over (order by s desc), {start}) AS q FROM curve)
 SELECT round(sum(pos * (p + q) / 2) / cast(max(np) as double), 6) AS auc_pr FROM pairs"""


@query("auc_roc_exact", _auc_sql("score"))
def _(spark, sf_dir):
    return _rounded(evaluate.auc_roc(scored(spark, sf_dir)))


@query("auc_roc_hard", _auc_sql("cast(prediction as double)"))
def _(spark, sf_dir):
    return _rounded(evaluate.auc_roc(scored(spark, sf_dir), score="prediction"))


@query("average_precision", _ap_sql("score"))
def _(spark, sf_dir):
    return _rounded(evaluate.average_precision(scored(spark, sf_dir)))


@query("average_precision_hard", _ap_sql("cast(prediction as double)"))
def _(spark, sf_dir):
    return _rounded(evaluate.average_precision(scored(spark, sf_dir), score="prediction"))


@query("auc_pr_score", _pr_sql("score", "1.0"))
def _(spark, sf_dir):
    return _rounded(evaluate.auc_pr(scored(spark, sf_dir)))


@query("auc_pr_hard", _pr_sql("cast(prediction as double)", "p"))
def _(spark, sf_dir):
    return _rounded(evaluate.auc_pr(scored(spark, sf_dir), score="prediction", start="first"))


@query(
    "log_loss",
    f"""WITH {SCORED_SQL} SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM (
 SELECT y, greatest(least(score, 1 - 1e-15::double), 1e-15::double) AS p FROM scored)""",
)
def _(spark, sf_dir):
    return _rounded(evaluate.log_loss(scored(spark, sf_dir)))


_LIMITS = """limits AS (SELECT cast(i as integer) AS threshold_no,
 CASE WHEN i = 99 THEN 1.0::double ELSE i * (1 / 99.0::double) END AS threshold FROM range(100) t(i))"""


def _ap_hard(tp: str, fp: str, pos: str, total: str) -> str:
    share = f"({pos} / cast({total} as double))"
    return (
        f"CASE WHEN {tp} + {fp} > 0 THEN ({tp} / cast({tp} + {fp} as double)) * ({tp} / cast({pos} as double)) "
        f"+ (1 - {tp} / cast({pos} as double)) * {share} ELSE {share} END"
    )


_TABLE = f"""{SCORED_SQL}, {_LIMITS}, cut AS (
 SELECT threshold_no, threshold, count(*) FILTER (y = 1 AND score > threshold) AS tp, count(*) FILTER (y = 0 AND score > threshold) AS fp,
 count(*) FILTER (y = 1) AS pos, count(*) AS total FROM scored, limits GROUP BY threshold_no, threshold),
 ap AS (SELECT threshold_no, threshold, tp, fp, {_ap_hard('tp', 'fp', 'pos', 'total')} AS ap FROM cut)"""


@query(
    "threshold_table",
    f"WITH {_TABLE} SELECT threshold_no, round(threshold, 6) AS threshold, tp, fp, round(ap, 6) AS ap FROM ap",
)
def _(spark, sf_dir):
    return _rounded(evaluate.threshold_table(scored(spark, sf_dir)))


@query(
    "threshold_search",
    f"WITH {_TABLE} SELECT round(threshold, 6) AS threshold, round(ap, 6) AS ap FROM ap ORDER BY ap.ap DESC, threshold_no LIMIT 1",
)
def _(spark, sf_dir):
    return _rounded(evaluate.best_threshold(scored(spark, sf_dir)))


_METRICS = f"""round({_ratio('tp', '(tp + fp)')}, 6) AS precision, round({_ratio('tp', 'pos')}, 6) AS recall,
 round({_ratio('2 * tp', '(tp + fp + pos)')}, 6) AS f1, round({_ratio('tp + total - pos - fp', 'total')}, 6) AS accuracy,
 round((1 + {_ratio('tp', 'pos')} - {_ratio('fp', '(total - pos)')}) / 2, 6) AS auc_hard,
 round({_ap_hard('tp', 'fp', 'pos', 'total')}, 6) AS ap_hard"""


@query(
    "eval_before_after",
    f"""WITH {SCORED_SQL}, {_LIMITS}, parts AS (
 SELECT *, cast({hash_sql('id', 42)} >= floor(0.8 * 4294967296) as integer) AS split FROM scored),
 cut AS (SELECT split, threshold_no, threshold, count(*) FILTER (y = 1 AND score > threshold) AS tp,
 count(*) FILTER (y = 0 AND score > threshold) AS fp, count(*) FILTER (y = 1) AS pos, count(*) AS total
 FROM parts, limits GROUP BY ALL),
 best AS (SELECT threshold_no AS best_no FROM cut WHERE split = 1 ORDER BY {_ap_hard('tp', 'fp', 'pos', 'total')} DESC, threshold_no LIMIT 1),
 both_stages AS (
 SELECT split, 'after' AS stage, threshold, tp, fp, pos, total FROM cut JOIN best ON threshold_no = best_no UNION ALL
 SELECT split, 'before', NULL, count(*) FILTER (y = 1 AND prediction = 1), count(*) FILTER (y = 0 AND prediction = 1),
 count(*) FILTER (y = 1), count(*) FROM parts GROUP BY split)
 SELECT split, stage, round(threshold, 6) AS threshold, tp, fp, {_METRICS} FROM both_stages""",
)
def _(spark, sf_dir):
    parts = with_split(scored(spark, sf_dir, spread=True), [0.8, 0.2])
    return _rounded(evaluate.evaluate_before_after(parts, "split", 1))


@query(
    "model_statistics",
    f"""WITH {_CM}, area AS ({_auc_sql('score').replace('WITH ' + SCORED_SQL + ',', 'WITH')})
 SELECT round({_ratio('tp + tn', '(tp + fp + tn + fn)')}, 6) AS accuracy, round({_ratio('tp', '(tp + fp)')}, 6) AS precision,
 round({_ratio('tp', '(tp + fn)')}, 6) AS recall, auc_roc AS auc FROM cm, area""",
)
def _(spark, sf_dir):
    return _rounded(evaluate.model_statistics(scored(spark, sf_dir)))


@query("outliers", f"WITH {SCORED_SQL} SELECT id, round(score, 6) AS score FROM scored WHERE prediction = 1")
def _(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumnRenamed("prediction", "predicted_label")
    return _rounded(evaluate.outliers(rows).select("id", "score"))


@query("prediction_counts", f"WITH {SCORED_SQL} SELECT prediction, count(*) AS n_rows FROM scored GROUP BY prediction")
def _(spark, sf_dir):
    return evaluate.prediction_counts(scored(spark, sf_dir), "prediction")


_CLASSES = 10
_CLASS_AREAS = f"""WITH rows_ AS (
 SELECT label, unnest(range({_CLASSES})) AS class, unnest(list_transform(embedding[1:{_CLASSES}], lambda x: (1 + cast(x as double)) / 2)) AS score
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 steps AS (SELECT class, score, count(*) FILTER (label = class) AS pos, count(*) FILTER (label <> class) AS neg FROM rows_ GROUP BY class, score),
 sums AS (SELECT *, sum(pos) over w AS tp, sum(neg) over w AS fp FROM steps WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
 areas AS (SELECT cast(class as integer) AS class, cast(sum(pos) as bigint) AS support,
 CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (tp / cast(tp + fp as double))) / sum(pos) END AS average_precision
 FROM sums GROUP BY class)"""


def _class_areas(spark, sf_dir):
    scores = F.transform(F.slice("embedding", 1, _CLASSES), lambda x: (1 + x.cast("double")) / 2)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.when(F.col("embedding").isNotNull(), scores).alias("probability"))
    return evaluate.average_precision_by_class(rows, "label")


@query("average_precision_by_class", f"{_CLASS_AREAS} SELECT class, support, round(average_precision, 6) AS average_precision FROM areas")
def _(spark, sf_dir):
    return _rounded(_class_areas(spark, sf_dir))


@query(
    "mean_average_precision",
    f"{_CLASS_AREAS} SELECT round(avg(average_precision), 6) AS macro, "
    "round(sum(average_precision * support) / sum(support) FILTER (average_precision IS NOT NULL), 6) AS weighted FROM areas",
)
def _(spark, sf_dir):
    return _rounded(evaluate.mean_average_precision(_class_areas(spark, sf_dir)))
