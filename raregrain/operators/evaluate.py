"""Exact distributed evaluation of binary and multi-class predictions.

Counts come from one aggregate per result. Curve metrics first collapse rows to
distinct scores and then use range-sliced running sums, so no task sees the whole
score order and nothing is binned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.text import ratio_or_zero
from raregrain.functions.vectors import as_array
from raregrain.operators.ranking import running_sums, stratified_running_sums
from raregrain.session import freeze


def confusion(df: DataFrame, label: str = "y", prediction: str = "prediction") -> DataFrame:
    """One row ``tp, fp, tn, fn``."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def confusion_rows(df: DataFrame, label: str = "y", prediction: str = "prediction") -> DataFrame:
    """The matrix as two rows: actual 0 with ``tn, fp``, actual 1 with ``fn, tp``."""
    rows = F.array(
        F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"), F.col("fp").alias("predicted_1")),
        F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"), F.col("tp").alias("predicted_1")),
    )
    return confusion(df, label, prediction).select(F.inline(rows))


def accuracy(df: DataFrame, label: str = "y", prediction: str = "prediction") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def precision_recall(df: DataFrame, label: str = "y", prediction: str = "prediction") -> DataFrame:
    """Precision and recall of class 1, 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion(df, label, prediction).select(
        ratio_or_zero(tp, tp + fp).alias("precision"), ratio_or_zero(tp, tp + fn).alias("recall")
    )


def weighted_precision(df: DataFrame, label: str = "y", prediction: str = "prediction") -> DataFrame:
    """Precision per class weighted by class size; every class but 1 counts as the negative one."""
    y, p = F.col(label), F.col(prediction)
    n, n1 = F.col("n"), F.col("n1")
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    counts = df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if(y == 1).alias("n1"),
        F.count(y).alias("n"),
    )
    value = ratio_or_zero(tp, tp + fp) * ratio_or_zero(n1, n) + ratio_or_zero(tn, tn + fn) * ratio_or_zero(n - n1, n)
    return counts.select(value.alias("weighted_precision"))


def class_report(df: DataFrame, label: str = "y", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    Everything after the first aggregate works on (classes x classes) rows.
    """
    y, p, n = F.col(label).cast("string"), F.col(prediction).cast("int").cast("string"), F.col("n")
    pairs = df.groupBy(y.alias("y"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("y").alias("c"), n.alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("support"), n.alias("predicted")),
    )
    tp = F.when(F.col("y") == F.col("p"), n).otherwise(0)
    per_class = (
        pairs.select(tp.alias("tp"), F.inline(sides))
        .groupBy("c")
        # a hit is listed on both sides of its pair
        .agg((F.sum("tp") / 2).alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )
    precision, recall = ratio_or_zero("tp", "predicted"), ratio_or_zero("tp", "support")
    per_class = per_class.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    whole = Window.partitionBy()
    total = F.sum("support").over(whole)
    weighted = per_class.withColumns(
        {"_even": 1 / F.count(F.lit(1)).over(whole), "_by_size": F.col("support") / total, "_hits": F.col("tp") / total}
    )
    null = F.lit(None).cast("double")

    def line(name: Column, weight: Column) -> Column:
        return F.struct(
            name.alias("class"),
            (weight * F.col("precision")).alias("precision"),
            (weight * F.col("recall")).alias("recall"),
            (weight * F.col("f1")).alias("f1"),
            F.col("support").alias("support"),
        )

    overall = F.struct(
        F.lit("accuracy").alias("class"), null.alias("precision"), null.alias("recall"),
        F.col("_hits").alias("f1"), F.col("support").alias("support"),
    )
    lines = F.array(
        line(F.col("c"), F.lit(1.0)),
        line(F.lit("macro avg"), F.col("_even")),
        line(F.lit("weighted avg"), F.col("_by_size")),
        overall,
    )
    return (
        weighted.select(F.inline(lines))
        .groupBy("class")
        .agg(*[F.sum(m).alias(m) for m in ("precision", "recall", "f1", "support")])
    )


def _score_steps(df: DataFrame, label: str, score: str, rows: int | None = None) -> DataFrame:
    """Per distinct score, descending: ``pos, neg`` there and ``tp, fp`` down to and including it."""
    y = F.col(label)
    groups = (
        df.where(y.isin(0, 1))
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    return running_sums(groups, [F.col("score").desc()], {"tp": "pos", "fp": "neg"}, rows)


def auc_roc(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve by rank sums; tied scores count half."""
    neg_above = F.col("fp") - F.col("neg")
    pairs_lost = F.sum(F.col("pos").cast("double") * (neg_above + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return _score_steps(df, label, score).agg((1 - F.try_divide(pairs_lost, pairs)).alias("auc_roc"))


def average_precision(df: DataFrame, label: str = "y", score: str = "score", rows: int | None = None) -> DataFrame:
    """Step form of the area under the precision-recall curve, ties grouped; ``rows`` is a bound on the rows where one is known."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return _score_steps(df, label, score, rows).agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos").cast("double")).alias("average_precision")
    )


#: Running sums from which :func:`curve_area` is computed.
CURVE_SUMS = {"tp": "pos", "fp": "neg"}


def curve_area() -> Column:
    """Average precision as an aggregate of rows ``pos, neg`` by descending score with their ``CURVE_SUMS``."""
    gained = F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    return F.try_divide(F.sum(gained), F.sum("pos").cast("double"))


def staged_curve(steps: DataFrame, stratum: str) -> DataFrame:
    """``<stratum>, average_precision`` of every stratum of a table ``<stratum>, score, pos, neg`` with one row per score.

    Null for a stratum without positive rows.
    """
    sums = stratified_running_sums(steps, [stratum], [F.col("score").desc()], CURVE_SUMS)
    return sums.groupBy(stratum).agg(curve_area().alias("average_precision"))


def average_precision_by_class(df: DataFrame, label: str = "y", probability: str = "probability") -> DataFrame:
    """``class, support, average_precision`` of every class against the rest, from a vector of a score per class.

    Vectors are unpacked to (class, score) and summed by both before the only shuffle of rows, so that all curves
    come from one pass. A class without rows has support 0 and no area (null), as has one that holds all rows, whose rest is empty.
    Rows with a null label or vector take no part; labels beyond the vector count in the rest of every class.
    """
    known = df.select(F.col(label).cast("int").alias("_y"), F.when(F.col(probability).isNotNull(), as_array(df, probability)).alias("_p")).where("_y IS NOT NULL AND _p IS NOT NULL")
    rows = known.select("_y", F.posexplode("_p").alias("class", "score"))
    own = F.col("_y") == F.col("class")
    steps = freeze(rows.groupBy("class", "score").agg(F.count_if(own).alias("pos"), F.count_if(~own).alias("neg")))
    sizes = steps.groupBy("class").agg(F.sum("pos").alias("support"), F.sum("neg").alias("_rest"))
    areas = sizes.join(staged_curve(steps, "class"), "class")
    area = F.when((F.col("support") > 0) & (F.col("_rest") > 0), F.col("average_precision"))
    return areas.select("class", "support", area.alias("average_precision"))


def mean_average_precision(by_class: DataFrame) -> DataFrame:
    """One row: the plain mean of the areas and the mean weighted by support, over classes that have an area."""
    area = F.col("average_precision")
    known = F.when(area.isNotNull(), F.col("support"))
    return by_class.agg(F.avg(area).alias("macro"), F.try_divide(F.sum(area * known), F.sum(known)).alias("weighted"))


def auc_pr(df: DataFrame, label: str = "y", score: str = "score", start: str = "one") -> DataFrame:
    """Trapezoid area under the precision-recall curve.

    The curve starts at recall 0 with precision 1 (``start='one'``) or with the
    precision of the highest score (``start='first'``).
    """
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    here = tp / (tp + fp)
    before = F.try_divide((tp - pos).cast("double"), (tp + fp - pos - neg).cast("double"))
    before = F.coalesce(before, F.lit(1.0) if start == "one" else here)
    return _score_steps(df, label, score).agg(
        F.try_divide(F.sum(pos * (here + before) / 2), F.sum(pos).cast("double")).alias("auc_pr")
    )


def log_loss(
    df: DataFrame, label: str = "y", probability: str = "score", eps: float = 1e-15, weight: str | None = None
) -> DataFrame:
    """Binary cross-entropy, weighted if asked, with probabilities clipped to ``[eps, 1 - eps]``."""
    y = F.col(label).cast("double")
    p = F.greatest(F.least(F.col(probability).cast("double"), F.lit(1 - eps)), F.lit(eps))
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    mean = F.avg(loss) if weight is None else F.try_divide(F.sum(F.col(weight) * loss), F.sum(weight))
    return df.agg(mean.alias("log_loss"))


def thresholds(n: int = 100) -> list[float]:
    """``n`` evenly spaced thresholds from 0 to 1."""
    step = 1 / (n - 1)
    return [i * step for i in range(n - 1)] + [1.0]


def _exceeded(score: Column, n: int) -> Column:
    """How many of the ``n`` thresholds lie strictly below the score.

    The guess by arithmetic is at most one off; the three thresholds around it
    are compared exactly.
    """
    table = F.array(*[F.lit(t) for t in thresholds(n)])
    guess = F.greatest(F.least(F.floor(score * (n - 1)), F.lit(n - 2)), F.lit(1)).cast("int")
    above = [(score > F.get(table, guess + d)).cast("int") for d in (-1, 0, 1)]
    return guess - 1 + above[0] + above[1] + above[2]


def _hard_metrics(tp: Column, fp: Column, pos: Column, total: Column) -> dict[str, Column]:
    """Metrics of a 0/1 predictor from its counts, in closed form."""
    neg = total - pos
    precision, recall = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, pos)
    prevalence = ratio_or_zero(pos, total)
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio_or_zero(2 * tp, tp + fp + pos),
        "accuracy": ratio_or_zero(tp + neg - fp, total),
        "auc_hard": (1 + recall - ratio_or_zero(fp, neg)) / 2,
        "ap_hard": F.when(tp + fp > 0, precision * recall + (1 - recall) * prevalence).otherwise(prevalence),
    }


def _threshold_counts(hist: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """Per group and threshold: ``tp, fp, pos, total``.

    ``hist`` holds ``_k`` (thresholds exceeded), ``_pos`` and ``_n``: at most
    ``n + 1`` rows per group, collected to one array per group. A prediction at
    threshold ``i`` is positive for all rows with ``_k > i``.
    """
    cells = F.collect_list(F.struct("_k", "_pos", "_n"))
    packed = hist.groupBy(*group).agg(cells.alias("_cells"), F.sum("_pos").alias("pos"), F.sum("_n").alias("total"))
    i = F.col("threshold_no")
    zero = F.lit(0).cast("bigint")

    def above(field: str) -> Column:
        return F.aggregate(F.filter("_cells", lambda c: c["_k"] > i), zero, lambda acc, c: acc + c[field])

    every = F.sequence(F.lit(0), F.lit(n - 1))
    return (
        packed.select(*group, "_cells", "pos", "total", F.explode(every).alias("threshold_no"))
        .withColumns({"tp": above("_pos"), "_p": above("_n")})
        .withColumn("fp", F.col("_p") - F.col("tp"))
        .withColumn("threshold", F.get(F.array(*[F.lit(t) for t in thresholds(n)]), i))
        .drop("_cells", "_p")
    )


def _threshold_hist(df: DataFrame, label: str, score: str, n: int, group: Sequence[Column | str] = ()) -> DataFrame:
    return df.groupBy(*group, _exceeded(F.col(score).cast("double"), n).alias("_k")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count(F.lit(1)).alias("_n")
    )


def threshold_table(df: DataFrame, label: str = "y", score: str = "score", n: int = 100) -> DataFrame:
    """Average precision of the hard prediction at each of ``n`` thresholds.

    One pass: a row is counted once, under the number of thresholds its score
    exceeds; the hundred results are sums over that histogram.
    """
    counts = _threshold_counts(_threshold_hist(df, label, score, n), [], n)
    metrics = _hard_metrics(*(F.col(c) for c in ("tp", "fp", "pos", "total")))
    return counts.select("threshold_no", "threshold", "tp", "fp", metrics["ap_hard"].alias("ap"))


def best_threshold(df: DataFrame, label: str = "y", score: str = "score", n: int = 100) -> DataFrame:
    """Lowest threshold with the highest average precision (0 if none is above 0)."""
    table = threshold_table(df, label, score, n)
    return table.agg(F.max_by("threshold", F.struct("ap", -F.col("threshold_no"))).alias("threshold"), F.max("ap").alias("ap"))


def evaluate_before_after(
    df: DataFrame, part: str, choose_on: object, label: str = "y", score: str = "score", prediction: str = "prediction", n: int = 100
) -> DataFrame:
    """Metrics of every part at its default predictions and at the threshold chosen on one part.

    ``part`` names the column that tells training from validation rows. Both
    stages for all parts come out of one scan.
    """
    # frozen: two rows per part and threshold at most, read for both stages
    hist = freeze(_threshold_hist(df, label, score, n, [F.col(part), F.col(prediction).cast("int").alias("_pred")]))
    at_all = _threshold_counts(hist.groupBy(part, "_k").agg(F.sum("_pos").alias("_pos"), F.sum("_n").alias("_n")), [part], n)
    ap = _hard_metrics(*(F.col(c) for c in ("tp", "fp", "pos", "total")))["ap_hard"]
    rank = F.when(F.col(part) == F.lit(choose_on), F.struct(ap.alias("ap"), (-F.col("threshold_no")).alias("i")))
    best = F.max(rank).over(Window.partitionBy())["i"]
    after = at_all.withColumn("_best", -best).where("threshold_no = _best").drop("_best", "threshold_no")
    hit = F.col("_pred") == 1
    before = hist.groupBy(part).agg(
        F.sum("_pos").alias("pos"),
        F.sum("_n").alias("total"),
        F.coalesce(F.sum(F.when(hit, F.col("_pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("_n") - F.col("_pos"))), F.lit(0)).alias("fp"),
        F.lit(None).cast("double").alias("threshold"),
    )
    both = before.withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after")))
    metrics = _hard_metrics(*(F.col(c) for c in ("tp", "fp", "pos", "total")))
    return both.select(part, "stage", "threshold", "tp", "fp", *[m.alias(k) for k, m in metrics.items()])


def model_statistics(df: DataFrame, label: str = "y", prediction: str = "prediction", score: str = "score") -> DataFrame:
    """One row: accuracy, precision, recall and AUC on scores.

    Two aggregates over the same input; their single rows are put side by side.
    """
    counts = confusion(df, label, prediction)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    area = auc_roc(df, label, score).first()[0]
    return counts.select(
        ratio_or_zero(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        F.lit(area).cast("double").alias("auc"),
    )


def outliers(df: DataFrame, prediction: str = "predicted_label") -> DataFrame:
    """Rows predicted anomalous."""
    return df.where(F.col(prediction) == 1)


def prediction_counts(df: DataFrame, prediction: str = "predicted_label") -> DataFrame:
    """Rows per predicted label."""
    return df.groupBy(prediction).agg(F.count(F.lit(1)).alias("n_rows"))
