"""Isolation forest (Liu, Ting and Zhou, 2008) and calibration of its scores.

Rows are drawn for all trees in one narrow pass, each tree's bounded sample is
grown in its own task, and the forest (trees x twice the sample size in nodes) is
shipped to the scoring tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.vectors import as_array, class1_probability
from raregrain.operators.sampling import kfold
from raregrain.session import freeze

#: Largest sample grown in one task; the published method uses 256.
MAX_TREE_ROWS = 100_000
#: Largest forest shipped to the scoring tasks, in nodes of 36 bytes.
MAX_FOREST_NODES = 5_000_000
#: Copies of a row that one task numbers.
_COPIES = 10_000
#: Extra rows drawn so that a tree seldom falls short of its sample size.
_MARGIN = 1.2
_NODES = "tree int, node int, feature int, split double, child int, depth double"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 2.0)
    harmonic = np.log(np.maximum(big - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, rng: np.random.Generator, features: np.ndarray) -> list[tuple]:
    """Nodes ``(node, feature, split, child, depth)`` of one random tree.

    ``child`` is the left child, the right one follows it; a leaf has feature -1
    and its depth includes the expected depth of the rows it still holds.
    """
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[tuple | None] = [None]
    todo = [(0, np.arange(len(points)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        held = points[np.ix_(rows, features)]
        low, high = (held.min(0), held.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        usable = np.flatnonzero(high > low)
        if len(rows) <= 1 or depth >= limit or not usable.size:
            nodes[node] = (node, -1, 0.0, -1, depth + float(average_path(len(rows))))
            continue
        at = rng.choice(usable)
        split = rng.uniform(low[at], high[at])
        left = held[:, at] <= split
        child = len(nodes)
        nodes += [None, None]
        nodes[node] = (node, int(features[at]), float(split), child, 0.0)
        todo += [(child, rows[left], depth + 1), (child + 1, rows[~left], depth + 1)]
    return nodes


def _tree_samples(rows: DataFrame, trees: int, size: int, total: int, seed: int) -> DataFrame:
    """``tree, x``: exactly ``size`` rows per tree without replacement, trees independent of each other.

    Every row has a draw per tree, a hash of key, content and tree (and of the number of the copy, where rows
    repeat both, so that copies enter a tree independently of each other), and a tree takes the
    rows with the smallest draws. Only draws below a bound that a full sample
    nearly always stays under are kept; should a tree fall short, the bound is doubled, which
    changes no sample.
    """
    rate = min(1.0, (size + 6 * math.sqrt(size) + 10) / total)
    based = _based(rows, seed)
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    while True:
        draws = F.filter(F.transform(numbers, lambda t: F.struct(t.alias("tree"), _draw(t).alias("o"))), lambda d: d["o"] < F.lit(rate))
        tried = based.select("x", F.explode(draws).alias("d")).select("d.tree", "d.o", "x")
        first = Window.partitionBy("tree").orderBy("o", F.xxhash64("x"))
        samples = freeze(tried.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= size).drop("_n"))
        if rate >= 1 or samples.count() == trees * size:
            return samples
        rate = min(1.0, 2 * rate)


def _based(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``_base``, a hash of its own for every row.

    Where rows repeat, they are counted and numbered from their count, in pieces of ``_COPIES`` that are dealt
    out, so that no task writes all copies of a row; the first copy has the hash that it has alone.
    """
    based = rows.withColumn("_base", F.xxhash64("key", "x", F.lit(seed + 1)))
    if based.groupBy("_base").count().where("count > 1").isEmpty():
        return based
    counted = based.groupBy("key", "x", "_base").agg(F.count(F.lit(1)).alias("_of"))
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_of") - 1) / _COPIES))))
    begin = F.col("_piece") * _COPIES
    numbers = F.sequence(begin, F.least(F.col("_of"), begin + _COPIES) - 1)
    copies = pieces.repartition("_base", "_piece").select("key", "x", "_base", F.explode(numbers).alias("_copy"))
    own = F.when(F.col("_copy") == 0, F.col("_base")).otherwise(F.xxhash64("_base", "_copy"))
    return freeze(copies.select("key", "x", own.alias("_base")))


def _draw(tree: Column) -> Column:
    """Number from 0 to 1 of a row for a tree."""
    return F.shiftrightunsigned(F.xxhash64(F.col("_base"), tree), 11) / F.lit(float(1 << 53))


@dataclass
class IsolationForestModel:
    """A grown forest; ``threshold`` separates anomalies from the rest."""

    nodes: DataFrame
    trees: int
    sample_size: int
    features: str
    threshold: float | None = None

    def score(self, df: DataFrame, out: str = "outlier_score") -> DataFrame:
        """Add the anomaly score ``2^(-mean depth / c(sample size))``, between 0 and 1."""
        table = self.nodes.toPandas().sort_values(["tree", "node"])
        offsets = np.concatenate([[0], np.cumsum(table.groupby("tree").size().to_numpy())])
        forest = df.sparkSession.sparkContext.broadcast(
            (table.feature.to_numpy(), table.split.to_numpy(), table.child.to_numpy(), table.depth.to_numpy(), offsets)
        )
        scale = float(average_path(self.sample_size)) or 1.0

        def run(vectors: pd.Series) -> pd.Series:
            feature, split, child, depth, starts = forest.value
            points = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 1))
            every = np.arange(len(points))
            total = np.zeros(len(points))
            for start in starts[:-1]:
                at = np.zeros(len(points), dtype=np.int64)
                open_rows = every
                while open_rows.size:
                    here = start + at[open_rows]
                    inner = feature[here] >= 0
                    open_rows, here = open_rows[inner], here[inner]
                    right = points[open_rows, feature[here]] > split[here]
                    at[open_rows] = child[here] + right
                total += depth[start + at]
            return pd.Series(np.exp2(-total / (len(starts) - 1) / scale))

        return df.withColumn(out, F.pandas_udf(run, "double")(as_array(df, self.features)))

    def transform(self, df: DataFrame, score: str = "outlier_score", label: str = "predicted_label") -> DataFrame:
        """Add score and 0/1 label."""
        return self.score(df, score).withColumn(label, (F.col(score) >= F.lit(self.threshold)).cast("int"))


def fit_isolation_forest(
    df: DataFrame,
    features: str = "vectors",
    key: str = "id",
    trees: int = 100,
    max_samples: int = 256,
    max_features: float = 1.0,
    bootstrap: bool = False,
    contamination: float = 0.1,
    contamination_error: float = 0.01,
    seed: int = 42,
) -> IsolationForestModel:
    """Grow a forest and set its threshold at the ``1 - contamination`` quantile of the scores.

    ``max_samples`` is the number of rows per tree, whatever the size of the table (all rows,
    if it has fewer). A sample is grown in one task and the forest is broadcast, so settings beyond
    :data:`MAX_TREE_ROWS` rows or :data:`MAX_FOREST_NODES` nodes are refused. The
    quantile is taken with rank error ``contamination_error * contamination``.
    """
    if not isinstance(max_samples, int) or max_samples < 1:
        raise ValueError("max_samples is a number of rows")
    if max_samples > MAX_TREE_ROWS or 2 * max_samples * trees > MAX_FOREST_NODES:
        raise ValueError(f"max_samples is at most {min(MAX_TREE_ROWS, MAX_FOREST_NODES // (2 * trees))} with {trees} trees")
    total = df.count()
    if not total:
        raise ValueError("no rows to grow trees from")
    size = min(max_samples, total)
    rows = df.select(F.col(key).alias("key"), as_array(df, features).alias("x"))
    samples = _tree_samples(rows, trees, size, total, seed)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group.tree.iloc[0])
        rng = np.random.default_rng([seed, tree])
        group = group.sort_values("o", kind="stable")
        points = np.stack(group.x.to_numpy())
        if bootstrap:
            points = points[rng.integers(0, len(points), len(points))]
        width = points.shape[1]
        chosen = rng.choice(width, max(1, round(max_features * width)), replace=False)
        nodes = pd.DataFrame(grow_tree(points, rng, chosen), columns=["node", "feature", "split", "child", "depth"])
        return nodes.assign(tree=tree)[["tree", "node", "feature", "split", "child", "depth"]]

    # an explicit number keeps the planner from merging the small samples into one task
    tasks = min(trees, 2 * df.sparkSession.sparkContext.defaultParallelism)
    samples = samples.repartition(tasks, "tree")
    model = IsolationForestModel(freeze(samples.groupBy("tree").applyInPandas(grow, _NODES)), trees, size, features)
    accuracy = min(1_000_000, max(100, math.ceil(1 / (contamination_error * contamination))))
    cut = F.percentile_approx("outlier_score", F.lit(1 - contamination), F.lit(accuracy))
    model.threshold = model.score(df.select(key, features)).agg(cut).first()[0]
    return model


def calibrate(df: DataFrame, score: str, label: str = "y", method: str = "isotonic", higher_is_anomalous: bool = True, weight: str | None = None):
    """Fit a map from score to ``P(label = 1)``; returns a function from table to table with ``p0, p1``.

    Both fits take one weighted point per distinct score (a sigmoid: and label), which gives the same fit from less data;
    rows that were grouped already come with their number in ``weight``.
    """
    sign = 1.0 if higher_is_anomalous else -1.0
    rows = F.lit(1.0) if weight is None else F.col(weight).cast("double")

    def prepared(table: DataFrame) -> DataFrame:
        signed = table.withColumn("_s", F.col(score) * F.lit(sign))
        return VectorAssembler(inputCols=["_s"], outputCol="_v").transform(signed)

    if method == "isotonic":
        target = F.col(label).cast("double")
        mean = F.try_divide(F.sum(target * rows), F.sum(F.when(target.isNotNull(), rows)))
        points = df.groupBy(score).agg(mean.alias("_y"), F.sum(rows).alias("_w"))
        fit = IsotonicRegression(featuresCol="_v", labelCol="_y", weightCol="_w", predictionCol="_p")
        model = fit.fit(prepared(points))
    elif method == "platt":
        points = df.groupBy(score, label).agg(F.sum(rows).alias("_w"))
        fit = LogisticRegression(featuresCol="_v", labelCol=label, weightCol="_w", probabilityCol="_q", predictionCol="_c", rawPredictionCol="_r")
        model = fit.fit(prepared(points))
        if model.numClasses == 2:
            return _sigmoid(score, sign, float(model.coefficients[0]), float(model.intercept))
    else:
        raise ValueError("method is 'isotonic' or 'platt'")

    def apply(table: DataFrame) -> DataFrame:
        scored = model.transform(prepared(table))
        p1: Column = F.col("_p") if method == "isotonic" else class1_probability(scored, "_q")
        return scored.select(*table.columns, (1 - p1).alias("p0"), p1.alias("p1"))

    return apply


def _sigmoid(score: str, sign: float, slope: float, intercept: float):
    """The map of a fitted sigmoid as an expression: a model of one number needs no vectors."""

    def apply(table: DataFrame) -> DataFrame:
        signed = F.col(score).cast("double") * F.lit(sign)
        p1 = 1 - 1 / (1 + F.exp(signed * F.lit(slope) + F.lit(intercept)))
        missing = F.raise_error(F.lit(f"no probability for a null or NaN in {score}")).cast("double")
        p1 = F.when(signed.isNull() | F.isnan(signed), missing).otherwise(p1)
        return table.select(*table.columns, (1 - p1).alias("p0"), p1.alias("p1"))

    return apply


@dataclass
class CalibrationEnsemble:
    """Maps from score to ``P(label = 1)``, one per fold; a row gets the mean of their probabilities."""

    maps: list

    def __call__(self, table: DataFrame) -> DataFrame:
        """Add ``p0, p1``."""
        columns, names = table.columns, [f"_p{i}" for i in range(len(self.maps))]
        for name, apply in zip(names, self.maps):
            table = apply(table).drop("p0").withColumnRenamed("p1", name)
        mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
        return table.select(*columns, (1 - mean).alias("p0"), mean.alias("p1"))

    def fits(self, df: DataFrame, label: str = "y", fold: str = "fold") -> DataFrame:
        """``fold, n_rows, n_positive, sum_p1`` of every map on the rows it was fitted on; a sigmoid's sum equals its positives."""
        out = None
        for i, apply in enumerate(self.maps):
            rows = apply(df.where(F.col(fold) == i))
            sums = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(label).cast("bigint")).alias("n_positive"), F.sum("p1").alias("sum_p1"))
            sums = sums.select(F.lit(i).alias("fold"), "*")
            out = sums if out is None else out.unionByName(sums)
        return out


def calibrate_folds(
    df: DataFrame, score: str, label: str = "y", method: str = "platt", folds: int = 5, key: str = "id", seed: int = 42,
    higher_is_anomalous: bool = True, fold: str = "fold",
) -> tuple[CalibrationEnsemble, DataFrame]:
    """Calibrate a given score ``folds`` times, on one stratified fold each, and average; also returns ``df`` with its ``fold``.

    The score comes from a model that is not fitted again, so each fold's rows are new to every other map. A fold
    needs rows of both classes, else it is an error.
    """
    marked = freeze(kfold(df, label, folds, key, seed, fold))
    # the rows are read once for all fits
    points = freeze(marked.groupBy(fold, score, label).agg(F.count(F.lit(1)).alias("_n")))
    classes = points.groupBy(fold).agg(F.countDistinct(F.when(F.col(label).isin(0, 1), F.col(label))).alias("n"))
    if classes.where("n = 2").count() < folds:
        raise ValueError(f"every one of {folds} folds needs rows of both classes")
    maps = [calibrate(points.where(F.col(fold) == i), score, label, method, higher_is_anomalous, "_n") for i in range(folds)]
    return CalibrationEnsemble(maps), marked
