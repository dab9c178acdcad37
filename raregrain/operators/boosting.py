"""Gradient boosting that continues a stored ensemble, with metrics after every round.

A round is one Spark ML regression tree on pseudo-residuals, which are a column of the table: for a label y of
-1 or 1 and a margin F, the sum of the trees so far, ``4 y / (1 + exp(2 y F))``. A fit therefore starts from any
ensemble by starting from its margins, and from none it makes the trees of Spark's own boosted classifier. The ensemble is a
small table of tree nodes (rounds times nodes of a tree); all partial sums of a row come from one pass over it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.functions.vectors import as_array
from raregrain.operators.evaluate import CURVE_SUMS, curve_area
from raregrain.operators.few_rows import SETTINGS, FewRows, boost_few, few_metrics
from raregrain.operators.ranking import FEW_ROWS, stratified_running_sums
from raregrain.session import checkpoint_root, freeze

#: Largest ensemble that scoring tasks get, in nodes of 40 bytes.
MAX_NODES = 5_000_000
#: Rows times trees whose margins a scoring task holds at once, and rows, whose columns should stay in the cache.
_CELLS = 1 << 20
_ROWS = 8192
#: A tree of no more nodes is read node by node from the fitted model, a larger one from files.
_FEW_NODES = 255
#: Columns of a stored ensemble.
NODES_SCHEMA = "round int, weight double, node int, feature int, threshold double, lower int, upper int, value double"


def _stepper() -> Callable[[tuple[np.ndarray, ...], np.ndarray], np.ndarray | float]:
    """A function of a tree and of rows that are given as columns: what the tree adds to their margins. It travels with what calls it."""

    def steps(tree: tuple[np.ndarray, ...], columns: np.ndarray) -> np.ndarray | float:
        feature, threshold, lower, upper, step = tree
        if len(feature) > 63:  # down from the root, a level at a time
            at, every = np.zeros(columns.shape[1], np.int64), np.arange(columns.shape[1])
            while (inner := feature[at] >= 0).any():
                down = columns[np.maximum(feature[at], 0), every] <= threshold[at]
                at = np.where(inner, np.where(down, lower[at], upper[at]), at)
            return step[at]

        def value(node: int) -> np.ndarray | float:  # all nodes of a small tree: no gathering
            f = feature[node]
            return step[node] if f < 0 else np.where(columns[f] <= threshold[node], value(lower[node]), value(upper[node]))

        return value(0)

    return steps


@dataclass(frozen=True)
class BoostedTrees:
    """Trees of a boosted ensemble in the order of their rounds, from 1; ``nodes`` is sorted by round and node."""

    nodes: pd.DataFrame
    features: str = "vectors"

    @property
    def rounds(self) -> int:
        return int(self.nodes["round"].max()) if len(self.nodes) else 0

    def save(self, spark: SparkSession, path: str) -> None:
        """Overwrite the ensemble stored at ``path``."""
        table = pa.table({c: self.nodes[c].to_numpy() for c in _TYPES})
        spark.createDataFrame(table, NODES_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, features: str = "vectors") -> BoostedTrees:
        return BoostedTrees.of(spark.read.schema(NODES_SCHEMA).parquet(path).orderBy("round", "node").toPandas(), features)

    @staticmethod
    def of(nodes: pd.DataFrame, features: str = "vectors") -> BoostedTrees:
        """Of a table of nodes that is sorted by round and node."""
        return BoostedTrees(nodes[list(_TYPES)].astype(_TYPES).reset_index(drop=True), features)

    def _trees(self) -> list[tuple[np.ndarray, ...]]:
        """``feature, threshold, lower, upper, step`` of the nodes of every tree."""
        columns = [self.nodes[c].to_numpy() for c in ("feature", "threshold", "lower", "upper")]
        columns.append(self.nodes["weight"].to_numpy() * self.nodes["value"].to_numpy())
        cuts = np.searchsorted(self.nodes["round"].to_numpy(), np.arange(1, self.rounds + 2))
        return [tuple(c[lo:hi] for c in columns) for lo, hi in zip(cuts[:-1], cuts[1:])]

    def margins(self, df: DataFrame, first: int = 1) -> Column:
        """Array of a row's margins after each of the rounds from ``first`` on; null for null features."""
        if len(self.nodes) > MAX_NODES:
            raise ValueError(f"an ensemble has at most {MAX_NODES} nodes")
        forest = df.sparkSession.sparkContext.broadcast(self._trees())
        steps = _stepper()

        def run(vectors: pd.Series) -> pd.Series:
            trees = forest.value
            known = vectors.notna().to_numpy()
            points = np.stack(vectors[known].to_numpy()) if known.any() else np.zeros((0, 1))
            out: list[list[float] | None] = [None] * len(vectors)
            places, some = np.flatnonzero(known).tolist(), max(1, min(_ROWS, _CELLS // max(1, len(trees) - first + 1)))
            for begin in range(0, len(points), some):
                columns = np.ascontiguousarray(points[begin : begin + some].T)
                margin, kept = np.zeros(columns.shape[1]), []
                for i, tree in enumerate(trees, 1):
                    margin = margin + steps(tree, columns)
                    if i >= first:
                        kept.append(margin)
                for place, row in zip(places[begin : begin + some], np.stack(kept, axis=1).tolist() if kept else [[]] * len(margin)):
                    out[place] = row
            return pd.Series(out, dtype=object)

        known = F.col(self.features).isNotNull()
        return F.when(known, F.pandas_udf(run, "array<double>")(F.when(known, as_array(df, self.features))))

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Add ``p1``, the probability of class 1, and the 0/1 ``prediction``."""
        keep = df.columns if keep is None else keep
        if not self.rounds:
            raise ValueError("an ensemble without trees cannot score")
        scored = df.withColumn("_margin", F.element_at(self.margins(df, self.rounds), 1))
        p1 = 1 / (1 + F.exp(-2 * F.col("_margin")))
        return scored.select(*keep, p1.alias("p1"), (F.col("_margin") > 0).cast("double").alias("prediction"))


def mean_probability(df: DataFrame, models: Sequence[BoostedTrees]) -> Column:
    """Mean probability of class 1 over several ensembles, of which none needs to know another; null for null features."""
    if sum(len(m.nodes) for m in models) > MAX_NODES:
        raise ValueError(f"ensembles that score together have at most {MAX_NODES} nodes")
    forests = df.sparkSession.sparkContext.broadcast([m._trees() for m in models])
    steps = _stepper()
    features = models[0].features

    def run(vectors: pd.Series) -> pd.Series:
        known = vectors.notna().to_numpy()
        points = np.stack(vectors[known].to_numpy()) if known.any() else np.zeros((0, 1))
        out = np.full(len(points), np.nan)
        for begin in range(0, len(points), _ROWS):
            columns = np.ascontiguousarray(points[begin : begin + _ROWS].T)
            total = np.zeros(columns.shape[1])
            with np.errstate(over="ignore"):
                for trees in forests.value:
                    total += 1 / (1 + np.exp(-2 * sum((steps(tree, columns) for tree in trees), np.zeros(columns.shape[1]))))
            out[begin : begin + _ROWS] = total / len(forests.value)
        found = pd.Series([None] * len(vectors), dtype=object)
        found[known] = out
        return found.astype("float64")

    known = F.col(features).isNotNull()
    return F.when(known, F.pandas_udf(run, "double")(F.when(known, as_array(df, features))))


_TYPES = {"round": "int32", "weight": "float64", "node": "int32", "feature": "int32", "threshold": "float64", "lower": "int32", "upper": "int32", "value": "float64"}


def _walked_nodes(model: DecisionTreeRegressionModel, number: int, scale: float) -> pd.DataFrame:
    """Nodes of a small fitted tree, numbered from its root on as in its files."""
    rows: list[list] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([number, scale, at, -1, 0.0, -1, -1, node.prediction()])
        if node.getClass().getSimpleName() != "LeafNode":
            split = node.split()
            if split.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("features with nominal attributes are not supported: drop the column's ML metadata")
            rows[at][3:5] = split.featureIndex(), split.threshold()
            rows[at][5], rows[at][6] = walk(node.leftChild()), walk(node.rightChild())
        return at

    walk(model._java_obj.rootNode())
    return pd.DataFrame(rows, columns=list(_TYPES)).astype(_TYPES)


def _tree_nodes(spark: SparkSession, paths: dict[int, str], scales: dict[int, float]) -> pd.DataFrame:
    """Nodes of stored regression trees by round."""
    rows = spark.read.parquet(*[f"{p}/data" for p in paths.values()])
    at = F.regexp_extract(F.col("_metadata.file_path"), r"round-(\d+)/", 1).cast("int")
    split = F.col("split")
    rows = rows.select(
        at.alias("round"), F.col("id").alias("node"), split["featureIndex"].alias("feature"),
        F.coalesce(F.get(split["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"),
        F.col("leftChild").alias("lower"), F.col("rightChild").alias("upper"), F.col("prediction").alias("value"), split["numCategories"].alias("kinds"),
    )
    table = rows.toPandas().sort_values(["round", "node"], ignore_index=True)
    if (table["kinds"] >= 0).any():
        raise ValueError("features with nominal attributes are not supported: drop the column's ML metadata")
    table["weight"] = table["round"].map(scales)
    return table[list(_TYPES)].astype(_TYPES)


def _listed_nodes(trees: list[tuple[int, float, list[list]]]) -> pd.DataFrame:
    """Nodes of trees grown in memory."""
    rows = [[i, scale, at, *node] for i, scale, nodes in trees for at, node in enumerate(nodes)]
    return pd.DataFrame(rows, columns=list(_TYPES)).astype(_TYPES)


def boost(
    df: DataFrame | FewRows, rounds: int, start: BoostedTrees | None = None, label: str = "binds", features: str = "vectors",
    weight: str | None = None, step: float = 0.1, cut_every: int = 10, **tree: object,
) -> BoostedTrees:
    """Add ``rounds`` trees to ``start`` (or to none) on the rows of ``df`` with a label of 0 or 1 and features.

    ``step`` scales every tree but the first of the ensemble. ``tree`` holds settings of the regression tree (depth 3 and
    seed 42 unless given). Rows and margins are stored every ``cut_every`` rounds, which bounds both the lineage and what a lost executor costs.
    :class:`FewRows` have their own weights and margins, those of ``start``, and are boosted in memory.
    """
    if isinstance(df, FewRows):
        if set(tree) - set(SETTINGS):
            raise ValueError(f"settings that few rows do not follow: {sorted(set(tree) - set(SETTINGS))}")
        grown = _listed_nodes(boost_few(df, start.rounds if start is not None else 0, rounds, step, {"maxDepth": 3, **tree}))
        return BoostedTrees(grown if start is None else pd.concat([start.nodes, grown], ignore_index=True), features)
    spark = df.sparkSession
    done = start.rounds if start is not None else 0
    y = F.when(F.col(label) == 1, 1.0).when(F.col(label) == 0, -1.0)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    margin = F.element_at(start.margins(df, done), 1) if done else F.lit(0.0)
    rows = df.select(F.col(features).alias("_x"), y.alias("_y"), w.alias("_w"), margin.alias("_margin"))
    rows = freeze(rows.where("_x IS NOT NULL AND _y IS NOT NULL AND _w > 0"))
    if rows.isEmpty():
        raise ValueError("no labelled rows to boost on")
    root = f"{checkpoint_root(spark)}/trees-{uuid.uuid4().hex}"
    learner = DecisionTreeRegressor(featuresCol="_x", labelCol="_target", weightCol="_w", predictionCol="_step", **{"maxDepth": 3, "seed": 42, **tree})
    residual = 4 * F.col("_y") / (1 + F.exp(2 * F.col("_y") * F.col("_margin")))
    paths, scales, walked = {}, {}, {}
    for i in range(done + 1, done + rounds + 1):
        model = learner.fit(rows.withColumn("_target", residual if i > 1 else F.col("_y")))
        scales[i] = step if i > 1 else 1.0
        if model.numNodes <= _FEW_NODES:
            walked[i] = _walked_nodes(model, i, scales[i])
        else:
            paths[i] = f"{root}/round-{i}"
            model.write().save(paths[i])
        rows = model.transform(rows).withColumn("_margin", F.col("_margin") + F.lit(scales[i]) * F.col("_step")).drop("_step")
        if (i - done) % cut_every == 0 and i < done + rounds:
            rows = freeze(rows)
    grown = [*walked.values(), *([_tree_nodes(spark, paths, scales)] if paths else [])]
    nodes = pd.concat(grown, ignore_index=True).sort_values(["round", "node"], ignore_index=True)
    return BoostedTrees(pd.concat([start.nodes, nodes], ignore_index=True) if done else nodes, features)


def round_metrics(
    df: DataFrame | FewRows, model: BoostedTrees, first: int = 1, label: str = "binds", weight: str | None = None, n_rows: int | None = None
) -> DataFrame | pa.Table:
    """``round, logloss, aucpr`` on ``df`` after every round from ``first`` on, from one pass over its rows.

    A row gives all its margins at once; rows are summed by round and margin before the only shuffle of them.
    ``aucpr`` is average precision with ties grouped, null where a class is missing. ``n_rows`` is a bound on the rows where one is known.
    :class:`FewRows` give the rounds that were fitted last on them, as a table in memory.
    """
    if isinstance(df, FewRows):
        held = df.margins.shape[1]
        if first <= model.rounds - held:
            raise ValueError(f"these rows have margins of the last {held} rounds")
        numbers = list(range(first, model.rounds + 1))
        found = [few_metrics(df, i - model.rounds + held - 1) for i in numbers]
        columns = {"round": pa.array(numbers, pa.int32()), **{n: pa.array(list(c), pa.float64()) for n, c in zip(("logloss", "aucpr"), zip(*found))}}
        return pa.table(columns)
    most = None if n_rows is None else n_rows * (model.rounds - first + 1)
    few = most is not None and most <= FEW_ROWS
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    staged = (df.coalesce(1) if few else df).select(F.col(label).alias("_y"), w.alias("_w"), model.margins(df, first).alias("_m")).where(F.col("_y").isin(0, 1) & F.col("_m").isNotNull())
    rows = staged.select("_y", "_w", F.posexplode("_m").alias("at", "score")).withColumn("round", F.col("at") + first)
    positive, negative = (F.sum(F.when(F.col("_y") == k, F.col("_w")).otherwise(0.0)) for k in (1, 0))
    steps = rows.groupBy("round", "score").agg(positive.alias("pos"), negative.alias("neg"))
    steps = steps if few else freeze(steps)
    loss = F.col("pos") * F.log1p(F.exp(-2 * F.col("score"))) + F.col("neg") * F.log1p(F.exp(2 * F.col("score")))
    sums = stratified_running_sums(steps, ["round"], [F.col("score").desc()], CURVE_SUMS, most)
    return sums.groupBy("round").agg((F.sum(loss) / F.sum(F.col("pos") + F.col("neg"))).alias("logloss"), curve_area().alias("aucpr"))
