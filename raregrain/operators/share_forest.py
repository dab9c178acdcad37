"""Isolation forests whose trees are grown from a share of all rows, level by level over the whole table.

No tree is grown in one task: a level is one grouped minimum and maximum per node, its splits are joined back to the rows of
the samples, and rows go to the children. Nodes are numbered as in a heap (root 1, children 2i and 2i + 1). The law is that of
the forest with a fixed number of rows: a sample without replacement of exact size, a feature chosen evenly among those that
are not constant in a node, a split evenly between their least and greatest value, a depth of at most the logarithm of the sample's size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.vectors import as_array
from raregrain.operators.anomaly import MAX_FOREST_NODES, IsolationForestModel, _based, _draw, average_path
from raregrain.operators.ranking import stratified_running_sums
from raregrain.session import attach_small, freeze

#: Features of a node that are looked at in one pass; more passes follow where all of them are constant.
TRIED = 8
#: Buckets of the draws, in which the last row of a sample is looked for.
_BUCKETS = 1 << 16


def _unit(*parts: Column | str) -> Column:
    """Even number from 0 to 1 made of its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def samples(rows: DataFrame, trees: int, size: int, seed: int) -> DataFrame:
    """``tree, o, _base, x``: exactly ``size`` rows of ``rows`` (``key, x``) per tree, ``o`` and ``_base`` being their order.

    A tree takes the rows with its smallest draws. The last of them is found in a histogram of the draws and among the rows of
    one bucket, so that one cut per tree is all that is compared with the rows.
    """
    based = freeze(_based(rows, seed))
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    drawn = based.select("_base", F.explode(numbers).alias("tree")).select("tree", "_base", _draw(F.col("tree")).alias("o"))
    drawn = drawn.withColumn("bucket", F.floor(F.col("o") * _BUCKETS).cast("int"))
    hist = drawn.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("tree").orderBy("bucket"))
    last = freeze(hist.withColumn("upto", upto).where((F.col("upto") >= size) & (F.col("upto") - F.col("n") < size)))
    need = last.select("tree", "bucket", (F.lit(size) - F.col("upto") + F.col("n")).alias("need"))
    inside = attach_small(drawn, need, ["tree", "bucket"]).withColumn("at", F.row_number().over(Window.partitionBy("tree").orderBy("o", "_base")))
    cuts = {r.tree: (r.o, r["_base"]) for r in inside.where("at = need").select("tree", "o", "_base").collect()}  # a row per tree
    bounds = F.array(*[F.struct(F.lit(cuts[t][0]).alias("o"), F.lit(cuts[t][1]).alias("b")) for t in range(trees)])
    marks = F.transform(numbers, lambda t: F.struct(t.alias("tree"), _draw(t).alias("o"), F.element_at(bounds, t + 1).alias("cut")))
    taken = F.filter(marks, lambda d: (d["o"] < d["cut"]["o"]) | ((d["o"] == d["cut"]["o"]) & (F.col("_base") <= d["cut"]["b"])))
    return based.select("x", "_base", F.explode(taken).alias("d")).select("d.tree", "d.o", "_base", "x")


def _with_copies(sample: DataFrame, trees: int, size: int, seed: int) -> DataFrame:
    """A sample drawn again with replacement: ``m``, how often each of its rows is drawn, adds up to ``size``."""
    sample = freeze(sample)
    slots = sample.sparkSession.range(size).select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "id")
    slots = slots.select("tree", (F.floor(_unit(F.lit(seed), F.lit("again"), "tree", "id") * size) + 1).alias("place")).groupBy("tree", "place").agg(F.count(F.lit(1)).alias("m"))
    placed = stratified_running_sums(sample.withColumn("one", F.lit(1).cast("bigint")), ["tree"], [F.col("o"), F.col("_base")], {"place": "one"})
    return placed.join(slots, ["tree", "place"]).select("tree", "x", "m")


def _candidates(node: Column, begin: Column, tried: int, width: int, kept: int, seed: int) -> Column:
    """The next ``tried`` of a tree's ``kept`` features in the order in which ``node`` tries them."""
    tree = F.col("tree")

    def ordered(features: Column, *of: Column) -> Column:
        hashed = F.transform(features, lambda f: F.struct(F.xxhash64(F.lit(seed), *of, f).alias("h"), f.alias("f")))
        return F.transform(F.array_sort(hashed), lambda d: d["f"])

    own = F.slice(ordered(F.sequence(F.lit(0), F.lit(width - 1)), F.lit("tree"), tree), 1, kept)
    return F.slice(ordered(own, tree, node), begin + 1, tried)


def _leaf_depth(level: Column, count: Column) -> Column:
    n = count.cast("double")
    path = F.when(n > 2, 2 * (F.log(n - 1) + float(np.euler_gamma)) - 2 * (n - 1) / n).when(n == 2, 1.0).otherwise(0.0)
    return level.cast("double") + path


def grow(sample: DataFrame, trees: int, size: int, width: int, kept: int, seed: int, tried: int = TRIED) -> DataFrame:
    """``tree, node, feature, split, depth`` of all nodes of the trees of ``sample`` (``tree, m, x``).

    A leaf has feature -1 and the depth that its rows count for. Every pass stores the rows that are still open.
    """
    limit, tried = math.ceil(math.log2(max(size, 2))), min(tried, kept)

    def next_of(node: Column, begin: Column) -> Column:
        return _candidates(node, begin, tried, width, kept, seed)

    node, level = F.col("node"), F.length(F.bin("node")) - 1
    roots = sample.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree"), F.lit(1).cast("bigint").alias("node"))
    roots = freeze(roots.select("tree", "node", F.lit(0).alias("offset"), next_of(node, F.lit(0)).alias("tries")))
    state = freeze(attach_small(sample, roots, ["tree"]))
    done = None
    while not state.isEmpty():
        values = [F.element_at("x", F.get("tries", F.lit(k)) + 1) for k in range(tried)]
        bounds = [f(v).alias(f"{name}{k}") for k, v in enumerate(values) for name, f in (("low", F.min), ("high", F.max))]
        whole = F.xxhash64("x")
        grouped = state.groupBy("tree", "node", "offset").agg(
            F.sum("m").alias("n"), (F.min(whole) == F.max(whole)).alias("same"), F.first("tries").alias("tries"), *bounds
        )
        found = [F.struct(F.get("tries", F.lit(k)).alias("f"), F.col(f"low{k}").alias("low"), F.col(f"high{k}").alias("high")) for k in range(tried)]
        pick = F.coalesce(*[F.when(F.col(f"high{k}") > F.col(f"low{k}"), found[k]) for k in range(tried)])
        ends = (F.col("n") <= 1) | F.col("same") | (level >= limit)
        judged = grouped.withColumn("pick", F.when(~ends, pick))
        # where all features so far are constant, the node's rows wait for its next features
        judged = judged.withColumn("further", ~ends & F.col("pick").isNull() & (F.col("offset") + tried < kept))
        at = F.col("pick.low") + (F.col("pick.high") - F.col("pick.low")) * _unit(F.lit(seed), F.lit("split"), "tree", "node")
        judged = freeze(judged.select("tree", "node", "offset", "n", "further", F.col("pick.f").alias("f"), at.alias("at")))
        settled = judged.where("not further").select(
            "tree", "node", F.coalesce("f", F.lit(-1)).alias("feature"), F.coalesce("at", F.lit(0.0)).alias("split"),
            F.when(F.col("f").isNull(), _leaf_depth(level, F.col("n"))).otherwise(0.0).alias("depth"),
        )
        done = settled if done is None else done.unionByName(settled)
        after = F.col("offset") + tried
        same = F.struct(node.alias("node"), after.alias("offset"), next_of(node, after).alias("tries"))
        left, right = (F.struct((node * 2 + k).alias("node"), F.lit(0).alias("offset"), next_of(node * 2 + k, F.lit(0)).alias("tries")) for k in (0, 1))
        steps = judged.where("further or f IS NOT NULL").select(
            "tree", "node", "f", "at", F.when(F.col("further"), same).otherwise(left).alias("left"), F.when(F.col("further"), same).otherwise(right).alias("right")
        )
        moved = attach_small(state.select("tree", "node", "m", "x"), freeze(steps), ["tree", "node"])
        goes = F.when(F.coalesce(F.element_at("x", F.col("f") + 1) > F.col("at"), F.lit(False)), F.col("right")).otherwise(F.col("left"))
        state = freeze(moved.select("tree", "m", "x", goes.alias("to")).select("tree", "m", "x", "to.node", "to.offset", "to.tries"))
    return freeze(done)


@dataclass
class ShareForestModel:
    """A forest of heap-numbered ``nodes``; ``threshold`` separates anomalies from the rest."""

    nodes: DataFrame
    trees: int
    sample_size: int
    features: str
    threshold: float | None = None

    def _small(self) -> IsolationForestModel:
        """The same forest with the nodes of a tree numbered from 0, children side by side, to be shipped to tasks."""
        place = F.row_number().over(Window.partitionBy("tree").orderBy("node")) - 1
        numbered = freeze(self.nodes.withColumn("at", place))
        left = numbered.where("node % 2 = 0").select("tree", F.floor(F.col("node") / 2).cast("bigint").alias("node"), F.col("at").alias("child"))
        rows = numbered.join(left, ["tree", "node"], "left").select("tree", F.col("at").alias("node"), "feature", "split", F.coalesce("child", F.lit(-1)).alias("child"), "depth")
        return IsolationForestModel(rows, self.trees, self.sample_size, self.features)

    def score(self, df: DataFrame, out: str = "outlier_score", max_nodes: int = MAX_FOREST_NODES) -> DataFrame:
        """Add the anomaly score ``2^(-mean depth / c(sample size))``, between 0 and 1.

        A forest of up to ``max_nodes`` nodes is shipped to the tasks. A larger one is joined to the rows level by level.
        """
        if self.nodes.count() <= max_nodes:
            return self._small().score(df, out)
        scale = float(average_path(self.sample_size)) or 1.0
        rows = freeze(df.withColumn("_row", F.monotonically_increasing_id()))
        numbers = F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1)))
        state = rows.select("_row", as_array(rows, self.features).alias("x"), numbers.alias("tree"), F.lit(1).cast("bigint").alias("node"))
        done = None
        while True:
            met = freeze(state.join(self.nodes, ["tree", "node"]))
            ended = met.where("feature < 0").groupBy("_row").agg(F.sum("depth").alias("depth"))
            done = ended if done is None else done.unionByName(ended)
            met = met.where("feature >= 0")
            if met.isEmpty():
                break
            right = (F.element_at("x", F.col("feature") + 1) > F.col("split")).cast("bigint")
            state = met.select("_row", "x", "tree", (F.col("node") * 2 + right).alias("node"))
        total = done.groupBy("_row").agg(F.sum("depth").alias("_depth"))
        return rows.join(total, "_row").withColumn(out, F.pow(F.lit(2.0), -F.col("_depth") / self.trees / scale)).select(*df.columns, out)

    def transform(self, df: DataFrame, score: str = "outlier_score", label: str = "predicted_label") -> DataFrame:
        """Add score and 0/1 label."""
        return self.score(df, score).withColumn(label, (F.col(score) >= F.lit(self.threshold)).cast("int"))


def fit_share_forest(
    df: DataFrame, features: str = "vectors", key: str = "id", trees: int = 100, max_samples: float = 0.5, max_features: float = 1.0,
    bootstrap: bool = False, contamination: float = 0.1, contamination_error: float = 0.01, seed: int = 42,
) -> ShareForestModel:
    """Grow a forest from ``max_samples`` (0 to 1) of all rows per tree and set its threshold at the ``1 - contamination`` quantile.

    A sample has ``floor(max_samples * rows)`` rows, one at least; with ``bootstrap`` it is drawn from again as often. Rows times
    trees times share are stored once per level, and a forest has up to twice as many nodes as samples have rows.
    """
    if not 0 < max_samples <= 1:
        raise ValueError("max_samples is a share of the rows")
    rows = freeze(df.select(F.col(key).alias("key"), as_array(df, features).alias("x")))
    total = rows.count()
    if not total:
        raise ValueError("no rows to grow trees from")
    size, width = max(1, math.floor(max_samples * total)), len(rows.first().x)
    sample = samples(rows, trees, size, seed)
    sample = _with_copies(sample, trees, size, seed) if bootstrap else sample.select("tree", "x", F.lit(1).cast("bigint").alias("m"))
    nodes = grow(sample, trees, size, width, max(1, round(max_features * width)), seed)
    model = ShareForestModel(nodes, trees, size, features)
    accuracy = min(1_000_000, max(100, math.ceil(1 / (contamination_error * contamination))))
    cut = F.percentile_approx("outlier_score", F.lit(1 - contamination), F.lit(accuracy))
    model.threshold = model.score(df.select(key, features)).agg(cut).first()[0]
    return model
