"""Ordering, sampling, splitting and batching, reproducible by key and seed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.hashing import HASH_SPACE, hash_bucket, hash_fraction_below, hash_key
from raregrain.operators.ranking import FEW_ROWS, hash_parts, stratified_running_sums, with_position
from raregrain.session import attach_small, fits_broadcast, freeze

#: Up to here a top-k over sorted runs is cheaper than finding a cut point.
TOP_K_ROWS = 10_000


def order_by_id(df: DataFrame, key: str = "id") -> DataFrame:
    """Ascending by key."""
    return df.orderBy(key)


def shuffle_rows(df: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """Random but reproducible global order: by hash key, ties by key."""
    return df.orderBy(hash_key(key, seed), key)


def first_rows(df: DataFrame, n: int = 20) -> DataFrame:
    """Any ``n`` rows."""
    return df.limit(n)


def spread(df: DataFrame, partitions: int | None = None, *cols: str) -> DataFrame:
    """Redistribute rows; without a number the adaptive planner sizes the partitions."""
    if partitions is None:
        return df.repartition(*cols) if cols else df.hint("rebalance")
    return df.repartition(partitions, *cols)


def sample_rows(df: DataFrame, fraction: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """Bernoulli sample without replacement; with a key the same keys are drawn on any layout."""
    if key is None:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    return df.where(hash_fraction_below(key, seed, fraction))


def sample_n(df: DataFrame, n: int, key: str = "id", seed: int = 42, top_k_rows: int = TOP_K_ROWS) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), those smallest in the order of hash, key and content.

    A small sample is a top-k. A large one would funnel all its rows through one
    task, so it is cut off at the exact n-th key instead, and of the copies of that
    key only as many are kept as are wanting. Both forms give the same rows.
    """
    if n <= top_k_rows:
        return df.orderBy(hash_key(key, seed), key, F.xxhash64(*[F.col(c) for c in df.columns])).limit(n)
    kept = hash_parts(df, key, seed, lambda total: [F.least(total, F.lit(n))], out="_part").where("_part = 0").drop("_part")
    total, last = kept.agg(F.count(F.lit(1)), F.max(F.struct(hash_key(key, seed).alias("h"), F.col(key).alias("k")))).first()
    if total <= n:
        return kept
    is_last = F.col(key).eqNullSafe(F.lit(last["k"]).cast(df.schema[key].dataType))
    before = kept.where(~is_last)
    copies = with_position(kept.where(is_last), key, seed, out="_pos").where(F.col("_pos") <= n - before.count())
    return before.unionByName(copies.drop("_pos"))


def sample_by_class(
    df: DataFrame, label: str, fractions: Mapping[object, float], seed: int = 42, key: str | None = None
) -> DataFrame:
    """Keep the given fraction of every class; classes not named are dropped."""
    if key is None:
        return df.sampleBy(label, fractions=dict(fractions), seed=seed)
    fraction: Column = F.lit(0.0)
    for value, share in fractions.items():
        fraction = F.when(F.col(label) == F.lit(value), F.lit(float(share))).otherwise(fraction)
    return df.where(hash_fraction_below(key, seed, fraction))


def with_split(
    df: DataFrame, weights: Sequence[float], key: str = "id", seed: int = 42, out: str = "split"
) -> DataFrame:
    """Number of the weighted split each row falls in, 0-based, in one narrow pass."""
    total = float(sum(weights))
    hashed = hash_key(key, seed)
    bounds, reached = [], 0.0
    for weight in weights[:-1]:
        reached += weight
        bounds.append(int(reached / total * HASH_SPACE))
    number = sum(((hashed >= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    return df.withColumn(out, number)


def split_two(df: DataFrame, first: float = 0.8, key: str = "id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Disjoint, covering split by weight."""
    marked = with_split(df, [first, 1.0 - first], key, seed, "_split")
    return marked.where("_split = 0").drop("_split"), marked.where("_split = 1").drop("_split")


def split_n(df: DataFrame, n: int = 8, key: str = "id", seed: int = 42, out: str = "split") -> DataFrame:
    """Mark ``n`` equal splits, 1-based; writing with ``partitionBy(out)`` stores all in one pass."""
    return df.withColumn(out, (hash_bucket(key, seed, n) + 1).cast("int"))


def stratified_split(
    df: DataFrame, label: str, ratio: float = 0.8, key: str = "id", seed: int = 42, out: str = "is_train"
) -> DataFrame:
    """Mark exactly ``ceil(ratio * n)`` rows of every class as train (1), the rest as test (0)."""
    marked = hash_parts(
        df, key, seed, lambda total: [F.ceil(F.lit(float(ratio)) * total)], strata=[label], out="_part"
    )
    return marked.withColumn(out, 1 - F.col("_part")).drop("_part")


def kfold(df: DataFrame, label: str, k: int = 5, key: str = "id", seed: int = 42, out: str = "fold") -> DataFrame:
    """Stratified fold number, 0-based: ``k`` runs of hash order per class, equal up to one row."""
    return hash_parts(
        df, key, seed, lambda total: [F.floor(total * j / k) for j in range(1, k)], strata=[label], out=out
    )


def balanced_batches(
    df: DataFrame, label: str = "y", size: int = 32, key: str = "id", seed: int = 42, out: str = "batch_no"
) -> DataFrame:
    """Batches of half class 1 and half class 0 (an odd row goes to class 0).

    Class 0 is used once, in hash order; class 1 is recycled until every batch is
    full. Batches are numbered from 0.
    """
    half1, half0 = size // 2, size - size // 2
    n0, n1 = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    if not n0 or (half1 and not n1):
        raise ValueError("balanced batches need rows of both classes")
    placed = with_position(df.where(F.col(label).isin(0, 1)), key, seed, [label], "_pos")
    batches = -(-n0 // half0)
    rank = F.col("_pos") - 1
    zeros = placed.where(F.col(label) == 0).withColumn(out, F.floor(rank / half0).cast("bigint")).drop("_pos")
    ones = placed.where(F.col(label) == 1)
    slots = df.sparkSession.range(batches * half1).select(
        F.floor(F.col("id") / half1).cast("bigint").alias(out), (F.col("id") % n1 + 1).alias("_pos")
    )
    # Few positives means many slots per positive: then the positives are mostly small
    # enough to broadcast. Many positives means few slots per join key.
    ones = F.broadcast(ones) if n1 <= 10_000 and fits_broadcast(df.where(F.col(label) == 1)) else ones
    return zeros.unionByName(slots.join(ones, "_pos").drop("_pos"))


def with_minibatch(df: DataFrame, size: int = 1024, key: str = "id", seed: int = 42, out: str = "batch_id") -> DataFrame:
    """Number mini-batches of ``size`` rows in hash order from 0; the last may be short, no row is lost."""
    placed = with_position(df, key, seed, out="_pos")
    return placed.withColumn(out, F.floor((F.col("_pos") - 1) / size).cast("bigint")).drop("_pos")


def minibatch_stats(df: DataFrame, label: str = "y", size: int = 1024, key: str = "id", seed: int = 42) -> DataFrame:
    """Rows and positives of every mini-batch."""
    return with_minibatch(df.select(key, label), size, key, seed).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(label).cast("bigint")).alias("n_positive")
    )


#: Weights are counted in units of this part of one copy.
WEIGHT_UNITS = 1 << 20


def resample_weighted(
    df: DataFrame, weight: str, strata: Sequence[str] = (), key: str = "id", seed: int = 42, out: str = "copy", rows: int | None = None
) -> DataFrame:
    """Every row as often as its weight says on average, numbered in ``out`` from 1; rows whose turn does not come go.

    For learners without a weight column. A stratum has exactly as many copies as its weights sum to (rounded), and rows of
    weight w have ``floor(w)`` or ``ceil(w)`` copies, but for the rounding of the sum: copies are the steps of the running weight
    in the order of hash, key and content, in integers, so that any layout gives the same rows. Weights are
    counted in units of 2**-20; null, negative and not-a-number weights count as 0. Spread over two shuffles of the rows;
    a table known to have few ``rows`` takes one task.
    """
    few = rows is not None and rows <= FEW_ROWS
    strata = list(strata)
    w = F.col(weight).cast("double")
    units = F.when(~F.isnan(w) & (w > 0), F.round(w * WEIGHT_UNITS)).otherwise(0).cast("bigint")
    names = strata or ["_all"]
    content = F.xxhash64(*[F.col(c) for c in df.columns])
    marked = (df.coalesce(1) if few else df).select("*", *([] if strata else [F.lit(0).alias("_all")]), hash_key(key, seed).alias("_h"), content.alias("_content"), units.alias("_units"))
    marked = marked.withColumn("_scan", F.monotonically_increasing_id())
    marked = marked if few else freeze(marked)
    target = F.expr(f"(_sum + {WEIGHT_UNITS // 2}) div {WEIGHT_UNITS}")
    placed = stratified_running_sums(marked, names, [F.col(c) for c in ("_h", key, "_content", "_scan")], {"_upto": "_units"}, rows)
    if few:
        placed = placed.withColumn("_sum", F.sum("_units").over(Window.partitionBy(*names))).withColumn("_target", target)
    else:
        totals = marked.groupBy(*names).agg(F.sum("_units").alias("_sum")).withColumn("_target", target)
        placed = attach_small(placed, freeze(totals), names)

    def copies(upto: Column) -> Column:
        return upto.cast("decimal(19,0)") * F.col("_target").cast("decimal(19,0)")  # beyond 64 bits

    parts = placed.withColumns({"_a": copies(F.col("_upto")), "_b": copies(F.col("_upto") - F.col("_units")), "_d": F.greatest("_sum", F.lit(1)).cast("decimal(19,0)")})
    taken = parts.withColumn("_taken", F.expr("_a div _d - _b div _d").cast("int")).where("_taken > 0")
    return taken.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("_taken"))).alias(out))
