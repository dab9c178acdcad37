"""Counts, shares, class weights and chunk progress; one job per result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.operators.ranking import running_sums


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def class_counts(df: DataFrame, label: str = "y") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def class_share(df: DataFrame, label: str = "y") -> DataFrame:
    """Rows per class with their share of all rows, as fraction and percent."""
    whole = Window.partitionBy()
    share = F.col("n_rows") / F.sum("n_rows").over(whole)
    return class_counts(df, label).withColumns({"share": share, "percent": 100 * share})


def label_by_category(
    df: DataFrame, category: str = "category", label: str = "y", values: Sequence[object] = (0, 1)
) -> DataFrame:
    """Rows per category and label value, one column per value."""
    return df.groupBy(category).agg(
        *[F.count_if(F.col(label) == F.lit(v)).alias(f"label_{v}") for v in values],
        F.count(F.lit(1)).alias("n_rows"),
    )


def label_values(df: DataFrame, label: str = "y") -> DataFrame:
    """Distinct label values."""
    return df.select(label).distinct()


def _binary_counts(df: DataFrame, label: str) -> tuple[int, int, int]:
    y = F.col(label)
    row = df.agg(F.count(F.lit(1)), F.count_if(y == 0), F.count_if(y == 1)).first()
    return row[0], row[1], row[2]


def class_weights(df: DataFrame, label: str = "y", mode: str = "balanced", out: str = "sample_weights") -> DataFrame:
    """Row weights that balance classes 0 and 1; other labels get null.

    ``balanced`` gives ``total / (2 n_c)``, ``inverse`` gives ``total / n_c``.
    The two class counts are read back first and enter the plan as constants, so
    adding the weights is a plain projection.
    """
    total, n0, n1 = _binary_counts(df, label)
    factor = {"balanced": 2, "inverse": 1}[mode]

    def weight(n: int) -> Column:
        return F.lit(total / (factor * n)) if n else F.lit(None).cast("double")

    y = F.col(label)
    return df.withColumn(out, F.when(y == 0, weight(n0)).when(y == 1, weight(n1)))


def pos_ratio(df: DataFrame, label: str = "y") -> DataFrame:
    """Class counts with ``n0/n1``, the odds ``n1/n0`` and the fraction ``n1/(n0+n1)`` in one pass."""
    y = F.col(label)
    counts = df.agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    return counts.withColumns(
        {
            "scale_pos_weight": F.try_divide(n0, n1),
            "odds": F.try_divide(n1, n0),
            "fraction": F.try_divide(n1, n0 + n1),
        }
    )


def mean_metrics(log: DataFrame, by: str = "chunk_no", metrics: Sequence[str] = ("logloss", "aucpr")) -> DataFrame:
    """Mean of per-round metrics."""
    return log.groupBy(by).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])


def chunk_progress(chunks: DataFrame, total: int | None = None) -> DataFrame:
    """Rows used and remaining after each chunk, also as percent with two decimals.

    ``chunks`` has ``chunk_no`` and ``n_rows``; ``total`` defaults to their sum.
    """
    if total is None:
        total = chunks.agg(F.sum("n_rows")).first()[0] or 0
    everything = F.lit(int(total))
    used = F.col("used")
    return running_sums(chunks, [F.col("chunk_no")], {"used": "n_rows"}).withColumns(
        {
            "used_pct": F.round(F.try_divide(used * 100.0, everything), 2),
            "remaining": everything - used,
            "remaining_pct": F.round(F.try_divide((everything - used) * 100.0, everything), 2),
        }
    )


def running_share(batches: DataFrame, by: str = "batch_id") -> DataFrame:
    """Rows of both classes up to and including each batch, and their percent with two decimals.

    ``batches`` has ``by``, ``n_rows`` and ``n_positive``; a null label is in ``n_rows`` alone and counts as class 0.
    """
    sums = running_sums(batches, [F.col(by)], {"used": "n_rows", "used_1": "n_positive"})
    ones, rows = F.col("used_1"), F.col("used")
    return sums.select(
        by, (rows - ones).alias("used_0"), ones.alias("used_1"),
        F.round(F.try_divide((rows - ones) * 100.0, rows), 2).alias("pct_0"), F.round(F.try_divide(ones * 100.0, rows), 2).alias("pct_1"),
    )
