"""Keyed joins of feature sets, predictions and samples.

No join here carries a broadcast hint: neither side has a bound on its size. The
adaptive planner broadcasts a side it has measured to be small and splits the
partitions of hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_features(
    left: DataFrame, right: DataFrame, key: str = "id", drop_right: Sequence[str] = ("y", "protein")
) -> DataFrame:
    """Inner join of two feature sets on their key; repeated keys multiply.

    Columns both sides carry are dropped from the right before the shuffle.
    """
    return left.join(right.drop(*[c for c in drop_right if c != key]), key, "inner")


def attach_predictions(
    template: DataFrame, predictions: DataFrame, key: str = "id", value: str = "prediction", out: str = "binds"
) -> DataFrame:
    """Template rows with the prediction of the same key (null where there is none)."""
    values = predictions.select(key, F.col(value).alias(out))
    return template.drop(out).join(values, key, "left")


def exclude_keys(df: DataFrame, sampled: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key does not occur in ``sampled``.

    The sampled keys are made distinct first: copies collapse before the shuffle,
    and the join reuses the partitioning of that aggregate.
    """
    return df.join(sampled.select(key).distinct(), key, "left_anti")


def combine_descriptors(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two descriptor families of the same texts side by side."""
    return left.join(right, key, "inner")


def union_classes(*parts: DataFrame) -> DataFrame:
    """Union of class tables by column name, keeping duplicates."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
