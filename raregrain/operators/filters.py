"""Filters: class split, thresholds, the four-rule screen, invalid rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raregrain.fixed_values import RULE_BOUNDS


def split_by_class(df: DataFrame, label: str = "y") -> tuple[DataFrame, DataFrame]:
    """``(class 0, class 1)``; both filters are pushed to the scan."""
    return df.where(F.col(label) == 0), df.where(F.col(label) == 1)


def where_all(df: DataFrame, **values: object) -> DataFrame:
    """Rows on which every named column equals the given value."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in values.items()]))


def apply_threshold(score: str | Column, threshold: float) -> Column:
    """1 where the score is strictly above the threshold, else 0."""
    score = F.col(score) if isinstance(score, str) else score
    return (score > F.lit(float(threshold))).cast("int")


def rule_screen(df: DataFrame, bounds: Mapping[str, float] = RULE_BOUNDS) -> DataFrame:
    """Add ``violations`` (rules broken) and ``passes`` (all values strictly below their bounds)."""
    broken = [F.when(F.col(c) < F.lit(float(b)), 0).otherwise(1) for c, b in bounds.items()]
    violations = reduce(lambda a, b: a + b, broken)
    return df.withColumns({"violations": violations, "passes": violations == 0})


def apply_invalid_policy(df: DataFrame, col: str, on_invalid: str = "null") -> DataFrame:
    """Rows whose ``col`` is null: keep them, skip them, or fail."""
    if on_invalid == "null":
        return df
    if on_invalid == "skip":
        return df.where(F.col(col).isNotNull())
    if on_invalid == "error":
        return df.withColumn(
            col, F.when(F.col(col).isNotNull(), F.col(col)).otherwise(F.raise_error(F.lit(f"invalid value in {col}")))
        )
    raise ValueError("on_invalid is 'null', 'skip' or 'error'")
