"""Functions on feature and probability vectors (no Python per row)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_array(df: DataFrame, col: str) -> Column:
    """``array<double>`` view of a vector or numeric array column."""
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.col(col).cast("array<double>")
    return vector_to_array(F.col(col))


def class1_probability(df: DataFrame, col: str = "probability") -> Column:
    """Probability of class 1 as a plain double."""
    return F.get(as_array(df, col), F.lit(1))


def argmax_vector(df: DataFrame, col: str) -> Column:
    """0-based index of the largest element as double; the first maximum wins."""
    values = as_array(df, col)
    return (F.array_position(values, F.array_max(values)) - 1).cast("double")


def vector_width(df: DataFrame, col: str) -> int | None:
    """Width noted in the column's ML metadata, or None; reads no data."""
    return df.schema[col].metadata.get("ml_attr", {}).get("num_attrs")
