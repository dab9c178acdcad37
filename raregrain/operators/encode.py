"""Category encoders, one-hot columns, feature vectors and their persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.functions.vectors import as_array, vector_width


def fit_index(df: DataFrame, col: str, out: str | None = None, handle_invalid: str = "error") -> StringIndexerModel:
    """Index categories by descending frequency, ties alphabetically."""
    return StringIndexer(
        inputCol=col, outputCol=out or f"{col}_i", stringOrderType="frequencyDesc", handleInvalid=handle_invalid
    ).fit(df)


def fit_onehot(df: DataFrame, col: str, out: str | None = None, drop_last: bool = True):
    """One-hot encoder fitted on a column of category codes."""
    return OneHotEncoder(inputCols=[col], outputCols=[out or f"{col}_onehot"], dropLast=drop_last).fit(df)


def fit_encoders(df: DataFrame, category: str = "protein_name", drop_last: bool = True) -> PipelineModel:
    """Index and one-hot stages fitted together, to be used unchanged for training and scoring."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=category, outputCol="protein_i", stringOrderType="frequencyDesc"),
            OneHotEncoder(inputCols=["protein_i"], outputCols=["protein_onehot"], dropLast=drop_last),
        ]
    ).fit(df)


def save_encoders(model: PipelineModel, path: str) -> None:
    """Overwrite the encoders stored at ``path``."""
    model.write().overwrite().save(path)


def load_encoders(path: str) -> PipelineModel:
    """Stored encoders, used as they are and never refitted."""
    return PipelineModel.load(path)


def onehot_columns(df: DataFrame, col: str, prefix: str, width: int | None = None) -> DataFrame:
    """Every slot of a vector becomes ``<prefix>_<i>``; the width comes from column metadata."""
    width = width if width is not None else vector_width(df, col)
    if width is None:
        raise ValueError(f"{col} carries no width; pass it")
    values = as_array(df, col)
    return df.select("*", *[F.get(values, F.lit(i)).alias(f"{prefix}_{i}") for i in range(width)])


def assemble(
    df: DataFrame,
    cols: Sequence[str],
    out: str = "vectors",
    keep: Sequence[str] = ("id", "binds"),
    handle_invalid: str = "error",
) -> DataFrame:
    """Feature vector in the order of ``cols``, with the kept columns; a key is never a feature."""
    if "id" in cols:
        raise ValueError("the key must not be a feature")
    made = VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid).transform(df)
    return made.select(*keep, out)


def save_feature_columns(spark: SparkSession, cols: Sequence[str], path: str) -> None:
    """Store the ordered feature columns next to the model."""
    rows = spark.createDataFrame(list(enumerate(cols)), "pos int, name string")
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def load_feature_columns(spark: SparkSession, path: str) -> list[str]:
    """Feature columns in stored order."""
    return [r.name for r in spark.read.parquet(path).orderBy("pos").collect()]
