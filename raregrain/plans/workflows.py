"""The two complete paths from raw rows to scored rows, assembled from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.operators.columns import concat_features
from raregrain.operators.encode import assemble, fit_onehot
from raregrain.operators.joins import join_features


def token_vectors(
    features: DataFrame, arrays: Sequence[str], encoder: PipelineModel | None = None, keep: Sequence[str] = ("id", "y")
) -> tuple[DataFrame, object]:
    """One-hot category followed by all token counts as ``vectors``, with the encoder used.

    The arrays go into the vector as they are; no column per count is made. Pass
    the encoder returned for the training rows when preparing rows to score.
    """
    coded = concat_features(features, arrays, out="_counts").withColumn("protein", F.col("protein").cast("double"))
    encoder = encoder or fit_onehot(coded, "protein")
    ready = encoder.transform(coded).withColumn("_tokens", array_to_vector(F.col("_counts").cast("array<double>")))
    return assemble(ready, ["protein_onehot", "_tokens"], keep=keep), encoder


def joined_vectors(
    descriptors: DataFrame, tokens: DataFrame, names: Sequence[str], keep: Sequence[str] = ("id", "y")
) -> DataFrame:
    """Descriptor columns ``names`` followed by the token vector of the same id."""
    joined = join_features(descriptors, tokens.withColumnRenamed("vectors", "_tokens"), drop_right=("y",))
    return assemble(joined, [*names, "_tokens"], keep=keep)


def descriptor_names(prefixes: Mapping[str, str], fields: Sequence[str]) -> list[str]:
    """Expanded descriptor columns in prefix, then field order."""
    return [f"{prefix}_{field}" for prefix in prefixes.values() for field in fields]
