"""Chunk listing: one parquet file is one chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.operators.ranking import running_sums


def number_chunks(files: DataFrame) -> DataFrame:
    """Add the 1-based ``chunk_no``: by the number of a ``chunk_no=<n>`` folder where there is one, then by ``file``."""
    folder = F.regexp_extract("file", r"chunk_no=(\d+)", 1).try_cast("bigint")
    return running_sums(files, [folder, F.col("file")], {"_no": F.lit(1)}).select(
        F.col("_no").cast("int").alias("chunk_no"), "file", "n_rows"
    )


def list_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_no, file, n_rows`` for the parquet files under ``path``.

    Row counts need no column, so the scan reads file footers only.
    """
    rows = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(path)
    files = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    return number_chunks(files)
