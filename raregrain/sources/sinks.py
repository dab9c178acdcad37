"""Table, chunk, prediction and text sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.operators.ranking import with_sorted_position


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Snappy parquet; fails if the path exists unless ``mode`` says otherwise."""
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str = "id", buckets: int = 200, mode: str = "overwrite") -> None:
    """Catalog table bucketed and sorted by key, so that joins of such tables on it need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def append_table(df: DataFrame, path: str) -> None:
    """Add rows to a table without touching what is there."""
    df.write.mode("append").option("compression", "snappy").parquet(path)


def with_chunk(df: DataFrame, order_by: str, rows_per_file: int = 1_000_000, out: str = "chunk_no") -> DataFrame:
    """Number chunks of exactly ``rows_per_file`` rows, 1-based, in the order of a column.

    The order is made total by the row's content and, between identical rows, by
    scan position, so a value shared by many rows spreads over range slices.
    ``df`` should be a scan or a frozen table.
    """
    content = F.xxhash64(*[F.col(c) for c in df.columns])
    total = df.withColumns({"_content": content, "_scan": F.monotonically_increasing_id()})
    placed = with_sorted_position(total, [F.col(order_by), F.col("_content"), F.col("_scan")], "_pos")
    chunk = F.floor((F.col("_pos") - 1) / rows_per_file) + 1
    return placed.withColumn(out, chunk.cast("int")).drop("_pos", "_content", "_scan")


def write_chunks(
    df: DataFrame, path: str, rows_per_file: int = 1_000_000, order_by: str = "id", exact: bool = True, mode: str = "overwrite"
) -> None:
    """Files of ``rows_per_file`` rows.

    ``exact`` writes one file per ``chunk_no=<n>`` directory, all full but the
    last, in the order of ``order_by``. Otherwise every task cuts its own rows at
    that length: no shuffle, but a short file per task.
    """
    if not exact:
        df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)
        return
    chunked = with_chunk(df, order_by, rows_per_file)
    # one task per chunk: a chunk has a fixed number of rows, whatever the keys
    chunked.repartition("chunk_no").sortWithinPartitions("chunk_no", order_by).write.mode(mode).partitionBy(
        "chunk_no"
    ).parquet(path)


def write_predictions_csv(df: DataFrame, path: str, key: str = "id", value: str = "binds", mode: str = "overwrite") -> None:
    """``key, value`` with a header line per file."""
    df.select(key, value).write.mode(mode).option("header", True).csv(path)


def write_lines(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    """One value of a text column per line, no header."""
    df.select(F.col(col).cast("string")).write.mode(mode).text(path)


def extract_column(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    """Store a single column; nothing else is read."""
    df.select(col).write.mode(mode).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> None:
    """All splits of a marked table in one write, a directory each."""
    df.write.mode(mode).partitionBy(split).parquet(path)


def write_pred_chunks(df: DataFrame, path: str, mode: str = "overwrite", within: Sequence[str] = ()) -> None:
    """Predictions partitioned by ``chunk_no`` and the columns ``within`` it.

    Overwriting replaces only the chunks present in ``df``, so a repeated chunk
    is stored once.
    """
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("chunk_no", *within).parquet(path)


def load_pred_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All stored prediction chunks; an unreadable file is an error."""
    return spark.read.parquet(path)


def load_readable_pred_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the chunks that can be read, and the ``file`` of every one that gave no row."""
    rows = spark.read.option("ignoreCorruptFiles", True).parquet(path)
    slashes = (r"^file:/+", "file:/")
    read = rows.select(F.regexp_replace("_metadata.file_path", *slashes).alias("file")).distinct()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return rows, files.select(F.regexp_replace("path", *slashes).alias("file")).join(read, "file", "left_anti")
