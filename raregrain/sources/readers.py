"""Table scans with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("buildingblock1_smiles", T.StringType()),
        T.StructField("buildingblock2_smiles", T.StringType()),
        T.StructField("buildingblock3_smiles", T.StringType()),
        T.StructField("molecule_smiles", T.StringType()),
        T.StructField("protein_name", T.StringType()),
        T.StructField("binds", T.LongType()),
    ]
)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Parquet file, directory, part file or list of them; only ``columns`` are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return df if columns is None else df.select(*columns)


def widen_scan(df: DataFrame) -> DataFrame:
    """Redistribute a plain scan that has fewer splits than there are cores.

    Meant for whole-table work that is heavy per row (text functions) on files of few large
    row groups: the row numbers keep filters behind it from reaching the scan, so filter first.
    A table with a split per core passes through untouched; a smaller one, at most a split's
    size per core, is shuffled. Rows go by their scan number, which is the same
    on a retry and spares the sort that a plain round robin needs for that.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, F.monotonically_increasing_id())


def table_info(df: DataFrame) -> DataFrame:
    """Row count and number of scan partitions."""
    return (
        df.groupBy(F.spark_partition_id().alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("filled_partitions"))
    )


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, sep: str = ","
) -> DataFrame:
    """Delimited text, plain or compressed with a codec Spark can read (gz, bz2, zstd; not zip)."""
    if path.endswith(".zip"):
        raise ValueError("zip archives cannot be read; unpack the file first")
    return spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """``label, features`` from sparse label/vector text."""
    return spark.read.format("libsvm").option("numFeatures", num_features).load(path)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str, rows: int = 10_000
) -> DataFrame:
    """Apply ``fn`` to record batches of at most ``rows`` rows, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield fn(batch.slice(start, rows))

    return df.mapInArrow(run, schema)
