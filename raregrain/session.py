"""Session set-up and the two helpers that every multi-pass operator needs.

``freeze`` cuts lineage through a reliable checkpoint, ``attach_small`` joins a
lookup table and broadcasts it only after its size has been looked at.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A lookup table is broadcast only up to this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


#: Shuffled bytes one task should get.
TASK_BYTES = 128 << 20


def shuffle_partitions(shuffled_bytes: int) -> int:
    """Shuffle partitions for the largest shuffle of a job.

    The adaptive planner merges small partitions but never adds any, so the
    number has to fit the largest shuffle: 100 TB needs about 800,000.
    """
    return max(200, -(-shuffled_bytes // TASK_BYTES))


def build_session(
    app_name: str = "raregrain", master: str | None = None, shuffled_bytes: int = 0, **conf: object
) -> SparkSession:
    """Session with the settings that matter for these jobs; ``conf`` overrides any of them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": shuffle_partitions(shuffled_bytes),
        # HotSpot compiles no method above 8000 bytes of bytecode; a wide projection
        # is faster outside whole-stage code than interpreted inside it
        "spark.sql.codegen.hugeMethodLimit": 8000,
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session.

    Uses the folder already set on the context, else ``spark.checkpoint.dir``.
    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost together with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="raregrain-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Shuffle files of a finished write are of no use to later reads of the copy.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from the copy."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(lookup: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``rows`` rows and about ``size`` bytes; one pass over it."""
    width: Column = F.lit(16 * len(lookup.columns))
    for field in lookup.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value.alias("v")))
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            continue
        width = width + F.coalesce(F.octet_length(value), F.lit(0))
    n, total = lookup.agg(F.count(F.lit(1)), F.sum(width.cast("bigint"))).first()
    return n <= rows and (total or 0) <= size


def attach_small(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Null-safe equi-join of a (frozen) lookup table, keeping ``df``'s key columns.

    The lookup's rows and bytes are counted first. Within both bounds the table is
    broadcast and ``df`` is not shuffled at all; beyond them the join is left to
    the adaptive planner, which shuffles both sides and splits skewed keys.
    """
    if fits_broadcast(lookup, broadcast_rows, broadcast_bytes):
        lookup = F.broadcast(lookup)
    renamed = lookup.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = reduce(
        lambda a, b: a & b, [df[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on]
    )
    return df.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])
