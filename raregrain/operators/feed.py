"""Mini-batches for a trainer outside Spark: laid out once, read in order, resumed from a stored position.

The table is written by ranges of batches, a folder each, so that a range is read without touching the others. Every
range that is finished is noted; a run that starts again goes on behind the last note. A trainer stores its own state when a
range ends, and then state and position agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from raregrain.operators.sampling import with_minibatch

#: Batches between two stored positions.
EVERY = 10_000


def lay_out_batches(df: DataFrame, path: str, size: int = 1024, every: int = EVERY, key: str = "id", seed: int = 42) -> None:
    """Write ``df`` with ``batch_id``, batches of ``size`` rows in hash order, into folders ``batch_range=<n>`` of ``every`` batches.

    No row is lost; the last batch may be short. Rows are dealt out by runs of batches, so that a range has several tasks.
    """
    numbered = with_minibatch(df, size, key, seed, "batch_id")
    ranged = numbered.withColumn("batch_range", F.floor(F.col("batch_id") / every).cast("bigint"))
    ranged.repartitionByRange("batch_id").sortWithinPartitions("batch_id").write.mode("overwrite").partitionBy("batch_range").parquet(path)


def _folder(spark: SparkSession, path: str):
    """A folder and its file system, which any path that Spark can read has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _position(spark: SparkSession, progress: str) -> int:
    """Number of ranges that are noted as finished, each by a folder ``chunk_no=<n>``."""
    files, at = _folder(spark, progress)
    if not files.exists(at):  # nothing noted so far
        return 0
    names = [entry.getPath().getName() for entry in files.listStatus(at)]
    return max((int(n.removeprefix("chunk_no=")) + 1 for n in names if n.startswith("chunk_no=")), default=0)


def _note(spark: SparkSession, progress: str, number: int) -> None:
    """Note a finished range by an empty file, which takes no Spark job."""
    files, at = _folder(spark, f"{progress}/chunk_no={number}/finished")
    files.create(at, True).close()


def feed_batches(spark: SparkSession, path: str, progress: str, each: Callable[[DataFrame, int], None], at_once: int = 1) -> int:
    """Call ``each(rows of a range, its number)`` for every range not yet finished, in order; returns how many were fed.

    The position is stored after each range. A range during which the run was lost is fed again from its start,
    as the trainer's state at the last stored position needs it. For consumers that treat every range by itself, ``at_once``
    ranges are in work at a time; they start in order, and the position only passes ranges that are all finished.
    """
    table = spark.read.parquet(path)
    start = _position(spark, progress)
    ranges = sorted(r[0] for r in table.where(F.col("batch_range") >= start).select("batch_range").distinct().collect())

    def one(number: int) -> None:
        each(table.where(F.col("batch_range") == number).drop("batch_range"), number)

    if at_once == 1:
        for number in ranges:
            one(number)
            _note(spark, progress, number)
    else:
        with ThreadPoolExecutor(at_once) as pool:
            for number, _ in zip(ranges, pool.map(one, ranges)):  # an error cancels those not yet begun
                _note(spark, progress, number)
    return len(ranges)


def local_batches(rows: DataFrame) -> Iterator[tuple[int, list[Row]]]:
    """Batches of a range on the driver, in order, holding one Spark partition at a time."""
    held, number = [], None
    for row in rows.repartitionByRange("batch_id").sortWithinPartitions("batch_id").toLocalIterator():
        if number is not None and row.batch_id != number:
            yield number, held
            held = []
        number = row.batch_id
        held.append(row)
    if number is not None:
        yield number, held
