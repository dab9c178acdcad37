"""Vocabulary of a growing folder of files: a stateful streaming count, one part per micro-batch.

The running counts are the stream's state, in its checkpoint, so a run that starts again counts new files only and goes on from
where the last finished micro-batch left them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.operators.vocabulary import partial_counts, ranked_vocab
from raregrain.sources.sinks import write_pred_chunks


def update_vocab(texts: DataFrame, cols: Sequence[str], out: str, checkpoint: str) -> None:
    """Count the characters of all files that the stream ``texts`` has not read yet, then stop.

    Every micro-batch stores a part ``chunk_no=<micro-batch>`` under ``out`` with the new totals of the characters it met.
    A repeated micro-batch overwrites its own part. Tasks send one row per character.
    """
    counts = partial_counts(texts, cols).groupBy("token").agg(F.sum("n").alias("n"))

    def part(rows: DataFrame, batch: int) -> None:
        write_pred_chunks(rows.coalesce(1).withColumn("chunk_no", F.lit(batch)), out)

    query = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(part).start()
    query.awaitTermination()


def load_vocab(spark: SparkSession, out: str) -> DataFrame:
    """``pos, token, n`` after the last micro-batch; a character's latest total is its greatest."""
    return ranked_vocab(spark.read.parquet(out).groupBy("token").agg(F.max("n").alias("n")))
