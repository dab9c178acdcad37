"""Packing token pieces into sequences by the sum-of-squares rule.

Only texts longer than a sequence are cut. Full pieces are sequences of their own. The other pieces are
dealt at random, seeded by their row, to shards of about ``SHARD_PIECES``; every shard packs its pieces,
longest first, with the sum-of-squares rule: of the open bins with room, one per residual gap, take the one
after which the sum over gaps of the squared number of open bins is smallest. A new bin is opened only if
none has room: with a new bin among the choices the rule needs 2 % more sequences here. A random shard has
the length mix of the whole table, and as a bin is opened only when none has room, it leaves one bin at most
that is half empty; these are packed as a whole over fewer shards, until one shard is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import store
from raregrain.llm.tokens import encoded

CAPACITY = 2048
SHARD_PIECES = 8_192


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` for every piece of every text's ids, ``end`` included.

    A null or empty text is the one id ``end``.
    """
    kinds = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, ids in encoded(batches, path, end):
            keys, rows = part.column("key").to_pylist(), []
            data = ids.astype("<u4")
            for i, k in enumerate(keys):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                for piece, start in enumerate(range(lo, hi, capacity)):
                    stop = min(start + capacity, hi)
                    rows.append((k, piece, start - lo, stop - start, zlib.crc32(data[start:stop])))
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)

    schema = "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, items taken longest first (ties by place)."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by residual gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        gaps = open_bins[size:]  # gap g becomes g - size; a full bin is no longer open
        after = open_bins[: capacity + 1 - size]
        change = 2 * (after - gaps) + 2
        change[0] = 1 - 2 * gaps[0]
        change[gaps == 0] = np.iinfo(np.int64).max
        change[-1] = np.iinfo(np.int64).max - 1  # a new bin only if no open one has room
        gap = size + int(change.argmin())
        if gap == capacity:
            bin_, used = used, used + 1
        else:
            bin_ = stacks[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = bin_, capacity - gap
        if gap > size:
            stacks[gap - size].append(bin_)
            open_bins[gap - size] += 1
    return bins, offsets


def _pack(items: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """``item, bin, offset, filled``: every shard packs its items; bin numbers differ between shards and levels."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item", kind="stable")
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        filled = np.bincount(bins, weights=group["length"]).astype(np.int64) if len(bins) else bins
        number = (int(group["shard"].iloc[0]) << 32) + (level << 24 << 32) + bins
        return pd.DataFrame({"item": group["item"], "bin": number, "place": offsets, "filled": filled[bins]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "item bigint, bin bigint, place bigint, filled bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id, offset`` to a stored table of pieces with a ``length`` of 1 to ``capacity``.

    Offsets are gapless from 0 in every sequence. Ties between pieces are settled by their row; repeated
    rows are packed each. An empty table gives none.
    """
    pieces = store(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") >= capacity).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    loose = pieces.where(F.col("length") < capacity)
    shards, level = max(1, -(-loose.count() // shard_pieces)), 0
    placed = store(_pack(loose.select("item", "length"), shards, level, capacity), "level")
    # where bins that are moved go: a bin, at most one per shard, becomes an item of the next level
    last, moves = placed, None
    while shards > 1:
        left = last.where(F.col("filled") * 2 <= capacity).groupBy("bin").agg(F.max("filled").alias("length"))
        shards, level = max(1, -(-left.count() // shard_pieces)), level + 1
        last = store(_pack(left.withColumnRenamed("bin", "item"), shards, level, capacity), "level")
        step = last.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("place").alias("by"))
        if moves is not None:
            further = step.select(F.col("bin").alias("to"), F.col("to").alias("on"), F.col("by").alias("more"))
            joined = moves.join(further, "to", "left")
            moves = joined.select("bin", F.coalesce("on", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
        else:
            moves = step
    if moves is not None:
        placed = placed.join(moves, "bin", "left").select(
            "item", F.coalesce("to", "bin").alias("bin"), (F.col("place") + F.coalesce("by", F.lit(0))).alias("place")
        )
    placed = placed.select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    return full.unionByName(loose.join(placed, "item")).drop("item")


def pack_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """``<key>, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every text.

    Null and empty texts are pieces of one id; repeated rows and keys are packed each; other columns are
    not read.
    """
    return pack(token_pieces(docs, path, key, text, capacity, end), capacity, shard_pieces).withColumnRenamed("key", key)


def sequence_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, for texts with unique keys."""
    placed = pack_documents(docs, path, key, text, capacity, end).select(F.col(key).alias("key"), "piece", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, ids in encoded(batches, path, end):
            rows = [
                (k, piece, ids[start : min(start + capacity, offsets[i + 1])].tolist())
                for i, k in enumerate(part.column("key").to_pylist())
                for piece, start in enumerate(range(offsets[i], offsets[i + 1], capacity))
            ]
            keys, numbers, lists = zip(*rows)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["key", "piece", "ids"])

    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    cut = texts.mapInArrow(run, "key bigint, piece int, ids array<int>")
    joined = cut.join(placed, ["key", "piece"])
    # a sequence has at most ``capacity`` pieces
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
