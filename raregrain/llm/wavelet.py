"""Token ids in ascending document order, a wavelet matrix per shard.

A shard's file content is one self-contained binary: a header, the documents' keys and lengths, per
bit-plane the number of zeros, rank samples and the packed bits. Rank and select on the planes give
access to a token, the count of a token before a place, and the place of its k-th occurrence without
unpacking the shard. Spark's Parquet writer stores shards (one row each, zstd), so that a lost task
leaves no half file and any store that Spark writes to will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raregrain.llm.tokens import encoded

MAGIC = b"WVMX0001"
#: Bits between two rank samples.
SAMPLE = 512
SHARD_TOKENS = 2_000_000


class WaveletMatrix:
    """Sequence of ``n`` unsigned ids of ``bits`` bits as bit-planes with rank samples."""

    def __init__(self, n: int, bits: int, zeros: np.ndarray, samples: np.ndarray, words: np.ndarray):
        self.n, self.bits, self.zeros, self.samples, self.words = n, bits, zeros, samples, words

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n = len(ids)
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        width = -(-n // SAMPLE) * (SAMPLE // 8)
        planes, zeros = np.zeros((bits, width), np.uint8), np.zeros(bits, np.int64)
        for level in range(bits):
            one = (x >> (bits - 1 - level)) & 1 != 0
            planes[level, : -(-n // 8)] = np.packbits(one, bitorder="little")
            low = x[~one]
            zeros[level] = len(low)
            x = np.concatenate((low, x[one]))
        words = planes.view("<u8")
        ones = np.bitwise_count(words).reshape(bits, -1, SAMPLE // 64).sum(axis=2, dtype=np.int64)
        samples = np.concatenate((np.zeros((bits, 1), np.int64), np.cumsum(ones, axis=1)), axis=1).astype("<u4")
        return cls(n, bits, zeros, samples, words)

    def rank1(self, level: int, place: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        place = np.asarray(place, np.int64)
        block, word = place // SAMPLE, place // 64
        total = self.samples[level][block].astype(np.int64)
        row = self.words[level]
        for step in range(SAMPLE // 64 - 1):
            at = block * (SAMPLE // 64) + step
            total += np.where(at < word, np.bitwise_count(row[np.minimum(at, len(row) - 1)]), 0) if len(row) else 0
        rest = (place % 64).astype(np.uint64)
        last = row[np.minimum(word, len(row) - 1)] if len(row) else np.zeros(len(place), np.uint64)
        return total + np.bitwise_count(last & ((np.uint64(1) << rest) - np.uint64(1)))

    def _bit(self, level: int, place: np.ndarray) -> np.ndarray:
        return ((self.words[level][place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def access(self, places: np.ndarray) -> np.ndarray:
        """Ids at places."""
        at, value = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self.rank1(level, at)
            value = value * 2 + bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return value

    def rank(self, token: int, place: int) -> int:
        """Occurrences of ``token`` before ``place``."""
        lo, hi = np.array([0]), np.array([place])
        for level in range(self.bits):
            lo1, hi1 = self.rank1(level, lo), self.rank1(level, hi)
            one = token >> (self.bits - 1 - level) & 1
            lo, hi = (self.zeros[level] + lo1, self.zeros[level] + hi1) if one else (lo - lo1, hi - hi1)
        return int(hi[0] - lo[0])

    def select(self, token: int, k: int) -> int:
        """Place of occurrence ``k`` (from 0) of ``token``; -1 if it has fewer."""
        if token < 0 or token >> self.bits or k < 0 or k >= self.rank(token, self.n):
            return -1
        lo, starts = np.array([0]), []
        for level in range(self.bits):
            starts.append(lo)
            one = token >> (self.bits - 1 - level) & 1
            ones = self.rank1(level, lo)
            lo = self.zeros[level] + ones if one else lo - ones
        at = int(lo[0]) + k
        for level in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, one, at - (int(self.zeros[level]) if one else 0))
        return at

    def _select_bit(self, level: int, one: int, k: int) -> int:
        """Place of the k-th set (or clear) bit of a plane: binary search over ranks."""
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            ones = int(self.rank1(level, np.array([mid]))[0])
            lo, hi = (mid, hi) if (ones if one else mid - ones) <= k else (lo, mid)
        return lo

    def decode(self) -> np.ndarray:
        """All ids: planes are put back from the lowest."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in reversed(range(self.bits)):
            one = np.unpackbits(self.words[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            y = np.empty(self.n, kind)
            y[~one] = x[: self.zeros[level]]
            y[one] = x[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            x = y
        return x


def shard_bytes(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """A shard's file: header, null flags, keys and lengths of documents, zeros, rank samples, planes."""
    m = WaveletMatrix.build(ids, bits)
    null = np.array([k is None for k in keys], np.uint8)
    head = struct.pack("<8sQQII", MAGIC, len(keys), m.n, bits, SAMPLE)
    known = np.array([0 if k is None else k for k in keys], "<i8")
    arrays = (null, known, lengths.astype("<i8"), m.zeros.astype("<i8"), m.samples.astype("<u4"), m.words.astype("<u8"))
    return head + b"".join(a.tobytes() for a in arrays)


def open_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Keys, lengths and tokens of a shard's file."""
    magic, docs, n, bits, sample = struct.unpack_from("<8sQQII", data)
    if magic != MAGIC or sample != SAMPLE:
        raise ValueError("not a shard of this format")
    at = struct.calcsize("<8sQQII")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        array = np.frombuffer(data, kind, count, at)
        at += array.nbytes
        return array

    null, known, lengths, zeros = take("u1", docs), take("<i8", docs), take("<i8", docs), take("<i8", bits)
    blocks = -(-n // SAMPLE)
    samples = take("<u4", bits * (blocks + 1)).reshape(bits, -1)
    words = take("<u8", bits * blocks * (SAMPLE // 64)).reshape(bits, -1)
    return [None if z else int(k) for z, k in zip(null, known)], lengths, WaveletMatrix(n, bits, zeros, samples, words)


def write_token_shards(
    docs: DataFrame, path: str, tokenizer: str, bits: int, key: str = "doc_id", text: str = "text", end: int = 1, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode all texts and write them to ``path`` in ascending key order (null first, ties by text hash).

    A null or empty text is the one id ``end``; repeated rows are written each; other columns are not
    read. A shard is closed at the first document end behind ``shard_tokens``, so a longer text makes a
    longer shard. Shards are ordered by ``part, shard``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, keys, lengths, pending, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(pending) if pending else np.empty(0, np.uint32)
            data = shard_bytes(keys, np.concatenate(lengths), ids, bits)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "n_tokens", "file"])

        for rows, offsets, ids in encoded(batches, tokenizer, end):
            own, first = rows.column("key").to_pylist(), 0
            while first < len(own):
                last = min(len(own), int(np.searchsorted(offsets, offsets[first] + max(1, shard_tokens - n))))
                keys += own[first:last]
                lengths.append(np.diff(offsets[first : last + 1]))
                pending.append(ids[offsets[first] : offsets[last]])
                n += int(offsets[last] - offsets[first])
                first = last
                if n >= shard_tokens:
                    yield flush()
                    shard, keys, lengths, pending, n = shard + 1, [], [], [], 0
        if keys:
            yield flush()

    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    ordered = texts.repartitionByRange(F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("key").asc_nulls_first(), F.xxhash64("text")
    )
    shards = ordered.mapInArrow(run, "part int, shard int, n_tokens bigint, file binary")
    shards.write.option("compression", "zstd").parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, shard, before``: ids in earlier shards. Parts, one per writing task, are summed first."""
    sizes = spark.read.parquet(path).select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(parts, "part").select("part", "shard", (F.col("base") + F.col("inner")).alias("before"))


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``<key>, start, n_tokens, ids_crc32`` of every document, from the shards' planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, data in zip(batch.column("part"), batch.column("shard"), batch.column("file")):
                keys, lengths, matrix = open_shard(data.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lengths)]
                rows = len(keys)
                yield pa.record_batch(
                    [
                        pa.array(np.full(rows, part.as_py(), np.int32)), pa.array(np.full(rows, shard.as_py(), np.int32)),
                        pa.array(keys, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()),
                    ],
                    ["part", "shard", "key", "inner", "n_tokens", "ids_crc32"],
                )

    # a batch is one shard, whatever its size
    read = spark.read.parquet(path).select("part", "shard", "file").mapInArrow(
        run, "part int, shard int, key bigint, inner bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return read.join(shard_starts(spark, path), ["part", "shard"]).select(
        F.col("key").alias(key), (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )
