"""Importance resampling towards a target distribution of hashed word features.

Words come from the tokenizers library: an untrained Regex ``Split`` over the lower-cased text returns them with
offsets. Windows of offset pairs are features; the CRC of a feature's words picks its bucket. One pass over the texts
stores every document's buckets, so that the histogram of all documents and, after it, every document's sum of
bucket gains are numpy look-ups over the stored copy. The histogram, of a fixed number of buckets, is all the
driver sees.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from tokenizers import Regex, pre_tokenizers

from raregrain.llm.common import store, text_slices
from raregrain.operators.ranking import with_sorted_position

#: Fixed value: words are runs of ASCII letters and digits and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Characters that the splitter sees at a time; a text is cut between words only.
CHUNK = 1 << 16
#: Features whose buckets a Python worker remembers.
CACHE = 500_000

_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_SPLIT: list = []


def _splitter():
    """The worker's splitter; it is not picklable."""
    if not _SPLIT:
        _SPLIT.append(pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True))
    return _SPLIT[0]


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of about ``size`` characters that end where a word cannot go on."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + size)
        stop = gap.end() if gap else len(text)
        yield text[start:stop]
        start = stop


class Buckets:
    """Buckets of a text's features: runs of ``least`` to ``most`` words, joined by one space."""

    def __init__(self, least: int, most: int, buckets: int):
        self.least, self.most, self.buckets = least, most, buckets
        self.known: dict[str, int] = {}

    def _bucket(self, feature: str) -> int:
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[feature] = bucket = crc32(feature.encode()) % self.buckets
        return bucket

    def __call__(self, text: bytes | None) -> tuple[int, list[int]]:
        """Number of words and the bucket of every feature; null has none."""
        known, split = self.known, _splitter().pre_tokenize_str
        count, out = 0, []
        tail = ""  # words of earlier chunks that windows may begin with
        for chunk in chunks((text or b"").lower().decode()):  # bytes.lower knows A-Z only
            before = len(tail)
            spans = split(tail + chunk)
            words = [word for word, _ in spans]
            count += sum(span[0] >= before for _, span in spans) if before else len(spans)
            for n in range(self.least, self.most + 1):
                if n == 1 and not before:
                    features = words
                else:  # a window reaches from the offset of its first word to that of its last one
                    ends = (spans[i + n - 1][1][1] for i in range(len(spans) - n + 1))
                    features = [" ".join(words[i : i + n]) for i, end in enumerate(ends) if end > before]
                out += [known[f] if f in known else self._bucket(f) for f in features]
            tail = "".join(word + " " for word in words[len(words) - self.most + 1 :]) if self.most > 1 else ""
        return count, out


def bucketed(docs: DataFrame, key: str, text: str, least: int, most: int, buckets: int) -> DataFrame:
    """``key, n, words, buckets``: numbers of features and words, and the buckets as unsigned integers, for every row."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(least, most, buckets)
        for part in text_slices(batches):
            found = [of(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch(
                [part.column("key"), pa.array([len(b) for _, b in found], pa.int64()), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([np.array(b, kind).tobytes() for _, b in found], pa.binary())],
                names=["key", "n", "words", "buckets"],
            )

    made = StructType([StructField("key", rows.schema["key"].dataType), StructField("n", LongType()), StructField("words", LongType()), StructField("buckets", BinaryType())])
    return rows.mapInArrow(run, made)


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often every bucket occurs in the ``buckets`` of all rows; each task sends one row per bucket."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column("buckets"):
                total += np.bincount(np.frombuffer(value.as_buffer(), kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "count"])

    summed = rows.select("buckets").mapInArrow(run, "bucket bigint, count bigint").groupBy("bucket").agg(F.sum("count").alias("count"))
    total = np.zeros(buckets, np.int64)
    for bucket, count in summed.collect():  # one row per bucket at most
        total[bucket] = count
    return total


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket ``floor(1000 * ln of (share in the target / share in the raw table))``, one added to every count."""
    size, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (all_raw + size) / ((s + 1) * (all_target + size)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64
    )


def weighed(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """``key, n, words, weight`` of the rows of :func:`bucketed`."""
    kind = np.uint16 if len(gains) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gains[np.frombuffer(value.as_buffer(), kind)].sum()) for value in batch.column("buckets")]
            yield pa.record_batch([*batch.columns[:3], pa.array(weights, pa.int64())], names=["key", "n", "words", "weight"])

    return rows.select("key", "n", "words", "buckets").mapInArrow(run, StructType([*rows.schema.fields[:3], StructField("weight", LongType())]))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS,
    min_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """``<key>, n_features, weight, score, rank`` for every row of ``docs``; rank numbers the rows that are drawn.

    ``weight`` is the sum of the gains of a text's features, ``score`` adds Gumbel noise made of
    ``sha256(<seed>:<key>)``, so that the highest scores are a draw without replacement by importance. Of the rows with
    ``min_words`` words, ``percent`` of a hundred are drawn, ties to the smaller key.

    Null and empty texts have no features and weight 0. A null key draws with the empty text and comes last among ties;
    repeated rows count and are ranked each. An empty table gives no rows, an empty target only adds its ones. Very
    long texts are split in chunks. Other columns are not read.
    """
    rows = store(bucketed(docs, key, text, least, most, buckets), "buckets", "zstd")
    wanted = bucketed(target.withColumn("target row", F.lit(0)), "target row", text, least, most, buckets)
    weights = weighed(rows, bucket_gains(histogram(rows, buckets), histogram(wanted, buckets)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    drawn = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(drawn))).cast("bigint")
    scored = store(weights.withColumn("score", F.col("weight") + noise), "scores")
    able = F.col("words") >= min_words
    take = scored.where(able).count() * percent // 100
    placed = with_sorted_position(scored.where(able), [F.col("score").desc(), F.col("key").asc_nulls_last()], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    every = placed.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")))
    return every.select(F.col("key").alias(key), F.col("n").alias("n_features"), "weight", "score", "rank")
