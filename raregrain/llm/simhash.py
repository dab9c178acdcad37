"""SimHash fingerprints and near-duplicate links by multi-index hashing.

The 64 bits form four blocks of 16. A segment is what is left when one block is dropped (48 bits);
every fingerprint is entered in the table of each of the four segments. Two fingerprints that differ
in at most two bits differ either inside one block, so they agree on the segment without it, or in one
bit of each of two blocks, so that on the segment without the first of them they differ in one bit. A
look-up therefore enumerates, in each segment, the ball of radius 0, and that of radius 1 over the
blocks behind the dropped one; of a pair that differs in a bit, the one that has it set looks up. Every
match is verified on all 64 bits. 48 of 64 bits agree before a pair is formed, which keeps the
candidates of a dense cluster close to its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import components, store, text_slices, unsigned_hex

BITS, BLOCK = 64, 16
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 17


def shingle_fingerprint(text: bytes | None, size: int, seed: int) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64."""
    words = (text or b"").lower().split()  # both know ASCII letters and the six ASCII spaces only
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    total = len(words) - size + 1
    counts = np.zeros(BITS, np.int64)
    for start in range(0, total, CHUNK):
        n = min(CHUNK, total - start)
        grams = map(b" ".join, zip(*[words[start + i : start + i + n] for i in range(size)]))
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), "<u8", n)
        counts += np.unpackbits(hashed.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """``key, fp`` for every row of ``docs``; a text without words (null, empty) has fingerprint 0."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([shingle_fingerprint(t, size, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([part.column("key").cast(pa.int64()), pa.array(fps)], schema=schema)

    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key bigint, fp bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame) -> DataFrame:
    """``a, b`` for every two different fingerprints ``fp`` at two or fewer differing bits."""
    distinct = fps.select("fp").distinct()
    full = (1 << BITS) - 1
    keep = [full ^ (((1 << BLOCK) - 1) << (BLOCK * i)) for i in range(BITS // BLOCK)]
    exact = [(i, 0, _signed(k)) for i, k in enumerate(keep)]
    flips = [
        (i, _signed(1 << bit), _signed(keep[i]))
        for i in range(len(keep)) for bit in range(BLOCK * (i + 1), BITS)
    ]

    def places(steps: list[tuple[int, int, int]]) -> DataFrame:
        steps = F.array(*[F.struct(F.lit(i).alias("segment"), F.lit(f).cast("bigint").alias("flip"), F.lit(k).cast("bigint").alias("keep")) for i, f, k in steps])
        placed = distinct.select("fp", F.explode(steps).alias("s")).where("s.flip = 0 or (fp & s.flip) <> 0")
        return placed.select("fp", "s.segment", "s.flip", F.expr("(fp ^ s.flip) & s.keep").alias("part"))

    table = places(exact).select(F.col("fp").alias("b"), "segment", "part")
    probes = places(exact + flips).withColumnRenamed("fp", "a")
    found = probes.join(table, ["segment", "part"]).where("(flip <> 0 or a < b) and bit_count(a ^ b) between 1 and 2")
    return found.select("a", "b").distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """``<key>, fingerprint, component_id`` for every row; the component is the smallest key reachable.

    Rows with equal fingerprints are linked, empty and null texts (fingerprint zero) as well. Links are
    searched between distinct fingerprints, so copies, however many, are one entry. A null key keeps its
    row and never names a component that has another key. Other columns are not read.
    """
    fps = store(fingerprints(docs, key, text, size, seed), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("key").alias("first"))
    roots = components(links(fps)).withColumnRenamed("node", "fp")
    placed = store(first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    names = store(placed.join(named, "root").select("fp", "component_id"), "names")
    return fps.join(names, "fp").select(F.col("key").alias(key), unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")
