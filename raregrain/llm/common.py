"""What the operators share: stored intermediate tables, text batches, row keys and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.operators.ranking import with_sorted_position
from raregrain.session import store

#: Text that a Python task looks at in one go; a longer text is looked at alone.
SLICE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


#: A random 64-bit value per byte.
BYTE_VALUES = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def lowest_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the lowest hash in every window of ``width``; of equal ones the first.

    The upper 40 bits decide, so that hash and place are one number; arrays are shorter than 2**24.
    """
    low = np.uint64((1 << 24) - 1)
    tagged = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    return (sliding_min(tagged, width) & low).astype(np.int64)


def with_row_key(docs: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``docs`` with a unique, non-null bigint ``name`` in the order of ``key``.

    Unique keys are used as they are. If some are null or repeat, the rows are numbered in the order
    of key (null first), text hash and place, and stored once so that every pass sees the same numbers.
    """
    bad = docs.groupBy(key).agg(F.count(F.lit(1)).alias("rows of key")).where((F.col("rows of key") > 1) | F.col(key).isNull())
    if bad.isEmpty():
        return docs.withColumn(name, F.col(key).cast("bigint"))
    order = [F.col(key).asc_nulls_first(), F.xxhash64(text), F.col(name)]
    placed = docs.withColumn(name, F.monotonically_increasing_id())
    return store(with_sorted_position(placed, order, name), "keyed")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, id, text``: a unique row key as in :func:`with_row_key`, the given key, and the text."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return with_row_key(rows, "id", "text", "key").select("key", "id", "text")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``limit`` bytes of text, or one longer text.

    At the end Arrow's free memory goes back: a Python worker waits for its next task beside those that run.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def whole_groups(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Tables of whole groups of batches that are sorted by the column ``name``, about a batch of rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(name)
        if held and held[-1].column(name)[-1] != group[-1]:
            # the group that was open ends in this batch, and so do all but the last of its own
            start = int(np.searchsorted(group.to_numpy(), group[-1].as_py()))
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        elif not held:
            start = int(np.searchsorted(group.to_numpy(), group[-1].as_py()))
            if start:
                yield pa.Table.from_batches([batch.slice(0, start)])
            held = [batch.slice(start)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and bytes of a text column; null is empty."""
    array = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def is_space(data: np.ndarray) -> np.ndarray:
    """True where a byte is one of 0x20, 0x09-0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_starts_ends(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where words of a batch of texts start and end; no word crosses a text."""
    solid = ~is_space(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) & ~edge[:-1] if len(data) else solid
    after = np.concatenate((solid[1:], [False])) & ~edge[1:] if len(data) else solid
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for every length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected edges ``a, b``; root is the smallest node reachable.

    Alternating large-star and small-star steps: each is a minimum per node, joined back, so that
    no task gathers the neighbours of a node; minima are stored, so that a node with many neighbours is
    split where they are joined. Every round is written to the shared folder; the
    rounds end as soon as all components are stars, which takes about the logarithm of the longest chain.
    """
    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = store(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = store(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = store(small.where("a <> b").distinct(), "small")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``a`` of the distinct edges ``a > b`` has one edge and is the ``b`` of none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("end"))
    ends = ends.groupBy("end.node").agg(F.sum("end.up").alias("up"), F.max("end.down").alias("down"))
    return ends.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def unsigned_hex(col: Column) -> Column:
    """16 lowercase hex digits of a bigint's bits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
