"""Phrase collocations by direct-address tiles, all lengths by the same step on ever longer runs.

1. Texts are cut into blocks (about ``BLOCK_BYTES`` of text). A block's words are numbered inside the block, so
   that one row per block and distinct word, not one per word, is counted and joined.
2. Words that occur ``least`` times are ranked by frequency over the whole table: the rank is a word's id, and a
   block becomes a sequence of ids, -1 where a word is rarer or a piece ends. A phrase that occurs ``least``
   times is made of runs that do.
3. One step turns runs of k words into runs of k + 1: neighbours in the sequence form a pair of ids, and the plane
   of all pairs is split into square tiles. A tile that a block fills well is counted by one ``bincount`` over its
   cells; the others go into a sorted list of coordinates. Counts of a block are dealt out by short strips
   of a tile's row, so that no tile, however frequent its words, is summed in one task. Pairs that occur ``least`` times
   are ranked by frequency in turn; their ranks replace the pairs in the sequences, and the step repeats on them.

Counts travel as one binary value per block and bucket of strips. Every intermediate table is stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.llm.common import mixed, raw_text, store, text_slices
from raregrain.operators.ranking import with_sorted_position

BLOCK_BYTES = 8 << 20
#: A tile has 2**TILE_BITS ids on either side; ids stay below 2**31.
TILE_BITS = 10
ID_BITS = 31
#: Cells of a strip, the unit in which counts are dealt out.
STRIP_BITS = 4
#: A tile is counted densely when a block has a pair for every so many cells.
DENSE_SHARE = 8
#: Counts that a summing task holds before it merges them.
HELD = 1 << 22
#: Rows of a language that the second of two ranking steps gets from each part of the first.
PARTS = 64

_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words of a text column, the row of every word and the number of its piece; no piece crosses a row."""
    offsets, data = raw_text(column)
    kind = _CLASS[data]
    solid = kind == _WORD
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.concatenate(([False], solid[:-1])) & ~fresh[:-1] if len(data) else solid
    after = np.concatenate((solid[1:], [False])) & ~fresh[1:] if len(data) else solid
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    piece = np.cumsum((kind == _BREAK) | fresh[:-1])[starts] if len(data) else starts
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[solid]]))
    return words, np.searchsorted(offsets, starts, "right") - 1, piece


def spaced(ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """``ids`` with -1 wherever a piece ends."""
    if not len(ids):
        return ids
    ends = np.concatenate((np.flatnonzero(piece[1:] != piece[:-1]) + 1, [len(ids)]))
    return np.insert(ids, ends, -1)


_BLOCK = pa.schema([
    ("block", pa.int64()), ("seq", pa.binary()), ("words", pa.list_(pa.string())), ("langs", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for part in text_slices(batches, limit=BLOCK_BYTES):
        words, row, piece = split_words(part.column("text"))
        if not len(words):
            continue
        word, lang = words.dictionary_encode(), part.column("lang").dictionary_encode()
        n = len(word.dictionary)
        codes = lang.indices.to_numpy()[row].astype(np.int64) * n + word.indices.to_numpy()
        codes, local, counts = np.unique(codes, return_inverse=True, return_counts=True)
        seq = spaced(local.astype(np.int32), piece)
        whole = pa.array([0, len(codes)], pa.int32())
        yield pa.record_batch([
            pa.array([block]), pa.array([seq.tobytes()], pa.binary()),
            pa.ListArray.from_arrays(whole, word.dictionary.take(pa.array(codes % n)).cast(pa.string())),
            pa.ListArray.from_arrays(whole, lang.dictionary.take(pa.array(codes // n)).cast(pa.string())),
            pa.ListArray.from_arrays(whole, pa.array(counts, pa.int64())),
        ], schema=_BLOCK)
        block += 1


def _encode(block: pa.Table, ids: pa.Table) -> pa.Table:
    """A block's sequence with the words' global ids, -1 for words that are too rare."""
    schema = pa.schema([("block", pa.int64()), ("seq", pa.binary())])
    if not block.num_rows or not ids.num_rows:
        return schema.empty_table()
    seq = np.frombuffer(block.column("seq")[0].as_buffer(), np.int32)
    known = np.full(int(seq.max()) + 2, -1, np.int32)  # the last entry is that of -1
    known[ids.column("local").to_numpy()] = ids.column("id").to_numpy()
    return pa.table([block.column("block"), pa.array([known[seq].tobytes()], pa.binary())], schema=schema)


def pair_keys(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose run has a right neighbour, and the keys of the two: tile, then cell."""
    at = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
    return at, cell_key(seq[at].astype(np.int64), seq[at + 1].astype(np.int64))


def cell_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    low = (1 << TILE_BITS) - 1
    tile = (x >> TILE_BITS << (ID_BITS - TILE_BITS)) | (y >> TILE_BITS)
    return tile << (2 * TILE_BITS) | (x & low) << TILE_BITS | (y & low)


def tile_counts(keys: np.ndarray, dense_share: int = DENSE_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts: dense tiles by ``bincount``, the others as sorted coordinates."""
    cells = 1 << (2 * TILE_BITS)
    tiles, sizes = _runs(np.sort(keys >> (2 * TILE_BITS)))
    found, rest = [], np.ones(len(keys), bool)
    for tile in tiles[sizes * dense_share >= cells]:
        inside = keys >> (2 * TILE_BITS) == tile
        rest &= ~inside
        table = np.bincount(keys[inside] & (cells - 1), minlength=cells)
        used = np.flatnonzero(table)
        found.append((tile << (2 * TILE_BITS) | used, table[used]))
    found.append(_runs(np.sort(keys[rest])))
    keys, counts = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    return keys, counts


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
    return ordered[starts], np.diff(np.concatenate((starts, [len(ordered)])))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of sorted coordinate lists."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    distinct, sizes = _runs(keys)
    return distinct, np.add.reduceat(counts, np.cumsum(sizes) - sizes) if len(keys) else counts


def _cut(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` items each, one after the other."""
    offsets = np.concatenate(([0], np.cumsum(sizes))) * values.dtype.itemsize
    array = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return array.cast(pa.binary())


def _partial_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """``bucket, block, keys, counts``: a block's pair counts, dealt out by strips."""
    for batch in batches:
        for block, seq in zip(batch.column("block").to_pylist(), batch.column("seq")):
            keys, counts = tile_counts(pair_keys(np.frombuffer(seq.as_buffer(), np.int32))[1])
            bucket = (mixed((keys >> STRIP_BITS).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            used, sizes = _runs(bucket[order])
            yield pa.record_batch(
                [pa.array(used), pa.array(np.full(len(used), block)), _cut(keys[order], sizes), _cut(counts[order].astype(np.int64), sizes)],
                names=["bucket", "block", "keys", "counts"],
            )


def _sum_bucket(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``bucket, x, y, a``: pairs of a bucket that occur ``least`` times over all blocks."""
    bucket, keys, counts, held, unmerged = None, [], [], 0, HELD
    for batch in batches:
        for i in range(batch.num_rows):
            bucket = batch.column("bucket")[i].as_py()
            keys.append(np.frombuffer(batch.column("keys")[i].as_buffer(), np.int64))
            counts.append(np.frombuffer(batch.column("counts")[i].as_buffer(), np.int64))
            held += len(keys[-1])
            if held > unmerged:
                k, c = _merge(keys, counts)
                keys, counts, held = [k], [c], len(k)
                unmerged = HELD + held
    if bucket is None:
        return
    k, c = _merge(keys, counts)
    k, c = k[c >= least], c[c >= least]
    low = (1 << TILE_BITS) - 1
    tile = k >> (2 * TILE_BITS)
    x = (tile >> (ID_BITS - TILE_BITS) << TILE_BITS) | (k >> TILE_BITS & low)
    y = (tile & ((1 << (ID_BITS - TILE_BITS)) - 1)) << TILE_BITS | (k & low)
    yield pa.record_batch([pa.array(np.full(len(k), bucket, np.int32)), pa.array(x), pa.array(y), pa.array(c)], names=["bucket", "x", "y", "a"])


def _look_up(parts: pa.Table, frequent: pa.Table) -> pa.Table:
    """``block, keys, ids``: of each block's pairs in a bucket those that are frequent."""
    schema = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())])
    if not frequent.num_rows:
        return schema.empty_table()
    known = cell_key(frequent.column("x").to_numpy(), frequent.column("y").to_numpy())
    order = np.argsort(known)
    known, ids = known[order], frequent.column("id").to_numpy()[order].astype(np.int32)
    blocks, found = [], []
    for block, keys in zip(parts.column("block").to_pylist(), parts.column("keys")):
        keys = np.frombuffer(keys.as_buffer(), np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        if hit.any():
            blocks.append(block)
            found.append((keys[hit].tobytes(), ids[at[hit]].tobytes()))
    return pa.table([pa.array(blocks, pa.int64()), pa.array([k for k, _ in found], pa.binary()), pa.array([i for _, i in found], pa.binary())], schema=schema)


def _lengthen(block: pa.Table, found: pa.Table) -> pa.Table:
    """A block's sequence with every frequent pair of neighbours replaced by the pair's id."""
    schema = pa.schema([("block", pa.int64()), ("seq", pa.binary())])
    if not block.num_rows or not found.num_rows:
        return schema.empty_table()
    seq = np.frombuffer(block.column("seq")[0].as_buffer(), np.int32)
    known = np.frombuffer(b"".join(found.column("keys").to_pylist()), np.int64)
    ids = np.frombuffer(b"".join(found.column("ids").to_pylist()), np.int32)
    order = np.argsort(known)
    known, ids = known[order], ids[order]
    at, keys = pair_keys(seq)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    longer = np.full(len(seq), -1, np.int32)
    longer[at] = np.where(known[place] == keys, ids[place], -1)
    return pa.table([block.column("block"), pa.array([longer.tobytes()], pa.binary())], schema=schema)


def _ranked(counted: DataFrame, order: list[str]) -> DataFrame:
    """``counted`` with ``id``, 0 for the most frequent row."""
    placed = with_sorted_position(counted, [F.col("a").desc(), *map(F.col, order)], "id").withColumn("id", F.col("id") - 1)
    # an id beyond the key's bits would be taken for another pair: stop rather than lose counts
    return placed.withColumn("id", F.when(F.col("id") < (1 << ID_BITS), F.col("id")).otherwise(F.raise_error(F.lit("too many frequent runs"))))


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """``lang, k, phrase, a`` of all runs of 1 to ``most`` words that occur ``least`` times, and ``lang, n``, all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blocks = store(rows.mapInArrow(_blocks, "block bigint, seq binary, words array<string>, langs array<string>, counts array<bigint>"), "blocks", "zstd")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "langs", "counts")).alias("local", "w"))
    listed = listed.select("block", "local", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    words = store(listed.groupBy("lang", "word").agg(F.sum("count").alias("a")), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    vocabulary = store(_ranked(words.where(F.col("a") >= least), ["lang", "word"]), "vocabulary")
    ids = listed.join(vocabulary, ["lang", "word"]).select(F.col("block").alias("of"), "local", "id")
    sequences = blocks.select("block", "seq").groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(_encode, "block bigint, seq binary")

    grams = vocabulary.select("id", "lang", F.col("word").alias("phrase"), "a")
    levels = [grams]
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(2, most + 1):
        sequences = store(sequences, "sequences", "zstd")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _partial_counts(batches, buckets)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _sum_bucket(batches, least)

        partial = sequences.mapInArrow(count, "bucket int, block bigint, keys binary, counts binary")
        partial = store(partial, "partial", "zstd")
        summed = partial.select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(add, "bucket int, x bigint, y bigint, a bigint")
        ranked = store(_ranked(store(summed, "pairs"), ["x", "y"]), "ranked")
        left = grams.select(F.col("id").alias("x"), "lang", F.col("phrase").alias("head"))
        right = grams.select(F.col("id").alias("y"), F.substring_index("phrase", " ", -1).alias("tail"))
        grams = ranked.join(left, "x").join(right, "y").select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "a")
        grams = store(grams, "grams")
        levels.append(grams)
        if k < most:
            hits = partial.select("bucket", "block", "keys").groupBy("bucket").cogroup(ranked.groupBy("bucket"))
            hits = hits.applyInArrow(_look_up, "block bigint, keys binary, ids binary")
            sequences = sequences.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(_lengthen, "block bigint, seq binary")
    runs = [g.select("lang", F.lit(k).alias("k"), "phrase", "a") for k, g in enumerate(levels, 1)]
    return reduce(DataFrame.unionByName, runs), totals


def _exact(count: str, factor: int = 1) -> Column:
    """A count times a small factor, beyond 64 bits if need be."""
    return F.col(count).cast("decimal(20,0)") * F.lit(factor).cast("decimal(10,0)")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", most: int = 4, least: int = 30, top: int = 2000,
    scale: int = 2_000_000, cover: int = 80,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of every language by score.

    Words are lower-cased (A-Z) runs without blanks and tabs inside pieces that end at ``.,;:!?`` and line breaks.
    Candidates have 2 to ``most`` words and occur ``a >= least`` times. Cutting a candidate in two parts that occur
    l and r times gives ``floor(scale * a / (l + r))``; the lowest counts, of equal ones the first cut. Candidates
    inside a longer one with at least ``cover`` percent of their own occurrences go. Order: score and
    ``a`` descending, phrase.

    Null and empty texts have no words, a null language is ``und``, repeated rows count each time, an empty table
    gives no rows. Other columns are not read. A text has to fit the memory of a task; there is no other bound on it. At
    most 2**31 frequent runs of one length are possible, more are an error.
    """
    runs, totals = frequent_phrases(docs, lang, text, most, least)
    words = F.split("phrase", " ")
    candidates = runs.where("k > 1")

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("head", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "))
    cuts = cuts.withColumn("tail", F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " "))
    part = runs.select("lang", "phrase", "a")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("whole", _exact("a", scale)).withColumn("parts", _exact("l") + _exact("r"))
    cuts = cuts.withColumn("score", F.expr("whole div parts"))
    scored = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))"
    )
    longer = candidates.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    covered = F.coalesce(_exact("longest", 100) >= _exact("a", cover), F.lit(False))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    parted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    first = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
