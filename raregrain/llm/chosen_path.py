"""Near-duplicate groups by a chosen-path set similarity join.

1. A text becomes its set of shingle hashes, and the set ``COORDINATES`` minwise tokens (the least of its shingles
   under as many hash functions). Equal sets are linked to their first row; only that row goes on.
2. A tree starts with all rows in one node. A node chooses one coordinate, or with some probability two, so that
   it has ``1 / similarity`` children a row on average; a row goes to the child named by its minwise token there. The first
   ``SEEDED`` choices are made at once. Nodes of one row end, nodes of up to ``LEAF`` rows are leaves, larger ones branch
   again, up to ``DEPTH`` choices. A pair at the threshold stays together in some branch with a known probability;
   independent trees are repeated until the chance that all of them miss it is below ``1 - recall``.
3. Leaves are compared exhaustively by a byte of every token: pairs that may be similar join their rows to one cluster, and a leaf
   sends the joins alone, not its pairs. Rows of a node that is still large after ``DEPTH`` choices share as many
   tokens and are one cluster.
4. A row is in one cluster, and its full set travels there once. All pairs of a cluster are compared on full sets,
   and again only what joins them is sent on. A cluster of more than ``BLOCK`` rows is cut into random blocks first; then the
   rows outside its largest component are compared with all of its rows, block by block, so that copies that are linked anyhow,
   however many, are not compared again, and no link between different components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import components, is_space, keyed, mixed, ranges, raw_text, store, text_slices, whole_groups, word_starts_ends

COORDINATES = 64
LEAF = 48
SEEDED, DEPTH = 2, 4
#: Rows of a cluster that are compared with each other, or with as many others, in one go.
BLOCK = 256
#: Standard deviations by which the share of equal tokens may fall below the threshold in a leaf.
SLACK = 4.2

_FACTORS = mixed(mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of every text's distinct shingles; a text with fewer words has its whole sequence, one without words none."""
    offsets, data = raw_text(column)
    starts, ends = word_starts_ends(offsets, data)
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[~is_space(data)])])
    listed = words.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in listed.dictionary.to_pylist()], np.uint64)  # bytes.lower knows A-Z only
    word = hashes[listed.indices.to_numpy()] if len(starts) else np.empty(0, np.uint64)
    first = np.searchsorted(starts, offsets)
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(_shingles(word[begin:end], size))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = mixed(total * np.uint64(0x9FB21C651E98DF25) + words[i : len(words) - size + 1 + i])
    return total


def minwise(sets: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least product of a set's hashes with each of the factors."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(sets), 1 << 14):
        least = np.minimum(least, (sets[start : start + (1 << 14), None] * _FACTORS).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def trees_for(similarity: float, recall: float, depth: int = DEPTH) -> int:
    """Trees after which a pair at ``similarity`` was in a common leaf with probability ``recall``, if leaves lie at ``depth``."""
    second, stays = 1 / similarity - 1, 1.0
    for _ in range(depth):
        kept = similarity * stays
        stays = (1 - second) * kept + second * (1 - (1 - kept) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - stays))


def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """``key, id, n, same, tokens, sketch``: size of the set, its digest, minwise tokens and a byte of each; null where it is empty."""
    for part in text_slices(batches, limit=2 << 20):
        sizes, same, tokens = [], [], []
        for found in shingle_sets(part.column("text"), size):
            sizes.append(len(found))
            same.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            tokens.append(minwise(found) if len(found) else None)
        yield pa.record_batch(
            [part.column("key"), part.column("id"), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(tokens, pa.list_(pa.int32())),
             pa.array([None if t is None else t.astype(np.uint8).tobytes() for t in tokens], pa.binary())],
            names=["key", "id", "n", "same", "tokens", "sketch"],
        )


def _children(node: Column, second: float) -> Column:
    """One or two children of a row's node, by the node's coordinates and the row's ``tokens`` there."""
    draw = F.xxhash64(node, F.lit("second"))
    one = F.pmod(F.xxhash64(node, F.lit("one")), F.lit(COORDINATES))
    other = F.pmod(one + 1 + F.pmod(F.xxhash64(node, F.lit("other")), F.lit(COORDINATES - 1)), F.lit(COORDINATES))

    def child(at: Column) -> Column:
        return F.xxhash64(node, at, F.element_at("tokens", (at + 1).cast("int")))

    two = F.pmod(draw, F.lit(1 << 20)) < F.lit(int(second * (1 << 20)))
    return F.explode(F.when(two, F.array(child(one), child(other))).otherwise(F.array(child(one))))


def _nodes(rows: DataFrame, similarity: float, trees: int, depth: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """``node, key`` of all leaves, and of the nodes that are still large at the greatest depth."""
    second = 1 / similarity - 1
    placed = rows.select("key", "tokens", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
    # roots of different trees start at coordinates of their own
    first = F.pmod(F.col("tree") * 2, F.lit(COORDINATES))
    more = F.pmod(F.xxhash64("tree", F.lit("second")), F.lit(1 << 20)) < F.lit(int(second * (1 << 20)))

    def root(at: Column) -> Column:
        return F.xxhash64("tree", at, F.element_at("tokens", (at + 1).cast("int")))

    level = placed.select("key", "tokens", F.explode(F.when(more, F.array(root(first), root(first + 1))).otherwise(F.array(root(first)))).alias("node"))
    for _ in range(1, min(SEEDED, depth)):
        level = level.select("key", "tokens", _children(F.col("node"), second).alias("node"))
    level, leaves = level.select("key", "node"), None
    for at in range(min(SEEDED, depth), depth + 1):
        level = store(level, "level")
        sizes = store(level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        sized = store(level.join(sizes, "node"), "sized-level")  # one exchange of the level for both
        small, big = (sized.where(fits).select("node", "key") for fits in (F.col("size") <= leaf, F.col("size") > leaf))
        leaves = small if leaves is None else leaves.unionByName(small)
        if at == depth or big.isEmpty():
            break
        level = big.join(rows.select("key", "tokens"), "key").select("key", _children(F.col("node"), second).alias("node"))
    return leaves, big


class _Joined:
    """Union of keys; the smallest key names what has been joined, so that what is sent on is a star and not a chain."""

    def __init__(self, root: dict[int, int] | None = None):
        self.root = dict(root or {})
        self.touched: set[int] = set()

    def find(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = x = self.root.get(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.touched.update((a, b, x, y))

    def links(self) -> pa.RecordBatch:
        pairs = [(self.find(x), x) for x in self.touched if self.find(x) != x]
        return pa.record_batch([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def _compare_tokens(batches: Iterator[pa.RecordBatch], least: int, percent: int, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """``a, b``: joins of each node's rows that have ``least`` equal tokens and sizes that allow the similarity."""
    for table in whole_groups(batches, "node"):
        node, key, n = (table.column(c).to_numpy() for c in ("node", "key", "n"))
        tokens = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        begins = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        place = np.arange(len(node)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(node)]))))
        ends = np.concatenate(([0], np.cumsum(place)))  # a row is compared with those before it in its node
        joined, start = _Joined(), 0
        while start < len(node):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + rows, "right")) - 1)
            b = np.repeat(np.arange(start, stop), place[start:stop])
            a = b - 1 - ranges(place[start:stop])
            may = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
            a, b = a[may], b[may]
            good = (tokens[a] == tokens[b]).sum(axis=1) >= least
            for x, y in zip(key[a[good]].tolist(), key[b[good]].tolist()):
                joined.join(x, y)
            start = stop
        yield joined.links()


def _common(one: np.ndarray, held: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Size of the intersection of a set with each of several sets, ``held`` between ``offsets``; all sorted."""
    at = np.minimum(np.searchsorted(one, held), len(one) - 1)
    hits = np.concatenate(([0], np.cumsum(one[at] == held)))
    return hits[offsets[1:]] - hits[offsets[:-1]]


def _compare_sets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """``a, b``: joins of each cell's rows whose full sets are similar; rows of one component ``part`` are joined already."""
    for table in whole_groups(batches, "cell"):
        cell = table.column("cell").to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))).tolist()
        for begin, end in zip(begins, [*begins[1:], len(cell)]):
            if end - begin < 2:
                continue
            rows = table.slice(begin, end - begin).combine_chunks()
            key, part = (rows.column(c).to_pylist() for c in ("key", "part"))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("shingles")]
            size = np.array([len(s) for s in sets])
            held, offsets = np.concatenate(sets), np.concatenate(([0], np.cumsum(size)))
            joined = _Joined(dict(zip(key, part)))
            for i in range(1, len(sets)):
                # sets before i whose sizes allow the similarity, in components other than that of i
                common = _common(sets[i], held[: offsets[i]], offsets[: i + 1])
                near = np.flatnonzero(100 * common >= percent * (size[:i] + size[i] - common))
                for j in near.tolist():
                    joined.join(key[j], key[i])
            yield joined.links()


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(F.col(group)).sortWithinPartitions(group)


def full_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The rows of ``wanted`` (unique bigints ``key`` and others) with ``shingles``; other texts are not split into words again."""
    names = wanted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=2 << 20):
            found = [s.tobytes() for s in shingle_sets(part.column("text"), size)]
            yield pa.record_batch([*(part.column(n) for n in names), pa.array(found, pa.binary())], names=[*names, "shingles"])

    # by exchange at every size: a broadcast of the keys would spare it for small tables only
    rows = texts.select("key", "text").join(wanted.hint("merge"), "key").select(*names, "text")
    return rows.mapInArrow(run, "".join(f"{n} bigint, " for n in names) + "shingles binary")


def _across(large: DataFrame, block: int) -> DataFrame:
    """``cell, key, part``: rows of clusters outside the cluster's largest component, dealt out with all its rows block by block."""
    sizes = large.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("cluster").agg(F.max_by("part", "rows").alias("main"), F.sum("rows").alias("size"), F.max("rows").alias("most"))
    main = main.where("most < size").select("cluster", "main", F.ceil((F.col("size") - F.col("most")) / block).alias("down"), F.ceil(F.col("size") / block).alias("along"))
    rows = large.join(store(main, "main"), "cluster")
    own = F.xxhash64("key")
    rest = rows.where("part <> main").select("cluster", "key", "part", F.pmod(own, "down").alias("i"), F.explode(F.sequence(F.lit(0), F.col("along") - 1)).alias("j"))
    every = rows.select("cluster", "key", "part", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), F.pmod(own, "along").alias("j"))
    return rest.unionByName(every).select(F.xxhash64("cluster", "i", "j").alias("cell"), "key", "part").distinct()


def near_parts(
    rows: DataFrame, texts: DataFrame, size: int, percent: int, recall: float, leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK
) -> DataFrame:
    """``key, part`` of rows that are joined to others, ``part`` being one row of their component; ``rows`` has ``key, n, tokens, sketch``."""
    share = percent / 100
    least = math.floor(COORDINATES * share - SLACK * math.sqrt(COORDINATES * share * (1 - share)))
    leaves, large = _nodes(rows, share, trees_for(share, recall, depth), depth, leaf)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare_tokens(batches, least, percent)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare_sets(batches, percent)

    met = leaves.join(rows.select("key", "n", "sketch"), "key")
    large = store(large, "large")
    first = store(large.groupBy("node").agg(F.min("key").alias("a")), "first")
    joins = _dealt(met, "node").mapInArrow(tokens, "a bigint, b bigint").unionByName(large.join(first, "node").select("a", F.col("key").alias("b")))
    clusters = store(components(joins).select(F.col("node").alias("key"), F.col("root").alias("cluster")), "clusters")
    sized = store(clusters.join(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")), "cluster"), "sized")

    blocks = F.pmod(F.xxhash64("key"), F.ceil(F.col("rows") / block))
    # a set takes its cell along from the join with its text: no exchange by key of its own
    full = store(full_sets(texts, sized.select("key", F.xxhash64("cluster", blocks).alias("cell")), size), "sets")
    links = _dealt(full.withColumn("part", F.col("key")), "cell").mapInArrow(sets, "a bigint, b bigint")
    # a row is in one cell, which names its component: what is sent is a star already
    parts = store(links.select(F.col("b").alias("key"), F.col("a").alias("part")), "parts")
    wide = sized.where(F.col("rows") > block).select("cluster", "key")
    if wide.isEmpty():
        return parts
    wide = store(wide.join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")), "wide")
    more = store(_dealt(_across(wide, block).join(full.drop("cell"), "key"), "cell").mapInArrow(sets, "a bigint, b bigint"), "links")
    if more.isEmpty():
        return parts
    # components that the second comparison has joined
    joined = store(components(more).select(F.col("node").alias("part"), F.col("root")), "joined")
    rows = parts.unionByName(wide.where("key = part").select("key", "part"))
    return store(rows.join(joined, "part", "left").select("key", F.coalesce("root", "part").alias("part")), "parts")


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80, recall: float = 0.9999,
    leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK,
) -> DataFrame:
    """``<key>, n_shingles, component_id, kept`` for every row of ``docs``.

    Rows are linked when ``100 * intersection >= percent * union`` of their sets of ``size``-word shingles (words are
    lower-cased A-Z and separated by ASCII white space). The component is the smallest key reachable, and the row that has it
    is kept. ``recall`` is the chance that the trees bring a pair at the threshold together; what they bring
    together is confirmed on full sets, so no wrong link is made.

    Null and empty texts have no shingles and are linked with nothing. A null key never names a component that has another
    key; of rows that repeat a key one is kept. An empty table gives no rows. Other columns are not read. A text
    has to fit the memory of a task; there is no other bound on it.
    """
    texts = keyed(docs, key, text)
    given = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sketched(batches, size)

    base = store(texts.mapInArrow(run, f"key bigint, id {given}, n bigint, same binary, tokens array<int>, sketch binary"), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "key")).alias("keep")
    groups = base.where("n > 0").groupBy("same").agg(F.min("key").alias("key"), F.min("id").alias("id"), first)
    groups = store(groups, "groups")
    rows = store(base.join(groups.select("key"), "key", "left_semi").select("key", "n", "tokens", "sketch"), "rows")
    roots = near_parts(rows, texts, size, percent, recall, leaf, depth, block).withColumnRenamed("part", "root")
    placed = store(groups.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "roots")
    named = placed.groupBy("root").agg(F.min("id").alias("component_id"), F.min("keep").alias("keep"))
    names = store(placed.select("same", "root").join(named, "root").select("same", "component_id", F.col("keep.key").alias("keep")), "names")
    out = base.select("key", "id", "n", "same").join(names, "same", "left")
    alone = F.col("same").isNull()
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("key") == F.col("keep"))).alias("kept"),
    )
