"""Exact substring dedup with suffix arrays, sharded so that equal strings meet.

1. Every window of ``WINDOW`` bytes is owned by its anchor, the lowest-hashed ``GRAM``-byte string inside
   it, which depends on the window's bytes only. Equal windows have equal anchors. Anchors are counted over
   the whole table; windows with an anchor that occurs once are unique, and no more is done for them.
2. Texts with repeated anchors give, per anchor, the run of windows it owns and the bytes these windows
   cover (the context). Contexts go to shards by anchor; an anchor with more than ``GROUP`` occurrences is
   dealt to several shards, the same number in every task because its count is known. Equal contexts of
   one anchor collapse to the earliest, first inside the task that cuts them.
3. A shard puts its contexts in one byte string and builds its suffix array by Larsson-Sadakane
   refinement: suffixes are sorted by their first 8 bytes, then groups that are still tied are sorted by the
   rank of the suffix 8, 16, 32, 64 bytes further on. Kasai's common prefixes, run along all contexts at
   once, cut the array into runs of equal windows; the earliest of a run stays, the others are removed.
4. Winners of anchors that were dealt to several shards are merged across these shards by binary search in
   sorted windows.
5. Removed windows are gathered per text, whose bytes they cover are taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import BYTE_VALUES, keyed, lowest_places, mixed, raw_text, store, text_slices

WINDOW, GRAM = 100, 32
#: Occurrences of an anchor that go to one shard.
GROUP = 4096
#: Bytes of contexts in one suffix array, more if one anchor has more.
SHARD_BYTES = 4 << 20
#: Texts are hashed in pieces of this many window starts.
PIECE = 4 << 20


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size``-byte string (a power of two)."""
    h, done = BYTE_VALUES[data], 1
    while done < size:
        if len(h) <= done:
            return np.empty(0, np.uint64)
        h = mixed(h[:-done] * np.uint64(0x9FB21C651E98DF25) + h[done:])
        done *= 2
    return h


def owned_runs(offsets: np.ndarray, data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, text, first start (in its text) and number of every run of windows with one anchor."""
    found = []
    for begin in range(0, max(1, len(data) - window + 1), PIECE):
        part = data[begin : begin + PIECE + window - 1]
        if len(part) < window:
            break
        hashes = gram_hashes(part, gram)
        place = lowest_places(hashes, window - gram + 1)
        # a window is inside a text if it starts at or behind its start and ends in it
        step = np.zeros(len(place) + 1, np.int64)
        first, last = offsets[:-1] - begin, offsets[1:] - begin - window
        fits = (last >= first) & (last >= 0) & (first < len(place))
        np.add.at(step, np.maximum(first[fits], 0), 1)
        np.add.at(step, np.minimum(last[fits] + 1, len(place)), -1)
        inside = np.cumsum(step[:-1]) > 0
        same = np.concatenate(([False], (place[1:] == place[:-1]) & inside[1:] & inside[:-1]))
        starts = np.flatnonzero(inside & ~same)
        ends = np.flatnonzero(inside & ~np.concatenate((same[1:], [False])))
        text = np.searchsorted(offsets, starts + begin, "right") - 1
        found.append((hashes[place[starts]], text, starts + begin - offsets[text], ends - starts + 1))
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes at least, and the 8 bytes at every place."""
    n = len(text)
    eight = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        eight = (eight[:-width] << np.uint64(8 * width)) | eight[width:]
    eight = eight[:n]
    order = np.argsort(eight)
    slot = np.arange(n)
    fresh = np.concatenate(([True], eight[order[1:]] != eight[order[:-1]]))
    head = np.maximum.accumulate(np.where(fresh, slot, 0))
    rank = np.zeros(n + depth + 8, np.int64)  # beyond the end: smaller than any
    rank[order] = head + 1
    done = 8
    tied = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))))
    while done < depth and len(tied):
        suffix = order[tied]
        key = (rank[suffix] << 32) | rank[suffix + done]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[suffix] = head + 1
        tied = tied[~(fresh & np.concatenate((fresh[1:], [True])))]
        done *= 2
    return order, eight


def common_prefixes(
    text: np.ndarray, order: np.ndarray, eight: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limit: int
) -> np.ndarray:
    """Length (at most ``limit``) that every suffix shares with the one before it in ``order``.

    Kasai's walk from left to right, where a suffix shares at least one less than its left neighbour, is
    taken in all contexts at once. Suffixes that tie beyond the sorted depth may break that rule, so lengths
    that reach ``limit`` are compared in full, eight bytes at a time; what fails is set to 0.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((text, np.zeros(limit + 1, np.uint8)))
    shared = np.zeros(n, np.int64)
    known = np.zeros(len(starts), np.int64)
    for step in range(int(lengths.max(initial=0))):
        lane = np.flatnonzero(lengths > step)
        here = starts[lane] + step
        left = before[here]
        reach = np.maximum(known[lane] - 1, 0)
        reach[left < 0] = 0
        going = np.flatnonzero((left >= 0) & (reach < limit))
        while len(going):
            i, j = here[going] + reach[going], left[going] + reach[going]
            going = going[(padded[i] == padded[j]) & (i < n) & (j < n)]
            reach[going] += 1
            going = going[reach[going] < limit]
        known[lane] = reach
        shared[here] = reach
    full = np.flatnonzero(shared >= limit)
    equal = np.ones(len(full), bool)
    for step in (*range(0, limit - 8, 8), max(0, limit - 8)):
        equal &= eight[full + step] == eight[before[full] + step]
    shared[full[~equal]] = 0
    return shared


def repeated_windows(
    contexts: list[bytes], counts: np.ndarray, keys: np.ndarray, starts: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, window in it, and whether it is the earliest of its equals, for the owned windows of a shard."""
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    text = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.cumsum(lengths) - lengths
    order, eight = suffix_array(text, window)
    shared = common_prefixes(text, order, eight, at, lengths, window)
    run = np.cumsum(shared[order] < window)
    context = np.repeat(np.arange(len(contexts)), lengths)[order]
    inner = order - at[context]
    own = inner < counts[context]
    run, context, inner = run[own], context[own], inner[own]
    by = np.lexsort((starts[context] + inner, keys[context], run))
    run, context, inner = run[by], context[by], inner[by]
    return context, inner, np.concatenate(([True], run[1:] != run[:-1]))


_SHARDED = "h bigint, salt int, key bigint, start bigint, n int, context binary"
_JUDGED = "salt int, key bigint, start bigint, n int, winner binary"
_JUDGED_ARROW = pa.schema([("salt", pa.int32()), ("key", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("winner", pa.binary())])


def _judged(salt, key, start, n, winner) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip((salt, key, start, n, winner), _JUDGED_ARROW)], schema=_JUDGED_ARROW)


def _removed(key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Single windows as runs."""
    by = np.lexsort((start, key))
    key, start = key[by], start[by]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(key)])))
    none = [None] * len(first)
    return _judged(np.full(len(first), -1), key[first], start[first], n, none)


def _judge(rows: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    """Removed runs and, for salted anchors, winners, of one shard's rows (h, salt, key, start, n, context)."""
    best: dict[tuple, tuple] = {}
    lost = []
    for h, salt, key, start, n, context in rows:
        held = best.get((h, context))
        if held is None:
            best[h, context] = (salt, key, start, n)
        elif (key, start) < held[1:3]:
            best[h, context] = (salt, key, start, n)
            lost.append(held[1:])
        else:
            lost.append((key, start, n))
    if lost:
        key, start, n = zip(*lost)
        yield _judged([-1] * len(lost), key, start, n, [None] * len(lost))
    rivals: dict[int, int] = {}
    for h, _ in best:
        rivals[h] = rivals.get(h, 0) + 1
    kept = [(c, *v) for (h, c), v in best.items() if rivals[h] > 1 or v[0] >= 0]
    if not kept:
        return
    contexts, salts, keys, starts, counts = zip(*kept)
    keys, starts, salts = np.array(keys, np.int64), np.array(starts, np.int64), np.array(salts, np.int32)
    context, inner, first = repeated_windows(list(contexts), np.array(counts, np.int64), keys, starts, window)
    if not first.all():
        yield _removed(keys[context[~first]], (starts[context] + inner)[~first])
    won = np.flatnonzero(first & (salts[context] >= 0))
    for part in np.array_split(won, max(1, len(won) // 10_000)) if len(won) else ():
        c, i = context[part], inner[part]
        windows = [contexts[a][b : b + window] for a, b in zip(c, i)]
        yield _judged(salts[c], keys[c], starts[c] + i, np.ones(len(part), np.int32), windows)


def _merge_winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Losers among equal windows that won in different shards: binary search in the sorted windows so far."""
    shards: dict[int, list[tuple]] = {}
    for batch in batches:
        for salt, key, start, winner in zip(*(batch.column(c).to_pylist() for c in ("salt", "key", "start", "winner"))):
            shards.setdefault(salt, []).append((winner, key, start))
    held = None
    for rows in shards.values():
        rows.sort()
        sorted_ = np.array([w for w, _, _ in rows], dtype=object)
        key, start = np.array([k for _, k, _ in rows], np.int64), np.array([s for _, _, s in rows], np.int64)
        if held is None:
            held = (sorted_, key, start)
            continue
        old, old_key, old_start = held
        at = np.searchsorted(old, sorted_)
        match = (at < len(old)) & (old[np.minimum(at, len(old) - 1)] == sorted_)
        there = at[match]
        later = (key[match] > old_key[there]) | ((key[match] == old_key[there]) & (start[match] > old_start[there]))
        lost_key = np.where(later, key[match], old_key[there])
        lost_start = np.where(later, start[match], old_start[there])
        if match.any():
            yield _removed(lost_key, lost_start)
        old_key[there], old_start[there] = np.where(later, old_key[there], key[match]), np.where(later, old_start[there], start[match])
        new = ~match
        held = tuple(np.insert(o, at[new], x[new]) for o, x in zip(held, (sorted_, key, start)))


def removed_runs(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``key, start, n``: runs of windows of ``texts`` (unique ``key``, ``text``) that also start earlier."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=1 << 20):
            offsets, data = raw_text(part.column("text"))
            h, text, start, n = owned_runs(offsets, data, window, gram)
            keys = part.column("key").to_numpy()[text]
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(keys), pa.array(start), pa.array(n.astype(np.int32))], ["h", "key", "start", "n"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            best, lost = {}, []
            for key, text, runs in zip(part.column("key").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), part.column("runs").to_pylist()):
                for r in runs:
                    row = (key, r["start"], r["n"])
                    same = (r["h"], r["salt"], text[r["start"] : r["start"] + r["n"] + window - 1])
                    held = best.get(same)
                    if held is None or row < held:
                        best[same] = row
                        row = held
                    if row is not None:
                        lost.append(row)
            h, salt, context = zip(*best)
            key, start, n = zip(*best.values())
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            names = ["h", "salt", "key", "start", "n", "context"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip((h, salt, key, start, n, context), kinds)], names)
            if lost:
                key, start, n = zip(*lost)
                # spread like anchors, passed through by the shards
                yield pa.record_batch([pa.array(c, t) for c, t in zip((key, [-1] * len(lost), key, start, n, [None] * len(lost)), kinds)], names)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[5] is None:
                    held.append(row)
                    continue
                if size >= shard_bytes and row[:2] != last:
                    yield from finish(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[5]), row[:2]
        yield from finish(held)

    def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        passed = [r for r in rows if r[5] is None]
        if passed:
            _, _, key, start, n, none = zip(*passed)
            yield _judged([-1] * len(passed), key, start, n, none)
        yield from _judge([r for r in rows if r[5] is not None], window)

    runs = texts.select("key", "text").mapInArrow(anchors, "h bigint, key bigint, start bigint, n int")
    # stored, so that the join below has an exchange on both sides and splits a frequent anchor
    often = store(runs.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
    parts = F.ceil(F.col("c") / group)
    salt = F.when(F.col("c") > group, F.pmod(F.xxhash64("key"), parts).cast("int")).otherwise(F.lit(-1))
    wanted = store(runs.join(often, "h").select("key", F.struct("start", "n", "h", salt.alias("salt")).alias("run")), "anchors")
    lists = wanted.groupBy("key").agg(F.collect_list("run").alias("runs"))
    cut = texts.select("key", "text").join(lists, "key").mapInArrow(contexts, _SHARDED)
    dealt = cut.repartition("h", "salt").sortWithinPartitions("h", "salt")
    judged = store(dealt.mapInArrow(shards, _JUDGED), "judged")
    winners = judged.where("winner is not null").repartition(F.xxhash64("winner"))
    merged = winners.mapInArrow(_merge_winners, _JUDGED)
    return judged.where("winner is null").select("key", "start", "n").unionByName(merged.select("key", "start", "n"))


def covered(starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Maximal removed byte runs ``[start, stop)`` from runs of windows."""
    by = np.argsort(starts)
    begin, stop = starts[by], np.maximum.accumulate(starts[by] + counts[by] - 1 + window)
    first = np.flatnonzero(np.concatenate(([True], begin[1:] > stop[:-1])))
    return np.stack((begin[first], stop[np.concatenate((first[1:] - 1, [len(begin) - 1]))]), axis=1)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``<key>, n_bytes, n_removed, n_spans, spans, kept`` for every row of ``docs``.

    ``kept`` are the UTF-8 bytes of the text without each byte covered by a ``window``-byte string that also
    starts earlier: in a row with a smaller key, or in the same row further left. A null text is empty. Rows
    with null or repeated keys come in the order of key (null first), text hash and place. Other columns are
    not read.
    """
    texts = keyed(docs, key, text)
    lists = removed_runs(texts, window, gram, group, shard_bytes).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = []
            for body, runs in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("runs").to_pylist()):
                body, spans = body or b"", np.empty((0, 2), np.int64)
                if runs:
                    spans = covered(np.array([r["start"] for r in runs]), np.array([r["n"] for r in runs]), window)
                edges = [0, *spans.ravel().tolist(), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(body), len(body) - len(kept), len(spans), [{"start": a, "stop": b} for a, b in spans.tolist()], kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            yield pa.record_batch(
                [part.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
            )

    out = texts.join(lists, "key", "left").select(F.col("id").cast("bigint").alias("id"), "text", "runs").mapInArrow(
        run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    )
    return out.withColumnRenamed("id", key)
