"""Mixing sources to target sizes by subset-sum budget fitting.

Sources share a budget by weight; a source's target stops at ``cap`` times its size and the excess is
reshared. A source is repeated whole as often as its target allows; for the remaining budget its
documents are counted by exact length, most of it is spread over all lengths in proportion, and a bounded
knapsack over the lengths' left-over counts fits the rest to the token. Which documents of a length are
taken is settled by a seeded hash, never by place or layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.llm.common import raw_text, store, text_slices, word_starts_ends
from raregrain.operators.ranking import with_sorted_position

WEIGHTS = (5.0, 2.0, 1.0)
#: The knapsack settles at most this many words; what is above it is spread over all lengths first.
KNAPSACK_WORDS = 1 << 16
#: Documents of one length and source that are ranked together.
RANK_ROWS = 1024


def word_counts(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key, source, size`` for every row; a null text has size 0."""
    kinds = pa.schema([("key", pa.int64()), ("source", pa.string()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            offsets, data = raw_text(part.column("text"))
            starts, _ = word_starts_ends(offsets, data)
            size = np.diff(np.searchsorted(starts, offsets))
            yield pa.record_batch([part.column("key"), part.column("source").cast(pa.string()), pa.array(size.astype(np.int64))], schema=kinds)

    columns = [F.col(key).cast("bigint").alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")]
    return docs.select(*columns).mapInArrow(run, "key bigint, source string, size bigint")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``source, source_size, target`` per source of ``sized``, sources weighing by code-point order, null last.

    The fill level (budget per unit of weight) rises until the capped sources no longer change; every
    round is one aggregate over the sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = with_sorted_position(sums, [F.col("source").asc_nulls_last()], "place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = store(placed.withColumn("weight", F.get(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int"))), "sources")
    budget = float(share) * (placed.agg(F.sum("source_size")).first()[0] or 0)
    level, top = 0.0, cap * F.col("source_size")
    capped = -1
    while True:
        full = top <= F.lit(level) * F.col("weight")
        at_cap, used, weight = placed.agg(
            F.count_if(full), F.sum(F.when(full, top).otherwise(F.lit(0.0))), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight")))
        ).first()
        if not weight or at_cap == capped:
            break
        capped, level = at_cap, (budget - used) / weight
    return placed.select("source", "source_size", F.least(top, F.lit(level) * F.col("weight")).cast("double").alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, limit: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many of ``counts`` items of each length to take so that the sum comes nearest to ``budget`` from below.

    All but the last ``limit`` words are spread over the lengths in proportion, carrying what a length
    cannot take to the next; the rest is a bounded knapsack, counts split into powers of two.
    """
    order = np.argsort(-lengths)
    size, left = lengths[order].astype(object), counts[order].astype(object)
    total = sum(int(s) * int(c) for s, c in zip(size, left))
    budget = min(int(budget), total)
    taken = [0] * len(size)
    spread, carry = max(0, budget - limit // 2), 0
    if total and spread:
        for i, (s, c) in enumerate(zip(size, left)):
            carry += int(s) * int(c) * spread
            taken[i] = min(int(c), carry // (int(s) * total)) if s else 0
            carry -= taken[i] * int(s) * total
    rest = budget - sum(t * int(s) for t, s in zip(taken, size))
    # reachable sums as the bits of a number; each step remembers what was reachable before it
    reach, steps, mask = 1, [], (1 << (rest + 1)) - 1
    for i in reversed(range(len(size))):
        s, free, chunk = int(size[i]), int(left[i]) - taken[i], 1
        free = min(free, rest // s) if s else 0
        while free > 0 and not reach >> rest & 1:
            n = min(chunk, free)
            steps.append((i, n, reach))
            reach = (reach | reach << (n * s)) & mask
            free, chunk = free - n, chunk * 2
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * int(size[i])
    out = np.empty(len(size), np.int64)
    out[order] = np.array(taken, dtype=np.int64)
    return out


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5, cap: float = 2.0, seed: int = 42,
) -> DataFrame:
    """``<key>, size, source_size, target, taken`` for every row; ``taken`` is a multiple of ``size``.

    Null texts have size 0 and take nothing, null sources are one source, repeated rows are documents of
    their own (told apart by a stored row number), and a table without words has targets of 0. Other
    columns are not read. No document is taken more than ``ceil(cap)`` times.
    """
    sized = store(word_counts(docs, key, text, source).withColumn("row", F.monotonically_increasing_id()), "sized")
    sized = sized.withColumn("h", F.xxhash64("key", F.lit(seed)))
    targets = store(source_targets(sized, weights, share, cap), "targets")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        whole, size = int(group["source_size"].iloc[0]), group["size"].to_numpy()
        target = float(group["target"].iloc[0])
        base = int(target // whole) if whole else 0
        extra = fit_counts(size, group["n"].to_numpy(), int(round(target)) - base * whole)
        return pd.DataFrame({"source": group["source"], "size": size, "n": group["n"], "source_size": whole, "target": target, "base": base, "extra": extra})

    # one row per source and length: bounded by the longest document, whatever the number of rows
    lengths = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    lengths = lengths.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plans = lengths.groupBy("source").applyInPandas(
        plan, "source string, size bigint, n bigint, source_size bigint, target double, base bigint, extra bigint"
    )
    plans = store(plans, "plans").withColumnsRenamed({"source": "s", "size": "l"})
    marked = sized.join(plans, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l"))).drop("s", "l")
    marked = store(marked.withColumn("bucket", F.pmod("h", F.ceil(F.col("n") / RANK_ROWS))), "marked")

    # hash buckets in order are taken whole until the one in which the count ends; only that one is ranked
    some = marked.where("extra > 0 and extra < n")
    group = ["source", "size"]
    cells = some.groupBy(*group, "bucket", "extra").agg(F.count(F.lit(1)).alias("m"))
    cells = store(_running(cells, group), "cells")
    cut = cells.withColumn("quota", F.greatest(F.lit(0), F.least("m", F.col("extra") - F.col("before"))))
    cut = cut.select(F.col("source").alias("s"), F.col("size").alias("l"), F.col("bucket").alias("b"), "m", "quota")
    some = some.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")) & (F.col("bucket") == F.col("b")))
    sure = some.where("quota = 0 or quota = m").withColumn("more", (F.col("quota") > 0).cast("bigint"))
    ranked = some.where("quota > 0 and quota < m").withColumn("rank", _rank([*group, "bucket"]))
    ranked = ranked.withColumn("more", (F.col("rank") <= F.col("quota")).cast("bigint"))
    plain = marked.where("extra = 0 or extra >= n").withColumn("more", (F.col("extra") > 0).cast("bigint"))

    def out(df: DataFrame) -> DataFrame:
        return df.select(F.col("key").alias(key), "size", "source_size", "target", ((F.col("base") + F.col("more")) * F.col("size")).alias("taken"))

    return out(plain).unionByName(out(sure)).unionByName(out(ranked))


def _running(cells: DataFrame, group: list[str]) -> DataFrame:
    earlier = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))


def _rank(group: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy("h", "key", "row"))
