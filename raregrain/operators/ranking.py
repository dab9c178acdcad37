"""Exact positions, cut points and running sums that never sort a group in one task.

A plain ``row_number() over (partition by label order by hash)`` sends each label
to one task, and with a rare label the other class is nearly the whole table.
Four forms replace it:

* :func:`hash_parts` — cuts every stratum at exact ranks *without shuffling rows*:
  a 65,536-bucket histogram of the hash finds the bucket of each cut, only the
  rows of those buckets are looked at again, and the cut points found are compared
  with each row in a map-side join.
* :func:`with_position` — exact 1-based position of every row in hash order:
  positions inside a histogram bucket plus the number of rows in earlier buckets.
* :func:`with_sorted_position` — the same in the order of any columns.
* :func:`running_sums` — running totals in the order of any columns: totals inside
  range slices plus the totals of earlier slices.

The windows without partitioning below run over bucket or slice tables, whose size
is fixed (65,536) or the number of shuffle partitions, never over data rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.hashing import HASH_BITS, hash_key
from raregrain.session import attach_small, freeze

BUCKET_BITS = 16
#: Rows of a bucket that one task sorts; larger buckets are cut into range slices.
HOT_BUCKET_ROWS = 5_000_000
#: A table known to have no more rows is summed in one task, without slices.
FEW_ROWS = 100_000


def _bucket(hashed: str = "_h") -> Column:
    return F.shiftright(F.col(hashed), HASH_BITS - BUCKET_BITS)


def _below(hist: DataFrame, strata: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add rows in earlier buckets of the stratum, and rows of the whole stratum."""
    ordered = Window.partitionBy(*strata).orderBy(*order)
    whole = Window.partitionBy(*strata)
    return hist.withColumns(
        {"_below": F.sum("_n").over(ordered) - F.col("_n"), "_total": F.sum("_n").over(whole)}
    )


def hash_parts(
    df: DataFrame,
    key: str,
    seed: int,
    ranks: Callable[[Column], Sequence[Column]],
    strata: Sequence[str] = (),
    out: str = "part",
) -> DataFrame:
    """Cut every stratum, in hash order, after the given ranks; ``out`` is the 0-based part.

    ``ranks`` maps the stratum's row count to its ascending cut ranks. A row's
    rank is one plus the number of rows with a smaller ``(hash, key)``, so with
    unique keys the parts have exactly the asked sizes; copies of one key always
    share a part, which keeps them from straddling train and test.

    Cost: three scans, no shuffle of data rows.
    """
    strata = list(strata)
    n_cuts = len(ranks(F.lit(0)))
    keyed = df.select(*strata, F.col(key).alias("_k"), hash_key(key, seed).alias("_h"))
    hist = keyed.groupBy(*strata, _bucket().alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = F.array(
        *[F.struct(F.lit(j).alias("j"), c.cast("bigint").alias("c")) for j, c in enumerate(ranks(F.col("_total")))]
    )
    wanted = freeze(
        _below(hist, strata, ["_b"])
        .select(*strata, "_b", "_below", "_n", F.explode(cuts).alias("_cut"))
        .where((F.col("_cut.c") > F.col("_below")) & (F.col("_cut.c") <= F.col("_below") + F.col("_n")))
        .groupBy(*strata, "_b", "_below")
        .agg(F.collect_list("_cut").alias("_cuts"))
    )
    # Copies of a key collapse to one row before the shuffle, so a bucket window
    # only ever sees distinct keys: about 1/65,536 of the stratum.
    edge = (
        attach_small(keyed.withColumn("_b", _bucket()), wanted, [*strata, "_b"])
        .groupBy(*strata, "_b", "_below", "_cuts", "_h", "_k")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    before = Window.partitionBy(*strata, "_b").orderBy("_h", "_k")
    found = (
        edge.withColumn("_rank", F.col("_below") + F.sum("_n").over(before) - F.col("_n") + 1)
        .select(*strata, "_h", "_k", "_rank", F.explode("_cuts").alias("_cut"))
        .where(F.col("_rank") <= F.col("_cut.c"))
        .groupBy(*strata, F.col("_cut.j").alias("_j"))
        .agg(F.max(F.struct("_h", "_k")).alias("_last"))
    )
    hashed = df.withColumn("_h", hash_key(key, seed))
    row = F.struct(F.col("_h"), F.col(key).alias("_k"))
    if strata:
        by_cut = F.map_from_entries(F.collect_list(F.struct("_j", "_last")))
        lookup = freeze(found.groupBy(*strata).agg(by_cut.alias("_lasts")))
        # A stratum with no cut inside it (all cut ranks 0) has no row here: left join.
        hashed = attach_small(hashed, lookup, strata, "left")
        lasts = [F.try_element_at("_lasts", F.lit(j)) for j in range(n_cuts)]
    else:
        # The few cut points of one stratum become constants instead of a join.
        kind = df.schema[key].dataType
        lasts: list[Column | None] = [None] * n_cuts
        for cut in found.collect():
            h, k = cut["_last"]
            lasts[cut["_j"]] = F.struct(F.lit(h).cast("bigint").alias("_h"), F.lit(k).cast(kind).alias("_k"))
    # below no cut point: in the part after it
    above = [F.lit(True) if last is None else F.coalesce(row > last, F.lit(True)) for last in lasts]
    part = sum((a.cast("int") for a in above), F.lit(0))
    return hashed.withColumn(out, part).drop("_h", "_lasts")


def with_position(
    df: DataFrame,
    key: str,
    seed: int,
    strata: Sequence[str] = (),
    out: str = "position",
    hot_rows: int = HOT_BUCKET_ROWS,
) -> DataFrame:
    """Exact 1-based position of every row of a stratum in ``(hash, key, content)`` order.

    One shuffle of the rows, on the hash bucket, so tasks are even whatever the
    label distribution. Rows of a bucket with more than ``hot_rows`` rows (copies
    of a key, or a very large table) are placed by range slices instead, in the
    same order; only the plan depends on ``hot_rows``. Identical rows take their
    positions in any order.
    """
    strata = list(strata)
    cell = [*strata, "_b"]
    content = F.xxhash64(*[F.col(c) for c in df.columns])
    keyed = df.withColumns({"_h": hash_key(key, seed), "_content": content}).withColumn("_b", _bucket())
    hist = freeze(keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")))
    offsets = _below(hist, strata, ["_b"]).drop("_total")
    inside = Window.partitionBy(*cell).orderBy("_h", key, "_content")
    even = attach_small(keyed, offsets.where(F.col("_n") <= hot_rows).drop("_n"), cell)
    placed = even.withColumn(out, (F.col("_below") + F.row_number().over(inside)).cast("bigint"))
    hot = offsets.where(F.col("_n") > hot_rows)
    if not hot.isEmpty():
        # how far the position in the stratum is ahead of that among all hot rows
        earlier = Window.orderBy(*cell)
        ahead = F.col("_below") - (F.sum("_n").over(earlier) - F.col("_n"))
        hot = freeze(hot.select(*cell, ahead.alias("_ahead")))
        rows = attach_small(keyed, hot, cell).withColumn("_scan", F.monotonically_increasing_id())
        order = [F.col(c) for c in (*cell, "_h", key, "_content", "_scan")]
        sliced = with_sorted_position(rows, order, "_pos")
        position = (F.col("_pos") + F.col("_ahead")).cast("bigint")
        placed = placed.select(*df.columns, out).unionByName(sliced.withColumn(out, position).select(*df.columns, out))
    return placed.select(*df.columns, out)


def with_sorted_position(df: DataFrame, order_by: Sequence[Column], out: str = "position") -> DataFrame:
    """1-based position of every row in the order of ``order_by``, which must identify rows.

    The table is range-partitioned, sorted inside the slices and frozen together
    with a row number that holds slice and place in the slice; the rows of earlier
    slices are then added. One shuffle of the rows.
    """
    place_bits = 33  # of monotonically_increasing_id
    sliced = freeze(
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_m", F.monotonically_increasing_id())
    ).withColumn("_slice", F.shiftright("_m", place_bits))
    totals = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _below(totals, [], ["_slice"]).select("_slice", "_below")
    place = F.col("_m").bitwiseAND(F.lit((1 << place_bits) - 1))
    return (
        attach_small(sliced, offsets, ["_slice"])
        .withColumn(out, (F.col("_below") + place + 1).cast("bigint"))
        .drop("_m", "_slice", "_below")
    )


def running_sums(df: DataFrame, order_by: Sequence[Column], sums: Mapping[str, Column | str], rows: int | None = None) -> DataFrame:
    """Running totals in the order of ``order_by``, which must identify rows.

    The table is range-partitioned and frozen, so the slice a row belongs to is
    settled once; slice totals (one row per slice) give the offsets. ``rows`` is a bound on the table's rows where the
    caller knows one: up to ``FEW_ROWS`` need no slices.
    """
    names = list(sums)
    columns = df.columns
    if rows is not None and rows <= FEW_ROWS:
        upto = Window.partitionBy(F.lit(0)).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
        return df.coalesce(1).select(*columns, *[F.sum(F.col(c) if isinstance(c, str) else c).over(upto).alias(n) for n, c in sums.items()])
    sliced = freeze(
        df.withColumns({f"_v_{n}": F.col(c) if isinstance(c, str) else c for n, c in sums.items()})
        .repartitionByRange(*order_by)
        .withColumn("_slice", F.spark_partition_id())
    )
    totals = sliced.groupBy("_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    earlier = Window.orderBy("_slice")
    offsets = totals.select(
        "_slice", *[(F.sum(f"_t_{n}").over(earlier) - F.col(f"_t_{n}")).alias(f"_o_{n}") for n in names]
    )
    inside = Window.partitionBy("_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return attach_small(sliced, offsets, ["_slice"]).select(
        *columns, *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}")).alias(n) for n in names]
    )


def stratified_running_sums(
    df: DataFrame, strata: Sequence[str], order_by: Sequence[Column], sums: Mapping[str, str], rows: int | None = None
) -> DataFrame:
    """Running totals inside every stratum in the order of ``order_by``, which must identify a stratum's rows.

    As :func:`running_sums`, with slices of the order of stratum and row: a large stratum has many slices and a slice may
    hold many strata. Totals per slice and stratum, at most one more than there are slices and strata, give the offsets.
    """
    names, strata = list(sums), list(strata)
    if rows is not None and rows <= FEW_ROWS:
        upto = Window.partitionBy(*strata).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
        return df.coalesce(1).select(*df.columns, *[F.sum(c).over(upto).alias(n) for n, c in sums.items()])
    sliced = freeze(df.repartitionByRange(*strata, *order_by).withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy(*strata, "_slice").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*strata).orderBy("_slice")
    offsets = totals.select(*strata, "_slice", *[(F.sum(f"_t_{n}").over(earlier) - F.col(f"_t_{n}")).alias(f"_o_{n}") for n in names])
    inside = Window.partitionBy(*strata, "_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return attach_small(sliced, freeze(offsets), [*strata, "_slice"]).select(
        *df.columns, *[(F.sum(c).over(inside) + F.col(f"_o_{n}")).alias(n) for n, c in sums.items()]
    )
