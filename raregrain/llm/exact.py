"""Exact dedup by skew-safe combining, in DataFrame operations only.

1. Every row's digest is stored, and rows are counted per salted digest group, then per digest.
   Digests with more than ``hot_share`` of all rows are hot; there are at most ``1 / hot_share``,
   so that their list can be broadcast.
2. Content pass: rows are grouped by digest, salt and *whole content*. The partial aggregate does
   this inside each task first, so a task sends one row per content however often it occurs; hot
   digests are spread over salts, others have one salt.
3. Salt winners of hot digests are combined globally, again by whole content. Content travels once,
   and twice for the few hot ones only.
4. A digest with more than one content (none is known for SHA-256) is settled by content itself;
   every other row finds its group by digest.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raregrain.llm.common import store

HOT_SHARE = 1 / 10_000
SALTS = 64


def lower_ascii(text: str | Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def exact_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = lambda sha: sha,
    hot_share: float = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """``<key>, keep_id, group_size, kept, text_sha256`` for every row of ``docs``, dropped ones too.

    Texts are equal when they agree after lower-casing A-Z; null counts as empty, and all empty
    texts are equal. The row with the largest key stays. A null key loses to any other; of rows
    that repeat the largest key exactly one stays. Other columns are not read. ``digest`` maps the
    SHA-256 (binary) to what groups are formed by; a weaker one changes the plan, not the result.
    """
    content = docs.select(F.col(key).alias("key"), lower_ascii(text).alias("content"))
    hashed = content.withColumn("sha", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    hashed = hashed.withColumn("digest", digest(F.col("sha")))
    rows = store(hashed.select("key", "sha", "digest", F.monotonically_increasing_id().alias("row")), "digests")

    best = F.struct("key", "row")
    salted = rows.groupBy("digest", F.pmod("row", F.lit(salts)).alias("salt")).agg(
        F.max(best).alias("best"), F.count(F.lit(1)).alias("n")
    )
    heads = salted.groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    hot = heads.where(F.col("n") > F.lit(rows.count() * hot_share)).select("digest", F.lit(True).alias("hot"))

    spread = hashed.join(F.broadcast(hot), "digest", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    spread = spread.withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0)))
    winners = spread.groupBy("digest", "hot", "salt", "content").agg(F.max("key").alias("keep"), F.count(F.lit(1)).alias("n"))
    winners = store(
        winners.select("digest", "hot", F.when(F.col("hot"), F.col("content")).alias("content"), "keep", "n"), "winners"
    )
    merged = winners.where("hot").groupBy("digest", "content").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    groups = winners.where("not hot").select("digest", "keep", "n").unionByName(merged.select("digest", "keep", "n"))

    counted = groups.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("contents"))
    info = store(counted.join(heads.select("digest", "best"), "digest"), "groups")
    result = rows.join(info.where("contents = 1"), "digest").select(
        "key", "keep", "n", (F.col("row") == F.col("best.row")).alias("kept"), "sha"
    )
    clashes = info.where("contents > 1").select("digest")
    if not clashes.isEmpty():
        result = result.unionByName(_by_content(hashed.join(clashes, "digest")))
    return result.select(
        F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _by_content(rows: DataFrame) -> DataFrame:
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "clashes")
    groups = rows.groupBy("digest", "content").agg(
        F.max("key").alias("keep"), F.count(F.lit(1)).alias("n"), F.max(F.struct("key", "row")).alias("best")
    )
    return rows.join(groups, ["digest", "content"]).select(
        "key", "keep", "n", (F.col("row") == F.col("best.row")).alias("kept"), "sha"
    )
