"""Tables that the catalogue works on, derived from the generated ones, in Spark and SQL."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.sources.readers import widen_scan

TEXTS = ("bb1_text", "bb2_text", "bb3_text", "whole_text")
#: Text columns with few distinct values.
REPEATED = ("bb1_text", "bb2_text", "bb3_text")
OUTPUTS = dict(zip(TEXTS, ("bb1", "bb2", "bb3", "molecule")))
CODES = {"A": 1, "N": 2, "R": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy per row."""
    return widen_scan(table(spark, sf_dir, name))


def _row_id() -> Column:
    parts = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").cast("string")
    )
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _label() -> Column:
    return ((F.col("l_discount") > 0.095) & (F.col("l_quantity") >= 46)).cast("int")


def labelled(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Every line item with its id, category, rare label and numbers; no join.

    ``spread`` deals the rows of a table of few row groups out before their ids are computed, for work that has no filter to push down.
    """
    source = wide_table if spread else table
    return source(spark, sf_dir, "lineitem").select(
        _row_id().alias("id"), F.col("l_returnflag").alias("category"), _label().alias("y"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labelled`` with four texts from part and supplier."""
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    rows = wide_table(spark, sf_dir, "lineitem")
    joined = rows.join(parts, rows.l_partkey == parts.p_partkey).join(suppliers, rows.l_suppkey == suppliers.s_suppkey)
    return joined.select(
        _row_id().alias("id"),
        F.col("p_name").alias("bb1_text"),
        F.concat("p_type", F.lit("("), "p_brand", F.lit(")")).alias("bb2_text"),
        F.concat("s_name", F.lit("["), F.col("p_size").cast("string"), F.lit("]")).alias("bb3_text"),
        F.concat("p_name", F.lit("."), "p_type", F.lit("."), "s_name", F.lit("[Dy]")).alias("whole_text"),
        F.col("l_returnflag").alias("category"),
        _label().alias("y"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice",
    )


def scored(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``labelled`` with a deterministic score with heavy ties and a hard prediction."""
    score = (F.col("l_quantity") * 2 + F.round(F.col("l_discount") * 100) * 5) / F.lit(150.0)
    return labelled(spark, sf_dir, spread).select("id", "category", "y", score.alias("score")).withColumn(
        "prediction", (F.col("score") > 0.9).cast("int")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as feature vectors with a binary label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("vectors"),
        (F.col("label") == 3).cast("int").alias("binds"),
    )


#: Sum of two components above which a vector has label 1, about a tenth of all.
LEARNABLE_ABOVE = 0.227


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vectors`` with a rare label that follows from the features, so that a fit can be told from a constant."""
    first, second = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("vectors"),
        (first + second > LEARNABLE_ABOVE).cast("int").alias("binds"),
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


_ID_SQL = (
    "cast('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "cast(l_shipdate as date))), 1, 15) as bigint)"
)
_Y_SQL = "cast(l_discount > 0.095 and l_quantity >= 46 as integer)"

LABELLED_SQL = f"""labelled AS (
  SELECT {_ID_SQL} AS id, l_returnflag AS category, {_Y_SQL} AS y,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem)"""

COMPOUNDS_SQL = f"""compounds AS (
  SELECT {_ID_SQL} AS id, p_name AS bb1_text, p_type || '(' || p_brand || ')' AS bb2_text,
         s_name || '[' || p_size || ']' AS bb3_text,
         p_name || '.' || p_type || '.' || s_name || '[Dy]' AS whole_text,
         l_returnflag AS category, {_Y_SQL} AS y,
         l_quantity, l_extendedprice, l_discount, l_tax, p_size, p_retailprice
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

SCORED_SQL = LABELLED_SQL + """, scored AS (
  SELECT *, cast(score > 0.9 as integer) AS prediction FROM (
    SELECT id, category, y, (l_quantity * 2 + round(l_discount * 100) * 5) / cast(150.0 as double) AS score
    FROM labelled))"""

VECTORS_SQL = """vectors AS (
  SELECT vec_id AS id, cast(embedding as double[]) AS vectors, cast(label = 3 as integer) AS binds FROM embeddings)"""


LEARNABLE_SQL = f"""vectors AS (
  SELECT vec_id AS id, cast(embedding as double[]) AS vectors,
         cast(cast(embedding[1] as double) + cast(embedding[2] as double) > cast({LEARNABLE_ABOVE} as double) as integer) AS binds FROM embeddings)"""


def hash_sql(key: str, seed: int) -> str:
    """The portable hash key in SQL."""
    return f"cast('0x' || substr(md5(concat(cast({key} as varchar), ':{seed}')), 1, 8) as bigint)"
