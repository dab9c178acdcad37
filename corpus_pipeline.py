"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing, each over what the last one kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``. Rows with
null or empty texts have no language and go in the first stage. Extra columns of ``docs`` are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.llm import exact, language, mixing, packing, simhash
from raregrain.llm.common import store, with_row_key
from raregrain.llm.queries import TOKENIZER


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique row number in the order of ``doc_id``, and the name of that column."""
    name = "stage_row"
    while name in docs.columns:
        name += "_"
    return with_row_key(docs, "doc_id", "text", name), name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows without a language (``und``); learning reads the rows that are not held out."""
    return language.keep_known(docs, language.learn(docs.where(~language.held_out())))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts agree after lower-casing A-Z, keep the one with the largest ``doc_id``."""
    rows, row = _numbered(docs)
    kept = exact.exact_groups(rows, row).where("kept").select(row)
    return rows.join(kept, row, "left_semi").drop(row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every near-duplicate component keep the row with the smallest ``doc_id``."""
    rows, row = _numbered(docs)
    kept = simhash.near_groups(rows, row).where(F.col(row) == F.col("component_id")).select(row)
    return rows.join(kept, row, "left_semi").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat every row as often as the mix takes it; rows that it does not take go."""
    rows, row = _numbered(docs)
    times = (F.col("taken") / F.col("size")).cast("int")
    copies = mixing.mix(rows, row).where("taken > 0").select(row, F.explode(F.sequence(F.lit(1), times)).alias("copy")).select(row)
    return rows.join(copies, row).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2048 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language ID", identify_language), ("exact dedup", drop_exact_copies), ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources), ("packing", pack_sequences),
]

#: SQL has no n-gram filter, XXH64, knapsack or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
