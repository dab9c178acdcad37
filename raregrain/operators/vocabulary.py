"""Vocabulary of characters, token feature tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raregrain.functions.text import code_points, is_removed, text_slices, token_vector, token_vector_expr
from raregrain.operators.columns import map_values

_CODE_SPACE = 0x110000


def _partition_counter(repeated: Sequence[str]):
    """Reduce the text columns of a partition to one row per character."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(_CODE_SPACE, dtype=np.int64)
        for batch in batches:
            for name in batch.schema.names:
                texts, weights = batch.column(name), None
                if name in repeated:
                    pairs = texts.value_counts()
                    texts, weights = pairs.field(0), pairs.field(1).to_numpy()
                start = 0
                for piece in text_slices(texts):
                    points, lengths = code_points(piece)
                    if points.size:
                        per_point = None if weights is None else np.repeat(weights[start : start + len(piece)], lengths)
                        counts = np.bincount(points, weights=per_point)
                        totals[: counts.size] += counts.astype(np.int64)
                    start += len(piece)
        found = [int(p) for p in np.flatnonzero(totals) if not is_removed(chr(p))]
        yield pa.RecordBatch.from_pydict(
            {"token": pa.array([chr(p) for p in found], pa.string()), "n": pa.array(totals[found], pa.int64())}
        )

    return count


def ranked_vocab(counts: DataFrame) -> DataFrame:
    """Add the 0-based position: count descending, token ascending (one row per character)."""
    order = Window.orderBy(F.col("n").desc(), F.col("token"))
    return counts.select((F.row_number().over(order) - 1).alias("pos"), "token", "n")


def build_vocab(df: DataFrame, cols: Sequence[str], repeated: Sequence[str] = ()) -> DataFrame:
    """``(pos, token, n)``: total count of every character over the text columns.

    One pass; each task reduces its texts to one row per character, so the shuffle
    carries alphabets, not text. In columns named in ``repeated`` (few distinct
    texts) each distinct text of a record batch is read once.
    """
    return merge_vocab(partial_counts(df, cols, repeated))


def partial_counts(df: DataFrame, cols: Sequence[str], repeated: Sequence[str] = ()) -> DataFrame:
    """``token, n`` with one row per task and character, of a table or a stream."""
    return df.select(*cols).mapInArrow(_partition_counter(repeated), "token string, n bigint")


def merge_vocab(*vocabs: DataFrame) -> DataFrame:
    """Add up vocabularies (or partial counts) and rank the result."""
    first, *rest = [v.select("token", "n") for v in vocabs]
    for vocab in rest:
        first = first.unionByName(vocab)
    return ranked_vocab(first.groupBy("token").agg(F.sum("n").alias("n")))


def vocab_tokens(vocab: DataFrame) -> list[str]:
    """Ordered tokens on the driver; an alphabet, so at most a few thousand entries."""
    return [row.token for row in vocab.orderBy("pos").select("token").collect()]


def token_features(
    df: DataFrame,
    texts: Mapping[str, str],
    vocab: Sequence[str],
    category: str,
    codes: Mapping[str, int],
    label: str | None = None,
    key: str = "id",
    on_missing: str = "null",
    python: bool = True,
) -> DataFrame:
    """``key``, one count array per text, ``protein`` code and (if given) ``y``.

    ``texts`` maps source columns to output names. A single projection: only the
    named columns are read, and nothing is shuffled. ``python=False`` builds the
    arrays from built-in expressions.
    """
    vector = token_vector if python else token_vector_expr
    cols = [F.col(key)]
    cols += [vector(source, vocab).alias(out) for source, out in texts.items()]
    cols.append(map_values(category, codes, on_missing).cast("int").alias("protein"))
    if label is not None:
        cols.append(F.col(label).cast("int").alias("y"))
    return df.select(*cols)


def category_token_totals(
    features: DataFrame, arrays: Sequence[str], category: str = "protein", label: str = "y"
) -> DataFrame:
    """Per category and label: rows, tokens, and each array's share of the tokens."""

    def size(col: str) -> Column:
        return F.aggregate(F.col(col), F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    totals = features.groupBy(category, label).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(size(a)).alias(f"{a}_tokens") for a in arrays]
    )
    everything = sum((F.col(f"{a}_tokens") for a in arrays), F.lit(0).cast("bigint"))
    return totals.withColumn("n_tokens", everything).withColumns(
        {f"{a}_share": F.try_divide(F.col(f"{a}_tokens").cast("double"), F.col("n_tokens").cast("double")) for a in arrays}
    )
