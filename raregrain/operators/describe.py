"""Record-valued descriptor functions over text columns.

The function is called once per distinct text. Columns whose distinct texts fit a
broadcast are described as a small table and joined back map-side; the others are
described in place, once per distinct text of each Arrow batch. Either way the
wide table itself is never shuffled, and a text that fills a third of all rows
costs one call per batch at most.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from raregrain.operators.columns import expand_struct, infer_struct
from raregrain.operators.filters import apply_invalid_policy
from raregrain.session import BROADCAST_ROWS, attach_small, freeze

#: Texts described through a lookup table may take up this many bytes in all.
LOOKUP_BYTES = 64 << 20

Record = Mapping[str, object]


def describe(col: str | Column, fn: Callable[[str], Record | None], schema: T.StructType) -> Column:
    """Struct column ``fn(text)``; null where the text is null or ``fn`` returns None."""
    arrow_type = to_arrow_type(schema)

    def run(texts: pa.Array) -> pa.Array:
        encoded = texts.dictionary_encode()
        records = pa.array([fn(text) for text in encoded.dictionary.to_pylist()], type=arrow_type)
        return records.take(encoded.indices)

    return F.arrow_udf(run, schema)(F.col(col) if isinstance(col, str) else col)


def _repeating(df: DataFrame, cols: list[str], max_rows: int, max_bytes: int) -> list[str]:
    """Columns whose distinct texts, by a one-pass estimate, fit a lookup table."""
    stats = df.agg(
        *[F.approx_count_distinct(c).alias(f"n_{c}") for c in cols],
        *[F.max(F.octet_length(c)).alias(f"b_{c}") for c in cols],
    ).first()
    fits = []
    for c in sorted(cols, key=lambda c: stats[f"n_{c}"]):
        rows, size = stats[f"n_{c}"], stats[f"n_{c}"] * ((stats[f"b_{c}"] or 0) + 64)
        if rows <= max_rows and size <= max_bytes:
            fits.append(c)
            max_rows, max_bytes = max_rows - rows, max_bytes - size
    return fits


def describe_texts(
    df: DataFrame,
    texts: Mapping[str, str],
    fn: Callable[[str], Record | None],
    schema: T.StructType | Record,
    on_invalid: str = "null",
    repeated: Sequence[str] | None = None,
    lookup_rows: int = BROADCAST_ROWS // 2,
    lookup_bytes: int = LOOKUP_BYTES,
) -> DataFrame:
    """Describe every text column and expand the records to ``<prefix>_<field>``.

    ``texts`` maps text columns to prefixes; the text columns are dropped.
    ``schema`` is a struct type or one sample record to infer it from. Texts
    without a record give null fields, or are skipped, or raise. Columns known to
    hold few distinct texts can be named in ``repeated``, which saves the pass
    that estimates this; should their lookup table turn out large, it is joined by
    shuffle.
    """
    if not isinstance(schema, T.StructType):
        schema = infer_struct(schema)
    small = _repeating(df, list(texts), lookup_rows, lookup_bytes) if repeated is None else list(repeated)
    if small:
        distinct = df.select(F.explode(F.array(*small)).alias("_text")).where("_text is not null").distinct()
        # a fixed number of tasks: the texts are few bytes, but the function may be slow
        distinct = distinct.repartition(df.sparkSession.sparkContext.defaultParallelism)
        lookup = freeze(distinct.withColumn("_record", describe("_text", fn, schema)))
    for col, prefix in texts.items():
        struct = f"_s_{prefix}"
        if col in small:
            renamed = lookup.withColumnsRenamed({"_text": col, "_record": struct})
            df = attach_small(df, renamed, [col], "left")
        else:
            df = df.withColumn(struct, describe(col, fn, schema))
    for col, prefix in texts.items():
        df = apply_invalid_policy(df, f"_s_{prefix}", on_invalid)
    df = df.drop(*texts)
    for prefix in texts.values():
        df = expand_struct(df, f"_s_{prefix}", prefix)
    return df
