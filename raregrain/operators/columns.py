"""Projections: constants, renames, widening, re-schema, struct expansion, codes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregrain.fixed_values import UNLABELLED, WIDE_PREFIXES


def pick(df: DataFrame, cols: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """Named columns, then all columns that start with one of the prefixes, in table order."""
    chosen = [*cols, *[c for c in df.columns if c not in cols and any(c.startswith(p) for p in prefixes)]]
    return df.select(*chosen)


def with_const(df: DataFrame, name: str, value: object) -> DataFrame:
    """Add a constant column."""
    return df.withColumn(name, F.lit(value))


def fill_label(df: DataFrame, label: str = "binds", value: int = UNLABELLED) -> DataFrame:
    """Give an unlabelled table the label column of the labelled one."""
    if label in df.columns:
        return df.withColumn(label, F.coalesce(F.col(label), F.lit(value)))
    return with_const(df, label, value)


def rename_cols(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; names that do not occur are ignored."""
    return df.withColumnsRenamed(dict(names))


def drop_cols(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Drop columns by name or by reference to the parent they come from."""
    return df.drop(*cols)


def widen_arrays(
    df: DataFrame,
    prefixes: Mapping[str, str] = WIDE_PREFIXES,
    width: int = 24,
    keep_before: Sequence[str] = ("id", "protein"),
    keep_after: Sequence[str] = ("y",),
) -> DataFrame:
    """Element ``i`` of every array becomes ``<prefix><i+1>`` as int.

    One narrow pass; an array that is too short gives nulls. The arrays are cut on Arrow batches: a projection with an
    expression per element becomes one method that is too large for the JIT.
    """
    names = [f"{prefix}{i + 1}" for prefix in prefixes.values() for i in range(width)]
    kept = {c: df.schema[c].dataType for c in (*keep_before, *keep_after)}
    kinds = [*[kept[c] for c in keep_before], *[T.IntegerType()] * len(names), *[kept[c] for c in keep_after]]
    schema = T.StructType([T.StructField(n, t) for n, t in zip([*keep_before, *names, *keep_after], kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [column for name in prefixes for column in _elements(batch.column(name), width)]
            columns = [*[batch.column(c) for c in keep_before], *wide, *[batch.column(c) for c in keep_after]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    arrays = [F.col(c).cast("array<int>").alias(c) for c in prefixes]
    return df.select(*kept, *arrays).mapInArrow(run, schema)


def _elements(lists: pa.ListArray, width: int) -> list[pa.Array]:
    """The first ``width`` elements of every list, an array per place; null where a list has none there."""
    offsets, values = lists.offsets.to_numpy(), lists.values
    sizes = np.diff(offsets)
    if not lists.null_count and not values.null_count and bool((sizes == width).all()):
        flat = values.to_numpy()[offsets[0] : offsets[-1]].reshape(-1, width)
        return [pa.array(np.ascontiguousarray(column)) for column in flat.T]
    sizes[lists.is_null().to_numpy(zero_copy_only=False)] = 0
    return [values.take(pa.array(offsets[:-1].astype(np.int64) + i, mask=sizes <= i)) for i in range(width)]


def concat_features(
    df: DataFrame, arrays: Sequence[str], scalars: Sequence[str] = (), out: str = "features"
) -> DataFrame:
    """Flatten arrays, then scalars, into one float array."""
    parts = [F.col(a).cast("array<float>") for a in arrays]
    if scalars:
        parts.append(F.array(*[F.col(s).cast("float") for s in scalars]))
    return df.withColumn(out, F.concat(*parts))


def cast_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` by name, cast to its types, in its order."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def wide_schema(prefixes: Mapping[str, str] = WIDE_PREFIXES, width: int = 24) -> T.StructType:
    """Schema of the wide table for the given prefixes and width."""
    features = [T.StructField(f"{p}{i + 1}", T.IntegerType()) for p in prefixes.values() for i in range(width)]
    return T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("protein", T.IntegerType()), *features,
         T.StructField("y", T.IntegerType())]
    )


def expand_struct(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Every field of a struct column becomes ``<prefix>_<field>``; the struct goes."""
    fields = df.schema[col].dataType.fieldNames()
    kept = [c for c in df.columns if c != col]
    return df.select(*kept, *[F.col(col).getField(f).alias(f"{prefix}_{f}") for f in fields])


def map_values(col: str | Column, mapping: Mapping[str, object], on_missing: str = "null") -> Column:
    """Dictionary lookup. Unknown values give null, NaN or an error."""
    key = F.col(col) if isinstance(col, str) else col
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, key)
    if on_missing == "null":
        return found
    if on_missing == "nan":
        return F.coalesce(found.cast("double"), F.lit(float("nan")))
    if on_missing == "error":
        message = F.concat(F.lit("no code for value: "), F.coalesce(key.cast("string"), F.lit("null")))
        return F.when(found.isNotNull(), found).otherwise(F.raise_error(message))
    raise ValueError("on_missing is 'null', 'nan' or 'error'")


def onehot_to_category(p0: str | Column, p1: str | Column) -> Column:
    """Category of a two-slot one-hot: first slot 0, second slot 1, neither 2, else null."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (p0, p1))
    return F.when((a == 0) & (b == 0), 2).when(a == 1, 0).when(b == 1, 1).otherwise(F.lit(None).cast("int"))


def infer_struct(sample: Mapping[str, object]) -> T.StructType:
    """Schema of a record function from one sample record."""

    def kind(value: object) -> T.DataType:
        if isinstance(value, float):
            return T.DoubleType()
        if isinstance(value, int):
            return T.IntegerType()
        return T.StringType()

    return T.StructType([T.StructField(name, kind(value), True) for name, value in sample.items()])


def check_alignment(df: DataFrame, width: int, arrays: Sequence[str] = tuple(WIDE_PREFIXES)) -> DataFrame:
    """One row: whether every array of every row has exactly ``width`` elements, and how many rows fail."""
    good = reduce(lambda a, b: a & b, [F.coalesce(F.size(F.col(c)) == width, F.lit(False)) for c in arrays])
    return df.agg(
        F.coalesce(F.bool_and(good), F.lit(True)).alias("aligned"),
        F.count_if(~good).alias("bad_rows"),
        F.count(F.lit(1)).alias("n_rows"),
    )
