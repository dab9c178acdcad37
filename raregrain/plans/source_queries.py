"""Round trips through every sink and source, chunk listing and the chunk stream."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from raregrain.operators import encode, stats
from raregrain.operators.sampling import split_n
from raregrain.plans.fixtures import LABELLED_SQL, SCORED_SQL, hash_sql, labelled, scored, table, vectors
from raregrain.plans.registry import query
from raregrain.session import checkpoint_root
from raregrain.sources import chunks, readers, sinks
from raregrain.streaming.incremental import TOGETHER, count_chunks, read_chunks

CHUNK_ROWS = 25_000
EVENT_ROWS = 3_000


def scratch(spark: SparkSession, name: str) -> str:
    """New folder below the session's shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "chunk_sink_roundtrip",
    f"""WITH {LABELLED_SQL} SELECT cast(c as integer) AS chunk_no, count(*) AS n_rows, min(id) AS first_id, max(id) AS last_id,
 cast(sum(y) as bigint) AS n_positive FROM (
 SELECT id, y, (row_number() over (order by id) - 1) // {CHUNK_ROWS} + 1 AS c FROM labelled) GROUP BY c""",
)
def _(spark, sf_dir):
    path = scratch(spark, "chunks")
    sinks.write_chunks(labelled(spark, sf_dir, spread=True), path, CHUNK_ROWS)
    return readers.read_table(spark, path).groupBy("chunk_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.sum(F.col("y").cast("bigint")).alias("n_positive"),
    )


def _event_chunks(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "events")
    sinks.write_chunks(table(spark, sf_dir, "events"), path, EVENT_ROWS, "event_id")
    return path


_EVENT_CHUNKS = f"""chunks AS (SELECT c AS chunk_no, count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS n_positive FROM (
 SELECT event_type, (row_number() over (order by event_id) - 1) // {EVENT_ROWS} + 1 AS c FROM events) GROUP BY c)"""


@query(
    "chunk_listing_progress",
    f"""WITH {_EVENT_CHUNKS}, running AS (SELECT n_rows, cast(sum(n_rows) over (order by chunk_no) as bigint) AS used,
 cast(sum(n_rows) over () as bigint) AS total, row_number() over (order by chunk_no) AS rn FROM chunks)
 SELECT cast(rn as integer) AS chunk_no, n_rows, used, round(used * 100.0 / total, 2) AS used_pct, total - used AS remaining,
 round((total - used) * 100.0 / total, 2) AS remaining_pct FROM running""",
)
def _(spark, sf_dir):
    files = chunks.list_chunks(spark, _event_chunks(spark, sf_dir))
    return stats.chunk_progress(files.select("chunk_no", "n_rows"))


@query(
    "stream_chunk_counts",
    f"WITH {_EVENT_CHUNKS} SELECT cast(chunk_no as integer) AS chunk_no, n_rows, n_positive FROM chunks",
)
def _(spark, sf_dir):
    path, out = _event_chunks(spark, sf_dir), scratch(spark, "stream")
    events = table(spark, sf_dir, "events")
    stream = read_chunks(spark, path, events.schema, TOGETHER).withColumn("y", (F.col("event_type") == "error").cast("int"))
    count_chunks(stream, f"{out}/counts", f"{out}/progress")
    return spark.read.parquet(f"{out}/counts").select("chunk_no", "n_rows", "n_positive")


@query("csv_roundtrip", f"WITH {SCORED_SQL} SELECT id, round(score, 6) AS binds FROM scored")
def _(spark, sf_dir):
    path = scratch(spark, "csv")
    sinks.write_predictions_csv(scored(spark, sf_dir).select("id", F.round("score", 6).alias("binds")), path)
    return readers.read_csv(spark, path, "id bigint, binds double")


@query("lines_roundtrip", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name")
def _(spark, sf_dir):
    path = scratch(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "part"), "p_name", path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("append_roundtrip", "SELECT p_partkey, p_size FROM part UNION ALL SELECT s_suppkey, -1 FROM supplier")
def _(spark, sf_dir):
    path = scratch(spark, "append")
    sinks.write_table(table(spark, sf_dir, "part").select("p_partkey", "p_size"), path)
    suppliers = table(spark, sf_dir, "supplier")
    sinks.append_table(suppliers.select(F.col("s_suppkey").alias("p_partkey"), F.lit(-1).alias("p_size")), path)
    return readers.read_table(spark, path)


@query("extract_column", "SELECT embedding FROM embeddings")
def _(spark, sf_dir):
    path = scratch(spark, "column")
    sinks.extract_column(table(spark, sf_dir, "embeddings"), "embedding", path)
    return readers.read_table(spark, path, ["embedding"])


@query("splits_roundtrip", f"WITH {LABELLED_SQL} SELECT cast({hash_sql('id', 42)} % 8 + 1 as integer) AS split, count(*) AS n FROM labelled GROUP BY 1")
def _(spark, sf_dir):
    path = scratch(spark, "splits")
    sinks.write_splits(split_n(labelled(spark, sf_dir).select("id", "y")), path)
    return readers.read_table(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("pred_chunks_roundtrip", f"WITH {SCORED_SQL} SELECT id, round(score, 6) AS p1, cast({hash_sql('id', 7)} % 4 + 1 as integer) AS chunk_no FROM scored")
def _(spark, sf_dir):
    path = scratch(spark, "predictions")
    rows = split_n(scored(spark, sf_dir).select("id", F.round("score", 6).alias("p1")), 4, seed=7, out="chunk_no")
    sinks.write_pred_chunks(rows, path)
    sinks.write_pred_chunks(rows.where("chunk_no = 2"), path)  # a repeated chunk replaces itself
    return sinks.load_pred_chunks(spark, path)


@query("libsvm_roundtrip", "SELECT cast(label = 3 as double) AS label, cast(round(list_sum(cast(embedding as double[])), 4) as double) AS total FROM embeddings")
def _(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    path = scratch(spark, "libsvm")
    vectors(spark, sf_dir).select(F.col("binds").cast("double").alias("label"), F.col("vectors").alias("features")).write.format("libsvm").save(path)
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return readers.read_libsvm(spark, path, 64).select("label", F.round(total, 4).alias("total"))


@query("map_batches", f"WITH {LABELLED_SQL} SELECT y, count(*) AS n_rows FROM labelled GROUP BY y")
def _(spark, sf_dir):
    import pyarrow as pa

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = batch.column("y").value_counts()
        return pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["y", "n"])

    counts = readers.map_batches(labelled(spark, sf_dir).select("y"), split, "y int, n bigint")
    return counts.groupBy("y").agg(F.sum("n").alias("n_rows"))


@query("table_info", "SELECT count(*) AS n_rows FROM orders")
def _(spark, sf_dir):
    return readers.table_info(table(spark, sf_dir, "orders")).select("n_rows")


@query(
    "encoder_roundtrip",
    f"""WITH {LABELLED_SQL}, indexed AS (SELECT category, cast(row_number() over (order by count(*) desc, category) - 1 as double) AS i
 FROM labelled GROUP BY category) SELECT id, i AS protein_i FROM labelled JOIN indexed USING (category)""",
)
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("id", F.col("category").alias("protein_name"))
    path = scratch(spark, "encoders")
    encode.save_encoders(encode.fit_encoders(rows), path)
    return encode.load_encoders(path).transform(rows).select("id", "protein_i")


@query("feature_columns_roundtrip", "SELECT id FROM (SELECT vec_id AS id FROM embeddings)")
def _(spark, sf_dir):
    path = scratch(spark, "columns")
    rows = vectors(spark, sf_dir)
    encode.save_feature_columns(spark, ["id"], path)
    return rows.select(*encode.load_feature_columns(spark, path))
