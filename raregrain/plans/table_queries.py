"""Columns, filters, counts, weights, joins and encoders."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregrain.functions.vectors import argmax_vector, class1_probability
from raregrain.operators import columns as cols
from raregrain.operators import encode, filters, joins, stats
from raregrain.operators.sampling import sample_rows
from raregrain.plans.fixtures import (
    CODES, COMPOUNDS_SQL, LABELLED_SQL, SCORED_SQL, compounds, hash_sql, labelled, scored, table,
)
from raregrain.plans.registry import query
from raregrain.plans.source_queries import scratch

_CODE_SQL = "CASE category WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END"


@query("category_encode", f"WITH {LABELLED_SQL} SELECT id, {_CODE_SQL} AS protein, CASE category WHEN 'A' THEN 10 END AS partial, coalesce(CASE category WHEN 'R' THEN 7.0::double END, -1) AS partial_nan FROM labelled")
def _(spark, sf_dir):
    nan = cols.map_values("category", {"R": 7}, "nan")
    return labelled(spark, sf_dir).select(
        "id",
        cols.map_values("category", CODES, "error").cast("int").alias("protein"),
        cols.map_values("category", {"A": 10}).alias("partial"),
        F.when(F.isnan(nan), F.lit(-1.0)).otherwise(nan).alias("partial_nan"),
    )


@query(
    "onehot_decode",
    f"WITH {LABELLED_SQL} SELECT id, CASE category WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS protein FROM labelled",
)
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumns(
        {"p0": (F.col("category") == "A").cast("double"), "p1": (F.col("category") == "N").cast("double")}
    )
    return rows.select("id", cols.onehot_to_category("p0", "p1").alias("protein"))


@query("rename_const", "SELECT p_partkey AS id, p_name AS bb1, p_type AS bb2, 2 AS binds FROM part")
def _(spark, sf_dir):
    part = cols.rename_cols(table(spark, sf_dir, "part"), {"p_partkey": "id", "p_name": "bb1", "p_type": "bb2", "absent": "x"})
    return cols.pick(cols.fill_label(part), ["id"], ["bb", "binds"])


@query("cast_schema", "SELECT l_orderkey AS l_orderkey, cast(l_linenumber as bigint) AS l_linenumber, cast(l_quantity as integer) AS l_quantity FROM lineitem")
def _(spark, sf_dir):
    schema = T.StructType(
        [T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.LongType()), T.StructField("l_quantity", T.IntegerType())]
    )
    return cols.cast_schema(table(spark, sf_dir, "lineitem"), schema)


@query(
    "rule_screen",
    f"""WITH {COMPOUNDS_SQL} SELECT id, violations, violations = 0 AS passes FROM (
 SELECT id, cast(l_extendedprice >= 50000 as integer) + cast(l_quantity >= 40 as integer) + cast(l_discount >= 0.08 as integer)
  + cast(p_size >= 45 as integer) AS violations FROM compounds)""",
)
def _(spark, sf_dir):
    bounds = {"l_extendedprice": 50000, "l_quantity": 40, "l_discount": 0.08, "p_size": 45}
    return filters.rule_screen(compounds(spark, sf_dir), bounds).select("id", "violations", "passes")


@query("threshold_apply", f"WITH {SCORED_SQL} SELECT id, cast(score > 0.6 as integer) AS prediction FROM scored")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("id", filters.apply_threshold("score", 0.6).alias("prediction"))


@query("where_all", f"WITH {SCORED_SQL} SELECT id, category FROM scored WHERE y = 1 AND prediction = 1")
def _(spark, sf_dir):
    return filters.where_all(scored(spark, sf_dir), y=1, prediction=1).select("id", "category")


@query("class_split_union", f"WITH {LABELLED_SQL} SELECT id, y, category FROM labelled WHERE y IN (0, 1)")
def _(spark, sf_dir):
    zero, one = filters.split_by_class(labelled(spark, sf_dir).select("id", "y", "category"))
    return joins.union_classes(one, zero)


@query("table_count", "SELECT count(*) AS n_rows FROM lineitem")
def _(spark, sf_dir):
    return stats.row_count(table(spark, sf_dir, "lineitem"))


@query("label_values", f"WITH {LABELLED_SQL} SELECT DISTINCT y FROM labelled")
def _(spark, sf_dir):
    return stats.label_values(labelled(spark, sf_dir))


@query("class_counts", f"WITH {LABELLED_SQL} SELECT y, count(*) AS n_rows FROM labelled GROUP BY y")
def _(spark, sf_dir):
    return stats.class_counts(labelled(spark, sf_dir))


@query(
    "class_share",
    f"""WITH {LABELLED_SQL} SELECT y, count(*) AS n_rows, round(count(*) / cast(sum(count(*)) over () as double), 6) AS share,
 round(100.0 * count(*) / cast(sum(count(*)) over () as double), 6) AS percent FROM labelled GROUP BY y""",
)
def _(spark, sf_dir):
    shares = stats.class_share(labelled(spark, sf_dir))
    return shares.withColumns({"share": F.round("share", 6), "percent": F.round("percent", 6)})


@query(
    "label_by_category",
    f"WITH {LABELLED_SQL} SELECT category, count(*) FILTER (y = 0) AS label_0, count(*) FILTER (y = 1) AS label_1, count(*) AS n_rows FROM labelled GROUP BY category",
)
def _(spark, sf_dir):
    return stats.label_by_category(labelled(spark, sf_dir))


def _weights_sql(factor: int) -> str:
    return f"""WITH {LABELLED_SQL} SELECT id, y, round(count(*) over () / cast({factor} * count(*) over (partition by y) as double), 6)
 AS sample_weights FROM labelled"""


@query("class_weights_balanced", _weights_sql(2))
def _(spark, sf_dir):
    rows = stats.class_weights(labelled(spark, sf_dir).select("id", "y"))
    return rows.withColumn("sample_weights", F.round("sample_weights", 6))


@query("class_weights_inverse", _weights_sql(1))
def _(spark, sf_dir):
    rows = stats.class_weights(labelled(spark, sf_dir).select("id", "y"), mode="inverse")
    return rows.withColumn("sample_weights", F.round("sample_weights", 6))


@query(
    "pos_ratio",
    f"""WITH {LABELLED_SQL} SELECT n0, n1, round(n0 / cast(n1 as double), 6) AS scale_pos_weight,
 round(n1 / cast(n0 as double), 6) AS odds, round(n1 / cast(n0 + n1 as double), 6) AS fraction FROM (
 SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM labelled)""",
)
def _(spark, sf_dir):
    rows = stats.pos_ratio(labelled(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("scale_pos_weight", "odds", "fraction")})


@query(
    "mean_metrics",
    "SELECT event_type, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type",
)
def _(spark, sf_dir):
    rows = stats.mean_metrics(table(spark, sf_dir, "events"), "event_type", ["value"])
    return rows.withColumn("mean_value", F.round("mean_value", 6))


@query(
    "feature_join",
    f"WITH {COMPOUNDS_SQL} SELECT id, y, l_quantity, l_tax, cast(length(whole_text) as integer) AS n_chars, p_size FROM compounds",
)
def _(spark, sf_dir):
    left = labelled(spark, sf_dir).select("id", "y", "l_quantity", "l_tax")
    right = compounds(spark, sf_dir).select("id", "y", F.length("whole_text").alias("n_chars"), "p_size")
    return joins.join_features(left, right)


@query(
    "attach_predictions",
    f"WITH {SCORED_SQL} SELECT l.id, CASE WHEN s.category <> 'A' THEN round(s.score, 6) END AS binds FROM labelled l JOIN scored s ON l.id = s.id",
)
def _(spark, sf_dir):
    predictions = scored(spark, sf_dir).where("category <> 'A'").select("id", F.round("score", 6).alias("p"))
    return joins.attach_predictions(labelled(spark, sf_dir).select("id"), predictions, value="p")


@query(
    "exclude_keys",
    f"WITH {LABELLED_SQL} SELECT id, y FROM labelled WHERE {hash_sql('id', 42)} >= 0.3 * 4294967296",
)
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir, spread=True).select("id", "y")
    return joins.exclude_keys(rows, sample_rows(rows, 0.3, 42, "id"))


_INDEX_SQL = f"""{LABELLED_SQL}, indexed AS (
 SELECT category, cast(row_number() over (order by count(*) desc, category) - 1 as double) AS category_i FROM labelled GROUP BY category)"""


@query("string_index", f"WITH {_INDEX_SQL} SELECT id, category_i FROM labelled JOIN indexed USING (category)")
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("id", "category")
    return encode.fit_index(rows, "category").transform(rows).select("id", "category_i")


@query(
    "onehot_columns",
    f"WITH {_INDEX_SQL} SELECT id, cast(category_i = 0 as double) AS protein_0, cast(category_i = 1 as double) AS protein_1 FROM labelled JOIN indexed USING (category)",
)
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("id", F.col("category").alias("protein_name"))
    coded = encode.fit_encoders(rows).transform(rows)
    return encode.onehot_columns(coded, "protein_onehot", "protein").select("id", "protein_0", "protein_1")


@query(
    "onehot_codes",
    f"WITH {LABELLED_SQL} SELECT id, [0.0::double, cast(category = 'A' as double), cast(category = 'N' as double)] AS slots FROM labelled",
)
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("id", cols.map_values("category", CODES).cast("double").alias("protein"))
    coded = encode.fit_onehot(rows, "protein").transform(rows)
    wide = encode.onehot_columns(coded, "protein_onehot", "p")
    return wide.select("id", F.array("p_0", "p_1", "p_2").alias("slots"))


@query(
    "assemble_vectors",
    f"WITH {LABELLED_SQL} SELECT id, y AS binds, [l_quantity, l_extendedprice, l_discount, l_tax] AS features FROM labelled",
)
def _(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows = labelled(spark, sf_dir).withColumnRenamed("y", "binds")
    made = encode.assemble(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return made.select("id", "binds", vector_to_array("vectors").alias("features"))


@query("class1_probability", f"WITH {SCORED_SQL} SELECT id, score AS p1 FROM scored")
def _(spark, sf_dir):
    rows = scored(spark, sf_dir).select("id", array_to_vector(F.array(1 - F.col("score"), "score")).alias("probability"))
    return rows.select("id", class1_probability(rows).alias("p1"))


@query(
    "argmax_vector",
    "SELECT vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as double) AS best FROM embeddings",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return rows.select("vec_id", argmax_vector(rows, "v").alias("best"))


@query("drop_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return cols.drop_cols(rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"), "l_tax", rows["l_discount"])


@query(
    "onehot_all",
    f"WITH {LABELLED_SQL} SELECT id, " + ", ".join(f"cast(category = '{c}' as double) AS p_{c.lower()}" for c in "ANR") + " FROM labelled",
)
def _(spark, sf_dir):
    """One slot per category, none left out; slots are found by the fitted order of labels."""
    rows = labelled(spark, sf_dir)
    coder = encode.fit_encoders(rows.withColumnRenamed("category", "protein_name"), drop_last=False)
    wide = encode.onehot_columns(coder.transform(rows.withColumnRenamed("category", "protein_name")), "protein_onehot", "slot")
    labels = coder.stages[0].labels
    return wide.select("id", *[F.col(f"slot_{labels.index(c)}").alias(f"p_{c.lower()}") for c in "ANR"])


@query("invalid_kept", f"WITH {LABELLED_SQL} SELECT id, CASE category WHEN 'A' THEN 1 END AS code FROM labelled")
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("id", cols.map_values("category", {"A": 1}).cast("int").alias("code"))
    return filters.apply_invalid_policy(rows, "code", "null")


@query(
    "feature_columns_in_order",
    "SELECT cast(row_number() over (order by n) - 1 as integer) AS pos, name FROM (VALUES (1, 'l_tax'), (2, 'l_quantity'), (3, 'l_discount'), (4, 'l_extendedprice')) t(n, name)",
)
def _(spark, sf_dir):
    """The columns of a fitted feature vector, stored and read back in the vector's order, which is not that of their names."""
    path = f"{scratch(spark, 'features')}/columns"
    rows = labelled(spark, sf_dir)
    made = encode.assemble(rows, ["l_tax", "l_quantity", "l_discount", "l_extendedprice"], keep=["id"])
    attrs = [a for kind in made.schema["vectors"].metadata["ml_attr"]["attrs"].values() for a in kind]
    encode.save_feature_columns(spark, [a["name"] for a in sorted(attrs, key=lambda a: a["idx"])], path)
    return spark.createDataFrame(list(enumerate(encode.load_feature_columns(spark, path))), "pos int, name string")
