"""Plan shape: nothing that fails to scale may appear in any catalogue plan."""

import pytest

from __spark_entry__ import queries
from raregrain.fixed_values import TOKEN_ORDER
from raregrain.functions.text import token_vector_expr
from raregrain.operators import evaluate, joins, sampling, stats
from raregrain.operators.vocabulary import token_features
from raregrain.plans.fixtures import CODES, OUTPUTS, compounds, labelled, scored, table
from raregrain.session import shuffle_partitions
from raregrain.sources.sinks import write_bucketed

#: Queries whose fit runs when they are called; their plans are covered by the others.
FITTED = {
    "random_forest", "gbt", "gbt_weighted", "booster", "unbalanced_booster", "logistic", "logistic_cv", "mlp", "grid_search",
    "random_search", "holdout_search", "best_params", "stream_incremental_fit", "chunk_ensemble", "kmeans",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - FITTED))
def test_no_cross_join_and_no_row_udf(spark, sf, name):
    text = plan(queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_counts_read_two_columns_without_shuffling_rows(spark, sf):
    text = plan(stats.class_counts(table(spark, sf, "events"), "event_type"))
    assert "ReadSchema: struct<event_type:string>" in text and "partial_count" in text


def test_confusion_is_one_scan(spark, sf):
    text = plan(evaluate.confusion(scored(spark, sf)))
    assert text.count("FileScan") == 1 and "partial_count" in text
    assert "l_orderkey" not in text  # the id is not computed


def test_token_features_shuffle_nothing(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(token_features(rows, {"text": "bb1"}, TOKEN_ORDER, "lang", {"en": 1}, key="doc_id"))
    assert "Exchange" not in text and "n_chars" not in text and text.count("ArrowEvalPython") == 1
    text = plan(rows.select(token_vector_expr("text", TOKEN_ORDER)))
    assert "EvalPython" not in text


def test_four_texts_share_one_python_pass(spark, sf):
    text = plan(token_features(compounds(spark, sf), OUTPUTS, TOKEN_ORDER, "category", CODES, "y"))
    assert text.count("ArrowEvalPython") == 1


def test_stratified_split_does_not_shuffle_rows(spark, sf):
    rows = labelled(spark, sf).select("id", "y", "l_quantity")
    text = plan(sampling.stratified_split(rows, "y", 0.8))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "Window" not in text


def test_filters_reach_the_scan(spark, sf):
    """Of both sides of a union, with no exchange, and of a joined side."""
    text = plan(queries()["class_split_union"](spark, sf))
    assert "Exchange" not in text and text.count("PushedFilters: [Or(") + text.count("PushedFilters: [IsNotNull(") == text.count("FileScan")
    text = plan(queries()["attach_predictions"](spark, sf))
    assert "Not(EqualTo(l_returnflag,A))" in text and "RoundRobin" not in text


def test_sample_by_key_is_narrow(spark, sf):
    assert "Exchange" not in plan(sampling.sample_by_class(labelled(spark, sf), "y", {0: 0.1, 1: 1.0}, key="id"))


def test_bucketed_tables_join_without_shuffle(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("plan_left", "plan_right"):
            write_bucketed(labelled(spark, sf).select("id", "y"), name, buckets=4)
        joined = joins.join_features(spark.table("plan_left"), spark.table("plan_right"))
        assert "Exchange" not in plan(joined) and joined.count() == labelled(spark, sf).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("plan_left", "plan_right"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_shuffle_partitions_follow_the_data():
    assert shuffle_partitions(0) == 200
    assert 700_000 < shuffle_partitions(100 * 10**12) < 800_000


def test_descriptor_path_stores_its_wide_tables_as_parquet(spark, sf, monkeypatch):
    """Checkpoints of the texts and vectors took 3.7 times the disk."""
    from raregrain.plans import workflow_queries

    names, frozen = [], []
    store, freeze = workflow_queries.store, workflow_queries.freeze
    monkeypatch.setattr(workflow_queries, "store", lambda df, name: names.append((name, sorted(df.columns)[:3])) or store(df, name))
    monkeypatch.setattr(workflow_queries, "freeze", lambda df: frozen.append(df.columns) or freeze(df))
    from __spark_entry__ import queries

    assert queries()["descriptor_path_quality"](spark, sf).count() == 1
    assert [n for n, _ in names] == ["compounds", "vectors"] and len(frozen) == 2 and "vectors" not in frozen[1]
