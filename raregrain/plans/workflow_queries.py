"""Whole paths on the derived tables, and the labelled documents."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from raregrain.fixed_values import TOKEN_ORDER
from raregrain.functions.text import token_vector
from raregrain.operators import classifiers, evaluate, stats
from raregrain.operators.describe import describe_texts
from raregrain.operators.sampling import sample_by_class, stratified_split
from raregrain.operators.vocabulary import token_features
from raregrain.plans.fixtures import CODES, COMPOUNDS_SQL, OUTPUTS, REPEATED, TEXTS, compounds, doc_labels
from raregrain.plans.registry import query
from raregrain.plans.text_queries import letters, vector_sql
from raregrain.plans.workflows import descriptor_names, joined_vectors, token_vectors
from raregrain.session import freeze, store

_DOCS = "docs AS (SELECT * FROM documents JOIN labels USING (doc_id))"


def _tokens(rows):
    return token_features(rows, OUTPUTS, TOKEN_ORDER, "category", CODES, "y")


@query(
    "token_vectors",
    f"""WITH {COMPOUNDS_SQL} SELECT id, y, list_concat(
 [0.0::double, cast(category = 'A' as double), cast(category = 'N' as double)],
 cast(list_concat(list_concat({vector_sql(TEXTS[0], TOKEN_ORDER)}, {vector_sql(TEXTS[1], TOKEN_ORDER)}),
 list_concat({vector_sql(TEXTS[2], TOKEN_ORDER)}, {vector_sql(TEXTS[3], TOKEN_ORDER)})) as double[])) AS features FROM compounds""",
)
def _(spark, sf_dir):
    ready, _encoder = token_vectors(_tokens(compounds(spark, sf_dir)), list(OUTPUTS.values()))
    return ready.select("id", "y", vector_to_array("vectors").alias("features"))


def _quality(scored):
    areas = [evaluate.auc_roc(scored, score="p1"), evaluate.average_precision(scored, score="p1")]
    auc, ap = (a.first()[0] for a in areas)
    counts = evaluate.confusion(scored).select((F.col("tp") + F.col("fn")).alias("n_positive"), (F.col("fp") + F.col("tn")).alias("n_negative"))
    return counts.withColumns({"auc_roc_valid": F.lit(0 <= auc <= 1), "average_precision_valid": F.lit(0 < ap <= 1)})


#: Which rows are held out is exact; what a fit makes of them is not said in SQL.
_QUALITY_SQL = f"""WITH {COMPOUNDS_SQL}, sizes AS (
 SELECT y, cast(count(*) - ceil(cast(0.8 as double) * count(*)) as bigint) AS n FROM compounds GROUP BY y)
 SELECT cast(sum(n) FILTER (y = 1) as bigint) AS n_positive, cast(sum(n) FILTER (y = 0) as bigint) AS n_negative,
 true AS auc_roc_valid, true AS average_precision_valid FROM sizes"""


@query("token_path_quality", _QUALITY_SQL)
def _(spark, sf_dir):
    rows = stratified_split(freeze(_tokens(compounds(spark, sf_dir))), "y", 0.8)
    arrays = list(OUTPUTS.values())
    train, encoder = token_vectors(rows.where("is_train = 1"), arrays)
    test, _encoder = token_vectors(rows.where("is_train = 0"), arrays, encoder)
    model = classifiers.fit_logistic(train, "y", maxIter=20)
    return _quality(freeze(classifiers.predict(test, model, keep=["y"], ordered=False)))


@query("descriptor_path_quality", _QUALITY_SQL)
def _(spark, sf_dir):
    # both wide tables as Parquet: a checkpoint of the vectors takes many times the input, and the join's shuffle files go with the write
    rows = store(compounds(spark, sf_dir), "compounds")
    described = describe_texts(rows.select("id", "y", *TEXTS), OUTPUTS, letters, letters("Ab"), repeated=REPEATED)
    tokens, _encoder = token_vectors(_tokens(rows), list(OUTPUTS.values()))
    names = descriptor_names(OUTPUTS, list(letters("Ab")))
    ready = stratified_split(store(joined_vectors(described, tokens, names), "vectors"), "y", 0.8)
    # the fit alone takes a twentieth of the common class; every held-out row is scored
    train = freeze(sample_by_class(ready.where("is_train = 1"), "y", {0: 0.05, 1: 1.0}, seed=7, key="id"))
    model = classifiers.fit_gbt(stats.class_weights(train, "y"), "y", weight="sample_weights", maxIter=3, maxDepth=3)
    test = ready.where("is_train = 0")
    return _quality(freeze(classifiers.predict(test, model, keep=["y"], ordered=False)))


@query(
    "document_label_by_lang",
    f"WITH {_DOCS} SELECT lang, count(*) FILTER (toxic = 0) AS label_0, count(*) FILTER (toxic = 1) AS label_1, count(*) AS n_rows FROM docs GROUP BY lang",
)
def _(spark, sf_dir):
    return stats.label_by_category(doc_labels(spark, sf_dir), "lang", "toxic")


@query(
    "document_weights",
    f"WITH {_DOCS} SELECT doc_id, toxic, round(count(*) over () / cast(2 * count(*) over (partition by toxic) as double), 6) AS sample_weights FROM docs",
)
def _(spark, sf_dir):
    rows = stats.class_weights(doc_labels(spark, sf_dir).select("doc_id", "toxic"), "toxic")
    return rows.withColumn("sample_weights", F.round("sample_weights", 6))


@query(
    "document_token_totals",
    f"""WITH {_DOCS} SELECT lang, toxic, cast(sum(list_sum({vector_sql('text', TOKEN_ORDER)})) as bigint) AS n_tokens, count(*) AS n_rows
 FROM docs GROUP BY lang, toxic""",
)
def _(spark, sf_dir):
    rows = doc_labels(spark, sf_dir)
    counted = rows.select("lang", "toxic", F.aggregate(token_vector("text", TOKEN_ORDER), F.lit(0), lambda a, x: a + x).alias("n"))
    return counted.groupBy("lang", "toxic").agg(F.sum(F.col("n").cast("bigint")).alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"))
