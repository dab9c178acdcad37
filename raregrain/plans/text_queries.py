"""Vocabulary, token features and text descriptors."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from raregrain.fixed_values import TOKEN_ORDER
from raregrain.functions.text import clean_text, coerce_number, count_tokens, ratio_or_zero, sum_of, text_profile, token_vector
from raregrain.operators.columns import check_alignment, concat_features, expand_struct, widen_arrays
from raregrain.operators.describe import describe_texts
from raregrain.operators.joins import combine_descriptors
from raregrain.operators.vocabulary import build_vocab, category_token_totals, merge_vocab, token_features, vocab_tokens
from raregrain.plans.fixtures import CODES, COMPOUNDS_SQL, OUTPUTS, REPEATED, TEXTS, compounds, table, wide_table
from raregrain.plans.registry import query
from raregrain.plans.source_queries import scratch
from raregrain.streaming.vocabulary import load_vocab, update_vocab

CLEAN = r"regexp_replace({}, '[\p{{Nd}}()\[\]{{}}]+', '', 'g')"


def clean_sql(col: str) -> str:
    return CLEAN.format(col)


def vocab_sql(name: str, source: str) -> str:
    """CTE ``name(pos, token, n)`` from a subquery with one text column ``t``."""
    return f"""{name} AS (
  SELECT cast(row_number() over (order by n desc, token) - 1 as integer) AS pos, token, n FROM (
    SELECT token, count(*) AS n FROM (
      SELECT unnest(string_split({clean_sql('t')}, '')) AS token FROM ({source}))
    WHERE token <> '' GROUP BY token))"""


def vector_sql(col: str, vocab: list[str]) -> str:
    """Count array of a fixed vocabulary."""
    text = clean_sql(col)
    return "[" + ", ".join(f"cast(length({text}) - length(replace({text}, '{t}', '')) as integer)" for t in vocab) + "]"


_ALL_TEXTS = " UNION ALL ".join(f"SELECT {c} AS t FROM compounds" for c in TEXTS)
_CODE_SQL = "CASE category WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END"
_VOCAB_LIST = "[cast(length(c_{0}) - length(replace(c_{0}, k, '')) as integer) for k in v] AS {1}"


def _features_sql(select: str) -> str:
    cleaned = ", ".join(f"{clean_sql(c)} AS c_{c}" for c in TEXTS)
    arrays = ", ".join(_VOCAB_LIST.format(c, o) for c, o in OUTPUTS.items())
    return f"""WITH {COMPOUNDS_SQL}, {vocab_sql('vocab', _ALL_TEXTS)},
 ordered AS (SELECT list(token ORDER BY pos) AS v FROM vocab),
 cleaned AS (SELECT id, category, y, {cleaned} FROM compounds),
 features AS (SELECT id, {arrays}, {_CODE_SQL} AS protein, y FROM cleaned, ordered)
 {select}"""


def _fixed_features_sql(select: str) -> str:
    arrays = ", ".join(f"{vector_sql(c, TOKEN_ORDER)} AS {o}" for c, o in OUTPUTS.items())
    return f"""WITH {COMPOUNDS_SQL},
 features AS (SELECT id, {arrays}, {_CODE_SQL} AS protein, y FROM compounds)
 {select}"""


def _data_features(spark, sf_dir):
    rows = compounds(spark, sf_dir)
    vocab = vocab_tokens(build_vocab(rows, TEXTS, REPEATED))
    return token_features(rows, OUTPUTS, vocab, "category", CODES, "y")


def _fixed_features(spark, sf_dir):
    return token_features(compounds(spark, sf_dir), OUTPUTS, TOKEN_ORDER, "category", CODES, "y")


@query("vocab_build", f"WITH {COMPOUNDS_SQL}, {vocab_sql('vocab', _ALL_TEXTS)} SELECT * FROM vocab")
def _(spark, sf_dir):
    return build_vocab(compounds(spark, sf_dir), TEXTS, REPEATED)


@query("vocab_documents", f"WITH {vocab_sql('vocab', 'SELECT text AS t FROM documents')} SELECT * FROM vocab")
def _(spark, sf_dir):
    return build_vocab(wide_table(spark, sf_dir, "documents"), ["text"])


@query(
    "vocab_merge_by_part",
    "WITH "
    + vocab_sql(
        "vocab",
        "SELECT p_name AS t FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part "
        "UNION ALL SELECT text FROM pages_text",
    ).replace("pages_text", "documents")
    + " SELECT * FROM vocab",
)
def _(spark, sf_dir):
    parts = build_vocab(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], ["p_name", "p_brand", "p_type"])
    return merge_vocab(parts, build_vocab(wide_table(spark, sf_dir, "documents"), ["text"]))


@query(
    "clean_text",
    f"SELECT doc_id, cast(length(c) as integer) AS n_clean, md5(c) AS clean_md5 FROM (SELECT doc_id, {clean_sql('text')} AS c FROM documents)",
)
def _(spark, sf_dir):
    cleaned = wide_table(spark, sf_dir, "documents").select("doc_id", clean_text("text").alias("c"))
    return cleaned.select("doc_id", F.length("c").alias("n_clean"), F.md5(F.col("c").cast("binary")).alias("clean_md5"))


@query(
    "count_tokens",
    f"""SELECT doc_id, token, cast(count(*) as integer) AS n FROM (
 SELECT doc_id, unnest(string_split({clean_sql('text')}, '')) AS token FROM documents) WHERE token <> '' GROUP BY doc_id, token""",
)
def _(spark, sf_dir):
    docs = wide_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(count_tokens("text")).alias("token", "n"))


@query(
    "document_tokens",
    f"SELECT doc_id, {vector_sql('text', TOKEN_ORDER)} AS tokens FROM documents",
)
def _(spark, sf_dir):
    return wide_table(spark, sf_dir, "documents").select("doc_id", token_vector("text", TOKEN_ORDER).alias("tokens"))


@query("token_features", _features_sql("SELECT * FROM features"))
def _(spark, sf_dir):
    return _data_features(spark, sf_dir)


_PREFIXES = {"bb1": "a", "bb2": "b", "bb3": "c", "molecule": "d"}
_WIDE_SQL = ", ".join(f"{c}[{i + 1}] AS {p}{i + 1}" for c, p in _PREFIXES.items() for i in range(len(TOKEN_ORDER)))


@query("token_wide", _fixed_features_sql(f"SELECT id, protein, {_WIDE_SQL}, y FROM features"))
def _(spark, sf_dir):
    return widen_arrays(_fixed_features(spark, sf_dir), _PREFIXES, len(TOKEN_ORDER))


@query(
    "token_concat",
    _fixed_features_sql(
        "SELECT id, y, cast(list_concat(list_concat(bb1, bb2), list_concat(list_concat(bb3, molecule), [protein])) as float[]) AS features FROM features"
    ),
)
def _(spark, sf_dir):
    rows = concat_features(_fixed_features(spark, sf_dir), ["bb1", "bb2", "bb3", "molecule"], ["protein"])
    return rows.select("id", "y", "features")


@query(
    "alignment_check",
    _fixed_features_sql(
        "SELECT bool_and(ok) AS aligned, count(*) FILTER (NOT ok) AS bad_rows, count(*) AS n_rows FROM "
        "(SELECT len(bb1) = 24 AND len(bb2) = 24 AND len(bb3) = 24 AND len(molecule) = 24 AS ok FROM features)"
    ),
)
def _(spark, sf_dir):
    return check_alignment(_fixed_features(spark, sf_dir), len(TOKEN_ORDER))


_SUMS = ", ".join(f"cast(sum(list_sum({o})) as bigint) AS {o}_tokens" for o in OUTPUTS.values())
_TOTAL = " + ".join(f"{o}_tokens" for o in OUTPUTS.values())
_SHARES = ", ".join(f"round({o}_tokens / cast(n_tokens as double), 6) AS {o}_share" for o in OUTPUTS.values())


@query(
    "category_token_totals",
    _features_sql(
        f"SELECT *, {_SHARES} FROM (SELECT *, {_TOTAL} AS n_tokens FROM "
        f"(SELECT protein, y, count(*) AS n_rows, {_SUMS} FROM features GROUP BY protein, y))"
    ),
)
def flagship(spark, sf_dir):
    totals = category_token_totals(_data_features(spark, sf_dir), list(OUTPUTS.values()))
    return totals.withColumns({f"{o}_share": F.round(f"{o}_share", 6) for o in OUTPUTS.values()})


def _count_sql(col: str, keep: str) -> str:
    return f"cast(length(regexp_replace({col}, '{keep}', '', 'g')) as integer)"


def profile_sql(col: str, prefix: str = "") -> str:
    lower, upper = _count_sql(col, "[^a-z]"), _count_sql(col, "[^A-Z]")
    return f"""cast(length({col}) as integer) AS {prefix}n_chars, {upper} AS {prefix}n_upper, {lower} AS {prefix}n_lower,
 {_count_sql(col, '[^0-9]')} AS {prefix}n_digit, {_count_sql(col, r'[^(\[{]')} AS {prefix}n_open,
 {_count_sql(col, r'[A-Za-z0-9\s]')} AS {prefix}n_punct,
 cast(len(list_distinct(string_split({col}, ''))) as integer) AS {prefix}n_distinct,
 round(CASE WHEN {lower} + {upper} > 0 THEN {lower} / cast({lower} + {upper} as double) ELSE 0 END, 6) AS {prefix}lower_share"""


@query("text_profile", f"SELECT doc_id, {profile_sql('text')} FROM documents")
def _(spark, sf_dir):
    docs = wide_table(spark, sf_dir, "documents").select("doc_id", text_profile("text").alias("p"))
    return docs.select("doc_id", "p.*").withColumn("lower_share", F.round("lower_share", 6))


def _count(text: str, characters: str) -> int:
    """Occurrences of any of some ASCII characters."""
    raw = text.encode()
    return len(raw) - len(raw.translate(None, characters.encode()))


def letters(text: str) -> dict | None:
    """Small record function used as a stand-in for an expensive one."""
    upper, lower = _count(text, string.ascii_uppercase), _count(text, string.ascii_lowercase)
    return {"n_chars": len(text), "n_upper": upper, "n_lower": lower, "lower_ratio": lower / len(text) if text else 0.0}


_LETTERS = ", ".join(
    f"cast(length({c}) as integer) AS {o}_n_chars, {_count_sql(c, '[^A-Z]')} AS {o}_n_upper, "
    f"{_count_sql(c, '[^a-z]')} AS {o}_n_lower, "
    f"round({_count_sql(c, '[^a-z]')} / cast(length({c}) as double), 6) AS {o}_lower_ratio"
    for c, o in OUTPUTS.items()
)


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("_ratio")})


@query("describe_distinct", f"WITH {COMPOUNDS_SQL} SELECT id, y, {_LETTERS} FROM compounds")
def _(spark, sf_dir):
    rows = compounds(spark, sf_dir).select("id", "y", *TEXTS)
    return _rounded(describe_texts(rows, OUTPUTS, letters, letters("Ab"), repeated=REPEATED))


@query(
    "describe_skip_invalid",
    f"SELECT doc_id, cast(length(text) as integer) AS d_n_chars, {_count_sql('text', '[^0-9]')} AS d_n_digit FROM documents "
    f"WHERE {_count_sql('text', '[^0-9]')} > 0",
)
def _(spark, sf_dir):
    def digits(text: str) -> dict | None:
        found = _count(text, string.digits)
        return {"n_chars": len(text), "n_digit": found} if found else None

    docs = wide_table(spark, sf_dir, "documents").select("doc_id", "text")
    return describe_texts(docs, {"text": "d"}, digits, {"n_chars": 1, "n_digit": 1}, on_invalid="skip")


@query(
    "combine_descriptors",
    f"SELECT p_name, p_n_chars, p_n_upper, l_n_lower FROM (SELECT DISTINCT p_name, cast(length(p_name) as integer) AS p_n_chars, "
    f"{_count_sql('p_name', '[^A-Z]')} AS p_n_upper, {_count_sql('p_name', '[^a-z]')} AS l_n_lower FROM part)",
)
def _(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    profile = expand_struct(names.withColumn("s", text_profile("p_name")), "s", "p").select("p_name", "p_n_chars", "p_n_upper")
    small = names.withColumn("text", F.col("p_name"))
    family = describe_texts(small, {"text": "l"}, letters, letters("Ab")).select("p_name", "l_n_lower")
    return combine_descriptors(profile, family, "p_name")


@query(
    "ratio_or_zero",
    f"""WITH {COMPOUNDS_SQL} SELECT id, round(CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0 END, 6) AS ratio,
 round(l_tax + l_discount, 6) AS total FROM compounds""",
)
def _(spark, sf_dir):
    rows = compounds(spark, sf_dir)
    return rows.select(
        "id", F.round(ratio_or_zero("l_tax", "l_discount"), 6).alias("ratio"), F.round(sum_of("l_tax", "l_discount"), 6).alias("total")
    )


_NUMBER = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


@query(
    "coerce_number",
    rf"""SELECT event_id, part,
 CASE WHEN regexp_matches(t, '^\s*[+-]?[0-9]+\s*$') THEN cast(t as bigint) END AS as_int,
 CASE WHEN NOT regexp_matches(t, '^\s*[+-]?[0-9]+\s*$') AND regexp_matches(t, {_NUMBER}) THEN cast(t as double) END AS as_float,
 CASE WHEN NOT regexp_matches(t, {_NUMBER}) THEN t END AS as_text FROM (
 SELECT event_id, 0 AS part, event_type AS t FROM events UNION ALL
 SELECT event_id, 1, cast(value as varchar) FROM events UNION ALL
 SELECT event_id, 2, regexp_extract(props, '([0-9]+)', 1) FROM events)""",
)
def _(spark, sf_dir):
    texts = F.array("event_type", F.col("value").cast("string"), F.regexp_extract("props", "([0-9]+)", 1))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(texts).alias("part", "t"))
    return rows.select("event_id", "part", *coerce_number("t"))


@query("vocab_stream", f"WITH {vocab_sql('vocab', 'SELECT text AS t FROM documents')} SELECT * FROM vocab")
def _(spark, sf_dir):
    """Documents that come in files, counted in two runs of a stream."""
    root = scratch(spark, "vocabulary")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for run in (0, 1):
        docs.where(F.pmod(F.col("doc_id"), F.lit(2)) == run).repartition(3).write.parquet(f"{root}/files/run={run}")
        files = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(f"{root}/files")
        update_vocab(files, ["text"], f"{root}/parts", f"{root}/state")
    return load_vocab(spark, f"{root}/parts")
