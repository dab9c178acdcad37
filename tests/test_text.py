import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

from raregrain.functions import text as tx
from raregrain.operators.vocabulary import build_vocab, merge_vocab, token_features, vocab_tokens

EDGES = ["", None, "C1CC(=O)[N]{2}", "a😀b😀", "x٣y7", "ÀéC", "  tab\tC\n", "C" * 3000]
VOCAB = ["C", "=", "O", "N", "😀", "é", "7", "(", " "]


def clean(text):
    return re.sub(r"[\d()\[\]{}]+", "", text)


def counts(text, vocab):
    found = Counter(clean(text))
    return [found.get(t, 0) for t in vocab]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(list(enumerate(EDGES)), "id bigint, t string").repartition(3)


def test_clean_text_removes_digits_of_any_script(edges):
    for row in edges.select("t", tx.clean_text("t").alias("c")).collect():
        assert row.c == (None if row.t is None else clean(row.t))


@pytest.mark.parametrize("form", [tx.token_vector, tx.token_vector_expr])
def test_token_vector(edges, form):
    for row in edges.select("t", form("t", VOCAB).alias("v")).collect():
        assert row.v == (None if row.t is None else counts(row.t, VOCAB))


def test_count_tokens(edges):
    for row in edges.select("t", tx.count_tokens("t").alias("m")).collect():
        assert row.m == (None if row.t is None else dict(Counter(clean(row.t))))


def test_vocab_must_be_distinct_characters():
    for bad in (["ab"], ["a", "a"], [""]):
        with pytest.raises(ValueError):
            tx.token_vector("t", bad)


def test_build_and_merge_vocab(edges):
    want = Counter("".join(clean(t) for t in EDGES if t))
    vocab = build_vocab(edges, ["t"])
    assert {r.token: r.n for r in vocab.collect()} == want
    assert vocab_tokens(vocab) == sorted(want, key=lambda c: (-want[c], c))
    assert {r.token: r.n for r in build_vocab(edges, ["t"], ["t"]).collect()} == want
    parts = [build_vocab(edges.where(f"id % 3 = {i}"), ["t"]) for i in range(3)]
    assert sorted(map(tuple, merge_vocab(*parts).collect())) == sorted(map(tuple, vocab.collect()))


def test_tokens_sum_to_cleaned_length(edges):
    vocab = vocab_tokens(build_vocab(edges, ["t"]))
    rows = edges.where("t is not null").select(tx.token_vector("t", vocab).alias("v"), F.length(tx.clean_text("t")).alias("n"))
    assert all(sum(r.v) == r.n for r in rows.collect())


def test_token_features_label_less(edges):
    rows = token_features(edges, {"t": "bb1"}, VOCAB, "t", {"ÀéC": 5})
    assert rows.columns == ["id", "bb1", "protein"]
    assert {r.protein for r in rows.collect()} == {None, 5}


def test_long_texts_are_sliced(monkeypatch):
    monkeypatch.setattr(tx, "_SLICE_BYTES", 10)
    texts = pa.array(["abc", None, "é" * 20, "", "zz", "q" * 11])
    pieces = list(tx.text_slices(texts.slice(1)))
    assert [t for p in pieces for t in p.to_pylist()] == ["", "é" * 20, "", "zz", "q" * 11]
    assert len(pieces) > 2


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
def test_code_points(texts):
    points, lengths = tx.code_points(pa.array(texts, pa.large_string()))
    assert lengths.tolist() == [len(t) for t in texts]
    assert "".join(map(chr, points.tolist())) == "".join(texts)


@pytest.mark.parametrize("form", [tx.text_profile, tx.text_profile_expr])
def test_text_profile(edges, form):
    for row in edges.select("t", form("t").alias("p")).collect():
        if row.t is None:
            assert row.p is None
            continue
        p, t = row.p, row.t
        lower, upper = len(re.findall("[a-z]", t)), len(re.findall("[A-Z]", t))
        assert (p.n_chars, p.n_lower, p.n_upper, p.n_distinct) == (len(t), lower, upper, len(set(t)))
        assert p.n_punct == len(re.findall(r"[^A-Za-z0-9 \t\n\r\f]", t))
        assert p.n_open == len(re.findall(r"[(\[{]", t)) and p.n_digit == len(re.findall("[0-9]", t))
        assert p.lower_share == (lower / (lower + upper) if lower + upper else 0)


def test_profile_of_a_wide_alphabet(monkeypatch):
    monkeypatch.setattr(tx, "_MATRIX_CELLS", 10)
    texts = ["".join(chr(0x4E00 + 7 * i + j) for j in range(i)) + "aB" for i in range(6)]
    columns = tx._profile(pa.array(texts, pa.large_string()))
    assert columns["n_distinct"].tolist() == [len(set(t)) for t in texts]
    assert columns["n_punct"].tolist() == [len(t) - 2 for t in texts]


def test_coerce_number(spark):
    cases = {"12": (12, None, None), " -7 ": (-7, None, None), "1.5": (None, 1.5, None), "1e3": (None, 1000.0, None),
             "1d": (None, None, "1d"), "": (None, None, ""), "x": (None, None, "x"), "inf": (None, float("inf"), None),
             "9" * 25: (None, float("9" * 25), None), ".5": (None, 0.5, None)}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", *tx.coerce_number("t")).collect()
    assert {r.t: tuple(r)[1:] for r in rows} == cases


def test_ratio_or_zero(spark):
    row = spark.range(1).select(tx.ratio_or_zero(F.lit(1), F.lit(4)), tx.ratio_or_zero(F.lit(1), F.lit(0)), tx.sum_of(F.lit(1), F.lit(2))).first()
    assert tuple(row) == (0.25, 0.0, 3)
