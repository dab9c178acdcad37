import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raregrain.fixed_values import CATEGORY_CODES, RAW_RENAMES, TOKEN_ORDER
from raregrain.operators import columns as cols
from raregrain.operators import encode, filters, joins, stats
from raregrain.operators.describe import describe_texts


def test_fixed_values():
    assert len(TOKEN_ORDER) == 24 and len(set(TOKEN_ORDER)) == 24
    assert sorted(CATEGORY_CODES.values()) == [1, 2, 3]
    assert set(RAW_RENAMES.values()) == {"bb1_smiles", "bb2_smiles", "bb3_smiles"}


def test_widen_arrays_names_match_contents(spark):
    df = spark.createDataFrame([(1, 2, [1, 2, 3], [4, 5], 0)], "id bigint, protein int, bb1 array<bigint>, bb2 array<bigint>, y int")
    row = cols.widen_arrays(df, {"bb1": "a", "bb2": "b"}, 3).first()
    assert row.asDict() == {"id": 1, "protein": 2, "a1": 1, "a2": 2, "a3": 3, "b1": 4, "b2": 5, "b3": None, "y": 0}
    assert cols.wide_schema({"bb1": "a"}, 2).fieldNames() == ["id", "protein", "a1", "a2", "y"]


def test_widen_arrays_takes_no_expression_per_element(spark):
    """A projection of many elements is too large for the JIT; nulls, short and long arrays keep their places."""
    rows = [(1, [1, None, 3]), (2, None), (3, [4]), (4, []), (5, [5, 6, 7, 8])]
    df = spark.createDataFrame(rows, "id bigint, bb1 array<bigint>").coalesce(1)
    wide = cols.widen_arrays(df, {"bb1": "a"}, 3, keep_before=["id"], keep_after=[])
    assert [tuple(r) for r in wide.collect()] == [(1, 1, None, 3), (2, None, None, None), (3, 4, None, None), (4, None, None, None), (5, 5, 6, 7)]
    assert "AS a2" not in wide._jdf.queryExecution().executedPlan().toString()
    even = cols.widen_arrays(df.where("id in (1, 5)").select("id", F.slice(F.array(F.lit(7), F.col("id"), F.lit(9)), 1, 3).alias("bb1")), {"bb1": "a"}, 3, ["id"], [])
    assert [tuple(r) for r in even.collect()] == [(1, 7, 1, 9), (5, 7, 5, 9)]


def test_concat_features_is_flat_float(spark):
    df = spark.createDataFrame([([1, 2], [3], 9)], "a array<int>, b array<int>, protein int")
    out = cols.concat_features(df, ["a", "b"], ["protein"])
    assert out.first().features == [1.0, 2.0, 3.0, 9.0]
    assert out.schema["features"].dataType == T.ArrayType(T.FloatType())


def test_map_values(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [r[0] for r in df.select(cols.map_values("c", {"a": 1})).collect()] == [1, None, None]
    values = [r[0] for r in df.select(cols.map_values("c", {"a": 1}, "nan")).collect()]
    assert values[0] == 1.0 and values[1] != values[1]
    with pytest.raises(Exception, match="no code for value"):
        df.select(cols.map_values("c", {"a": 1}, "error")).collect()
    with pytest.raises(ValueError):
        cols.map_values("c", {"a": 1}, "other")


def test_onehot_to_category_first_match_wins(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (5, 5), (None, 0)], "p int, q int")
    assert [r[0] for r in df.select(cols.onehot_to_category("p", "q")).collect()] == [2, 0, 1, 0, None, None]


def test_infer_struct():
    schema = cols.infer_struct({"s": "x", "f": 1.0, "i": 3, "b": True, "o": None})
    kinds = [f.dataType for f in schema.fields]
    assert kinds == [T.StringType(), T.DoubleType(), T.IntegerType(), T.IntegerType(), T.StringType()]


def test_check_alignment(spark):
    df = spark.createDataFrame([([1, 2],), ([1],), (None,)], "a array<int>")
    assert tuple(cols.check_alignment(df, 2, ["a"]).first()) == (False, 2, 3)
    assert tuple(cols.check_alignment(df.where("size(a) = 2"), 2, ["a"]).first()) == (True, 0, 1)
    assert tuple(cols.check_alignment(df.where("false"), 2, ["a"]).first()) == (True, 0, 0)


def test_fill_label_pick_and_drop(spark):
    df = spark.createDataFrame([(1, None)], "id int, binds int")
    assert cols.fill_label(df).first().binds == 2
    assert cols.fill_label(df.drop("binds")).first().binds == 2
    assert cols.pick(df, ["binds"], ["i"]).columns == ["binds", "id"]
    other = spark.createDataFrame([(1, 5)], "id int, v int")
    assert cols.drop_cols(df.join(other, df.id == other.id), other.id).columns == ["id", "binds", "v"]


def test_rule_screen_bounds_are_strict(spark):
    df = spark.createDataFrame([(499.0, 4.9, 4, 9), (500.0, 5.0, 5, 10), (100.0, 6.0, 1, 1)], "MW double, LogP double, NumHDonors int, NumHAcceptors int")
    assert [(r.violations, r.passes) for r in filters.rule_screen(df).collect()] == [(0, True), (4, False), (1, False)]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.50001,)], "s double")
    assert [r[0] for r in df.select(filters.apply_threshold("s", 0.5)).collect()] == [0, 1]


def test_class_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 0), (2, 1)], "id int, y int").write.parquet(path)
    zero, one = filters.split_by_class(spark.read.parquet(path))
    assert (zero.count(), one.count()) == (1, 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(y,1)" in plan


def test_join_features_multiplies_and_drops(spark):
    left = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (2, 1, "c")], "id int, y int, l string")
    right = spark.createDataFrame([(1, 0, 7, "r"), (1, 0, 7, "s")], "id int, y int, protein int, r string")
    out = joins.join_features(left, right)
    assert out.columns == ["id", "y", "l", "r"] and out.count() == 4


def test_attach_and_exclude(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id int, binds double")
    preds = spark.createDataFrame([(1, 0.7)], "id int, prediction double")
    assert {r.id: r.binds for r in joins.attach_predictions(rows, preds).collect()} == {1: 0.7, 2: None}
    assert [r.id for r in joins.exclude_keys(rows, preds.union(preds)).collect()] == [2]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    assert df.transform(stats.class_weights).agg(F.sum("sample_weights")).first()[0] == pytest.approx(8)
    inverse = stats.class_weights(df, mode="inverse").distinct().collect()
    assert {r.y: r.sample_weights for r in inverse} == {0: 8 / 6, 1: 4.0}
    odd = stats.class_weights(df.union(df.sparkSession.createDataFrame([(2,)], "y int")))
    assert odd.where("y = 2").first().sample_weights is None
    single = stats.class_weights(df.where("y = 0"))
    assert single.first().sample_weights == 0.5


def test_pos_ratio_of_one_class(spark):
    row = stats.pos_ratio(spark.createDataFrame([(0,)], "y int")).first()
    assert (row.n0, row.n1, row.scale_pos_weight, row.odds) == (1, 0, None, 0.0)


def test_chunk_progress(spark):
    chunks = spark.createDataFrame([(2, 30), (1, 50), (3, 20)], "chunk_no int, n_rows bigint")
    rows = sorted(map(tuple, stats.chunk_progress(chunks, 200).collect()))
    assert rows == [(1, 50, 50, 25.0, 150, 75.0), (2, 30, 80, 40.0, 120, 60.0), (3, 20, 100, 50.0, 100, 50.0)]


RECORD = {"n": 1, "x": 0.5}


def _describe(text):
    return None if text == "bad" else {"n": len(text), "x": len(text) / 2}


@pytest.mark.parametrize("options", [{}, {"lookup_rows": 0}, {"repeated": ["a"]}, {"repeated": []}])
def test_describe_texts(spark, options):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", ["bad", None, "ok"][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a string, b string").repartition(4)
    out = describe_texts(df, {"a": "p", "b": "q"}, _describe, RECORD, **options)
    assert out.columns == ["id", "p_n", "p_x", "q_n", "q_x"]
    for r in out.collect():
        a, b = rows[r.id][1:]
        assert (r.p_n, r.p_x) == (len(a), len(a) / 2)
        assert r.q_n == (2 if b == "ok" else None)


def test_describe_invalid_policies(spark):
    df = spark.createDataFrame([(1, "bad"), (2, "fine")], "id int, a string")
    assert [r.id for r in describe_texts(df, {"a": "p"}, _describe, RECORD, on_invalid="skip").collect()] == [2]
    with pytest.raises(Exception, match="invalid value"):
        describe_texts(df, {"a": "p"}, _describe, RECORD, on_invalid="error").collect()
    with pytest.raises(ValueError):
        describe_texts(df, {"a": "p"}, _describe, RECORD, on_invalid="other")


def test_encoders(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "protein_name string")
    model = encode.fit_encoders(df)
    path = str(tmp_path / "enc")
    encode.save_encoders(model, path)
    reordered = spark.createDataFrame([("c",), ("c",), ("a",)], "protein_name string")
    coded = encode.onehot_columns(encode.load_encoders(path).transform(reordered), "protein_onehot", "p")
    # the stored order holds, whatever the scored table looks like
    assert [(r.protein_i, r.p_0, r.p_1) for r in coded.collect()] == [(2.0, 0.0, 0.0)] * 2 + [(1.0, 0.0, 1.0)]


def test_onehot_without_dropping(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "y double")
    coded = encode.fit_onehot(df, "y", "v", drop_last=False).transform(df)
    assert encode.onehot_columns(coded, "v", "s").columns == ["y", "v", "s_0", "s_1"]


def test_assemble_refuses_key(spark):
    df = spark.createDataFrame([(1, 1.0, 0)], "id int, x double, binds int")
    with pytest.raises(ValueError):
        encode.assemble(df, ["id", "x"])
    assert encode.assemble(df, ["x"]).columns == ["id", "binds", "vectors"]


def test_feature_columns(spark, tmp_path):
    names = [f"c{i}" for i in range(30)]
    encode.save_feature_columns(spark, names, str(tmp_path / "f"))
    assert encode.load_feature_columns(spark, str(tmp_path / "f")) == names
