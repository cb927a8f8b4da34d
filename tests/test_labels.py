from pyspark.sql import functions as F

from labelweave.functions import labels as lab
from labelweave.operators import frames
from labelweave.operators.scoring import LabelSide, taxonomy_frame


def test_delimited_labels(col):
    out = col(["sport,news", " a ; b,,a ", "", None, ";,"], "string", lab.parse_delimited("v"))
    assert out == [["sport", "news"], ["a", "b", "a"], [], [], []]


def test_json_labels(col):
    values = ['["a", "b"]', "[]", "  ", None, "plain", "[a, b", "['a']", ' ["x::y"] ', '["a", null]']
    out = col(values, "string", lab.parse_json_list("v"))
    assert out == [["a", "b"], [], [], [], ["plain"], ["[a, b"], ["['a']"], ["x::y"], ["a"]]


def test_literal_and_any_labels(col):
    assert col(["['a', 'b']", "[]"], "string", lab.parse_literal_list("v")) == [["a", "b"], []]
    out = col(["['a']", '["b"]', "c;d"], "string", lab.parse_any("v"))
    assert out == [["a"], ["b"], ["c", "d"]]


def test_strip_equals_python(col):
    values = [" a b ", "\u00a0x\u3000", "\x1cq\x85", "\u2003", "\n\ty\r\n", "z\n\n", ""]
    assert col(values, "string", lab.strip("v")) == [v.strip() for v in values]


def test_keys_and_names(col):
    assert col(["a::b", "b", "a::b::c"], "string", lab.label_name("v")) == ["b", "b", "c"]
    assert col(["x"], "string", lab.label_key("v", F.lit("y"))) == ["x::y"]


def test_normalize_keeps_first_and_strips_all_space(col):
    out = col([[" b", "a\t", "b", "", None, "\n"]], "array<string>", lab.normalize_tags("v"))
    assert out == [["b", "a"]]


def test_slugs(col):
    names = ["sales", "a-b_c", "Bad Name", "a__b", "", "-x", "Bad Case", "abc\n"]
    out = col(names, "string", lab.is_slug("v"))
    assert out == [True, True] + [False] * 6


def test_query_terms(col):
    out = col(["topic Pricing cost", "other"], "string", lab.matches_query("v", " PRI cost "))
    assert out == [True, False]
    assert col(["x"], "string", lab.matches_query("v", " ")) == [True]


def test_encode_train_test(spark):
    train = spark.createDataFrame([("a", "sport,news"), ("b", "news")], "text string, labels string")
    test = spark.createDataFrame([("c", ["sport"])], "text string, labels array<string>")
    tr, te, classes = frames.encode_train_test(train, test)
    assert classes == ["news", "sport"]
    got = {r["text"]: r["multi_hot"] for r in tr.collect()}
    assert got == {"a": [1, 1], "b": [1, 0]}
    assert te.first()["multi_hot"] == [0, 1]


def test_fixed_classes_ignore_unknown(col):
    out = col([["sport", "weather"]], "array<string>", lab.multi_hot("v", ["news", "sport"]))
    assert out == [[0, 1]]


def test_custom_label_column(spark):
    df = spark.createDataFrame([("a", "x")], "text string, cats string")
    tr, _, classes = frames.encode_train_test(df, df, labels="cats")
    assert classes == ["x"] and tr.first()["multi_hot"] == [1]
    for bad in ("nope",):
        try:
            frames.require_labelled(df, labels=bad)
        except ValueError as error:
            assert bad in str(error)
        else:
            raise AssertionError("a missing column must be refused")


def test_predictions_frame(spark):
    df = spark.createDataFrame(
        [("a", [1, 0], [1, 1]), ("b", [0, 1], [0, 1])],
        "text string, t array<int>, p array<int>",
    )
    out = frames.predictions_frame(df, ["news", "sport"], "t", "p").orderBy("text")
    assert out.columns == ["text", "true", "predicted"]
    assert [r["true"] for r in out.collect()] == ["news", "sport"]
    assert [r["predicted"] for r in out.collect()] == ["news;sport", "sport"]


def test_review_frame(spark):
    df = spark.createDataFrame(
        [("a", ["y", "x"], ["x", "y", "x"]), ("b", ["x"], [])],
        "text string, t array<string>, p array<string>",
    )
    out = {r["text"]: r for r in frames.review_frame(df, "t", "p").collect()}
    assert out["a"]["labels"] == ["x", "y"] and out["a"]["is_correct"]
    assert not out["b"]["is_correct"]


def test_validation(spark):
    df = spark.createDataFrame(
        [(0, "ok", ["a"]), (1, " ", ["a"]), (2, None, ["b"]), (3, "x", [])],
        "row_id int, text string, labels array<string>",
    )
    report = {r["rule"]: (r["violations"], r["first_row"]) for r in frames.validation_report(df, "row_id").collect()}
    assert report == {
        "at_least_two_rows": (0, None),
        "non_blank_text": (2, 1),
        "at_least_one_tag": (1, 3),
    }
    try:
        frames.validate(df, "row_id")
    except ValueError as error:
        assert "non_blank_text" in str(error)
    else:
        raise AssertionError("broken rows must be refused")
    assert frames.validate(df.filter("row_id = 0").union(df.filter("row_id = 0")), "row_id").count() == 2


def test_taxonomy_order_and_one_hot(spark):
    taxonomy = {"z": {"b": "B text", "a": "A text"}, "c": {"x": "X text"}}
    rows = taxonomy_frame(spark, taxonomy).orderBy("label_idx").collect()
    assert [r["label_key"] for r in rows] == ["z::b", "z::a", "c::x"]
    side = LabelSide.from_taxonomy(taxonomy)
    assert side.category_names == ["z", "c"] and side.members("z") == [0, 1]
    df = spark.createDataFrame([(["z::a", "q::q"],)], "labels array<string>")
    row = frames.as_one_hot(df, side.keys).first()
    assert [row[k] for k in side.keys] == [False, True, False]


def test_alignment_by_id_not_position(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "row_id int, text string")
    b = spark.createDataFrame([(2, 20), (1, 10)], "row_id int, n int")
    assert {(r["text"], r["n"]) for r in frames.aligned(a, b, "row_id").collect()} == {("x", 10), ("y", 20)}


def test_missing_labels_count_as_none(spark):
    df = spark.createDataFrame(
        [(0, ["a"]), (1, []), (2, None), (3, ["b", None])], "row_id int, labels array<string>"
    )
    assert frames.labelled_rows(df).count() == 2 and frames.unlabelled_rows(df).count() == 2
    assert [r[0] for r in df.orderBy("row_id").select(lab.multi_hot("labels", ["a"])).collect()] == [[1], [0], [0], [0]]
    hot = frames.as_one_hot(df, ["a"]).orderBy("row_id").collect()
    assert [r["a"] for r in hot] == [True, False, False, False]
