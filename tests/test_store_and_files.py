import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from labelweave.operators import runs as run_ops
from labelweave.sources import files, folders
from labelweave.sources.store import Store

LABELLED = [
    ('He said "fine", twice;\nthen left', ["s::pos", "t::quality"]),
    ("  padded text ", []),
    ("plain", ["s::neg"]),
]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(LABELLED, "text string, labels array<string>")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path), "reviews")


def rows_of(df):
    return sorted((r["text"], r["labels"]) for r in df.select("text", "labels").collect())


@pytest.mark.parametrize("name", ["t.csv", "t.parquet", "t.jsonl", "t.json"])
def test_round_trip(spark, tmp_path, table, name):
    path = str(tmp_path / name)
    files.write_table(table, path)
    back = files.with_label_column(files.read_table(spark, path))
    assert rows_of(back) == sorted(LABELLED)


def test_csv_written_by_pandas(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    pd.DataFrame({"text": ["a, b", 'q "x"'], "labels": ['["s::pos", "t::x"]', "[]"]}).to_csv(path, index=False)
    got = rows_of(files.with_label_column(files.read_table(spark, path)))
    assert got == [("a, b", ["s::pos", "t::x"]), ('q "x"', [])]


def test_json_array(spark, tmp_path):
    path = str(tmp_path / "p.json")
    pd.DataFrame({"text": ["a", "b"], "n": [1, 2]}).to_json(path, orient="records", indent=2)
    assert sorted((r["text"], r["n"]) for r in files.read_table(spark, path).collect()) == [("a", 1), ("b", 2)]


def test_unknown_formats_are_refused(spark, table, tmp_path):
    with pytest.raises(ValueError):
        files.read_table(spark, "x.pkl")
    with pytest.raises(ValueError):
        files.write_table(table, str(tmp_path / "x.pkl"))
    path = str(tmp_path / "only.csv")
    pd.DataFrame({"text": ["a"]}).to_csv(path, index=False)
    with pytest.raises(ValueError):
        files.load_extraction(spark, path)
    pd.DataFrame({"text": ["a"], "f": ["x"]}).to_csv(path, index=False)
    assert files.load_extraction(spark, path)[1] == ["f"]


def test_only_labelled_rows_are_saved(spark, tmp_path, table):
    path = str(tmp_path / "labelled.csv")
    files.write_labelled(table, path)
    assert files.read_table(spark, path).count() == 2


def test_predictions_and_vocabulary(spark, tmp_path, table):
    files.write_vocabulary(table, str(tmp_path / "tags"))
    got = [r["label_key"] for r in spark.read.json(str(tmp_path / "tags")).collect()]
    assert got == ["s::neg", "s::pos", "t::quality"]
    frame = spark.createDataFrame([("a", "x;y", "")], "text string, true string, predicted string")
    files.write_predictions(frame, str(tmp_path / "p.csv"))
    row = files.read_csv(spark, str(tmp_path / "p.csv")).first()
    assert (row["text"], row["true"], row["predicted"] or "") == ("a", "x;y", "")


def test_resume(spark, tmp_path, table):
    fresh = table.drop("labels")
    for name in ("s.parquet", "s.json", "s.csv"):
        path = str(tmp_path / name)
        assert files.resume_or_start(spark, fresh, path).filter(F.size("labels") > 0).count() == 0
        files.write_table(table, path)
        assert rows_of(files.resume_or_start(spark, fresh, path)) == sorted(LABELLED)
        # another number of rows: start again
        longer = fresh.unionByName(fresh)
        assert files.resume_or_start(spark, longer, path).filter(F.size("labels") > 0).count() == 0


@pytest.mark.parametrize("name", ["s.parquet", "s.json", "s.csv"])
def test_resume_edit_save(spark, tmp_path, table, name):
    """The edited rows come from the very files that are replaced."""
    path = str(tmp_path / name)
    fresh = table.drop("labels")
    files.write_table(files.resume_or_start(spark, fresh, path), path)
    for round_no in (1, 2):
        saved = files.resume_or_start(spark, fresh, path)
        edited = saved.withColumn("labels", F.array_append("labels", F.lit(f"r::{round_no}")))
        files.write_table(edited, path)
    got = files.resume_or_start(spark, fresh, path)
    assert [r["labels"] for r in got.collect()] == [["r::1", "r::2"]] * 3


def test_resume_after_a_cut_replacement(spark, tmp_path, table):
    path = str(tmp_path / "s.parquet")
    files.write_table(table, path)
    folders.move(spark, path, path + folders.KEPT)
    assert rows_of(files.resume_or_start(spark, table.drop("labels"), path)) == sorted(LABELLED)


def test_unreadable_table_is_not_taken_for_a_missing_one(spark, tmp_path, table):
    (tmp_path / "s.parquet").mkdir()
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        files.resume_or_start(spark, table.drop("labels"), str(tmp_path / "s.parquet"))


def test_dataset_versions(spark, store):
    assert store.list_dataset_versions("comments") == []
    with pytest.raises(KeyError):
        store.get_dataset("comments")
    a = spark.createDataFrame([(1,), (2,)], "x bigint")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x bigint")
    assert store.submit_dataset(a, "comments") == 1
    assert store.submit_dataset(b, "comments", tags={"note": "n"}) == 2
    assert store.list_dataset_versions("comments") == [1, 2]
    assert store.get_dataset("comments").count() == 3
    assert store.get_dataset("comments", 1).count() == 2
    with pytest.raises(KeyError):
        store.get_dataset("comments", 9)
    with pytest.raises(ValueError):
        store.submit_dataset(a, "comments", tags={"version": "7"})
    with pytest.raises(TypeError):
        store.submit_dataset([1], "comments")
    assert store.find_runs("comments", "dataset", {"note": "n"}).count() == 1


def test_submit_after_a_crash(spark, store):
    """A writer that died after its claim, or after writing, blocks nobody."""
    df = spark.range(2)
    assert store.submit_dataset(df, "comments") == 1
    df.write.parquet(f"{store.base}/datasets/comments/half-written")
    assert folders.claim(spark, f"{store.base}/claims/dataset/comments/2")
    assert store.submit_dataset(spark.range(5), "comments") == 3
    assert store.list_dataset_versions("comments") == [1, 3]
    assert store.get_dataset("comments").count() == 5
    with pytest.raises(KeyError):
        store.get_dataset("comments", 0)


def test_failed_write_registers_nothing(spark, store):
    broken = spark.range(3).select(F.expr("raise_error('no')").alias("x"))
    with pytest.raises(Exception, match="no"):
        store.submit_dataset(broken.withColumn("x", F.col("x").cast("string")), "comments")
    assert store.list_dataset_versions("comments") == []


def test_compacted_registry(store):
    for i in range(3):
        store.submit_run("trial", {"i": i})
    before = sorted(r["run_id"] for r in store.runs().collect())
    store.compact()
    assert sorted(r["run_id"] for r in store.runs().collect()) == before


def test_runs(store):
    assert store.get_run("trial") is None
    assert store.list_runs().count() == 0
    run_id = store.submit_run("trial", {"width": 0.1}, {"loss": 2.5}, {"who": "me"})
    second = store.submit_run("trial", {"width": 0.2}, {"gap": 1})
    assert store.get_run("trial")["run_id"] == second
    rows = {r["run_id"]: r.asDict() for r in store.list_runs().collect()}
    assert rows[run_id]["params.width"] == "0.1" and rows[run_id]["metrics.loss"] == 2.5
    assert rows[run_id]["metrics.gap"] is None and rows[run_id]["tags.who"] == "me"


def test_model_versions_and_lineage(spark, store):
    model = Pipeline(stages=[SQLTransformer(statement="SELECT *, x + 1 AS y FROM __THIS__")]).fit(spark.range(1).toDF("x"))
    with pytest.raises(KeyError):
        store.latest_model_version("tagger")
    assert store.submit_model(model, "tagger", params={"k": 3}) == 1
    assert store.submit_model(model, "tagger", base_model="sorter", base_version=2, metrics={"f1": 1}) == 2
    assert store.latest_model_version("tagger") == 2
    params = store.model_run_params("tagger")
    assert params["base_model"] == "sorter" and params["base_version"] == "2"
    assert store.model_run_params("tagger", 1) == {"k": "3"}
    loaded = store.get_model("tagger")
    assert loaded.transform(spark.range(3).toDF("x")).agg(F.max("y")).first()[0] == 3
    linked = run_ops.lineage(
        store.find_runs("tagger", "model").select("name", "version", "run_id"), store.runs()
    ).first()
    assert linked["version"] == 2 and linked["params"]["base_model"] == "sorter"


@pytest.mark.parametrize("bad", ["Two Words", "left__right", "", "_front", "UPPER", "line\n", 3])
def test_bad_names(spark, tmp_path, store, bad):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), bad)
    with pytest.raises(ValueError):
        store.submit_run(bad)
    with pytest.raises(ValueError):
        store.list_dataset_versions(bad)


def test_round_table(store):
    store.append_round(1, 20, 1, 10, 0.5, 0.4, 0.6)
    store.append_round(2, 40, 1, 20, 0.3, 0.5, 0.7)
    assert [(r["round"], r["labeled_total"]) for r in store.rounds().collect()] == [(1, 10), (2, 20)]


def test_map_casts(spark):
    df = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    row = df.select(run_ops.as_params("m").alias("p"), run_ops.as_metrics("m").alias("q")).first()
    assert row["p"] == {"a": "1"} and row["q"] == {"a": 1.0}
