import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.functions import labels as lab
from labelweave.functions import sets, vectors
from labelweave.operators import extraction, metrics, pairs, scoring
from labelweave.operators.scoring import LabelSide

KEYS = ["a::0", "a::1", "b::0", "b::1", "b::2"]


@pytest.fixture(scope="module")
def matrices():
    rng = np.random.default_rng(0)
    scores = np.round(rng.random((60, 5)), 3)
    truth = rng.random((60, 5)) < 0.4
    truth[:3] = False
    truth[3] = True
    return scores, truth


@pytest.fixture(scope="module")
def side():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(5, 8))
    return LabelSide(tuple(KEYS), ("a", "a", "b", "b", "b"), tuple(map(tuple, v)))


@pytest.fixture(scope="module")
def scored(spark, matrices):
    scores, truth = matrices
    rows = [(i, s.tolist(), t.tolist()) for i, (s, t) in enumerate(zip(scores, truth))]
    return spark.createDataFrame(rows, "row_id int, scores array<double>, truth array<boolean>")


def numpy_prf(scores, truth, thr):
    pred = scores >= thr
    tp = (pred & truth).sum(0).astype(float)
    fp = (pred & ~truth).sum(0)
    fn = (~pred & truth).sum(0)
    p = np.divide(tp, tp + fp, out=np.zeros(5), where=tp + fp > 0)
    r = np.divide(tp, tp + fn, out=np.zeros(5), where=tp + fn > 0)
    f = np.divide(2 * p * r, p + r, out=np.zeros(5), where=p + r > 0)
    return tp, fp, fn, p, r, f


def test_counts_and_averages(scored, side, matrices):
    scores, truth = matrices
    tp, fp, fn, p, r, f = numpy_prf(scores, truth, 0.6)
    long = scoring.long_scores(scored, side, ["row_id"], truth="truth")
    counts = metrics.confusion_counts(long, 0.6)
    got = sorted(metrics.prf(counts).collect(), key=lambda x: x["label_idx"])
    assert [x["tp"] for x in got] == tp.tolist()
    assert [x["tp"] + x["fp"] + x["tn"] + x["fn"] for x in got] == [60] * 5
    assert np.allclose([x["f1"] for x in got], f)
    mm = metrics.macro_micro(counts).first()
    assert math.isclose(mm["macro_f1"], f.mean())
    mp, mr = tp.sum() / (tp.sum() + fp.sum()), tp.sum() / (tp.sum() + fn.sum())
    assert math.isclose(mm["micro_f1"], 2 * mp * mr / (mp + mr))


def test_perfect_prediction_scores_one(spark, side):
    rows = [(0, [1.0, 0.0, 0.0, 1.0, 0.0]), (1, [0.0, 1.0, 1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "row_id int, scores array<double>").withColumn(
        "truth", F.transform("scores", lambda s: s > 0.5)
    )
    long = scoring.long_scores(df, side, [], truth="truth")
    found = metrics.multilabel_metrics(
        metrics.confusion_counts(long, 0.5), metrics.row_outcomes(df, 0.5)
    ).collect()
    assert {r["metric"]: r["value"] for r in found} == {
        "f1_micro": 1.0,
        "f1_macro": 1.0,
        "subset_accuracy": 1.0,
    }


def test_row_metrics(scored, side, matrices):
    scores, truth = matrices
    pred = scores >= 0.6
    out = metrics.row_outcomes(scored, 0.6)
    rates = metrics.label_hit_rates(out).first()
    n_true, n_neg = truth.sum(1), (~truth).sum(1)
    rec = [(p & t).sum() / n for p, t, n in zip(pred, truth, n_true) if n]
    fpr = [(p & ~t).sum() / n for p, t, n in zip(pred, truth, n_neg) if n]
    assert math.isclose(rates["avg_pct_correct"], np.mean(rec))
    assert math.isclose(rates["avg_pct_incorrect"], np.mean(fpr))
    assert math.isclose(metrics.row_accuracy(out).first()[0], (pred == truth).all(1).mean())
    rows = sorted(metrics.row_scores(scored, side, 0.6, ["row_id"]).collect())
    right = np.stack([(pred[:, :2] == truth[:, :2]).all(1), (pred[:, 2:] == truth[:, 2:]).all(1)], 1)
    assert [r["score"] for r in rows] == right.sum(1).tolist()
    assert [r["fully_correct"] for r in rows] == right.all(1).tolist()
    assert [r["b_correct"] for r in rows] == right[:, 1].tolist()


def test_category_matrix(scored, side, matrices):
    scores, truth = matrices
    pred = scores >= 0.6
    got = {r["category"]: r for r in metrics.category_confusion(scored, side, 0.6).collect()}
    for cat, idx in (("a", [0, 1]), ("b", [2, 3, 4])):
        p, t = pred[:, idx].any(1), truth[:, idx].any(1)
        assert (got[cat]["tp"], got[cat]["fp"], got[cat]["tn"], got[cat]["fn"]) == (
            (p & t).sum(),
            (p & ~t).sum(),
            (~p & ~t).sum(),
            (~p & t).sum(),
        )


@pytest.mark.parametrize("metric", ["macro_f1", "micro_f1"])
def test_sweep_equals_brute_force(scored, side, matrices, metric):
    scores, truth = matrices
    best, best_thr = -1.0, 0.5
    by_thr = {}
    for thr in metrics.threshold_grid():
        tp, fp, fn, p, r, f = numpy_prf(scores, truth, thr)
        if metric == "macro_f1":
            s = f.mean()
        else:
            mp, mr = tp.sum() / max((tp + fp).sum(), 1), tp.sum() / (tp + fn).sum()
            s = 2 * mp * mr / (mp + mr) if mp + mr else 0.0
        by_thr[round(thr, 9)] = s
        if s > best + 1e-12:
            best, best_thr = s, thr
    long = scoring.long_scores(scored, side, [], truth="truth")
    sweep = metrics.threshold_sweep(long, side)
    got = {round(r["threshold"], 9): r[metric] for r in sweep.collect()}
    assert got.keys() == by_thr.keys()
    assert all(math.isclose(got[t], by_thr[t], abs_tol=1e-12) for t in got)
    found = metrics.best_threshold(sweep, metric).first()
    assert math.isclose(found["threshold"], best_thr) and math.isclose(found["score"], best, abs_tol=1e-9)


def test_sweep_includes_scores_equal_to_the_threshold(spark):
    side = LabelSide(("a::0",), ("a",))
    df = spark.createDataFrame([([0.5], [True]), ([0.4], [False])], "scores array<double>, truth array<boolean>")
    long = scoring.long_scores(df, side, [], truth="truth")
    got = metrics.threshold_sweep(long, side, [0.5]).first()
    assert got["macro_f1"] == 1.0


def test_log_loss(scored, side, matrices):
    scores, truth = matrices
    long = scoring.long_scores(scored, side, [], truth="truth")
    p = np.clip(scores, metrics.LOG_LOSS_EPS, 1 - metrics.LOG_LOSS_EPS)
    bce = -np.where(truth, np.log(p), np.log(1 - p))
    assert math.isclose(metrics.mean_log_loss(long).first()[0], bce.mean(0).mean())
    assert math.isclose(metrics.pair_log_loss(long).first()[0], bce.mean())


def test_logit_loss_is_stable(spark):
    df = spark.createDataFrame([(800.0, True), (-800.0, False)], "x double, t boolean")
    out = metrics.binary_evaluation(df, "x", "t").first()
    assert out["loss"] == 0.0 and out["accuracy"] == 1.0 and out["f1"] == 1.0


def test_similarity_rows_and_blocks_agree(spark, side):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 8)).astype(np.float32)
    df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "row_id int, vector array<float>"
    )
    rows = {r["row_id"]: r["scores"] for r in scoring.similarity_rows(df, side).collect()}
    want = x.astype(float) @ side.matrix.T
    assert rows[99] is None
    assert np.allclose([rows[i] for i in range(20)], want)
    held = df.filter("vector is not null")
    labels = side.frame(spark)
    blocked = scoring.similarity_join(held, labels, "row_id", block_labels=2).collect()
    assert len(blocked) == 100
    assert all(math.isclose(r["score"], want[r["row_id"], r["label_idx"]], abs_tol=1e-5) for r in blocked)


def test_thousands_of_labels(spark):
    """No operator switches or stops at a number of labels."""
    n = 5000
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(n, 4)).astype(np.float32)
    keys = [f"c{i % 7}::{i}" for i in range(n)]
    table = spark.createDataFrame(
        [(i, k, v.tolist()) for i, (k, v) in enumerate(zip(keys, matrix))],
        "label_idx int, label_key string, vector_label array<float>",
    )
    side = LabelSide.from_frame(table)
    x = rng.normal(size=(3, 4)).astype(np.float32)
    texts = spark.createDataFrame(
        [(i, v.tolist(), [keys[i], keys[n - 1 - i]]) for i, v in enumerate(x)],
        "row_id int, vector array<float>, labels array<string>",
    )
    want = x.astype(float) @ matrix.astype(float).T
    wide = {r["row_id"]: r["scores"] for r in scoring.similarity_rows(texts, side).collect()}
    assert all(np.allclose(wide[i], want[i]) for i in range(3))
    joined = scoring.similarity_join(texts, table, "row_id").collect()
    assert len(joined) == 3 * n
    assert all(math.isclose(r["score"], want[r["row_id"], r["label_idx"]], abs_tol=1e-6) for r in joined)
    hot = texts.select("row_id", F.size(F.filter(lab.multi_hot("labels", keys), lambda v: v == 1)).alias("n"))
    assert [r["n"] for r in hot.collect()] == [2, 2, 2]
    by_rows = pairs.contrastive_pairs(texts, keys, "row_id", n_neg=3).collect()
    by_table = pairs.contrastive_pairs_from_table(texts, table, "row_id", n_neg=3).collect()
    assert sorted(map(tuple, by_rows)) == sorted((r["row_id"], r["label_key"], r["label"]) for r in by_table)
    assert pairs.ratio_pairs(texts, keys, "row_id", "labels", 1).count() == 12


def test_rank_and_tags(spark, side):
    df = spark.createDataFrame([(0, [0.1, 0.9, 0.5, 0.5, 0.2])], "row_id int, scores array<double>")
    ranks = {r["label_key"]: (r["rank"], r["is_top"]) for r in scoring.rank_in_category(df, side, "row_id", 1).collect()}
    assert ranks == {
        "a::0": (2, False),
        "a::1": (1, True),
        "b::0": (1, True),
        "b::1": (2, False),
        "b::2": (3, False),
    }
    tags = scoring.scored_tags(df, side, "row_id", threshold=0.5, top_k=2).orderBy("position").collect()
    assert [t["label_key"] for t in tags] == ["a::1", "b::0"]


def test_unit_length_and_features(col):
    (v,) = col([[3.0, 4.0]], "array<float>", vectors.l2_normalize("v"))
    assert np.allclose(v, [0.6, 0.8])
    (f,) = col([[1.0, 2.0]], "array<float>", vectors.pair_features("v", F.array(F.lit(3.0), F.lit(5.0)), "concat+diff+prod"))
    assert f == [1, 2, 3, 5, -2, -3, 3, 10]
    with pytest.raises(ValueError):
        vectors.pair_features("v", "v", "none")


def test_widen_and_narrow(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0])], "row_id int, vector array<double>")
    wide = vectors.widen(df, "vector", 2)
    assert wide.columns == ["row_id", "emb_0", "emb_1"]
    assert vectors.narrow(wide, "vector", 2).first()["vector"] == [0.5, 2.0]


def test_set_f1_golden(spark):
    rows = [(["a", "b"], ["a", "b"]), (["a", "b"], ["a"]), (["a"], ["b"]), ([], [])]
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(rows)], "i int, g array<string>, p array<string>")
    out = [r[0] for r in df.orderBy("i").select(sets.set_f1("g", "p")).collect()]
    assert np.allclose(out, [1.0, 2 / 3, 0.0, 1.0])


def test_field_f1_golden(spark):
    schema = "gold struct<product:array<string>,issue:array<array<string>>>, got struct<product:array<string>,issue:array<array<string>>>"
    gold = (["a", "b"], [["a", "x"]])
    df = spark.createDataFrame([(gold, gold), (gold, (["a"], [])), (gold, ([" A", "B"], [["A ", "x"]]))], schema)
    out = [r["f1_macro"] for r in extraction.with_field_f1(df, "gold", "got").collect()]
    assert np.allclose(out, [1.0, 1 / 3, 1.0])


def test_map_f1_over_union_of_fields(spark):
    schema = "g map<string,array<string>>, p map<string,array<string>>"
    df = spark.createDataFrame([({"a": ["x"]}, {"a": ["X "], "b": ["y"]}), ({}, {})], schema)
    out = [r["f1_macro"] for r in extraction.with_map_f1(df, "g", "p").collect()]
    assert out == [0.5, 1.0]


def test_field_accuracy(spark):
    df = spark.createDataFrame(
        [
            ('{"a": "x", "b": null}', 'Sure: {"a": " x ", "b": null} bye'),
            ('{"a": "x", "b": "y"}', '{"a": "x"}'),
            ('{"a": "x", "b": "y"}', "{a: x"),
            ('{"a": "x", "b": "y"}', "no answer"),
        ],
        "gold string, out string",
    )
    got = {r["field"]: r for r in extraction.field_accuracy(df, "out", "gold", ["a", "b"]).collect()}
    assert (got["a"]["hits"], got["b"]["hits"]) == (2, 1)
    assert got["a"]["parse_failures"] == 2 and got["a"]["accuracy"] == 0.5
    assert got["ALL FIELDS (micro)"]["accuracy"] == 3 / 8


def test_tuning_examples(spark):
    df = spark.createDataFrame([("doc one", "A", None), ("w " * 60, "B", 2)], "text string, name string, n int")
    rows = extraction.tuning_examples(df, max_len=60).collect()
    assert rows[0]["completion"] == '{"name":"A","n":null}'
    assert rows[0]["prompt"].startswith("Extract the following fields") and "Fields: name, n\n" in rows[0]["prompt"]
    assert not rows[0]["truncated"] and rows[1]["truncated"]
    with pytest.raises(ValueError):
        extraction.tuning_examples(df.select("text"))


def test_last_losses(spark):
    hist = [(0, {"embedding_loss": 0.5}), (1, {"eval_embedding_loss": 0.4}), (2, {"embedding_loss": 0.2})]
    schema = "step int, metrics map<string,double>"
    assert tuple(metrics.last_losses(spark.createDataFrame(hist, schema)).first()) == (0.2, 0.4)
    assert tuple(metrics.last_losses(spark.createDataFrame([], schema)).first()) == (None, None)


def test_scoring_on_top_of_an_aggregate(spark):
    """A Python UDF right above an aggregate, with the vector itself dropped."""
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0])], "g int, v array<double>")
    side = LabelSide(("a::0", "a::1"), ("a", "a"), ((1.0, 0.0), (0.0, 1.0)))
    unit = df.groupBy("g").agg(F.max("v").alias("v")).select("g", vectors.l2_normalize("v").alias("vector"))
    got = scoring.long_scores(scoring.similarity_rows(unit, side, digits=6), side, ["g"]).collect()
    assert {(r["g"], r["label_key"]): r["score"] for r in got} == {
        (1, "a::0"): 0.6, (1, "a::1"): 0.8, (2, "a::0"): 0.0, (2, "a::1"): 1.0
    }
    texts = spark.createDataFrame([(1, "a b"), (2, "c")], "i int, text string")
    hashed = vectors.hash_vectors(texts, "i", "text", dims=2)
    assert scoring.similarity_rows(hashed, side).select("i", "scores").count() == 2
