import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.functions import text, vectors
from labelweave.operators import extraction, inference, learning, metrics, model_files, pair_fit, scoring, search
from labelweave.operators.scoring import LabelSide
from labelweave.plans import active_round, train_submit
from labelweave.sources.store import Store

D = 6
LABELS = ["a::0", "a::1", "b::0"]


def newton(X, y, C, weights=None):
    """Minimum of |w|^2 / 2 + C * sum of weighted logistic losses; free intercept."""
    Z = np.hstack([X, np.ones((len(X), 1))])
    s = np.ones(len(X)) if weights is None else weights
    keep = np.diag([1.0] * X.shape[1] + [0.0])
    w = np.zeros(Z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-Z @ w))
        g = keep @ w + C * Z.T @ (s * (p - y))
        h = keep + C * (Z.T * (s * p * (1 - p))) @ Z
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    return w[:-1], w[-1]


@pytest.fixture(scope="module")
def side():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3, D))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return LabelSide(tuple(LABELS), ("a", "a", "b"), tuple(map(tuple, v)))


@pytest.fixture(scope="module")
def data(side):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(120, D))
    Y = X @ side.matrix.T + rng.normal(scale=0.5, size=(120, 3)) > 0.2
    return X, Y


@pytest.fixture(scope="module")
def rows(spark, data):
    X, Y = data
    out = [
        (i, x.tolist(), [k for k, hit in zip(LABELS, y) if hit]) for i, (x, y) in enumerate(zip(X, Y))
    ]
    return spark.createDataFrame(out, "row_id bigint, vector array<double>, labels array<string>").repartition(2).cache()


@pytest.mark.parametrize("C,balanced", [(1.0, False), (0.1, False), (1.0, True)])
def test_labelwise_regression(rows, data, side, C, balanced):
    X, Y = data
    model = learning.fit_labelwise(rows, side, C=C, balanced=balanced)
    for i in range(3):
        y = Y[:, i].astype(float)
        s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else None
        w, b = newton(X, y, C, s)
        assert np.allclose(model.weights[i], w, atol=2e-3) and abs(model.offsets[i] - b) < 2e-3


def test_constant_labels(spark, rows):
    side = LabelSide(("never::x",), ("never",))
    model = learning.fit_labelwise(rows, side)
    assert {tuple(r["scores"]) for r in model.score_rows(rows).select("scores").collect()} == {(0.0,)}


@pytest.mark.parametrize("mode", vectors.FEATURE_MODES)
def test_folded_pair_scores_equal_pairwise_scores(rows, side, mode):
    train = learning.training_pairs(rows, side, "row_id", n_neg=2, mode=mode)
    model = learning.fit_linear_pairs(train, side, mode, max_iter=30)
    fast = {r["row_id"]: r["scores"] for r in model.score_rows(rows).select("row_id", "scores").collect()}
    w, b = model.fitted.coefficients.toArray(), model.fitted.intercept
    some = rows.select("row_id", "vector").collect()
    for r in some[:20]:
        t = np.array(r["vector"])
        for i, l in enumerate(side.matrix):
            parts = []
            if "concat" in mode:
                parts += [t, l]
            if "diff" in mode:
                parts.append(t - l)
            if "prod" in mode:
                parts.append(t * l)
            logit = np.concatenate(parts) @ w + b
            assert abs(fast[r["row_id"]][i] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_pair_regression_guard_and_optimum(spark, rows, side):
    one_class = learning.training_pairs(rows, side, "row_id", n_neg=0)
    assert learning.fit_linear_pairs(one_class, side) is None
    assert learning.fit_boosted_pairs(one_class, side) is None
    train = learning.training_pairs(rows, side, "row_id", n_neg=2, mode="prod")
    got = [(r["features"].toArray(), r["label"]) for r in train.collect()]
    X, y = np.stack([x for x, _ in got]), np.array([v for _, v in got])
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, b = newton(X, y, 1.0, s)
    model = learning.fit_linear_pairs(train, side, "prod")
    assert np.allclose(model.fitted.coefficients.toArray(), w, atol=2e-3)
    assert len(model.loss_curve) > 1 and model.loss_curve[-1] <= model.loss_curve[0]


def test_boosted_pairs(spark, tmp_path, rows, side):
    train = learning.training_pairs(rows, side, "row_id", n_neg=2).repartition(2).cache()
    model = learning.fit_boosted_pairs(train, side, rounds=4, max_depth=3, pca_components=6)
    curve = learning.loss_curves(model, {"train": train})
    assert [c[1] for c in curve] == [1, 2, 3, 4] and curve[-1][2] < curve[0][2]
    near = {r["row_id"]: r["scores"] for r in model.score_rows(rows).select("row_id", "scores").collect()}
    assert model.score_rows(rows).columns == [*rows.columns, "scores"]
    # the trees walked in batches give what Spark's own model gives for the pairs
    own = model.pair_scores(train).select("row_id", "label_idx", "score").collect()
    assert len(own) > 200 and all(abs(near[r["row_id"]][r["label_idx"]] - r["score"]) < 1e-12 for r in own)
    spark_loss = model.fitted.stages[-1].evaluateEachIteration(model.fitted.stages[0].transform(train).select("projected", "label"))
    assert np.allclose([c[2] for c in curve], spark_loss)
    path = str(tmp_path / "boosted")
    model_files.save_model(spark, model, path)
    again = model_files.load_model(spark, path)
    back = {r["row_id"]: r["scores"] for r in again.score_rows(rows).select("row_id", "scores").collect()}
    assert all(np.allclose(near[i], back[i]) for i in near)


def test_boosting_rows_are_dealt_to_few_partitions(spark, rows, side, monkeypatch):
    """Rounds on pairs in many partitions run on few, without their lineage, and give the same trees."""
    train = learning.training_pairs(rows, side, "row_id", n_neg=2).repartition(40).cache()
    whole = learning.GBTClassifier(labelCol="label", maxIter=3, maxDepth=3, stepSize=0.1, seed=42).fit(train)
    own, seen = learning.GBTClassifier.fit, []
    monkeypatch.setattr(learning.GBTClassifier, "fit", lambda self, df: seen.append(df) or own(self, df))
    model = learning.fit_boosted_pairs(train, side, rounds=3, max_depth=3)
    assert seen[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert seen[0].count() == train.count()
    got, want = learning.FlatTrees.of(model.fitted), learning.FlatTrees.of(learning.PipelineModel([whole]))
    assert (got.feature == want.feature).all() and (got.children == want.children).all()
    assert np.allclose(got.threshold, want.threshold) and np.allclose(got.value, want.value)
    # more partitions than cores where these would be large
    monkeypatch.setattr(learning, "MOST_VALUES", train.count() * 4 * D // 9)
    assert learning.dealt_for_rounds(train.select("label", "features"), 4 * D).rdd.getNumPartitions() in (9, 10)


def test_training_pairs_stay_where_their_text_is(spark, rows, side):
    """Neither a shuffle by the few labels nor a broadcast of the pairs, whatever Spark knows of sizes."""
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            made = learning.training_pairs(rows, side, "row_id")
            plan = made._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        assert "BroadcastHashJoin [label_key" in plan and "BuildRight" in plan and "BuildLeft" not in plan
    assert made.count() == made.select("row_id", "label_key").distinct().count() > 120


def test_boosted_scores_of_many_labels_and_null_vectors(spark, rows):
    rng = np.random.default_rng(9)
    keys = tuple(f"c::{i}" for i in range(40))
    side = LabelSide(keys, ("c",) * 40, tuple(map(tuple, rng.normal(size=(40, D)))))
    labelled = rows.withColumn("labels", F.expr("array(concat('c::', row_id % 40))"))
    gaps = labelled.withColumn("vector", F.when(F.col("row_id") % 7 > 0, F.col("vector")))
    model = learning.fit_boosted_pairs(learning.training_pairs(gaps, side, "row_id"), side, rounds=2, max_depth=2)
    scored = model.score_rows(gaps)
    assert "hashpartitioning" not in scored._jdf.queryExecution().executedPlan().toString()
    found = scored.select("row_id", "scores").collect()
    assert all((r.scores is None) == (r.row_id % 7 == 0) for r in found) and len(found) == 120
    assert {len(r.scores) for r in found if r.scores} == {40}
    assert model.score_rows(gaps.limit(0)).count() == 0
    whole = learning.evaluate_splits(model, {"train": labelled.filter("row_id < 80"), "eval": labelled.filter("row_id >= 80")})
    assert whole["train"]["n_rows"] == 80 and whole["eval"]["n_rows"] == 40
    assert whole["eval"]["micro_f1"] == learning.evaluate(model, labelled.filter("row_id >= 80"))["micro_f1"]


@pytest.mark.parametrize("mode", ["concat+diff+prod", "diff", "concat+prod"])
def test_pair_fit_equals_newton_on_expanded_features(rows, side, mode):
    train = learning.training_pairs(rows, side, "row_id", n_neg=2, mode=mode)
    got = [(r["features"].toArray(), r["label"]) for r in train.collect()]
    X, y = np.stack([x for x, _ in got]), np.array([v for _, v in got])
    w, b = newton(X, y, 0.5, np.ones(len(y)))
    model = learning.fit_linear_pairs(train, side, mode, C=0.5, balanced=False)
    assert np.allclose(model.fitted.coefficients.toArray(), w, atol=1e-4) and abs(model.fitted.intercept - b) < 1e-4
    assert len(model.loss_curve) < 20 and model.loss_curve[0] == pytest.approx(np.log(2))


def test_saved_linear_model(spark, tmp_path, rows, side):
    model = learning.fit_linear_pairs(learning.training_pairs(rows, side, "row_id"), side, max_iter=20)
    model.threshold = 0.4
    store = Store(spark, str(tmp_path), "models")
    store.submit_model(model, "pairs")
    again = store.get_model("pairs")
    assert again.threshold == 0.4 and again.loss_curve == pytest.approx(model.loss_curve)
    a = model.score_rows(rows).agg(F.sum(F.col("scores")[0])).first()[0]
    assert abs(a - again.score_rows(rows).agg(F.sum(F.col("scores")[0])).first()[0]) < 1e-6


def test_pca_equals_centred_svd(rows, data):
    X, _ = data
    train = learning.with_vector(rows, "vector")
    out = learning.centred_pca(train, 2).transform(train)
    got = np.stack([r["projected"].toArray() for r in out.orderBy("row_id").collect()])
    centred = X - X.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = centred @ vt[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    wide = learning.centred_pca(train, 99).transform(train).first()["projected"]
    assert len(wide) == D


@pytest.mark.parametrize("mode", ["concat+diff+prod", "diff+prod"])
def test_pair_axes_equal_svd_of_expanded_features(rows, side, mode):
    train = learning.training_pairs(rows, side, "row_id", n_neg=2, mode=mode)
    gaps = train.unionByName(train.limit(3).withColumn("vector", F.lit(None).cast("array<double>")))
    found = pair_fit.axes(pair_fit.compact(gaps), side.matrix, mode, 3)
    X = np.stack([r["features"].toArray() for r in train.collect()])
    centred = X - X.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(found.variances, s[:3] ** 2 / (len(X) - 1)) and np.allclose(found.total, X.var(0, ddof=1).sum())
    got = gaps.select("row_id", "label_key", "features", found.project("vector", "label_idx").alias("p"))
    seen = [r for r in got.collect() if r.p is not None]
    assert len(seen) == len(X) and got.filter("p is null").count() == 3
    for r in seen[:50]:
        want = (r["features"].toArray() - X.mean(0)) @ vt[:3].T
        assert np.allclose(np.abs(r.p), np.abs(want), atol=1e-6)  # features hold labels as floats


def test_predict_from_texts(spark, side):
    import pandas as pd

    def factory():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0, *[0.0] * (D - 2)] for t in texts], float)

    model = learning.CosineModel(side, threshold=0.1)
    table = spark.createDataFrame([(0, "abc"), (1, None)], "row_id bigint, text string")
    want = [tuple(r) for r in inference.predict(table, model, keep=["row_id", "text"], make_encoder=factory).orderBy("row_id").collect()]
    for texts in (["abc", None], pd.Series(["abc", None])):
        got = inference.predict(texts, model, make_encoder=factory, spark=spark)
        assert [tuple(r) for r in got.orderBy("row_id").collect()] == want and got.columns[:2] == ["row_id", "text"]
    with pytest.raises(ValueError, match="encoder"):
        inference.predict(["abc"], model, spark=spark)


def test_grid_search(spark):
    rng = np.random.default_rng(1)
    X = np.array([[2.0, 0]] * 3 + [[0, 2.0]] * 3) + rng.normal(0, 0.01, (6, 2))
    rows = [(i, x.tolist(), ["p" if i < 3 else "q"]) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "row_id bigint, vector array<double>, labels array<string>").coalesce(1)
    side = LabelSide.from_keys(["p", "q"])
    model, C, best, scores = learning.grid_search(df, side, "row_id", [0.1, 1.0, 10.0], cv=2)
    assert C in (0.1, 1.0, 10.0) and 0.0 <= best <= 1.0 and len(scores) == 3
    assert C == next(c for c, s in scores if s == best)
    assert model.weights.shape == (2, 2)


def test_separable_training_data(spark):
    X = [[2.0, 0.0], [3.0, 0.1], [0.0, 2.0], [0.1, 3.0]]
    rows = [(i, x, ["p" if i < 2 else "q"]) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "row_id bigint, vector array<double>, labels array<string>").coalesce(1)
    side = LabelSide.from_keys(["p", "q"])
    found = learning.evaluate(learning.fit_labelwise(df, side), df)
    assert found["micro_f1"] == found["macro_f1"] == found["row_accuracy"] == 1.0
    assert 0 <= found["mean_log_loss"] < 1


def test_rethreshold_equals_rescoring(rows, side):
    model = learning.CosineModel(side)
    snapshot = learning.score_snapshot(model, rows, ["row_id"])
    for thr in (0.0, 0.3):
        assert learning.snapshot_metrics(snapshot, side, thr) == pytest.approx(
            learning.evaluate(model, rows, thr), nan_ok=True
        )


def test_fit_summary_and_fallback(rows, side):
    train = learning.training_pairs(rows, side, "row_id", n_neg=2)
    model = learning.fit_linear_pairs(train, side, max_iter=20)
    found = learning.pair_fit_summary(model, train, train)
    assert found["fitted"] == 1.0 and found["n_pairs"] == found["n_eval_pairs"] == train.count()
    assert 0 < found["mean_loss"] < 1 and found["mean_loss"] == pytest.approx(found["mean_val_loss"])
    empty = learning.pair_fit_summary(None, train)
    assert empty["fitted"] == 0.0 and np.isnan(empty["mean_loss"])
    assert isinstance(learning.fitted_or_zero_shot(None, side), learning.CosineModel)
    assert learning.fitted_or_zero_shot(model, side) is model


def test_active_rounds(spark, tmp_path, rows, side):
    store = Store(spark, str(tmp_path), "demo")
    nothing = rows.withColumn("labels", F.expr("cast(array() as array<string>)"))
    first = active_round.run_round(store, nothing, rows, side, threshold=0.3)
    assert first.number == 0 and isinstance(first.model, learning.CosineModel)
    assert store.get_dataset("queue").count() == 120
    some = rows.withColumn("labels", F.when(F.col("row_id") < 60, F.col("labels")).otherwise(F.expr("cast(array() as array<string>)")))
    open_rows = some.filter("size(labels) = 0").count()
    for number in (1, 2):
        done = active_round.run_round(store, some, rows, side)
        assert done.number == number and done.queue_version == number + 1
    assert store.get_dataset("queue").count() == open_rows
    table = store.rounds().collect()
    assert [r["round"] for r in table] == [1, 2]
    assert table[0]["macro_f1"] == pytest.approx(done.metrics["macro_f1"])
    assert table[0]["labeled_total"] == 120 - open_rows


def test_a_round_of_another_model(spark, tmp_path, rows, side):
    store = Store(spark, str(tmp_path), "other")
    done = active_round.run_round(
        store, rows, rows, side, fit=lambda train: learning.fit_boosted_pairs(train, side, rounds=2, max_depth=2)
    )
    assert done.number == 1 and isinstance(done.model, learning.BoostedPairModel)
    assert 0 < store.rounds().first()["macro_f1"] <= 1


def test_ad_hoc_texts(spark, side):
    import pandas as pd

    for texts in (["x", None], pd.Series(["x", None])):
        rows = inference.as_text_frame(spark, texts).orderBy("row_id").collect()
        assert [r["text"] for r in rows] == ["x", None]
    table = spark.createDataFrame([("y",)], "text string")
    assert inference.as_text_frame(spark, table) is table


def test_swarm_decoding():
    specs = [
        {"name": "depth", "kind": "int", "min": 2, "max": 8},
        {"name": "rate", "kind": "log_float", "min": 0.01, "max": 1.0},
        {"name": "pca", "kind": "bool"},
        {"name": "mode", "kind": "choice", "choices": ["x", "y", "z"]},
        {"name": "f", "kind": "float", "min": 0, "max": 1},
    ]
    space = search.Space(specs)
    assert list(zip(space.low, space.high)) == [(2, 8), (-2, 0), (0, 1), (0, 2), (0, 1)]
    got = space.values([3.6, -1.0, 0.7, 5.0, 0.25])
    assert got == {"depth": 4, "rate": pytest.approx(0.1), "pca": True, "mode": "z", "f": 0.25}


def test_swarm_moves_to_the_minimum_and_survives_failures():
    def bowl(values):
        if values["x"] > 3.9:
            raise RuntimeError("bad place")
        return (values["x"] - 1.0) ** 2, 0.5

    specs = [{"name": "x", "kind": "float", "min": -4, "max": 4}]
    found = search.swarm_search(bowl, specs, particles=8, iterations=25, seed=0)
    assert abs(found.values["x"] - 1.0) < 0.05
    assert len(found.history) == 8 * 26
    again = search.swarm_search(bowl, specs, particles=8, iterations=25, seed=0)
    assert again.values == found.values

    def broken(values):
        raise RuntimeError("never")

    lost = search.swarm_search(broken, specs, particles=2, iterations=1)
    assert lost.fitness == float("inf") and all(h["error"] for h in lost.history)


def test_tuned_pair_model(rows, side):
    found = search.tune_linear_pairs(
        rows, rows, side, "row_id",
        [{"name": "C", "kind": "log_float", "min": 0.1, "max": 10}],
        metric="micro_f1", particles=2, iterations=0,
    )
    assert found.fitness < 0 and 0.0 < found.threshold < 1.0


# -- user-supplied models --------------------------------------------------------


def encoder_factory():
    """A nested factory travels by value, as this module is unknown to the workers."""

    def make_encoder():
        return lambda texts: np.array([[len(t), 1.0 + t.count("a")] for t in texts], dtype=float)

    return make_encoder


def test_encoder_batches_and_nulls(spark):
    texts = ["a" * (i % 7 + 1) for i in range(150)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["vector"] for r in inference.encode_texts(df, encoder_factory(), batch_size=16).collect()}
    assert got[150] is None
    raw = np.array([[len(t), 1 + t.count("a")] for t in texts[:-1]], dtype=float)
    want = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    assert np.allclose([got[i] for i in range(150)], want, atol=1e-6)


def test_label_embedding(spark):
    side = inference.embed_labels(spark, {"s": {"pos": "aa", "neg": "b"}}, encoder_factory())
    assert side.keys == ("s::pos", "s::neg")
    raw = np.array([[len("pos. aa"), 3.0], [len("neg. b"), 1.0]])
    assert np.allclose(side.matrix, raw / np.linalg.norm(raw, axis=1, keepdims=True), atol=1e-6)


def test_prompt_scorer(spark):
    df = spark.createDataFrame([("shoe", "red"), ("hat", "big")], "p string, tag string")
    asked = df.select("tag", text.pair_prompt("p", text.described_tag("tag", F.lit("d"))).alias("prompt"))
    out = {
        r["tag"]: r
        for r in inference.score_prompts(asked, lambda: lambda prompts: [2.0 if "red: d" in p else -2.0 for p in prompts]).collect()
    }
    assert out["red"]["score"] == pytest.approx(1 / (1 + np.exp(-2.0)))
    assert out["big"]["score"] < 0.5
    assert out["red"]["prompt"].startswith("Product text:\nshoe\n\nCandidate tag:\nred: d\n\n")


def test_generator_keeps_failures(spark):
    def make_generator():
        def run(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [f'x {{"f": "{p}"}}' for p in prompts]

        return run

    df = spark.createDataFrame([("p1", '{"f": "p1"}'), ("bad", '{"f": "z"}'), ("p2", '{"f": "q"}')], "prompt string, gold string")
    out = inference.generate_answers(df.coalesce(1), make_generator)
    rows = {r["prompt"]: r for r in out.collect()}
    assert rows["bad"]["generated"] is None and "ValueError" in rows["bad"]["error"]
    acc = {r["field"]: r for r in extraction.field_accuracy(out, "generated", "gold", ["f"]).collect()}
    assert acc["f"]["hits"] == 1 and acc["f"]["parse_failures"] == 1


def test_predict_threshold_override(spark, rows, side):
    model = learning.CosineModel(side, threshold=99.0)
    base = inference.predict(rows, model, keep=["row_id"])
    assert base.filter("`a::0`").count() == 0
    low = inference.predict(rows, model, threshold=-99.0, keep=["row_id"])
    assert low.filter("`a::0`").count() == 120


def test_hash_vectors_match_python(spark):
    import hashlib

    df = spark.createDataFrame([(0, "a b  a\tc"), (1, "   ")], "row_id int, text string")
    got = vectors.hash_vectors(df, "row_id", "text", dims=8).collect()
    want = np.zeros(8)
    for t in ["a", "b", "a", "c"]:
        want[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 8] += 1
    got = {r["row_id"]: r["vector"] for r in got}
    assert np.allclose(got[0], want / np.linalg.norm(want)) and got[1] == [0.0] * 8


def test_hash_vectors_move_nothing(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "x " * 50)], "row_id int, text string")
    out = vectors.hash_vectors(df.repartition(2), "row_id", "text", dims=8)
    assert [sum(v * v for v in r["vector"]) for r in out.orderBy("row_id").collect()] == pytest.approx([0, 0, 1])
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_cosine_and_labelwise_through_the_store(spark, tmp_path, rows, side):
    store = Store(spark, str(tmp_path), "models")
    for model in (learning.CosineModel(side, 0.3), learning.fit_labelwise(rows, side, max_iter=10)):
        kind = type(model).__name__.lower()
        store.submit_model(model, kind)
        again = store.get_model(kind)
        assert type(again) is type(model) and again.threshold == model.threshold
        both = [m.score_rows(rows).agg(F.sum(F.col("scores")[1])).first()[0] for m in (model, again)]
        assert both[0] == pytest.approx(both[1])


def test_rows_without_vector_stay_in_every_count(spark, side):
    width = len(side.vectors[0])
    frame = spark.createDataFrame(
        [(0, [1.0] * width, [side.keys[0]]), (1, None, [side.keys[0]]), (2, None, [])],
        "row_id int, vector array<float>, labels array<string>",
    )
    scored = learning.CosineModel(side).score_rows(frame).withColumn("truth", scoring.truth_array("labels", side))
    counts = metrics.confusion_counts(scoring.long_scores(scored, side, [], truth="truth"), 0.5).collect()
    assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == 3 for r in counts)
    assert metrics.row_outcomes(scored, 0.5).filter("all_right is null").count() == 0


def test_early_stopping_is_asked_for(rows, side):
    assert learning.boosting_rounds(0, 7) == 7 and learning.boosting_rounds(3, 7) == 21
    train = learning.training_pairs(rows, side, "row_id", n_neg=1)
    with pytest.raises(ValueError, match="validation"):
        learning.fit_boosted_pairs(train, side, rounds=2, early_stopping=True)
    plain = learning.fit_boosted_pairs(train, side, rounds=3, max_depth=2, validation=train, extra={"subsamplingRate": 0.9})
    assert plain.fitted.stages[-1].getNumTrees == 3


def test_train_and_submit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), "demo")
    good, bad = ["aaa nice", "aa nice aaa", "a nice a a"], ["bbbb bbbbbb bbbbbbb", "bbb bbbbbbbbb", "bbbbbbbbbb"]
    rows = [(i, t, "good" if i < 3 else "bad,other") for i, t in enumerate(good + bad)]
    schema = "row_id bigint, text string, labels string"
    store.submit_dataset(spark.createDataFrame(rows, schema).coalesce(1), "train")
    store.submit_dataset(spark.createDataFrame(rows[1:5], schema).coalesce(1), "test")
    version, scores = train_submit.train_and_submit(
        store, "train", "test", encoder_factory(), C=100.0
    )
    assert version == 1 and scores["train_f1_micro"] == 1.0 and scores["val_loss"] >= 0
    params = store.model_run_params("classifier")
    assert params["labels"] == '["bad", "good", "other"]' and params["train.version"] == "1"
    assert params["base_model"] == "embedder" and params["train.rows"] == "6"
    model = store.get_model("classifier")
    df = inference.encode_texts(spark.createDataFrame(rows, schema), encoder_factory())
    wide = {r["row_id"]: r for r in inference.predict(df, model, keep=["row_id"]).collect()}
    assert wide[0]["good"] and not wide[0]["bad"] and wide[5]["other"]
    kept = store.get_predictions("classifier", "train")
    assert kept.columns == ["text", "true", "predicted"] and kept.filter(F.col("true") == F.col("predicted")).count() == 6


@pytest.mark.parametrize(
    "name, module, fit, least",
    [
        *((n, learning, "fit_linear_pairs", {"max_iter": 1000}) for n in ("logreg_pairs", "loss_curve", "pair_fit_summary", "model_scores")),
        ("gbt_pairs", learning, "fit_boosted_pairs", {"rounds": 200, "max_depth": 6}),
        ("swarm_search", search, "swarm_search", {"particles": 5, "iterations": 4}),
    ],
)
def test_queries_use_whole_settings(spark, monkeypatch, name, module, fit, least):
    import inspect

    from labelweave.plans import model_queries

    own, used = getattr(module, fit), {}

    def seen(*args, **kwargs):
        bound = inspect.signature(own).bind(*args, **kwargs)
        bound.apply_defaults()
        used.update(bound.arguments)
        raise StopIteration

    monkeypatch.setattr(module, fit, seen)
    with pytest.raises(StopIteration):
        getattr(model_queries, name)(spark, "/root/testdata/sf0.001")
    assert {k: used[k] for k in least} == least


def test_split_snapshot_scores(spark, rows, side):
    """Both splits, also one whose rows lack a vector, against the metrics of one table."""
    model = learning.CosineModel(side, threshold=0.3)
    bare = rows.limit(7).withColumn("vector", F.lit(None).cast(dict(rows.dtypes)["vector"]))
    snapshot = learning.split_snapshot(model, {"all": rows, "bare": bare}, ["row_id"]).persist()
    got = {(r["split"], r["threshold"]): r for r in learning.split_scores(snapshot, side, [0.1, 0.5]).collect()}
    assert len(got) == 4
    for t in (0.1, 0.5):
        one = learning.evaluate(model, rows, t)
        assert got["all", t]["n_eval"] == rows.count() and got["bare", t]["n_eval"] == 7
        assert abs(got["all", t]["macro_f1"] - one["macro_f1"]) < 1e-12
        assert abs(got["all", t]["micro_f1"] - one["micro_f1"]) < 1e-12
        assert got["bare", t]["micro_f1"] == 0
