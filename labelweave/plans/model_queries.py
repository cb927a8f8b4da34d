"""Fits, model scores and searches over the given vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning, metrics, pair_fit, scoring, search
from ..operators.ranking import mark_hash_split, test_size
from ..session import ensure_checkpoint_dir
from . import views
from .catalog import query
from .metric_queries import _SWEEP, rounded
from .pair_queries import _PAIRS_SQL


def rows(spark, d):
    return views.vec_labels(spark, d).withColumnRenamed("embedding", "vector")


def split_rows(spark, d):
    """Labelled rows as 70 % train and 30 % test."""
    labelled = rows(spark, d).filter(F.size("labels") > 0)
    marked = mark_hash_split(labelled, "vec_id", test_size(0.3), views.SEED).persist()
    return marked.filter(~F.col("is_test")), marked.filter("is_test")


def metric_rows(spark, values: dict, **extra):
    names = list(extra)
    data = [(*extra.values(), k, float(v)) for k, v in values.items()]
    schema = ", ".join(f"{n} string" for n in names) + (", " if names else "")
    return spark.createDataFrame(data, schema + "metric string, value double")


@query("logreg_ovr")
def logreg_ovr(spark, d):
    """Weights of one regression per label."""
    side = views.label_side(spark, d)
    model = learning.fit_labelwise(rows(spark, d), side)
    data = [
        (k, float(b), [float(x) for x in w])
        for k, w, b in zip(side.keys, model.weights, model.offsets)
    ]
    return spark.createDataFrame(data, "label_key string, offset double, weights array<double>")


@query("logreg_pairs")
def logreg_pairs(spark, d):
    """Pair regression on the train part, evaluated on the test part."""
    side = views.label_side(spark, d)
    train, test = split_rows(spark, d)
    model = learning.fit_linear_pairs(learning.training_pairs(train, side, "vec_id"), side)
    return metric_rows(spark, learning.evaluate(model, test))


@query("gbt_pairs")
def gbt_pairs(spark, d):
    """Boosted trees on projected pair features: loss per round on both parts."""
    side = views.label_side(spark, d)
    train, test = split_rows(spark, d)
    train_pairs = learning.training_pairs(train, side, "vec_id")
    test_pairs = learning.training_pairs(test, side, "vec_id")
    model = learning.fit_boosted_pairs(train_pairs, side, pca_components=16)
    curves = learning.loss_curves(model, {"train": train_pairs, "test": test_pairs})
    return spark.createDataFrame(curves, "split string, round int, loss double")


@query("loss_curve")
def loss_curve(spark, d):
    """Objective of the pair regression after every iteration."""
    side = views.label_side(spark, d)
    model = learning.fit_linear_pairs(learning.training_pairs(rows(spark, d), side, "vec_id"), side)
    return spark.createDataFrame(list(enumerate(model.loss_curve)), "iteration int, loss double")


@query("pair_fit_summary")
def pair_fit_summary(spark, d):
    """Pair counts and mean losses of the pair regression on both parts."""
    side = views.label_side(spark, d)
    train, test = (learning.training_pairs(part, side, "vec_id") for part in split_rows(spark, d))
    model = learning.fit_linear_pairs(train, side)
    return metric_rows(spark, learning.pair_fit_summary(model, train, test))


@query("pca_project")
def pca_project(spark, d):
    """Pair features on their first 8 principal axes."""
    side = views.label_side(spark, d)
    train = learning.training_pairs(rows(spark, d), side, "vec_id")
    found = pair_fit.axes(pair_fit.compact(train), side.matrix, "concat+diff+prod", 8)
    return train.select("vec_id", "label_key", found.project("vector", "label_idx").alias("projected"))


@query(
    "pca_variance",
    _PAIRS_SQL
    + """, d AS (SELECT i, t, l FROM (
    SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS t, unnest(vector_label)::DOUBLE AS l
    FROM pairs JOIN vec_labels USING (vec_id) JOIN label_vectors USING (label_key)))
SELECT round(sum(v), 6) AS total_variance FROM (
  SELECT var_samp(t) + var_samp(l) + var_samp(t - l) + var_samp(t * l) AS v FROM d GROUP BY i)""",
)
def pca_variance(spark, d):
    """Variance of all pair features together, from the moments that the axes come from."""
    side = views.label_side(spark, d)
    train = learning.training_pairs(rows(spark, d), side, "vec_id")
    found = pair_fit.axes(pair_fit.compact(train), side.matrix, "concat+diff+prod", 8)
    return spark.createDataFrame([(round(found.total, 6),)], "total_variance double")


@query(
    "pair_fit_checks",
    _PAIRS_SQL
    + """, c AS (SELECT count(*) AS n, sum(label) AS p FROM pairs)
SELECT unnest(['n_pairs', 'positive_weight', 'negative_weight', 'prior_loss', 'slope_vanishes']) AS metric,
  unnest([n::DOUBLE, round(n / (2 * p), 6), round(n / (2 * (n - p)), 6), round(ln(2), 6), 1.0]) AS value FROM c""",
)
def pair_fit_checks(spark, d):
    """What the pair regression starts from and ends with: pairs, class weights, the loss
    without weights, and whether the gradient is gone at the weights found."""
    side = views.label_side(spark, d)
    train = pair_fit.compact(learning.training_pairs(rows(spark, d), side, "vec_id"))
    n, up, down = pair_fit.class_weights(train)
    found, curve = pair_fit.fit(train, side.matrix, "concat+diff+prod")
    slope = pair_fit.slope(train, side.matrix, "concat+diff+prod", found, 1.0, True)
    values = {
        "n_pairs": n, "positive_weight": round(up, 6), "negative_weight": round(down, 6),
        "prior_loss": round(curve[0], 6), "slope_vanishes": float(abs(slope).max() < 1e-5),
    }
    return metric_rows(spark, values)


@query("grid_search")
def grid_search(spark, d):
    """Mean micro F1 per C over three contiguous folds."""
    side = views.label_side(spark, d)
    _, best, _, scores = learning.grid_search(
        rows(spark, d), side, "vec_id", [0.01, 0.1, 1.0, 10.0], cv=3
    )
    data = [(c, s, c == best) for c, s in scores]
    return spark.createDataFrame(data, "C double, micro_f1 double, is_best boolean")


@query("model_scores")
def model_scores(spark, d):
    """Match probability of every (row, label) from the fitted pair regression."""
    side = views.label_side(spark, d)
    model = learning.fit_linear_pairs(learning.training_pairs(rows(spark, d), side, "vec_id"), side)
    return scoring.long_scores(model.score_rows(rows(spark, d)), side, ["vec_id"])


# a model with given weights: three times the label's own vector, less a fixed offset
_GIVEN = (
    views.with_views("label_vectors", "vec_labels")
    + """, given AS (
  SELECT v.vec_id, k.label_idx, k.label_key, k.category, list_contains(v.labels, k.label_key) AS truth,
    1 / (1 + exp(-(3 * list_dot_product(v.embedding::DOUBLE[], k.vector_label::DOUBLE[]) - 0.5))) AS p
  FROM vec_labels v CROSS JOIN label_vectors k),
c AS (SELECT label_idx, count(*) FILTER (p >= 0.5 AND truth) AS tp, count(*) FILTER (p >= 0.5 AND NOT truth) AS fp,
    count(*) FILTER (p < 0.5 AND truth) AS fn,
    avg(-ln(CASE WHEN truth THEN p ELSE 1 - p END)) AS loss FROM given GROUP BY 1),
prf AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c),
s AS (SELECT avg(pr) AS macro_p, avg(re) AS macro_r, avg(f1) AS macro_f1,
    coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0) AS micro_p,
    coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0) AS micro_r,
    coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) AS micro_f1,
    avg(loss) AS mean_log_loss FROM prf),
r AS (SELECT avg(ok::INT) AS row_accuracy FROM (SELECT vec_id, bool_and((p >= 0.5) = truth) AS ok FROM given GROUP BY 1))
"""
)


def given_model(side):
    return learning.LabelwiseModel(side, 3 * side.matrix, [-0.5] * len(side))


@query("given_model_scores", _GIVEN + "SELECT vec_id, label_idx, label_key, category, round(p, 6) AS score FROM given")
def given_model_scores(spark, d):
    """Probabilities of every (row, label) from a model with given weights."""
    side = views.label_side(spark, d)
    long = scoring.long_scores(given_model(side).score_rows(rows(spark, d)), side, ["vec_id"])
    return long.withColumn("score", F.round("score", 6))


_METRICS = ("macro_p", "macro_r", "macro_f1", "micro_p", "micro_r", "micro_f1", "mean_log_loss")


@query(
    "evaluate_given_model",
    _GIVEN
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 6) AS value FROM s" for m in _METRICS)
    + " UNION ALL SELECT 'row_accuracy', round(row_accuracy, 6) FROM r",
)
def evaluate_given_model(spark, d):
    """All summary numbers of a model with given weights, on its own classes."""
    found = learning.evaluate(given_model(views.label_side(spark, d)), rows(spark, d))
    return metric_rows(spark, {k: round(v, 6) for k, v in found.items()})


@query("evaluate_model")
def evaluate_model(spark, d):
    """Zero-shot and fitted model on the same test part."""
    side = views.label_side(spark, d)
    train, test = split_rows(spark, d)
    fitted = learning.fit_labelwise(train, side)
    zero = learning.CosineModel(side, threshold=views.THRESHOLD)
    return metric_rows(spark, learning.evaluate(zero, test), model="zero_shot").unionByName(
        metric_rows(spark, learning.evaluate(fitted, test), model="fitted")
    )


@query(
    "rethreshold",
    views.with_views("scores")
    + _SWEEP.replace("range(99) t(i)", "(VALUES (4), (9), (19)) t(i)")
    + """SELECT round(threshold, 9) AS threshold, round(macro_f1, 9) AS macro_f1, round(micro_f1, 9) AS micro_f1 FROM s2""",
)
def rethreshold(spark, d):
    """Scores are written once and summed up again for every threshold."""
    side = views.label_side(spark, d)
    ensure_checkpoint_dir(spark)
    snapshot = views.scored(spark, d, side).select("scores", "truth").checkpoint()
    grid = metrics.threshold_grid()
    out = None
    for t in (grid[4], grid[9], grid[19]):
        counts = metrics.confusion_counts(
            scoring.long_scores(snapshot, side, [], truth="truth"), t
        )
        one = metrics.macro_micro(counts).select(
            F.lit(t).alias("threshold"), "macro_f1", "micro_f1"
        )
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(
    "rethreshold_splits",
    views.with_views("scores")
    + """, ranked AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', vec_id)), vec_id) AS rn,
  count(*) OVER () AS n FROM vec_labels WHERE len(labels) > 0),
parts AS (SELECT vec_id, CASE WHEN rn <= ceil(0.3 * n) THEN 'test' ELSE 'train' END AS split FROM ranked),
c AS (SELECT split, threshold, label_idx, count(*) AS n, count(*) FILTER (score >= threshold AND truth) AS tp,
  count(*) FILTER (score >= threshold AND NOT truth) AS fp, count(*) FILTER (score < threshold AND truth) AS fn
  FROM scores JOIN parts USING (vec_id), (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) g(threshold) GROUP BY ALL)
SELECT split, threshold, max(n) AS n_eval,
  round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS macro_f1,
  round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 9) AS micro_f1
FROM c GROUP BY split, threshold""",
)
def rethreshold_splits(spark, d):
    """Both splits with their row counts, at several thresholds, from scores written once."""
    side = views.label_side(spark, d)
    ensure_checkpoint_dir(spark)
    scored = views.scored(spark, d, side).filter(F.size("labels") > 0)
    marked = mark_hash_split(scored.select("vec_id", "scores", "truth"), "vec_id", test_size(0.3), views.SEED)
    split = F.when(F.col("is_test"), "test").otherwise("train").alias("split")
    snapshot = marked.select(split, "scores", "truth").checkpoint()
    return rounded(learning.split_scores(snapshot, side, [0.05, 0.1, 0.2]))


@query("swarm_search")
def swarm_search(spark, d):
    """All evaluations of a small swarm over C and the number of negatives."""
    side = views.label_side(spark, d)
    train, test = split_rows(spark, d)
    found = search.tune_linear_pairs(
        train,
        test,
        side,
        "vec_id",
        [
            {"name": "C", "kind": "log_float", "min": 0.01, "max": 100.0},
            {"name": "n_neg", "kind": "int", "min": 1, "max": 6},
        ],
    )
    data = [
        (h["iteration"], h["particle"], h["values"]["C"], h["values"]["n_neg"], h["fitness"], h["threshold"])
        for h in found.history
    ]
    return spark.createDataFrame(
        data,
        "iteration int, particle int, C double, n_neg int, fitness double, threshold double",
    )
