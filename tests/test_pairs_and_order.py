import hashlib
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import frames, generation, pairs, queues, ranking, vocabularies

KEYS = [f"c::{i}" for i in range(5)]


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [str(k) for k in rng.choice(KEYS, 2, replace=False)]) for i in range(20)]
    rows += [(20, []), (21, ["x::unknown"])]
    return spark.createDataFrame(rows, "row_id bigint, labels array<string>")


def test_contrastive_pairs(texts, spark):
    got = pairs.contrastive_pairs(texts, KEYS, "row_id", n_neg=2).collect()
    labels = {r["row_id"]: r["labels"] for r in texts.collect()}
    per = defaultdict(list)
    for r in got:
        per[r["row_id"]].append((r["label_key"], r["label"]))
    assert set(per) == set(range(20))
    for i, items in per.items():
        assert sorted(k for k, y in items if y) == sorted(labels[i])
        want = sorted(
            (k for k in KEYS if k not in labels[i]),
            key=lambda k: hashlib.md5(f"42|{i}|{k}".encode()).hexdigest(),
        )[:2]
        assert sorted(k for k, y in items if not y) == sorted(want)
    table = spark.createDataFrame(list(enumerate(KEYS)), "label_idx int, label_key string")
    same = pairs.contrastive_pairs_from_table(texts, table, "row_id", n_neg=2, block_labels=2)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, got))


def test_ratio_pairs(spark):
    df = spark.createDataFrame([(0, ["b", "a", "b"]), (1, ["a", "b", "c", "d"])], "row_id int, tags array<string>")
    got = pairs.ratio_pairs(df, ["a", "b", "c", "d"], "row_id", negatives_per_positive=3).collect()
    counts = Counter((r["row_id"], r["label"]) for r in got)
    assert counts == {(0, 1): 2, (0, 0): 2, (1, 1): 4}


def test_all_pairs(spark):
    df = spark.createDataFrame([(0, ["b"])], "row_id int, labels array<string>")
    got = {(r["label_key"], r["label"]) for r in pairs.all_pairs(df, ["a", "b"], "row_id").collect()}
    assert got == {("a", 0), ("b", 1)}


def test_pairs_have_no_join_and_no_shuffle(texts):
    plan = pairs.contrastive_pairs(texts, KEYS, "row_id")._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "Exchange" not in physical and "Join" not in physical and "Window" not in physical


def check_partners(rows, labels, iterations):
    seen = Counter()
    for r in rows:
        a, b = set(labels[r["row_id"]]), set(labels[r["partner_id"]])
        assert r["row_id"] != r["partner_id"]
        assert bool(a & b) == (r["label"] == 1)
        seen[(r["row_id"], r["label"])] += 1
    for i, own in labels.items():
        others = [set(l) for j, l in labels.items() if j != i and l]
        near = any(set(own) & o for o in others)
        far = any(not (set(own) & o) for o in others)
        assert seen[(i, 1)] == (iterations if own and near else 0)
        assert seen[(i, 0)] == (iterations if own and far else 0)


def test_text_pairs(spark, texts):
    labels = {r["row_id"]: r["labels"] for r in texts.collect()}
    rows = pairs.text_pairs(texts, "row_id", num_iterations=3).collect()
    check_partners(rows, labels, 3)


def test_text_pairs_with_hot_label(spark):
    """Nearly all texts share a label, so the exact fallback has to find partners."""
    rows = [(i, ["hot", f"l{i % 3}"]) for i in range(60)] + [(60, ["rare"]), (61, ["hot", "rare"])]
    df = spark.createDataFrame(rows, "row_id bigint, labels array<string>")
    got = pairs.text_pairs(df, "row_id", num_iterations=2).collect()
    check_partners(got, dict(rows), 2)


@pytest.mark.parametrize("k", [1, 2, 37, 99, 100])
def test_kth_smallest(spark, k):
    rng = np.random.default_rng(k)
    values = np.unique(rng.integers(-(10**15), 10**15, 400))[:100]
    values[:5] = values[0] + np.arange(5)
    df = spark.createDataFrame([(int(v),) for v in rng.permutation(values)], "x bigint")
    assert ranking.kth_smallest(df, "x", k)[0] == sorted(values)[k - 1]
    assert ranking.kth_smallest(df, "x", 101) is None


def jobs_of(spark, run):
    """Number of jobs that a call starts, by its job group."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_order_statistics_share_their_passes(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.integers(-(10**15), 10**15, 6000), np.full(3000, 7)])
    df = spark.createDataFrame([(int(v),) for v in values], "x bigint").coalesce(2)
    ks = [0, 1, 2, 3000, 4500, 4501, 9000, 9001, 4500]
    found, order = ranking.order_statistics(df, "x", ks), np.sort(values)
    for k, f in zip(ks, found):
        at = int(order[k - 1]) if 1 <= k <= len(order) else None
        assert f == (None if at is None else (at, int((values < at).sum())))


def test_cuts_take_few_passes(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a job a pass
    try:
        df = spark.range(60_000).select((F.col("id") * 3).alias("row_id"))
        folds, passes = jobs_of(spark, lambda: ranking.contiguous_folds(df, "row_id", 5))
        assert passes <= 3
        split, passes = jobs_of(spark, lambda: ranking.mark_hash_split(df, "row_id", ranking.test_size(0.3)))
        assert passes <= 3
        assert [r["count"] for r in folds.groupBy("fold").count().collect()] == [12_000] * 5
        assert split.filter("is_test").count() == 18_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hash_cut_of_empty_and_whole_tables(spark):
    empty = spark.range(0).withColumnRenamed("id", "row_id")
    assert ranking.mark_hash_split(empty, "row_id", ranking.test_size(0.3)).count() == 0
    some = spark.range(5).withColumnRenamed("id", "row_id")
    for k in (0, 5, 9):
        assert some.filter(ranking.hash_cut(some, "row_id", k, 1)).count() == min(k, 5)


def test_numbered_vocabulary_and_dealt_negatives(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c", None, "hot"])] + [(i, ["hot"]) for i in range(5, 60)]
    rows += [(100 + i, [f"k{i}"]) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id bigint, tags array<string>")
    vocab = vocabularies.numbered_vocabulary(df, "tags").checkpoint()
    names = [r["label_key"] for r in vocab.orderBy("label_idx").collect()]
    assert names == sorted({t for _, ts in rows for t in ts or [] if t})
    numbers = {r["row_id"]: r["label_ids"] for r in vocabularies.label_numbers(df, vocab, "row_id", "tags").collect()}
    assert numbers == {i: sorted(names.index(t) for t in set(ts or []) if t) for i, ts in rows}
    wide = vocabularies.ratio_pairs_from_table(df, vocab, "row_id", negatives_per_positive=3).collect()
    for i, ts in rows:
        own = {t for t in ts or [] if t}
        plus = [r["label_key"] for r in wide if r["row_id"] == i and r["label"] == 1]
        minus = [r["label_key"] for r in wide if r["row_id"] == i and r["label"] == 0]
        assert sorted(plus) == sorted(own)
        assert len(minus) == len(set(minus)) == min(3 * len(own), len(names) - len(own)) and not own & set(minus)
    everything = vocabularies.ratio_pairs_from_table(df, vocab, "row_id", negatives_per_positive=99)
    assert everything.groupBy("row_id").count().filter(f"count <> {len(names)}").count() == 0
    none = vocabularies.numbered_vocabulary(df.filter("false"), "tags")
    assert none.count() == 0
    assert {tuple(r[0]) for r in df.select(vocabularies.dense_hot(F.array(F.lit(1)), 0)).collect()} == {()}


def test_slot_table_gives_the_same_texts(spark):
    templates = [("s::pos", "The {thing} is {good} and {good}."), ("s::neg", "{thing} broke."), ("s::no", "Nothing")]
    slots = {"thing": ["box", "cable", "lamp"], "good": ["fine", "great", "solid"]}
    tables = {k: (spark.createDataFrame([(x,) for x in [*v, *v, None]], "v string"), "v") for k, v in slots.items()}
    table = generation.slot_table(tables)
    tries = spark.range(200).withColumnRenamed("id", "try_id")
    made = generation.filled_templates(tries, "try_id", templates, slots, 3)
    joined = generation.filled_from_table(tries, "try_id", templates, table, 3)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, made.collect()))
    with pytest.raises(KeyError):
        generation.filled_from_table(tries, "try_id", [("a", "{none}")], table)


@pytest.mark.parametrize("n", [1, 2, 10, 33])
def test_split_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    marked = ranking.mark_hash_split(df, "row_id", ranking.test_size(0.3))
    chosen = {r[0] for r in marked.filter("is_test").select("row_id").collect()}
    order = sorted(range(n), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert chosen == set(order[: -(-3 * n // 10)])


def test_split_by_text_keeps_equal_texts_together(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(70)], "row_id int, text string")
    out = ranking.split_by_text(df, "text", 0.25).groupBy("text").agg(
        F.count_distinct("is_validation").alias("n"), F.max("is_validation").alias("v")
    ).collect()
    assert all(r["n"] == 1 for r in out)
    assert sum(r["v"] for r in out) == 2  # half-even rounding of 1.75


@pytest.mark.parametrize("n,k,sizes", [(10, 3, [4, 3, 3]), (10, 4, [3, 3, 2, 2]), (2, 3, [1, 1])])
def test_folds(spark, n, k, sizes):
    df = spark.range(n).select((F.col("id") * 7 + 3).alias("row_id"))
    out = ranking.contiguous_folds(df, "row_id", k).groupBy("fold").count().collect()
    assert [c for _, c in sorted(map(tuple, out))] == sizes


def test_global_rank_with_ties(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("v"))
    got = {r["id"]: r["position"] for r in ranking.global_rank(df, ["v", "id"]).collect()}
    order = sorted(range(1000), key=lambda i: (0 if i % 3 == 0 else i % 5, i))
    assert got == {i: p + 1 for p, i in enumerate(order)}


def test_rank_within_hot_group(spark):
    df = spark.range(500).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g")
    ).withColumn("h", ranking.hash_order(1, "id"))
    got = [(r["id"], r["rn"]) for r in ranking.rank_within(df, ["g"], "h", "id").filter("g = 'hot'").collect()]
    order = sorted(range(0, 500, 3), key=lambda i: hashlib.md5(f"1|{i}".encode()).hexdigest())
    assert dict(got) == {i: p + 1 for p, i in enumerate(order)}


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.random(3).round(2).tolist(), ["x"] if i % 4 == 0 else []) for i in range(40)]
    return spark.createDataFrame(rows, "row_id bigint, scores array<double>, labels array<string>")


@pytest.mark.parametrize("strategy", queues.STRATEGIES)
def test_queues(scored, strategy):
    rows = [r for r in scored.collect() if not r["labels"]]
    key = {
        "margin": lambda r: min(abs(s - 0.5) for s in r["scores"]),
        "least_confidence": lambda r: max(r["scores"]),
        "random": lambda r: hashlib.md5(f"42|{r['row_id']}".encode()).hexdigest(),
    }[strategy]
    want = [r["row_id"] for r in sorted(rows, key=lambda r: (key(r), r["row_id"]))]
    got = queues.label_queue(scored, "row_id", strategy).orderBy("position").collect()
    assert [r["row_id"] for r in got] == want
    head = queues.queue_head(scored, "row_id", 5, strategy).collect()
    assert [r["row_id"] for r in head] == want[:5]
    with pytest.raises(ValueError):
        queues.urgency("other", "row_id")


def test_navigation(spark, scored):
    queue = queues.label_queue(scored, "row_id", "margin")
    order = [r["row_id"] for r in queue.orderBy("position").collect()]
    done = spark.createDataFrame([(order[0],), (order[1],)], "row_id bigint")
    assert queues.next_item(queue, done, "row_id").first()["row_id"] == order[2]
    assert queues.next_unlabelled(scored, "row_id", 3).first()[0] == 5
    assert queues.next_unlabelled(scored, "row_id", 39).first()[0] == 1
    assert queues.first_unlabelled(scored, "row_id").first()[0] == 1
    assert queues.first_unlabelled(frames.labelled_rows(scored), "row_id").first()[0] == 0


def test_generated_texts(spark):
    templates = [("s::pos", "The {thing} is {good} and {good}."), ("s::neg", "{thing} broke.")]
    slots = {"thing": ["box", "cable", "lamp"], "good": ["fine", "great", "solid"]}
    made = generation.generate(spark, 12, templates, slots, seed=1)
    rows = made.collect()
    assert len(rows) == 12 and len({r["text"] for r in rows}) == 12
    assert all("{" not in r["text"] for r in rows)
    assert all(("broke" in r["text"]) == (r["label_key"] == "s::neg") for r in rows)
    words = {tuple(t.split(" is ")[1].rstrip(".").split(" and ")) for t in (r["text"] for r in rows) if " is " in t}
    assert any(a != b for a, b in words), "repeated slots are drawn independently"
    more = generation.generate(spark, 5, templates, slots, seed=2, avoid=made)
    assert not {r["text"] for r in more.collect()} & {r["text"] for r in rows}
    with pytest.raises(RuntimeError):
        generation.generate(spark, 1000, templates, slots)
    with pytest.raises(KeyError):
        generation.fill_slots("{none}", slots, 1, "id", "b")


def test_fewer_generated_texts(spark):
    """All texts there are, or none, where that may be fewer than asked for."""
    templates = [("s::neg", "{thing} broke."), ("s::pos", "{thing} is fine.")]
    slots = {"thing": ["box", "cable", "lamp"]}
    some = generation.generate(spark, 20, templates, slots, fewer=True)
    assert len({r["text"] for r in some.collect()}) == some.count() == 6
    rest = generation.generate(spark, 20, templates, slots, avoid=some.filter("try_id % 2 = 0"), fewer=True)
    assert {r["try_id"] for r in rest.collect()} == {r["try_id"] for r in some.collect() if r["try_id"] % 2}
    assert generation.generate(spark, 20, templates, slots, avoid=some, fewer=True).count() == 0
    with pytest.raises(RuntimeError):
        generation.generate(spark, 20, templates, slots)


def test_rank_within_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([(1, "g"), (2, None), (3, None)], "id bigint, g string")
    df = df.withColumn("h", ranking.hash_order(1, "id"))
    got = {r["id"]: (r["rn"], r["n"]) for r in ranking.rank_within(df, ["g"], "h", "id", size="n").collect()}
    assert got[1] == (1, 1) and sorted([got[2], got[3]]) == [(1, 2), (2, 2)]
