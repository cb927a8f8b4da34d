import random

import pytest
from pyspark.sql import functions as F

from labelweave.operators import inference
from labelweave.operators.learning import CosineModel
from labelweave.operators.scoring import LabelSide
from labelweave.streaming import events as ev

KEYS = ["t::a", "t::b", "t::c"]


def made_events(n, rows, seed, hot=True):
    """Edits where row 0 gets a third of all."""
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        row = 0 if hot and rng.random() < 0.33 else rng.randrange(rows)
        action = rng.choices(["on", "off", "clear"], [6, 3, 1])[0]
        out.append((seq, row, rng.choice(KEYS), action))
    return out


def replay(events, every, trained_at=0):
    """The event loop, one edit at a time."""
    labels, rounds, out = {}, 0, []
    for seq, row, key, action in events:
        have = labels.setdefault(row, set())
        if action == "on":
            have.add(key)
        elif action == "off":
            have.discard(key)
        else:
            have.clear()
        total = sum(bool(v) for v in labels.values())
        if every > 0 and total - trained_at >= every:
            trained_at, rounds = total, rounds + 1
        out.append((seq, total, rounds, max(0, every - (total - trained_at))))
    return {r: sorted(v) for r, v in labels.items()}, out


@pytest.fixture(scope="module")
def edits():
    return made_events(600, 80, 5)


def test_fold(spark, edits):
    df = spark.createDataFrame(edits, ev.EVENT_SCHEMA)
    got = {r["row_id"]: r["labels"] for r in ev.labels_now(df).collect()}
    assert got == replay(edits, 0)[0]


def test_merged_folds_equal_one_fold(spark, edits):
    df = spark.createDataFrame(edits, ev.EVENT_SCHEMA)
    parts = [ev.fold_edits(df.filter(F.col("seq") % 3 == i)) for i in range(3)]
    merged = ev.merge_folds(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(tuple, ev.current_edits(merged).collect())) == sorted(
        map(tuple, ev.labels_now(df).collect())
    )


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_retrain_rounds(spark, edits, ranges):
    df = spark.createDataFrame(edits, ev.EVENT_SCHEMA)
    got = ev.retrain_rounds(df, 5, ranges).orderBy("seq").collect()
    assert [(r["seq"], r["labelled_total"], r["round"], r["remaining"]) for r in got] == replay(edits, 5)[1]


def test_no_retraining_when_switched_off(spark, edits):
    df = spark.createDataFrame(edits[:50], ev.EVENT_SCHEMA)
    assert ev.retrain_rounds(df, 0).agg(F.max("round"), F.max("remaining")).first() == (0, 0)


def file_stream(spark, tmp_path, edits, batches):
    folder = str(tmp_path / "in")
    step = -(-len(edits) // batches)
    for i in range(batches):
        part = spark.createDataFrame(edits[i * step : (i + 1) * step], ev.EVENT_SCHEMA)
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ev.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_fold(spark, tmp_path, edits):
    root = str(tmp_path / "fold")
    ev.start_labelling(file_stream(spark, tmp_path, edits, 4), root).awaitTermination(120)
    got = {r["row_id"]: r["labels"] for r in ev.current_edits(ev.read_folds(spark, root)).collect()}
    assert got == replay(edits, 0)[0]
    # a batch that is written again changes nothing
    ev.write_fold(root)(spark.createDataFrame(edits[:150], ev.EVENT_SCHEMA), 0)
    again = {r["row_id"]: r["labels"] for r in ev.current_edits(ev.read_folds(spark, root)).collect()}
    assert again == got


def test_compacted_folds_and_published_labels(spark, tmp_path, edits):
    from labelweave.sources.store import Store

    root = str(tmp_path / "fold")
    for batch in range(4):
        if batch == 3:
            assert ev.compact_folds(spark, root) == 2
        part = spark.createDataFrame(edits[batch * 150 : (batch + 1) * 150], ev.EVENT_SCHEMA)
        ev.write_fold(root)(part, batch)
    want = replay(edits, 0)[0]
    got = {r["row_id"]: r["labels"] for r in ev.current_edits(ev.read_folds(spark, root)).collect()}
    assert got == want
    early = ev.current_edits(ev.read_folds(spark, root, 2)).collect()
    assert {r["row_id"]: r["labels"] for r in early} == replay(edits[:300], 0)[0]
    texts = spark.range(90).select(F.col("id").alias("row_id"), F.lit("t").alias("text"))
    store = Store(spark, str(tmp_path / "store"), "demo")
    assert ev.publish_labels(store, "labelled", texts, root) == 1
    saved = {r["row_id"]: r["labels"] for r in store.get_dataset("labelled").collect()}
    assert saved == {i: want.get(i, []) for i in range(90)}


def test_folds_stay_few(spark, tmp_path, edits, monkeypatch):
    """However many batches came, a batch reads the folds since the last compaction."""
    monkeypatch.setattr(ev, "COMPACT_EVERY", 2)
    root = str(tmp_path / "fold")
    for batch in range(7):
        part = spark.createDataFrame(edits[batch * 60 : (batch + 1) * 60], ev.EVENT_SCHEMA)
        ev.write_fold(root)(part, batch)
        kept = ev._numbers(spark, f"{root}/folds")
        assert len(kept) <= 4 and len(ev._numbers(spark, f"{root}/compacted")) <= 2
    got = {r["row_id"]: r["labels"] for r in ev.current_edits(ev.read_folds(spark, root)).collect()}
    assert got == replay(edits[:420], 0)[0]
    one = spark.createDataFrame([(3,)], "row_id bigint").select(ev.part_of().alias("p")).first()["p"]
    some = ev.read_folds(spark, root, parts=[one])
    assert {r["row_id"] for r in some.collect()} < set(got)
    assert "PartitionFilters: [isnotnull(part" in some._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="no longer kept"):
        ev.read_folds(spark, root, 1)


def test_stateful_fold_on_stream(spark, tmp_path, edits):
    folded = ev.fold_edits(file_stream(spark, tmp_path, edits, 3))
    q = folded.writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["row_id"]: r["labels"] for r in ev.current_edits(spark.table("folded")).collect()}
    assert got == replay(edits, 0)[0]


def test_streamed_rounds(spark, tmp_path, edits):
    root = str(tmp_path / "rounds")
    ev.start_retrain_counter(file_stream(spark, tmp_path, edits, 4), root, 5).awaitTermination(240)
    got = spark.read.parquet(f"{root}/rounds").orderBy("seq").collect()
    assert [(r["seq"], r["labelled_total"], r["round"], r["remaining"]) for r in got] == replay(edits, 5)[1]


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path, edits):
    """Two runs over parts of the files number the same rounds as the batch form."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    root, folder = str(tmp_path / "state"), str(tmp_path / "arriving")
    strange = [(None, "x", "on"), (None, None, "clear"), (0, "y", "on"), (0, None, "off"), (0, "y", None), (0, "y", "off")]
    rows = [tuple(r) for r in edits]
    last = max(r[0] for r in rows)
    rows += [(last + 1 + i, *r) for i, r in enumerate(strange)]
    rows.sort()
    try:
        for part in range(4):
            some = rows[part * len(rows) // 4 : (part + 1) * len(rows) // 4]
            spark.createDataFrame(some, ev.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(ev.EVENT_SCHEMA).parquet(folder)
            if part % 2:  # two runs
                q = ev.start_stateful_counter(stream.repartition(2), root, 5)
                assert q.awaitTermination(240)
    finally:
        spark.conf.unset(key)
    names = ["seq", "row_id", "labelled_total", "round", "remaining"]
    got = spark.read.parquet(f"{root}/rounds").select(names).orderBy("seq").collect()
    expected = ev.retrain_rounds(spark.createDataFrame(rows, ev.EVENT_SCHEMA), 5).select(names).orderBy("seq").collect()
    assert got == expected and len(got) == len(rows) - 1


def encoder_factory():
    """A nested factory travels by value, as this module is unknown to the workers."""

    def make_encoder():
        import numpy as np

        return lambda texts: np.array([[len(t), t.count("a") + 1.0, 1.0] for t in texts])

    return make_encoder


def test_scoring_on_a_stream_equals_the_batch(spark, tmp_path):
    side = LabelSide(("s::x", "s::y"), ("s", "s"), ((1.0, 0.0, 0.0), (0.0, 0.6, 0.8)))
    model = CosineModel(side, threshold=0.5)
    schema = "row_id bigint, text string"
    rows = [(i, "a" * (i % 5) + "bcd") for i in range(30)]
    folder = str(tmp_path / "texts")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(folder)

    def plan(df):
        return inference.predict(
            inference.encode_texts(df, encoder_factory()), model, keep=["row_id"], categories=True
        )

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = plan(stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = plan(spark.read.parquet(folder))
    assert batch.columns == ["row_id", "sim::s::x", "sim::s::y", "s::x", "s::y", "cat_sim::s", "cat::s"]
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, batch.collect()))


def test_edits_without_a_row_are_kept(spark):
    edits = [(0, None, "t::a", "on"), (1, 1, "t::a", "on"), (2, None, None, "clear"), (3, None, "t::b", "on"), (4, 5, None, "on")]
    got = ev.retrain_rounds(spark.createDataFrame(edits, ev.EVENT_SCHEMA), 10, 2).orderBy("seq").collect()
    assert [r["labelled_total"] for r in got] == [1, 2, 1, 2, 2]
