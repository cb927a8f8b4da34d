"""Label edits ``(seq, row_id, label_key, action)`` in the order of ``seq``.

Actions: ``on`` adds a label, ``off`` removes it, ``clear`` empties the row;
``on`` and ``off`` without a label change nothing. The same functions run on
tables and, where noted, on streams.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.labels import empty_labels
from ..operators.running import RANGE, running_total_and_peak, with_ranges
from ..session import ensure_checkpoint_dir
from ..sources import folders

#: Parts of the folds, by a hash of the row; a batch reads only the parts of its rows.
PARTS = 64
COMPACT_EVERY = 16
#: Parts of a range of events, by a hash of the row, that are worked off side by side.
RANGE_PARTS = 8
EVENT_SCHEMA = "seq bigint, row_id bigint, label_key string, action string"
# last edit as one number, so that the aggregate keeps a fixed-width buffer
_CODES = {"off": 0, "on": 1, "clear": 2}


def _code():
    action = F.col("action")
    code = F.lit(None).cast("bigint")
    for name, number in _CODES.items():
        code = F.when(action == name, F.lit(number).cast("bigint")).otherwise(code)
    return F.col("seq") * 4 + code


def fold_edits(events: DataFrame) -> DataFrame:
    """Last edit per (row, label) and last clear per row (label NULL): ``last``.

    One aggregate with map-side combining; runs on a stream as it is. Folds can
    be joined by ``merge_folds``.
    """
    is_clear = F.col("action") == "clear"
    label = F.when(~is_clear, F.col("label_key"))
    return events.filter(is_clear | F.col("label_key").isNotNull()).groupBy("row_id", label.alias("label_key")).agg(F.max(_code()).alias("last"))


def merge_folds(folds: DataFrame) -> DataFrame:
    return folds.groupBy("row_id", "label_key").agg(F.max("last").alias("last"))


def current_edits(fold: DataFrame) -> DataFrame:
    """``row_id, labels`` with the sorted current labels, ``[]`` for emptied rows.

    A row has one entry per label of the taxonomy at most.
    """
    is_clear = F.col("label_key").isNull()
    entry = F.when(~is_clear, F.struct("label_key", "last"))
    per_row = fold.groupBy("row_id").agg(
        F.coalesce(F.max(F.when(is_clear, F.col("last"))), F.lit(-1)).alias("_clear"),
        F.collect_list(entry).alias("_edits"),
    )
    kept = F.filter("_edits", lambda e: (e["last"] % 4 == 1) & (e["last"] > F.col("_clear")))
    return per_row.select(
        "row_id", F.array_sort(F.transform(kept, lambda e: e["label_key"])).alias("labels")
    )


def labels_now(events: DataFrame) -> DataFrame:
    return current_edits(fold_edits(events))


def label_transitions(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """``seq, row_id, change``: -1, 0 or +1 in the number of labelled rows per event.

    Events are cut into ranges of ``seq``. What a range does to a row is told by its last
    clear and the last edit of each label, of which the later one counts, as in a prefix
    sum; so the labels that a row has when a range begins follow from small summaries.
    With these, the parts of all ranges are worked off side by side. An event without
    action is left out.
    """
    ensure_checkpoint_dir(events.sparkSession)
    # a missing row id is a row of its own: two columns that are never NULL
    keyed = events.filter("action is not null").select(
        "seq",
        F.coalesce("row_id", F.lit(0)).cast("bigint").alias("_row"),
        F.col("row_id").isNull().alias("_norow"),
        "label_key",
        "action",
    )
    base = with_ranges(keyed, "seq", ranges).checkpoint()
    given = _labels_before(base).withColumn("_given", F.lit(True))
    both = base.withColumn("_given", F.lit(False)).unionByName(given)
    part = F.pmod(F.xxhash64("_row", "_norow"), F.lit(RANGE_PARTS)).alias("_part")
    changed = both.groupBy(RANGE, part).applyInArrow(_changes, f"seq long, _row long, _norow boolean, {RANGE} int, change int")
    return changed.select("seq", F.when(~F.col("_norow"), F.col("_row")).alias("row_id"), RANGE, "change")


def _labels_before(base: DataFrame) -> DataFrame:
    """The labels that a row has when a range with events of it begins, as further edits."""
    row = ["_row", "_norow"]
    is_clear = F.col("action") == "clear"
    edit = F.when(~is_clear & F.col("label_key").isNotNull(), F.struct("seq", (F.col("action") == "on").alias("on")))
    summary = base.groupBy(*row, RANGE, "label_key").agg(
        F.max(F.when(is_clear, F.col("seq"))).alias("clear"), F.max(edit).alias("edit")
    )
    present = summary.groupBy(*row, RANGE).agg(F.max("clear").alias("clear"))
    edits = summary.filter("edit is not null").select(*row, RANGE, "label_key", "edit")
    # a line per label of a row and range with events of it; as many as there are ranges, at most
    grid = present.join(edits.select(*row, "label_key").distinct(), row).join(edits, [*row, RANGE, "label_key"], "left")
    earlier = Window.partitionBy(*row, "label_key").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return (
        grid.withColumn("_edit", F.last("edit", ignorenulls=True).over(earlier))
        .withColumn("_clear", F.max("clear").over(earlier))
        .filter("_edit.on and (_clear is null or _edit.seq > _clear)")
        .select(F.col("_edit.seq").alias("seq"), *row, "label_key", F.lit("on").alias("action"), RANGE)
    )


def _changes(t: pa.Table) -> pa.Table:
    """Change of every event of a part of a range; edits that were given come first."""
    seq, row, none, given = (t.column(c).to_numpy() for c in ("seq", "_row", "_norow", "_given"))
    clear = pc.equal(t.column("action"), "clear").to_numpy()
    on = pc.equal(t.column("action"), "on").to_numpy()
    label = pc.fill_null(pc.dictionary_encode(t.column("label_key").combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
    order = np.lexsort((seq, ~given, row, none))
    row, none, clear, on, label = (x[order] for x in (row, none, clear, on, label))
    # an epoch begins with a row and after each clear
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (none[1:] != none[:-1]) | clear[:-1]
    epoch = np.cumsum(new) - 1
    toggle = np.flatnonzero(~clear & (label >= 0))
    by_label = toggle[np.lexsort((toggle, label[toggle], epoch[toggle]))]
    was = np.zeros(len(by_label), bool)
    same = (epoch[by_label][1:] == epoch[by_label][:-1]) & (label[by_label][1:] == label[by_label][:-1])
    was[1:] = same & on[by_label][:-1]
    delta = np.zeros(len(row), np.int64)
    delta[by_label] = on[by_label].astype(np.int64) - was
    total = np.cumsum(delta)
    before = (total - delta)[np.flatnonzero(new)][epoch]  # of the epochs before
    n = total - before
    change = (n > 0).astype(np.int32) - ((n - delta) > 0)
    change = np.where(clear, -(n > 0).astype(np.int32), change).astype(np.int32)
    events = ~given[order]
    out = t.select(["seq", "_row", "_norow", RANGE]).take(pa.array(order[events]))
    return out.append_column("change", pa.array(change[events]))


def rounds_of(
    transitions: DataFrame, every: int, labelled: int = 0, trained_at: int = 0
) -> DataFrame:
    """``seq, row_id, labelled_total, round, remaining`` after every event.

    A round starts when the labelled count has grown by ``every`` since the last
    one. An event moves the count by one at most and the mark only goes up, so the
    round follows from the running maximum. ``every <= 0`` never retrains.
    """
    peak = running_total_and_peak(transitions, "seq", "change", "_total", "_peak").select(
        "seq",
        "row_id",
        (F.lit(labelled) + F.col("_total")).alias("labelled_total"),
        (F.lit(labelled) + F.col("_peak")).alias("_peak"),
    )
    if every <= 0:
        return peak.select(
            "seq",
            "row_id",
            "labelled_total",
            F.lit(0).cast("bigint").alias("round"),
            F.lit(0).cast("bigint").alias("remaining"),
        )
    rounds = F.floor(F.greatest(F.col("_peak") - F.lit(trained_at), F.lit(0)) / F.lit(every))
    done = peak.withColumn("round", rounds.cast("bigint"))
    since = F.col("labelled_total") - F.lit(trained_at) - F.col("round") * every
    return done.select(
        "seq",
        "row_id",
        "labelled_total",
        "round",
        F.greatest(F.lit(0), F.lit(every) - since).cast("bigint").alias("remaining"),
    )


def retrain_rounds(
    events: DataFrame, every: int, ranges: int | None = None, labelled: int = 0, trained_at: int = 0
) -> DataFrame:
    return rounds_of(label_transitions(events, ranges), every, labelled, trained_at)


# -- streams -----------------------------------------------------------------


def fold_path(root: str, batch_id: int) -> str:
    return f"{root}/folds/batch={batch_id}"


def write_fold(root: str):
    """``foreachBatch`` sink: the fold of a batch in its own folder.

    A repeated batch writes the same folder again, so nothing is counted twice. Every
    ``COMPACT_EVERY`` batches the folds so far become one, so a batch reads a bounded
    number of folders however many came before it.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_parts(fold_edits(batch), fold_path(root, batch_id))
        if (batch_id + 1) % COMPACT_EVERY == 0:
            compact_folds(batch.sparkSession, root, batch_id)

    return sink


def part_of(row_id: str = "row_id") -> Column:
    """The part of the folds that holds a row."""
    return F.pmod(F.xxhash64(row_id), F.lit(PARTS)).cast("int")


def _write_parts(fold: DataFrame, path: str) -> None:
    parts = fold.withColumn("part", part_of()).repartition("part")
    parts.write.mode("overwrite").partitionBy("part").parquet(path)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in folders.names(spark, folder) if "=" in n)


def read_folds(
    spark: SparkSession,
    root: str,
    before_batch: int | None = None,
    parts: Sequence[int] | None = None,
) -> DataFrame:
    """The merged fold of all written batches, or of those before a batch.

    Starts from the newest compacted fold that fits and adds the later batches.
    ``parts`` names the parts to read, all by default. Folds before the compacted one
    before the last are gone, so an earlier state can't be asked for.
    """
    batches = [n for n in _numbers(spark, f"{root}/folds") if before_batch is None or n < before_batch]
    merged = _numbers(spark, f"{root}/compacted")
    fits = [n for n in merged if before_batch is None or n < before_batch]
    if merged and not fits and before_batch and (not batches or batches[0] > 0):
        raise ValueError(f"the folds before batch {before_batch} are no longer kept")
    upto = max(fits, default=-1)
    schema = fold_edits(spark.createDataFrame([], EVENT_SCHEMA)).schema
    found = spark.createDataFrame([], schema)
    later = [fold_path(root, n) for n in batches if n > upto]
    paths = {f"{root}/folds": later, f"{root}/compacted": [f"{root}/compacted/upto={upto}"] if fits else []}
    for base, some in paths.items():
        if some:
            read = spark.read.schema(StructType([*schema.fields, StructField("part", IntegerType())]))
            rows = read.option("basePath", base).parquet(*some)
            if parts is not None:
                rows = rows.filter(F.col("part").isin(list(parts)))
            found = found.unionByName(rows.select(*schema.names))
    return merge_folds(found)


def compact_folds(spark: SparkSession, root: str, upto: int | None = None) -> int:
    """Write the merged fold of all batches so far; returns the last batch in it.

    What the compacted fold before this one had replaced is removed.
    """
    if upto is None:
        upto = max(_numbers(spark, f"{root}/folds"))
    merged = _numbers(spark, f"{root}/compacted")
    _write_parts(read_folds(spark, root, upto + 1), f"{root}/compacted/upto={upto}")
    last = max((n for n in merged if n < upto), default=-1)
    for n in merged:
        if n < last:
            folders.drop(spark, f"{root}/compacted/upto={n}")
    for n in _numbers(spark, f"{root}/folds"):
        if n <= last:
            folders.drop(spark, fold_path(root, n))
    return upto


def with_current_labels(texts: DataFrame, fold: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Texts with the labels of a fold; rows without edits have none."""
    now = current_edits(fold).withColumnRenamed("row_id", row_id)
    joined = texts.drop("labels").join(now, row_id, "left")
    return joined.withColumn("labels", F.coalesce("labels", empty_labels()))


def publish_labels(store, name: str, texts: DataFrame, root: str, row_id: str = "row_id") -> int:
    """Write the texts with their labels as the next version of a dataset."""
    folds = read_folds(texts.sparkSession, root)
    return store.submit_dataset(with_current_labels(texts, folds, row_id), name)


def _start(stream: DataFrame, root: str, sink, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(sink).option(
        "checkpointLocation", f"{root}/checkpoint"
    )
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def start_labelling(
    stream: DataFrame, root: str, processing_time: str | None = None
) -> StreamingQuery:
    """Fold arriving edits under ``root``; read them with ``read_folds``.

    Takes what is there and ends, or goes on with a batch per ``processing_time``.
    """
    return _start(stream, root, write_fold(root), processing_time)


def _state_before(spark: SparkSession, root: str, batch_id: int) -> tuple[int, int, int]:
    """Labelled count, mark of the last training and rounds before a batch."""
    if batch_id == 0:
        return 0, 0, 0
    row = spark.read.parquet(f"{root}/state/batch={batch_id - 1}").first()
    return row["labelled"], row["trained_at"], row["rounds"]


def _write_rounds(moved: DataFrame, root: str, batch_id: int, every: int, counts: tuple[int, int, int]) -> None:
    """Write the numbered events of a batch and the counts after it."""
    labelled, trained_at, rounds = counts
    out = rounds_of(moved, every, labelled, trained_at).withColumn("round", F.col("round") + F.lit(rounds))
    out.write.mode("overwrite").parquet(f"{root}/rounds/batch={batch_id}")
    done = moved.sparkSession.read.parquet(f"{root}/rounds/batch={batch_id}").agg(
        F.max_by("labelled_total", "seq").alias("labelled"), F.max("round").alias("rounds")
    )
    state = done.select(
        F.coalesce("labelled", F.lit(labelled)).cast("bigint").alias("labelled"),
        F.coalesce("rounds", F.lit(rounds)).cast("bigint").alias("rounds"),
    ).withColumn("trained_at", F.lit(trained_at) + (F.col("rounds") - F.lit(rounds)) * F.lit(every))
    state.write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")


def retrain_sink(root: str, every: int):
    """``foreachBatch`` sink that numbers retrain rounds across batches.

    ``seq`` grows from batch to batch. The state is one row per batch: labelled
    count, count at the last training, rounds so far. Only the rows touched by
    the batch are read back from the folds.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        # read several times below
        batch = batch.persist()
        try:
            count_batch(batch, batch_id)
        finally:
            batch.unpersist()

    def count_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        labelled, trained_at, rounds = _state_before(spark, root, batch_id)
        edits = batch.select("seq", "row_id", "label_key", "action")
        if batch_id > 0:
            touched = edits.select("row_id").distinct()
            # at most PARTS numbers
            parts = [r["part"] for r in touched.select(part_of().alias("part")).distinct().collect()]
            before = current_edits(
                read_folds(spark, root, batch_id, parts).join(touched, "row_id", "left_semi")
            )
            lowest = edits.agg(F.min("seq")).first()[0] or 0
            # their labels re-entered ahead of the batch, one number per label
            known = before.select("row_id", F.posexplode("labels").alias("_p", "label_key"))
            known = known.select(
                (F.lit(lowest) - 1 - F.col("_p")).cast("bigint").alias("seq"),
                "row_id",
                "label_key",
                F.lit("on").alias("action"),
            )
            moved = label_transitions(known.unionByName(edits)).filter(F.col("seq") >= lowest)
        else:
            moved = label_transitions(edits)
        _write_rounds(moved, root, batch_id, every, (labelled, trained_at, rounds))
        write_fold(root)(batch, batch_id)

    return sink


class RowLabels(StatefulProcessor):
    """State of a row: its labels now. Gives ``seq, row_id, change`` of its edits.

    ``change`` is -1, 0 or +1 in the number of labelled rows, as in ``label_transitions``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._labels = handle.getValueState("labels", "labels array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        edits = pd.concat(list(rows)).sort_values("seq", kind="stable")
        have = set(self._labels.get()[0]) if self._labels.exists() else set()
        change = np.zeros(len(edits), np.int32)
        for i, (action, label) in enumerate(zip(edits["action"], edits["label_key"])):
            before = bool(have)
            if action == "clear":
                have.clear()
            elif action == "on" and isinstance(label, str):
                have.add(label)
            elif action == "off":
                have.discard(label)
            change[i] = bool(have) - before
        if have:
            self._labels.update((sorted(have),))
        else:
            self._labels.clear()
        yield pd.DataFrame({"seq": edits["seq"].to_numpy(), "_row": key[0], "_norow": key[1], "change": change})

    def close(self) -> None:
        pass


def stream_transitions(stream: DataFrame) -> DataFrame:
    """``label_transitions`` of a stream, with the labels of a row as keyed state.

    ``seq`` grows from batch to batch. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). The state is partitioned by row
    and kept with the checkpoint of the query, so a restart goes on where it ended; a
    batch touches the state of its own rows only. The edits of one row in one batch are
    worked off by one task: bound the batches by the source's options.
    """
    keyed = stream.filter("action is not null").select(
        "seq",
        F.coalesce("row_id", F.lit(0)).cast("bigint").alias("_row"),
        F.col("row_id").isNull().alias("_norow"),
        "label_key",
        "action",
    )
    moved = keyed.groupBy("_row", "_norow").transformWithStateInPandas(
        RowLabels(), "seq long, _row long, _norow boolean, change int", "Append", "None"
    )
    return moved.select("seq", F.when(~F.col("_norow"), F.col("_row")).alias("row_id"), "change")


def number_rounds_sink(root: str, every: int):
    """``foreachBatch`` sink that numbers the rounds of ``stream_transitions``.

    Only the row of counts of the batch before is read; a repeated batch writes the same.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = _state_before(spark, root, batch_id)
        batch = batch.persist()
        try:
            _write_rounds(with_ranges(batch, "seq"), root, batch_id, every, counts)
        finally:
            batch.unpersist()

    return sink


def start_stateful_counter(
    stream: DataFrame, root: str, every: int, processing_time: str | None = None
) -> StreamingQuery:
    """``start_retrain_counter`` with keyed state in place of folds; the same rounds."""
    return _start(stream_transitions(stream), root, number_rounds_sink(root, every), processing_time)


def start_retrain_counter(
    stream: DataFrame, root: str, every: int, processing_time: str | None = None
) -> StreamingQuery:
    """Number retrain rounds of arriving edits under ``root``."""
    return _start(stream, root, retrain_sink(root, every), processing_time)
