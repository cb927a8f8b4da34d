"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Each source, in code point order with null last, has a weight (1, 2, 3, repeating)
and a share of all words by weight; no source gives more than ``passes`` times its
own words, and what it cannot give is shared again by weight. The words of a source,
in order of doc_id, are cut into blocks of the same number of words. Seats, one per
block of the mix, go to the sources with the highest quotients target / (2 k + 1);
consecutive seats make a shard, which gives each shard whole quotas that follow the
targets. The quotas are filled shard after shard from the blocks of each source in
seeded order, starting over when all are taken; a taken stretch knows its shards.

Defined results: a null text has no words; sources without words get the target 0;
repeated doc_ids are separate documents; ties between quotients go to the earlier
source. Other columns are ignored by the plan and kept by ``mixed``. Large sources
share at most about ``SEATS`` seats, whatever the corpus, so their blocks grow with it.
A source whose target is under ``LEAST_BLOCKS`` of these blocks has blocks of its own
size, as many as its target needs to be met closely. The small sources are apportioned
among themselves by the same quotients; their seats lie between those of the others by
place, (2 k + 1) / blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_rank, rank_within
from .kernels import flat, slices, words
from .ranges import before_each, ranged
from .rounds import each, mapped, opened, packed, partitions, row_numbers, stored

WEIGHTS = (1, 2, 3)
PASSES = 3
#: Blocks of the smallest target, and a bound for all blocks of one size.
BLOCKS_OF_SMALLEST = 1024
SEATS = 1 << 20
#: Blocks that the target of every source has at least, unless these have a single word.
LEAST_BLOCKS = 512
#: Blocks listed at once.
LISTED = 1 << 16
SHARD_SEATS = 1 << 10


def word_counts(text: pa.Array) -> np.ndarray:
    raw, offsets = flat(text, b"\n")
    out = [np.empty(0, np.int64)]
    for i, j in slices(offsets):
        starts, _ = words(raw[offsets[i] : offsets[j]])
        out.append(np.diff(np.searchsorted(starts, offsets[i : j + 1] - offsets[i])))
    return np.concatenate(out)


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size): written, so that ``row`` stays the same."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            size = word_counts(b.column("text"))
            row = pa.array(np.arange(at, at + len(size)))
            at += len(size)
            yield pa.record_batch(
                [row, b.column("doc_id"), b.column("source"), pa.array(size)],
                ["row", "doc_id", "source", "size"],
            )

    return stored(
        mapped(
            docs.select("doc_id", "source", "text"),
            run,
            "row long, doc_id long, source string, size long",
        )
    )


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, passes: int = PASSES
) -> DataFrame:
    """(source_no, source, source_size, target) of sources with their sizes.

    The level, words per unit of weight, is raised until the sources that stop at
    their limit stay the same; each step is one sum over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.col("source_no") - 1) % len(weights) + 1).cast("int"),
    )
    ranked = stored(global_rank(totals, order, "source_no").withColumn("weight", weight))
    limit = F.col("source_size") * F.lit(float(passes))
    everything = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = limit < F.col("weight") * F.lit(level)
        taken, open_weight = ranked.agg(
            F.sum(F.when(full, limit)), F.sum(F.when(~full & (limit > 0), F.col("weight")))
        ).first()
        if not open_weight:
            break
        raised = (everything - (taken or 0.0)) / open_weight
        if raised <= level:
            break
        level = raised
    return ranked.select(
        "source_no", "source", "source_size",
        F.least(limit, F.col("weight") * F.lit(level)).alias("target"),
    )


def block_words(plan: DataFrame) -> tuple[int, int]:
    """Words of a block of large sources, and the number of blocks of the mix."""
    least, everything = plan.filter("target > 0").agg(F.min("target"), F.sum("target")).first()
    if not everything:
        return 1, 0
    b = max(1, int(least // BLOCKS_OF_SMALLEST), -int(-everything // SEATS))
    large = plan.filter(_own_block(b) == b).agg(F.sum("target")).first()[0] or 0
    return b, round(large / b) + _small_seats(plan, b)


def _own_block(b: int) -> Column:
    """Words of a block of a source: ``b``, or less where that would be too coarse."""
    own = F.floor(F.col("target") / LEAST_BLOCKS).cast("long")
    return F.least(F.lit(b).cast("long"), F.greatest(F.lit(1).cast("long"), own))


def _small_seats(plan: DataFrame, b: int) -> int:
    small = plan.filter((F.col("target") > 0) & (_own_block(b) < b))
    return small.agg(F.sum(F.round(F.col("target") / _own_block(b)).cast("long"))).first()[0] or 0


def seats(plan: DataFrame, b: int, n: int, passes: int = PASSES) -> DataFrame:
    """(source_no, k, seat, shard): the highest quotients of the large and of the small sources."""
    some = plan.filter("target > 0").withColumn("own", _own_block(b))
    own = F.col("target") / F.col("own")
    most = F.least(F.ceil(F.col("source_size") / F.col("own")) * passes, F.floor(own) + 3)
    most = most.cast("long")
    quotients = some.filter(most > 0).select(
        "source_no", "own", own.alias("blocks"), F.explode(F.sequence(F.lit(0).cast("long"), most - 1)).alias("k")
    ).select("source_no", "own", "k", (F.col("blocks") / (2 * F.col("k") + 1)).alias("quotient"))
    order = [F.desc("quotient"), "source_no", "k"]
    n_small = _small_seats(plan, b)
    taken = global_rank(quotients.filter(F.col("own") == b), order, "seat").filter(F.col("seat") <= n - n_small)
    if n_small:
        small = global_rank(quotients.filter(F.col("own") < b), order, "seat").filter(F.col("seat") <= n_small)
        small = small.drop("seat")
        taken = global_rank(taken.drop("seat").unionByName(small), order, "seat")
    return taken.select(
        "source_no", "k", "seat", F.expr(f"(seat - 1) div {SHARD_SEATS}L").alias("shard")
    )


def quotas(taken_seats: DataFrame) -> DataFrame:
    """(shard, source_no, blocks): whole numbers of blocks of each shard."""
    return taken_seats.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("blocks"))


def chosen_blocks(plan: DataFrame, taken_seats: DataFrame, b: int, seed: int) -> DataFrame:
    """(source_no, block, times, shards): blocks in seeded order that fill the shards' quotas."""
    n_blocks = F.ceil(F.col("source_size") / _own_block(b)).cast("long")
    zero = F.lit(0).cast("long")
    part = F.col("part") * LISTED
    listed = plan.filter("source_size > 0").select(
        "source_no", n_blocks.alias("blocks"),
        F.explode(F.sequence(zero, F.floor((n_blocks - 1) / LISTED))).alias("part"),
    ).select(
        "source_no", "blocks",
        F.explode(F.sequence(part, F.least(F.col("blocks"), part + LISTED) - 1)).alias("block"),
    ).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "source_no", "block")))
    order = rank_within(listed, ["source_no"], "_h", "block", out="_k", digits=2)
    # a quota is filled from where the shards before it left off; the seeded order starts over
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    filled = quotas(taken_seats).withColumn("_from", F.coalesce(F.sum("blocks").over(before), zero))
    filled = filled.withColumn("_at", F.explode(F.expr("sequence(_from, _from + blocks - 1)")))
    places = filled.join(plan.select("source_no", n_blocks.alias("_n")), "source_no")
    places = places.select("source_no", F.expr("_at % _n + 1").alias("_k"), "shard")
    return (
        order.join(places, ["source_no", "_k"])
        .groupBy("source_no", "block")
        .agg(F.count(F.lit(1)).alias("times"), F.sort_array(F.collect_list("shard")).alias("shards"))
    )


def mix_plan(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    passes: int = PASSES,
    seed: int = 42,
) -> DataFrame:
    """Rows of ``sizes`` (row, doc_id, source, size, ..) with what the mix takes of them.

    Adds source_size, target, taken and ``spans``, an array of (first, end, times, shards)
    word ranges that are taken, with a shard for each time.
    """
    plan = stored(targets(sizes, weights, passes))
    b, n = block_words(plan)
    chosen = stored(chosen_blocks(plan, stored(seats(plan, b, n, passes)), b, seed))
    plan = plan.withColumn("own", _own_block(b))
    numbered = sizes.join(plan, sizes.source.eqNullSafe(plan.source)).drop(plan.source)
    laid_out = before_each(
        ranged(numbered, "doc_id", 4 * partitions(sizes)),
        ["source_no"], ["doc_id", "size", "row"], "size", "_start",
    )
    last = F.expr("(_start + size - 1) div own")
    parts = (
        laid_out.filter("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr("_start div own"), last)))
        .join(chosen, ["source_no", "block"])
        .select(
            "row",
            F.greatest(F.lit(0), F.col("block") * F.col("own") - F.col("_start")).alias("first"),
            F.least("size", (F.col("block") + 1) * F.col("own") - F.col("_start")).alias("end"),
            "times", "shards",
        )
        .groupBy("row")
        .agg(
            F.sum((F.col("end") - F.col("first")) * F.col("times")).alias("taken"),
            F.sort_array(F.collect_list(F.struct("first", "end", "times", "shards"))).alias("spans"),
        )
    )
    return (
        numbered.join(parts, "row", "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        .drop("source_no", "own")
    )


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    passes: int = PASSES,
    seed: int = 42,
) -> DataFrame:
    """The documents of the mix, with all their columns.

    A document that is taken in part keeps the taken stretches of its text, one to a
    line; one that is taken more than once has a row for each time. ``n_chars`` is
    set to the new length where there is such a column.
    """
    batches = packed(docs, rows=1 << 20)

    def measure(batch: int, t: pa.Table, said: dict) -> Iterator[pa.RecordBatch]:
        size = word_counts(t.column("text"))
        at = np.arange(len(size))
        columns = {
            "row": pa.array(row_numbers(batch, at)), "batch": pa.array(np.full(len(size), batch)),
            "at": pa.array(at), "doc_id": t.column("doc_id").combine_chunks(),
            "source": t.column("source").combine_chunks(), "size": pa.array(size),
        }
        yield pa.record_batch(list(columns.values()), list(columns))

    sizes = stored(
        mapped(
            batches,
            each(measure),
            "row long, batch long, at long, doc_id long, source string, size long",
        )
    )
    plan = mix_plan(sizes, weights, passes, seed).filter("taken > 0")
    taken = plan.groupBy("batch").agg(F.collect_list(F.struct("at", "spans")).alias("taken"))

    def emit(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for payload, wanted in zip(b.column("payload"), b.column("taken")):
                yield from cut(opened(payload.as_buffer()), wanted.as_py()).to_batches()

    return mapped(batches.join(taken, "batch").select("payload", "taken"), emit, docs.schema)


def cut(t: pa.Table, wanted: list[dict]) -> pa.Table:
    """Rows of a batch with the word ranges that are taken of them."""
    raw, offsets = flat(t.column("text"), b"\n")
    rows, texts = [], []
    for doc in sorted(wanted, key=lambda d: d["at"]):
        i, spans = doc["at"], doc["spans"]
        text = raw[offsets[i] : offsets[i + 1]]
        starts, ends = words(text)
        for time in range(1, max(s["times"] for s in spans) + 1):
            pieces: list[list[int]] = []
            for s in spans:
                if s["times"] >= time:
                    if pieces and pieces[-1][1] == s["first"]:
                        pieces[-1][1] = s["end"]
                    else:
                        pieces.append([s["first"], s["end"]])
            whole = pieces == [[0, len(starts)]]
            found = [text[starts[a] : ends[z - 1]].tobytes() for a, z in pieces]
            texts.append(text[:-1].tobytes() if whole else b"\n".join(found))
            rows.append(i)
    out = t.take(pa.array(rows, pa.int64()))
    new = pa.array(texts, pa.binary()).cast(pa.string())
    for name, values in (("text", new), ("n_chars", pc.utf8_length(new))):
        if name in out.column_names:
            k = out.column_names.index(name)
            out = out.set_column(k, out.schema.field(k), pa.chunked_array([values.cast(out.schema.field(k).type)]))
    return out
