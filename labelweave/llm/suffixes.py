"""Substring dedup of byte strings by names that double in length, and minimiser sampling.

Names are hashes made inside a batch and take the place of ranks: Spark sorts no pairs of
position ranks in rounds of growing offsets. Two positions hold the same ``LENGTH`` bytes exactly if their ranks at half that
length are equal, and so are the ranks half of it further on; ranks at a length come
from pairs of ranks at half the length. Ranks are 64-bit names, made by doubling from
the eight bytes at a position (exact) to 16, 32 and 50 bytes; a pair of the last is a
128-bit name of 100 bytes. Sorting pairs over all positions would move the corpus
many times, so a position takes part only until it is unique:

1. 32 bytes, at sampled positions. A string of 100 bytes holds 69 stretches of 32; the
   one with the smallest rank stands for it, and equal strings have equal ones. Their
   ranks are sorted as gap-coded cells; strings whose stretch is unique are done.
2. Consecutive strings that share their stretch are one block (some 130 bytes). Blocks
   whose digest an earlier block has are repeats as a whole. Where a stretch has one
   block only, that settles all its strings.
3. 100 bytes, at every position of the first holder of the blocks that are left: the
   pairs of 50-byte ranks, sorted; all but the earliest position of a pair repeat it.

Buckets are dealt by rank, in round 3 by the whole pair, and each batch of documents
sends a rank once, so a passage that a third of all documents holds fills no bucket.

Defined results: a null text is empty; strings never cross documents; earlier means
smaller doc_id, then earlier start; a null doc_id is the largest; of repeated doc_ids
the one read first is earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .kernels import U64, Sequence, byte_names, covered, flat, names, pair, runs, slices, window_min
from .rounds import (
    BATCH_BYTES,
    ask,
    bits,
    bucket_bits,
    buckets,
    cell_bits,
    dump,
    dump_sorted,
    each,
    flags_of,
    load,
    mapped,
    packed,
    repeated,
    told,
)

LENGTH = 100
GRAM = 32
#: Bytes of text per sampled position, for sizing cells and buckets only.
SAMPLE_BYTES = 30
LAST = np.iinfo(np.int64).max


class Blocks:
    """Blocks of a batch of documents, by rising rank of their stretch."""

    def __init__(self, t: pa.Table, length: int, gram: int, digests: bool = True) -> None:
        self.raw, self.offsets = flat(t.column("text"))
        ids = pc.fill_null(t.column("doc_id").combine_chunks(), LAST)
        self.doc_ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        self.length = length
        none = np.empty(0, np.int64)
        found = [(none.view(U64), none.view(U64), none, none, none)]
        for i, j in slices(self.offsets, 1 << 19):
            found.append(self._slice(i, j, gram, digests))
        # rank of the stretch, digest, document, first byte, number of strings
        columns = [np.concatenate(x) for x in zip(*found)]
        order = np.lexsort((columns[3], columns[2], self.doc_ids[columns[2]], columns[1], columns[0]))
        self.key, self.digest, self.doc, self.at, self.n = (c[order] for c in columns)
        self.owner = self.doc_ids[self.doc]
        new = np.ones(len(order), bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.digest[1:] != self.digest[:-1])
        self.lead, self.again = np.flatnonzero(new), np.flatnonzero(~new)

    def _slice(self, i: int, j: int, gram: int, digests: bool) -> tuple[np.ndarray, ...]:
        base = self.offsets[i]
        raw, offsets = self.raw[base : self.offsets[j]], self.offsets[i : j + 1] - base
        eight = byte_names(raw)
        stretch = names(eight, 8, gram)
        low = window_min(stretch, self.length - gram + 1)
        new = np.ones(len(low), bool)
        # a block ends where the stretch that stands for its strings is left behind, also
        # if it comes again, so the strings of a block differ
        new[1:] = (low[1:] != low[:-1]) | (stretch[: len(low)][:-1] == low[:-1])
        # strings start up to ``length`` bytes before the end of their document
        first, last = offsets[:-1], offsets[1:] - self.length
        has = np.flatnonzero(last >= first)
        new[first[has]] = True
        inside = np.zeros(len(low) + 1, np.int8)
        inside[first[has]] += 1
        np.subtract.at(inside, last[has] + 1, 1)
        start = np.flatnonzero(new & (np.cumsum(inside[:-1]) > 0))
        doc = np.searchsorted(offsets, start, "right") - 1
        following = np.append(start[1:], len(low))
        end = np.minimum(following, last[doc] + 1)
        n = end - start
        digest = low[start]
        if digests:
            digest = Sequence(eight, 1).stretch(start, end + self.length - 8)
        return low[start], digest, doc + i, start + base, n

    def pairs(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all strings of some blocks, and their pairs of ranks."""
        half = self.length // 2
        size = self.n[some] + self.length - 1
        of, place = runs(size)
        eight = byte_names(self.raw[self.at[some][of] + place])
        rank = names(eight, 8, half)
        of, place = runs(self.n[some])
        at = (np.cumsum(size) - size)[of] + place
        return self.at[some][of] + place, rank[at], rank[at + self.length - half]


class _Plan:
    def __init__(self, size: int) -> None:
        keys = size / SAMPLE_BYTES
        self.cell, self.low = cell_bits(keys), bucket_bits(keys)
        self.some, self.pair = bucket_bits(keys / 4, 5e5), bucket_bits(size / 16, 5e5)

    def shared(self, x: Blocks, met: dict) -> np.ndarray:
        """Leads whose stretch stands elsewhere, in another batch or block."""
        cells, cuts, of = self.cells(x)
        hit = flags_of(met, cuts, len(cells))
        hit[of[1:][of[1:] == of[:-1]]] = True
        return x.lead[hit[of[x.lead]]]

    def cells(self, x: Blocks) -> tuple[np.ndarray, list, np.ndarray]:
        new = np.ones(len(x.key), bool)
        new[1:] = x.key[1:] != x.key[:-1]
        cells = x.key[new] >> U64(64 - self.cell)
        return cells, list(buckets(cells, self.cell - self.low)), np.cumsum(new) - 1

    def blocks(self, x: Blocks, shared: np.ndarray) -> list:
        return list(buckets(x.key[shared], 64 - self.some))


def _first_of(rank: tuple[np.ndarray, ...], *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted order by keys, then rank, and where a new value of the keys begins."""
    order = np.lexsort((*rank, *keys))
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def _blocks_answer(bucket: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Per block: whether an earlier one is equal, whether its stretch has others."""
    loads = [load(p) for _, p in asked]
    key, digest, owner = (np.concatenate([x[i] for x in loads]) for i in range(3))
    batch = np.repeat(np.arange(len(loads)), [len(x[0]) for x in loads])
    order, new = _first_of((batch, owner), digest, key)
    new_key = np.ones(len(order), bool)
    new_key[1:] = key[order][1:] != key[order][:-1]
    of_key = np.add.reduceat(new, np.flatnonzero(new_key), dtype=np.int64)
    flags = np.empty((2, len(order)), bool)
    flags[:, order] = ~new, of_key[np.cumsum(new_key) - 1] > 1
    at = 0
    for (number, _), x in zip(asked, loads):
        own = flags[:, at : at + len(x[0])]
        at += len(x[0])
        if own.any():
            yield number, bits(own.ravel())


def _pairs_answer(bucket: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Per pair: whether an earlier position has it."""
    loads = [load(p) for _, p in asked]
    key, rank, owner = (np.concatenate([x[i] for x in loads]) for i in range(3))
    batch = np.repeat(np.arange(len(loads)), [len(x[0]) for x in loads])
    order, new = _first_of((batch, owner), rank, key)
    flags = np.empty(len(order), bool)
    flags[order] = ~new
    sizes = [len(x[0]) for x in loads]
    for (number, _), own in zip(asked, np.split(flags, np.cumsum(sizes)[:-1])):
        if own.any():
            yield number, bits(own)


def _judged(x: Blocks, plan: _Plan, said: dict) -> tuple[np.ndarray, np.ndarray]:
    """Leads that repeat an earlier block, and leads that are open."""
    shared = plan.shared(x, said["met"])
    gone, several = np.zeros(len(shared), bool), np.zeros(len(shared), bool)
    for bucket, a, z in plan.blocks(x, shared):
        if bucket in said["held"]:
            got = np.unpackbits(np.frombuffer(said["held"][bucket], np.uint8), count=2 * (z - a))
            gone[a:z], several[a:z] = got[: z - a], got[z - a :]
    return shared[gone], shared[several & ~gone]


def _open(x: Blocks, some: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs of the open blocks: (key, rank, owner, place), and places that repeat."""
    place, a, b = x.pairs(some)
    key = pair(a, b, 1)
    owner = np.repeat(x.owner[some], x.n[some])
    order, new = _first_of((place, owner), a, key)
    lead = order[new]
    return key[lead], a[lead], owner[lead], place[lead], place[order[~new]]


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of each document."""
    batches = packed(docs.select("doc_id", "text"))
    plan = _Plan(max(1, batches.count()) * BATCH_BYTES)

    def ask_cells(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        cells, cuts, _ = plan.cells(Blocks(t, length, gram, digests=False))
        yield [(k, batch, dump_sorted(cells[a:z])) for k, a, z in cuts]

    def ask_blocks(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        x = Blocks(t, length, gram)
        some = plan.shared(x, said["met"])
        yield [
            (k, batch, dump(x.key[some[a:z]], x.digest[some[a:z]], x.owner[some[a:z]]))
            for k, a, z in plan.blocks(x, some)
        ]

    def ask_pairs(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        x = Blocks(t, length, gram)
        key, rank, owner, _, _ = _open(x, _judged(x, plan, said)[1])
        yield [(k, batch, dump(key[a:z], rank[a:z], owner[a:z])) for k, a, z in buckets(key, 64 - plan.pair)]

    batches = told(batches, met=ask(batches, ask_cells, repeated))
    batches = told(batches, held=ask(batches, ask_blocks, _blocks_answer))
    batches = told(batches, seen=ask(batches, ask_pairs, _pairs_answer))

    def last(batch: int, t: pa.Table, said: dict) -> Iterator[pa.RecordBatch]:
        x = Blocks(t, length, gram)
        gone, open_ = _judged(x, plan, said)
        whole = np.concatenate([gone, x.again])
        key, _, _, at, again = _open(x, open_)
        hit = flags_of(said["seen"], buckets(key, 64 - plan.pair), len(key))
        blocks = x.at[whole], x.n[whole] + length - 1
        yield _report(t, x, covered(len(x.raw), blocks, (np.concatenate([again, at[hit]]), length)))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return mapped(batches, each(last), schema)


def _report(t: pa.Table, x: Blocks, gone: np.ndarray) -> pa.RecordBatch:
    lost = np.concatenate([[0], np.cumsum(gone)])[x.offsets]
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    begins[x.offsets[:-1][x.offsets[:-1] < len(gone)]] |= gone[x.offsets[:-1][x.offsets[:-1] < len(gone)]]
    spans = np.concatenate([[0], np.cumsum(begins)])[x.offsets]
    data, ends = x.raw[~gone], x.offsets - lost
    kept = [data[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])]
    columns = [
        t.column("doc_id").combine_chunks(), pa.array(np.diff(x.offsets)), pa.array(np.diff(lost)),
        pa.array(np.diff(spans)), pa.array(kept, pa.binary()),
    ]
    return pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
