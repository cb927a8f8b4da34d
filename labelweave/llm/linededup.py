"""Line dedup with an edit bound, by a deletion-neighbourhood join.

Lines are compared as sequences of words. A line that has any goes if an earlier line
(smaller doc_id, or above it in the same document) has the same words, and, where the
longer of the two has ``LEAST_NEAR`` words, also if an earlier line is one edit away:
one word put in, left out or replaced. Two lines of fewer words, as are lines in
scripts without blanks and long addresses, are compared by characters instead, with
one blank between words: the later goes if they are one character apart and the longer
has ``LEAST_NEAR`` characters. Lines are judged on the input, not on what is left.
Lines without words stay.

Two lines are one edit apart exactly if leaving one unit out of one of them, or of
each at the same place, gives the same units. So every line emits itself and all
variants with one unit left out, as hashes. Nearly all meet nobody, so they travel
twice: first as gap-coded cells of about three bytes, then, where cells met, in full
(128 bits) with the place that was left out. What meets there is verified on the
place, and every line that meets an earlier one goes. No pairs are made; a hash that
very many lines share keeps one earliest line for each place.

A null text has no lines and stays null; repeated doc_ids are separate documents, of
which the one read first counts as earlier. A null doc_id comes last. A document that
loses all its lines keeps an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .kernels import U64, Sequence, character_names, flat, runs, slices, word_names, words
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

LEAST_WORDS = 1
#: Words of a line that may differ in one word; characters, in lines of fewer words.
LEAST_NEAR = 8
#: Bytes of a word with its blank, for sizing buckets and cells only.
WORD_BYTES = 5
LINE_BYTES = 100
#: Buckets of equal lines are numbered from here on.
EQUAL = 1 << 40
LAST = np.iinfo(np.int64).max


class Lines:
    """Lines of a batch of documents, with the names of their words and characters."""

    def __init__(self, t: pa.Table) -> None:
        self.raw, offsets = flat(t.column("text"), b"\n")
        ids = pc.fill_null(t.column("doc_id").combine_chunks(), LAST)
        self.doc_ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        self.breaks = np.flatnonzero(self.raw == 10) + 1  # ends of lines
        self.starts = np.concatenate([[0], self.breaks[:-1]])[: len(self.breaks)]
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        values, first = [np.empty(0, U64)], [np.zeros(1, np.int64)]
        total = 0
        for i, j in slices(offsets):
            part = self.raw[offsets[i] : offsets[j]]
            s, e = words(part)
            values.append(word_names(part, s, e))
            own = self.breaks[np.searchsorted(self.breaks, offsets[i], "right") : np.searchsorted(self.breaks, offsets[j], "right")]
            first.append(total + np.searchsorted(s, own - offsets[i]))
            total += len(s)
        values, self.first = np.concatenate(values), np.concatenate(first)
        self.n_words = np.diff(self.first)
        self.lanes = [Sequence(values, lane) for lane in (0, 1)]
        a, z = self.first[:-1], self.first[1:]
        self.h1, self.h2 = (lane.stretch(a, z) for lane in self.lanes)
        # characters of lines of few words; other lines have none here
        few = (self.n_words >= LEAST_WORDS) & (self.n_words < LEAST_NEAR)
        values, n_chars = character_names(self.raw, self.starts[few], self.breaks[few])
        self.n_chars = np.zeros(len(few), np.int64)
        self.n_chars[few] = n_chars
        self.first_char = np.concatenate([[0], np.cumsum(self.n_chars)])
        self.char_lanes = [Sequence(values, lane) for lane in (0, 1)]
        # place of a line among the batch's lines, earliest first
        order = np.lexsort((np.arange(len(a)), self.doc, self.doc_ids[self.doc]))
        self.place = np.empty(len(a), np.int64)
        self.place[order] = np.arange(len(a))
        judged = np.flatnonzero(self.n_words >= LEAST_WORDS)
        judged = judged[np.lexsort((self.place[judged], self.h2[judged], self.h1[judged]))]
        new = np.ones(len(judged), bool)
        new[1:] = (self.h1[judged][1:] != self.h1[judged][:-1]) | (self.h2[judged][1:] != self.h2[judged][:-1])
        self.distinct = judged[new]  # the earliest of equal lines, by rising h1
        self.again = judged[~new]

    def variants(self, lines: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, lines and places of the lines (place -1) and of what is left without a unit."""
        found = [
            _variants(self.lanes[lane], self.first, lines[self.n_words[lines] >= LEAST_NEAR - 1]),
            _variants(self.char_lanes[lane], self.first_char, lines[self.n_chars[lines] >= LEAST_NEAR - 1]),
        ]
        return tuple(np.concatenate(x) for x in zip(*found))


def _variants(units: Sequence, first: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The variants of lines whose units begin at ``first``; the shortest may be what is left."""
    whole = units.stretch(first[lines], first[lines + 1])
    n = first[lines + 1] - first[lines]
    long, n = lines[n >= LEAST_NEAR], n[n >= LEAST_NEAR]
    of, place = runs(n)
    a, z = first[long][of], first[long + 1][of]
    left = units.without(a, z, a + place)
    return (
        np.concatenate([whole, left]),
        np.concatenate([lines, long[of]]),
        np.concatenate([np.full(len(lines), -1), place]),
    )


class _Plan:
    """Cells and buckets for a corpus of so many bytes."""

    def __init__(self, size: int) -> None:
        self.cell, self.near = cell_bits(size / WORD_BYTES), bucket_bits(size / WORD_BYTES)
        self.equal = bucket_bits(size / LINE_BYTES, 5e5)

    def cells(self, h: np.ndarray) -> np.ndarray:
        return h >> U64(64 - self.cell)

    def near_cuts(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        return list(buckets(cells, self.cell - self.near))

    def equal_cuts(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        return [(EQUAL + k, a, z) for k, a, z in buckets(h, 64 - self.equal)]


def _lowest(rank: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The lowest rank among entries with the same keys."""
    order = np.lexsort((rank, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = rank[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def _split(asked: list, flags: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, bytes]]:
    for (batch, _), own in zip(asked, np.split(flags, np.cumsum(sizes)[:-1])):
        if own.any():
            yield batch, bits(own)


def _ranks(doc: list[np.ndarray], place: list[np.ndarray]) -> np.ndarray:
    """Ranks of entries by doc_id, then batch, then place in the batch."""
    batch = np.repeat(np.arange(len(doc)), [len(d) for d in doc])
    rank = np.empty(len(batch), np.int64)
    rank[np.lexsort((np.concatenate(place), batch, np.concatenate(doc)))] = np.arange(len(batch))
    return rank


def _first_answer(bucket: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    if bucket < EQUAL:
        yield from repeated(bucket, asked)
        return
    h1, h2, doc, place = zip(*(load(p) for _, p in asked))
    rank = _ranks(doc, place)
    flags = _lowest(rank, np.concatenate(h2), np.concatenate(h1)) < rank
    yield from _split(asked, flags, [len(x) for x in h1])


def _near_answer(bucket: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Which entries meet an earlier line: at the same place, or with one unit more or less."""
    v1, v2, at, doc, place = (list(x) for x in zip(*(load(p) for _, p in asked)))
    sizes = [len(x) for x in v1]
    rank = _ranks(doc, place)
    v1, v2, at = np.concatenate(v1), np.concatenate(v2), np.concatenate(at)
    none = np.int64(LAST)
    whole = at < 0
    flags = _lowest(rank, at, v2, v1) < rank  # the same place left out
    lowest_whole = _lowest(np.where(whole, rank, none), v2, v1)
    lowest_left = _lowest(np.where(whole, none, rank), v2, v1)
    flags |= np.where(whole, lowest_left, lowest_whole) < rank
    yield from _split(asked, flags, sizes)


def removed_lines(batches: DataFrame) -> DataFrame:
    """Batches with the answers that ``doomed`` reads: equal, met and near."""
    plan = _Plan(max(1, batches.count()) * BATCH_BYTES)

    def first(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        x = Lines(t)
        own = x.distinct
        equal = [
            (k, batch, dump(x.h1[own[a:z]], x.h2[own[a:z]], x.doc_ids[x.doc[own[a:z]]], x.place[own[a:z]]))
            for k, a, z in plan.equal_cuts(x.h1[own])
        ]
        cells = np.sort(plan.cells(x.variants(own, 0)[0]))
        yield equal + [(k, batch, dump_sorted(cells[a:z])) for k, a, z in plan.near_cuts(cells)]

    met = ask(batches, first, _first_answer)
    batches = told(batches, met=met)

    def second(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        x = Lines(t)
        _, entries, cuts = _entries(x, plan, said["met"])
        yield [(k, batch, dump(*(e[a:z] for e in entries))) for k, a, z in cuts]

    return told(batches, near=ask(batches, second, _near_answer))


def _entries(x: Lines, plan: _Plan, met: dict) -> tuple[np.ndarray, tuple, list]:
    """Lines and full variants whose cells met, of lines that are the first with their words."""
    own = x.distinct
    cells = np.sort(plan.cells(x.variants(own, 0)[0]))
    shared = np.unique(cells[flags_of(met, plan.near_cuts(cells), len(cells))])
    first = own[~flags_of(met, plan.equal_cuts(x.h1[own]), len(own))]
    h1, lines, place = x.variants(first, 0)
    cells = plan.cells(h1)
    some = np.flatnonzero(np.isin(cells, shared))
    some = some[np.argsort(cells[some], kind="stable")]
    h2 = x.variants(first, 1)[0]
    lines, place = lines[some], place[some]
    entries = (h1[some], h2[some], place, x.doc_ids[x.doc[lines]], x.place[lines])
    return lines, entries, plan.near_cuts(cells[some])


def doomed(x: Lines, size: int, said: dict) -> tuple[np.ndarray, np.ndarray]:
    """Which lines repeat an earlier one, and which are only near one."""
    plan = _Plan(size)
    own = x.distinct
    equal = np.zeros(len(x.n_words), bool)
    equal[x.again] = True
    equal[own[flags_of(said["met"], plan.equal_cuts(x.h1[own]), len(own))]] = True
    near = np.zeros(len(x.n_words), bool)
    lines, _, cuts = _entries(x, plan, said["met"])
    near[lines[flags_of(said["near"], cuts, len(lines))]] = True
    return equal, near & ~equal


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents, with all columns, without the lines that go.

    ``n_chars`` is set to the new length where there is such a column.
    """
    return _applied(docs, _texts, docs.schema)


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_equal, n_near, kept_text) of each document."""
    schema = "doc_id long, n_lines long, n_equal long, n_near long, kept_text string"
    return _applied(docs.select("doc_id", "text"), _report, schema)


def _applied(docs: DataFrame, make, schema) -> DataFrame:
    batches = packed(docs)
    size = max(1, batches.count()) * BATCH_BYTES
    answered = removed_lines(batches)

    def last(batch: int, t: pa.Table, said: dict) -> Iterator[pa.RecordBatch]:
        x = Lines(t)
        equal, near = doomed(x, size, said)
        yield from make(t, x, equal, near).to_batches()

    return mapped(answered, each(last), schema)


def kept_texts(t: pa.Table, x: Lines, gone: np.ndarray) -> pa.Array:
    """Texts without the lines that go; a document that loses none keeps its bytes."""
    n = t.num_rows
    keep = np.ones(len(x.raw), bool)
    for i in np.flatnonzero(gone):
        keep[x.starts[i] : x.breaks[i]] = False
    left = np.concatenate([[0], np.cumsum(keep)])
    bounds = np.searchsorted(x.doc, np.arange(n + 1))
    ends = np.concatenate([[0], x.breaks])[bounds]
    offsets = left[ends]
    data = x.raw[keep]
    texts = [data[offsets[i] : max(offsets[i], offsets[i + 1] - 1)].tobytes() for i in range(n)]
    null = t.column("text").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    return pa.array([None if gap else text for gap, text in zip(null, texts)], pa.binary()).cast(pa.string())


def _texts(t: pa.Table, x: Lines, equal: np.ndarray, near: np.ndarray) -> pa.Table:
    new = kept_texts(t, x, equal | near)
    for name, values in (("text", new), ("n_chars", pc.utf8_length(new))):
        if name in t.column_names:
            k = t.column_names.index(name)
            field = t.schema.field(k)
            t = t.set_column(k, field, pa.chunked_array([values.cast(field.type)]))
    return t


def _report(t: pa.Table, x: Lines, equal: np.ndarray, near: np.ndarray) -> pa.Table:
    n = t.num_rows
    counts = [np.bincount(x.doc, w, n).astype(np.int64) for w in (np.ones(len(x.doc)), equal, near)]
    columns = [t.column("doc_id"), *map(pa.array, counts), kept_texts(t, x, equal | near)]
    return pa.table(columns, ["doc_id", "n_lines", "n_equal", "n_near", "kept_text"])
