"""Substring dedup of word windows by super-k-mers.

A window is ``WINDOW`` consecutive words of a document. Its minimiser is the smallest
hash among its stretches of ``GRAM`` words, so equal windows have equal minimisers,
wherever they stand. Consecutive windows that share their minimiser are one
super-k-mer: one string of words that goes to the minimiser's bucket.

Three rounds find the windows that also start in a document with a smaller doc_id:

1. Minimisers as gap-coded cells. One that no other text has can hold no repeat, and
   all its windows stay at home.
2. Of the others, the digest of each super-k-mer's string with the smallest doc_id
   that has it. Documents that hold the same string later lose all its windows.
   Where a minimiser has a single string, that settles it.
3. Where it has several, the first holder of each string sends the string itself.
   In the bucket the strings are opened into windows, which are sorted, and a window
   goes wherever a smaller doc_id has it. A minimiser with very many strings (a
   passage in a third of all documents) sends its windows one by one, dealt by their
   words, so no bucket holds them all.

Each batch of documents sends a string or digest once, however often it has it.

Defined results: a null text has no words; texts under ``WINDOW`` words stay whole;
repeated doc_ids are not smaller than each other; a null doc_id is the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .kernels import (
    U64,
    Sequence,
    covered,
    flat,
    names,
    pair,
    runs,
    slices,
    window_min,
    word_names,
    words,
)
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

WINDOW = 50
GRAM = 20
#: Strings of one minimiser from which on its windows travel on their own.
MANY = 512
#: Bytes of text per minimiser and per string, for sizing cells and buckets only.
MINIMISER_BYTES = 80
STRING_BYTES = 1500
LAST = np.iinfo(np.int64).max


class Kmers:
    """Super-k-mers of a batch of documents, by rising minimiser."""

    def __init__(self, t: pa.Table, window: int = WINDOW, gram: int = GRAM) -> None:
        self.raw, offsets = flat(t.column("text"), b"\n")
        ids = pc.fill_null(t.column("doc_id").combine_chunks(), LAST)
        self.doc_ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        self.window = window
        begin, end, found, docs = [], [], [], [np.zeros(1, np.int64)]
        total = 0
        for i, j in slices(offsets):
            s, e = words(self.raw[offsets[i] : offsets[j]])
            first = np.searchsorted(s, offsets[i : j + 1] - offsets[i])
            begin.append(s + offsets[i])
            end.append(e + offsets[i])
            named = word_names(self.raw[offsets[i] : offsets[j]], s, e)
            low = window_min(names(named, 1, gram), window - gram + 1)
            found.append(self._slice(named, low, first, i, total))
            docs.append(total + first[1:])
            total += len(s)
        none = [np.empty(0, np.int64)]
        self.begin, self.end = np.concatenate(begin or none), np.concatenate(end or none)
        self.first = np.concatenate(docs)
        columns = [np.concatenate(x) for x in zip(*found)] or [np.empty(0, U64)] * 2 + none * 3
        # minimiser, digest of the string, document, first word, number of windows
        self.key, self.digest, self.doc, self.at, self.n = columns
        order = np.lexsort((self.doc, self.doc_ids[self.doc], self.digest, self.key))
        for name in ("key", "digest", "doc", "at", "n"):
            setattr(self, name, getattr(self, name)[order])
        self.owner = self.doc_ids[self.doc]
        new = np.ones(len(order), bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.digest[1:] != self.digest[:-1])
        self.lead = np.flatnonzero(new)  # first holder of each string
        self.string = np.cumsum(new) - 1
        self.own_first = self.owner == self.owner[self.lead][self.string] if len(order) else new

    def _slice(self, named, low, first, doc, total):
        """Super-k-mers of a slice of documents."""
        sizes = np.maximum(np.diff(first) - self.window + 1, 0)
        of, place = runs(sizes)
        at = first[of] + place  # starts of windows
        low = low[at] if len(at) else low[:0]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (of[1:] != of[:-1])
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(at)))
        start_word = at[start]
        length = n + self.window - 1
        return low[start], _digests(named, start_word, length), of[start] + doc, start_word + total, n

    def strings(self, some: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the strings from word ``some`` with n windows each, and their lengths.

        Words stand as they do in the text, white space included."""
        a, z = self.begin[some], self.end[some + n + self.window - 2]
        of, place = runs(z - a + 1)
        out = self.raw[a[of] + place]
        out[np.cumsum(z - a + 1) - 1] = 10
        return out, z - a + 1


def _digests(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return Sequence(values, 1).stretch(starts, starts + lengths)


class _Plan:
    def __init__(self, size: int) -> None:
        keys = size / MINIMISER_BYTES
        self.cell, self.low = cell_bits(keys), bucket_bits(keys)
        self.some, self.open = bucket_bits(keys / 4, 5e5), bucket_bits(size / STRING_BYTES, 1e4)

    def cells(self, x: Kmers) -> tuple[np.ndarray, list, np.ndarray]:
        """Cells of the distinct minimisers, and each super-k-mer's place among them."""
        new = np.ones(len(x.key), bool)
        new[1:] = x.key[1:] != x.key[:-1]
        cells = x.key[new] >> U64(64 - self.cell)
        return cells, list(buckets(cells, self.cell - self.low)), np.cumsum(new) - 1

    def shared(self, x: Kmers, met: dict) -> np.ndarray:
        """Strings (by their lead) whose minimiser may stand in another batch or document."""
        cells, cuts, of = self.cells(x)
        hit = flags_of(met, cuts, len(cells))
        if not len(x.key):
            return np.empty(0, np.int64)
        low, high = (f(x.doc, np.flatnonzero(np.diff(of, prepend=-1))) for f in (np.minimum.reduceat, np.maximum.reduceat))
        hit |= low != high
        return np.flatnonzero(hit[of[x.lead]])

    def digests(self, x: Kmers, shared: np.ndarray) -> list:
        return list(buckets(x.key[x.lead[shared]], 64 - self.some))


def _known(plan: _Plan, x: Kmers, said: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings that were asked about, and of each: held earlier elsewhere, open, one of many."""
    shared = plan.shared(x, said["met"])
    answers = [np.zeros(len(shared), bool) for _ in range(3)]
    for bucket, a, z in plan.digests(x, shared):
        if bucket in said["held"]:
            got = np.unpackbits(np.frombuffer(said["held"][bucket], np.uint8), count=3 * (z - a))
            for k in range(3):
                answers[k][a:z] = got[k * (z - a) : (k + 1) * (z - a)]
    return shared, *answers


def _held_answer(many: int):
    def answer(bucket: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        loads = [load(p) for _, p in asked]
        key, digest, owner = (np.concatenate([x[i] for x in loads]) for i in range(3))
        order = np.lexsort((owner, digest, key))
        k, d, o = key[order], digest[order], owner[order]
        new_key = np.ones(len(k), bool)
        new_key[1:] = k[1:] != k[:-1]
        new = new_key.copy()
        new[1:] |= d[1:] != d[:-1]
        lowest = o[new][np.cumsum(new) - 1]
        of_key = np.add.reduceat(new, np.flatnonzero(new_key), dtype=np.int64)
        strings = of_key[np.cumsum(new_key) - 1]
        flags = np.empty((3, len(k)), bool)
        flags[:, order] = lowest < o, strings > 1, strings >= many
        at = 0
        for (batch, _), x in zip(asked, loads):
            own = flags[:, at : at + len(x[0])]
            at += len(x[0])
            if own.any():
                yield batch, bits(own.ravel())

    return answer


def _open(x: Kmers, plan: _Plan, said: dict) -> tuple[np.ndarray, ...]:
    """What goes out in full: (bucket key, first word, windows, doc_id), by rising key."""
    shared, earlier, several, many = _known(plan, x, said)
    if not len(shared):
        return np.empty(0, U64), *[np.empty(0, np.int64)] * 3
    wanted = np.zeros((2, len(x.lead)), bool)
    wanted[0, shared] = several & ~earlier & ~many
    wanted[1, shared] = several & ~earlier & many
    some = np.flatnonzero(wanted[0][x.string] & x.own_first)
    key, at, n, owner = x.key[some], x.at[some], x.n[some], x.owner[some]
    single = np.flatnonzero(wanted[1][x.string] & x.own_first)
    of, place = runs(x.n[single])
    starts = x.at[single][of] + place
    parts = (key, at, n, owner)
    if len(starts):
        digest = _window_digests(x, starts)
        more = (pair(x.key[single][of], digest), starts, np.ones(len(starts), np.int64), x.owner[single][of])
        parts = tuple(np.concatenate(p) for p in zip(parts, more))
    order = np.lexsort((parts[1], parts[0]))
    return tuple(p[order] for p in parts)


def _window_digests(x: Kmers, starts: np.ndarray) -> np.ndarray:
    """Digests of single windows, from their bytes."""
    data, sizes = x.strings(starts, np.ones(len(starts), np.int64))
    s, e = words(data)
    return names(word_names(data, s, e), 1, x.window)[np.arange(len(starts)) * x.window] if len(s) else np.empty(0, U64)


def _windows_answer(window: int):
    def answer(bucket: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        loads = [load(p) for _, p in asked]
        first, second, owners, sizes = [], [], [], []
        for n, owner, data in loads:
            s, e = words(data)
            named = word_names(data, s, e)
            of, place = runs(n)
            at = (np.cumsum(n + window - 1) - (n + window - 1))[of] + place
            first.append(names(named, 1, window, 0)[at])
            second.append(names(named, 1, window, 1)[at])
            owners.append(owner[of])
            sizes.append(len(at))
        a, b, owner = np.concatenate(first), np.concatenate(second), np.concatenate(owners)
        order = np.lexsort((owner, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        flags = np.empty(len(order), bool)
        flags[order] = owner[order][np.flatnonzero(new)[np.cumsum(new) - 1]] < owner[order]
        for (batch, _), own in zip(asked, np.split(flags, np.cumsum(sizes)[:-1])):
            if own.any():
                yield batch, bits(own)

    return answer


def _applied(docs: DataFrame, make, schema, window: int, gram: int, many: int) -> DataFrame:
    batches = packed(docs)
    plan = _Plan(max(1, batches.count()) * BATCH_BYTES)

    def ask_cells(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        cells, cuts, _ = plan.cells(Kmers(t, window, gram))
        yield [(k, batch, dump_sorted(cells[a:z])) for k, a, z in cuts]

    def ask_digests(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        x = Kmers(t, window, gram)
        shared = plan.shared(x, said["met"])
        lead = x.lead[shared]
        yield [
            (k, batch, dump(x.key[lead[a:z]], x.digest[lead[a:z]], x.owner[lead[a:z]]))
            for k, a, z in plan.digests(x, shared)
        ]

    def ask_strings(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        x = Kmers(t, window, gram)
        key, at, n, owner = _open(x, plan, said)
        for k, a, z in buckets(key, 64 - plan.open):
            yield [(k, batch, dump(n[a:z], owner[a:z], x.strings(at[a:z], n[a:z])[0]))]

    batches = told(batches, met=ask(batches, ask_cells, repeated))
    batches = told(batches, held=ask(batches, ask_digests, _held_answer(many)))
    batches = told(batches, seen=ask(batches, ask_strings, _windows_answer(window)))

    def last(batch: int, t: pa.Table, said: dict) -> Iterator[pa.RecordBatch]:
        x = Kmers(t, window, gram)
        yield from make(t, x, _removed(x, plan, said)).to_batches()

    return mapped(batches, each(last), schema)


def _removed(x: Kmers, plan: _Plan, said: dict) -> np.ndarray:
    """Which words of the batch go."""
    shared, earlier, _, _ = _known(plan, x, said)
    gone = np.zeros(len(x.lead), bool)
    gone[shared] = earlier
    whole = np.flatnonzero(gone[x.string] | ~x.own_first) if len(x.key) else shared
    starts = [np.empty(0, np.int64)]
    key, at, n, _ = _open(x, plan, said)
    for bucket, a, z in buckets(key, 64 - plan.open):
        if bucket in said["seen"]:
            of, place = runs(n[a:z])
            hit = np.unpackbits(np.frombuffer(said["seen"][bucket], np.uint8), count=len(of))
            starts.append((at[a:z][of] + place)[hit.astype(bool)])
    runs_of_windows = x.at[whole], x.n[whole] + x.window - 1
    return covered(len(x.begin), runs_of_windows, (np.concatenate(starts), x.window))


def without_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = MANY
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text); kept words are joined by one space."""
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    return _applied(docs.select("doc_id", "text"), _report, schema, window, gram, many)


def _report(t: pa.Table, x: Kmers, gone: np.ndarray) -> pa.Table:
    sizes = x.end - x.begin + 1
    of, place = runs(np.where(gone, 0, sizes))
    data = x.raw[x.begin[of] + place]
    ends = np.concatenate([[0], np.cumsum(np.where(gone, 0, sizes))])
    data[ends[1:][~gone] - 1] = 32
    bounds = ends[x.first]
    kept = [data[a : max(a, z - 1)].tobytes() for a, z in zip(bounds[:-1], bounds[1:])]
    lost = np.concatenate([[0], np.cumsum(gone)])[x.first]
    return pa.table(
        [t.column("doc_id"), pa.array(np.diff(x.first)), pa.array(np.diff(lost)), pa.array(kept, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "n_removed", "kept_text"],
    )
