"""Periodic runs of words, by an enhanced suffix array and the branching-tandem test.

A run is a stretch of words with smallest period q and at least ``2 q`` words, which
neither neighbouring word continues. A square (a stretch of p words, twice) branches if
the word after it breaks its period: the suffixes at its start and its middle then
share exactly p words, that is, they lie in one LCP interval of depth p, in different
child intervals. So for each interval every suffix of all children but the largest
looks p words ahead and p words back, and asks the inverse suffix array whether that
suffix is in the interval, but not in its own child. A word is thus looked at in at
most log2(n) intervals. Each branching square is rotated to the left as far as its period goes;
that gives the run, and the squares of multiples of a period, which give the same
stretch, merge into the one of the smallest period. Intervals are pairs of bounds from
the LCP array; no tree is built.

The suffix array of a document comes from prefix doubling of ranks. The ranks of each
length are kept: they name the stretches of 1, 2, 4 ... words exactly, so that common
prefixes and suffixes are read off them. Words are numbered by their bytes. Many
documents are sorted at once; words of different documents never get the same rank.

A document is worked on whole in one task and nothing is shuffled. It takes some
4 log2(n) + 100 bytes for each of its n words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import _SPACE, covered, flat, runs, slices, words
from .rounds import mapped

LEAST_WORDS = 12
#: Suffixes that are tested at once.
TESTED = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>,"
    " collapsed string"
)


def word_ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of words; equal words have equal numbers."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    data = np.ascontiguousarray(raw[~_SPACE[raw]])
    column = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


class Suffixes:
    """Suffix array, its inverse and LCP array of sequences that lie one after another.

    ``levels[k]`` has a rank for the 2**k units from each position on. Two ranks are equal
    exactly if these units are, and lie in one sequence.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray) -> None:
        n = len(ids)
        sizes = np.diff(first)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.first, self.end = first[:-1][doc], first[1:][doc]
        key = doc * (int(ids.max(initial=0)) + 1) + ids
        self.sa = np.argsort(key, kind="stable")
        rank = np.full(n + 1, -1, np.int64)
        rank[self.sa] = _starts(key[self.sa], np.arange(n))
        self.levels = [rank.astype(np.int32) if n < 1 << 31 else rank.copy()]
        step, slots = 1, self._shared(rank, np.arange(n))
        while len(slots):
            open_ = self.sa[slots]
            after = np.minimum(open_ + step, n)
            second = np.where(open_ + step < self.end[open_], rank[after], -1)
            key = rank[open_] * (n + 1) + second + 1
            order = np.argsort(key, kind="stable")
            open_ = open_[order]
            self.sa[slots] = open_
            rank[open_] = _starts(key[order], slots)
            self.levels.append(rank.astype(self.levels[0].dtype))
            step, slots = 2 * step, self._shared(rank, slots)
        self.isa = np.empty(n, np.int64)
        self.isa[self.sa] = np.arange(n)
        self.lcp = np.zeros(n + 1, np.int64)
        ranks = self.levels[0][self.sa]
        near = np.flatnonzero(ranks[1:] == ranks[:-1]) + 1
        self.lcp[near] = self._ahead(self.sa[near - 1], self.sa[near])

    def _shared(self, rank: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Of these places of the suffix array those whose rank another suffix has, too."""
        r = rank[self.sa[slots]]
        same = r[1:] == r[:-1]
        none = np.zeros(min(1, len(r)), bool)
        return slots[np.concatenate([none, same]) | np.concatenate([same, none])]

    def _ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Units that the suffixes at i and j begin with in common."""
        out = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            out[level[i + out] == level[j + out]] += 1 << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Units that end before i and before j, a later place of its sequence, in common."""
        out = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            level, a = self.levels[k], i - out - (1 << k)
            some = np.flatnonzero(a >= self.first[i])
            a = a[some]
            out[some[level[a] == level[a + (j - i)[some]]]] += 1 << k
        return out

    def children(self) -> tuple[np.ndarray, ...]:
        """(depth, from, to, child from, child to) of all child intervals but the largest."""
        at = np.flatnonzero(self.lcp)
        if not len(at):
            return tuple(np.empty(0, np.int64) for _ in range(5))
        low, high = _bounds(self.lcp, at)
        order = np.lexsort((at, high, low))
        low, high, at = low[order], high[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        begin = np.flatnonzero(new)
        # the children of an interval begin at its bound and at each of its places
        a = np.insert(at, begin, low[begin])
        lead = begin + np.arange(len(begin))
        z = np.empty(len(a), np.int64)
        z[:-1] = a[1:] - 1
        z[np.append(lead[1:], len(a)) - 1] = high[begin]
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(lead, len(a))))
        size = z - a + 1
        largest = np.lexsort((-size, of))[lead]
        rest = np.ones(len(a), bool)
        rest[largest] = False
        depth, low, high = self.lcp[at[begin]], low[begin], high[begin]
        of = of[rest]
        return depth[of], low[of], high[of], a[rest], z[rest]


def _starts(key: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """For sorted keys the slot of the first with the same key."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return slots[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else slots


def _bounds(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last suffix of the LCP interval that each place with a depth belongs to."""
    wide = int(np.diff(np.flatnonzero(lcp == 0)).max(initial=1))
    tables = [lcp]
    while 1 << len(tables) <= wide:
        t, half = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(t[: len(t) - half], t[half:]))
    depth = lcp[at]
    low, high = at.copy(), at.copy()  # all between is as deep
    for k in reversed(range(len(tables))):
        t, step = tables[k], 1 << k
        a = low - step
        some = np.flatnonzero(a >= 0)
        some = some[t[a[some]] >= depth[some]]
        low[some] -= step
        some = np.flatnonzero(high + 1 < len(t))
        some = some[t[high[some] + 1] >= depth[some]]
        high[some] += step
    return low - 1, high


def squares(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching squares."""
    depth, low, high, a, z = s.children()
    found = []
    size = z - a + 1
    before = np.cumsum(size) - size
    cuts = np.searchsorted(before, np.arange(0, int(size.sum()) + TESTED, TESTED))
    for x, y in zip(cuts, np.append(cuts[1:], len(size))):
        if x == y:
            continue
        child, place = runs(size[x:y])
        child += x
        i, p = s.sa[a[child] + place], depth[child]
        for ahead in (True, False):
            j = i + p if ahead else i - p
            some = np.flatnonzero(j < s.end[i] if ahead else j >= s.first[i])
            of, r = child[some], s.isa[j[some]]
            hit = (r >= low[of]) & (r <= high[of]) & ((r < a[of]) | (r > z[of]))
            some = some[hit]
            found.append(np.stack([i[some] if ahead else j[some], p[some]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def maximal_runs(
    ids: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of runs of at least so many units, by start and period.

    Sequence k has the units ``first[k]`` to ``first[k + 1]``; starts count from the
    first unit of all.
    """
    s = Suffixes(ids, first)
    i, p = squares(s)
    start, end = i - s.behind(i, i + p), i + 2 * p
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    new &= end - start >= least
    start, length, p = start[new], (end - start)[new], p[new]
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): a row per document.

    ``runs`` lists start (word number from 0), length and period of the runs of at least
    ``least`` words, by start and period. ``collapsed`` has the words, joined by one
    blank, that no run contains after its first period. A null or empty text has no
    words, no runs and an empty collapsed text. Repeated and null doc_ids are rows of
    their own. Other columns are not looked at.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = flat(b.column("text"), b"\n")
            for x, y in slices(offsets):
                part = raw[offsets[x] : offsets[y]]
                yield _reported(b.column("doc_id").slice(x, y - x), part, offsets[x : y + 1] - offsets[x], least)

    return mapped(docs.select("doc_id", "text"), run, SCHEMA)


def _reported(doc_ids: pa.Array, raw: np.ndarray, offsets: np.ndarray, least: int) -> pa.RecordBatch:
    starts, ends = words(raw)
    first = np.searchsorted(starts, offsets)
    start, length, period = maximal_runs(word_ids(raw, starts, ends), first, least)
    kept = ~covered(len(starts), (start + period, length - period))
    # bytes of the kept words, each with the one after it, which becomes a blank
    own = covered(len(raw), (starts[kept], (ends - starts)[kept] + 1))
    before = np.concatenate([[0], np.cumsum(kept)])[first]
    last = before[1:][before[1:] > before[:-1]] - 1
    own[ends[kept][last]] = False
    data = raw[own]
    data[_SPACE[data]] = 0x20
    cuts = np.concatenate([[0], np.cumsum(own)])[offsets]
    collapsed = pa.Array.from_buffers(
        pa.large_binary(), len(doc_ids), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]
    ).cast(pa.large_string()).cast(pa.string())
    of = np.searchsorted(first, start, "right") - 1
    listed = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(start, first).astype(np.int32)),
        pa.StructArray.from_arrays(
            [pa.array(start - first[of]), pa.array(length), pa.array(period)], fields=list(RUN)
        ),
    )
    return pa.record_batch(
        [doc_ids, pa.array(np.diff(first)), listed, collapsed],
        ["doc_id", "n_words", "runs", "collapsed"],
    )
