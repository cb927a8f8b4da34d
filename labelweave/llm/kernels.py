"""Numpy kernels on the flat bytes of many texts, used inside Spark tasks.

Texts come as one byte buffer with offsets, as Arrow stores them, so a task works
on whole arrays and never on a Python string per word. Names are 64-bit hashes of a
stretch of units; a second ``lane`` with other constants makes them 128 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Odd multipliers, one row per lane.
_LANES = (
    (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93),
    (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3),
)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def flat(
    column: pa.ChunkedArray | pa.Array, end: bytes = b""
) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text.

    ``end`` is put after each text; with a line break no word spans two texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if end:
        end, none = pa.scalar(end, pa.large_binary()), pa.scalar(b"", pa.large_binary())
        column = pc.binary_join_element_wise(column, end, none)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``limit`` bytes; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over the whole range, in place."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def pair(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """One name for each pair of names."""
    k1, k2, k3 = (U64(k) for k in _LANES[lane])
    h = a * k1
    h ^= h >> U64(29)
    h += b * k2
    h ^= h >> U64(32)
    h *= k3
    h ^= h >> U64(31)
    return h


def names(first: np.ndarray, unit: int, length: int, lane: int = 0) -> np.ndarray:
    """Names of all stretches of ``length`` units, by doubling.

    ``first[i]`` names ``unit`` units from position i. Each step pairs the names at
    i and at i + the length so far; the last step overlaps so as to end at ``length``.
    """
    at, h = unit, first
    while at < length:
        step = min(at, length - at)
        h = pair(h[:-step], h[step:], lane) if len(h) > step else h[:0]
        at += step
    return h


def byte_names(raw: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit value for the eight bytes at each position: the bytes themselves, mixed."""
    if len(raw) < 8:
        return np.empty(0, U64)
    eight = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,))
    return mix(eight * U64(_LANES[lane][0]))


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` consecutive values from each position on."""
    if len(h) < width:
        return h[:0]
    out, at = h, 1
    while at < width:
        step = min(at, width - at)
        out = np.minimum(out[:-step], out[step:])
        at += step
    return out


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of texts that each end in white space."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    return edges[::2], edges[1::2]


#: Words longer than this are hashed one by one.
_LONG_WORD = 256


def word_names(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0
) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    size = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))

    def chunk(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[at] << (U64(8) * (U64(8) - np.minimum(left, 8).astype(U64)))

    h = pair(size.astype(U64), chunk(starts, size), lane)
    some, done = np.flatnonzero((size > 8) & (size <= _LONG_WORD)), 8
    while len(some):
        h[some] = pair(h[some], chunk(starts[some] + done, size[some] - done), lane)
        done += 8
        some = some[size[some] > done]
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), lane)
    return mix(h)


def character_names(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value of each UTF-8 character of stretches, and their number in each.

    A stretch has a word and ends in white space. Each run of white space inside counts
    as one blank, at its ends as nothing.
    """
    of, place = runs(ends - starts)
    at = starts[of] + place
    byte = raw[at]
    space = _SPACE[byte]
    after = np.zeros(len(at), bool)  # a blank after a character of the same stretch
    after[1:] = space[1:] & ~space[:-1] & (place[1:] > 0)
    some = np.flatnonzero(np.where(space, after, (byte & 0xC0) != 0x80))
    # the last of a stretch is the blank that ends it
    some = some[np.concatenate([of[some][1:] == of[some][:-1], np.zeros(min(1, len(some)), bool)])]
    lead = byte[some]
    value = np.where(space[some], 0x20, lead).astype(U64)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    for k, least in enumerate((0xC0, 0xE0, 0xF0), 1):
        more = np.flatnonzero(lead >= least)
        value[more] |= padded[at[some[more]] + k].astype(U64) << U64(8 * k)
    return mix((value + U64(1)) * U64(_LANES[0][2])), np.bincount(of[some], minlength=len(starts))


class Numbering:
    """Numbers of 128-bit names, in an open table of fixed size."""

    def __init__(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.first, self.second = np.zeros(1 << bits, U64), np.zeros(1 << bits, U64)
        self.number = np.zeros(1 << bits, np.int32)

    def _slots(self, first: np.ndarray) -> np.ndarray:
        return (first >> U64(64 - self.bits)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of the names, -1 for new ones."""
        out, slot = np.full(len(first), -1, np.int64), self._slots(first)
        open_ = np.arange(len(first))
        while len(open_):
            at = slot[open_]
            key = self.first[at]
            hit = (key == first[open_]) & (self.second[at] == second[open_])
            out[open_[hit]] = self.number[at[hit]]
            open_ = open_[~hit & (key != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        """Number distinct new names in their order."""
        slot, open_ = self._slots(first), np.arange(len(first))
        while len(open_):
            free = open_[self.first[slot[open_]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.first[slot[free]], self.second[slot[free]] = first[free], second[free]
            self.number[slot[free]] = self.count + free
            open_ = np.setdiff1d(open_, free, assume_unique=True)
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        self.count += len(first)


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, as far as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                values = np.full(n, base, U64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))
        return self.up, self.down


_POWERS = tuple(_Powers(lane[0]) for lane in _LANES)


class Sequence:
    """Hashes of stretches of one sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, lane: int = 0) -> None:
        up, self.down = _POWERS[lane].upto(len(values) + 2)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])
        self.per_unit = U64(_LANES[lane][1])

    def stretch(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end)."""
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        h += (ends - starts).astype(U64) * self.per_unit
        return mix(h)

    def without(self, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of [start, end) with the unit at ``at`` left out."""
        h = (self.sums[at] - self.sums[starts]) * self.down[starts]
        h += (self.sums[ends] - self.sums[at + 1]) * self.down[starts + 1]
        h += (ends - starts - 1).astype(U64) * self.per_unit
        return mix(h)


def runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given lengths: the group of each member and its place in it."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return group, np.arange(len(group)) - first[group]


def covered(size: int, *stretches: tuple[np.ndarray, np.ndarray | int]) -> np.ndarray:
    """Which of ``size`` positions lie in a stretch, given as starts and widths."""
    change = np.zeros(size + 1, np.int32)
    for starts, widths in stretches:
        change += np.bincount(starts, minlength=size + 1).astype(np.int32)
        change -= np.bincount(np.minimum(starts + widths, size), minlength=size + 1).astype(np.int32)
    return np.cumsum(change[:-1], dtype=np.int32) > 0
