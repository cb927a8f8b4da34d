"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2 r bits exactly if some value lies within
r bits of both. So every distinct fingerprint emits all values within r bits (2,081
for r = 2), the values are shuffled, and fingerprints that meet at a value are
linked; since both are within r of it, meeting is the proof. A group of any size
that meets at a value is linked to its smallest member only, never pair by pair.

The values are many (the fingerprints times 2,081), and nearly all meet nobody. They
travel twice. First as cells of some 36 to 50 bits, sorted and gap-coded at about two
bytes each, which tells each batch of fingerprints the values that may be shared.
Then those alone travel in full. Links become components by ``components``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import U64, flat, mix, slices
from .rounds import (
    ask,
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
    partitions,
    repeated,
    stored,
    told,
)

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Fingerprints whose values a task holds at once.
BATCH = 2048


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the shingles of a text, in order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, U64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    found = [digest(joined[a:z], seed) for a, z in zip(starts[:n], ends[-n:])]
    return np.array(found, U64)


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per text: the bits set in over half of its hashes."""
    out = np.zeros(len(counts), U64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    starts = (np.cumsum(counts) - counts)[some]
    half = counts[some] // 2
    eight = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        column = np.ascontiguousarray(eight[:, byte])
        for bit in range(8):
            ones = np.add.reduceat((column >> bit) & 1, starts, dtype=np.int64)
            out[some] |= (ones > half).astype(U64) << U64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each text, as a signed 64-bit integer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = flat(b.column("text"))
            for i, j in slices(offsets):
                found = [
                    shingle_hashes(raw[offsets[k] : offsets[k + 1]].tobytes(), shingle, seed)
                    for k in range(i, j)
                ]
                counts = np.fromiter(map(len, found), np.int64, j - i)
                fp = fold(np.concatenate(found), counts)
                yield pa.record_batch(
                    [b.column("doc_id").slice(i, j - i), pa.array(fp.view(np.int64))],
                    ["doc_id", "fp"],
                )

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def ball(radius: int, size: int = 64) -> np.ndarray:
    """All masks of ``size`` bits with at most ``radius`` of them set."""
    return np.array(
        [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(size), n)],
        U64,
    )


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): fingerprints that meet at a value, each with the smallest that it meets.

    ``distinct`` has each fingerprint once, in the column fp. The radius is even, so
    that meeting at half of it proves the link.
    """
    if radius % 2:
        raise ValueError(f"the radius must be even, not {radius}")
    masks = ball(radius // 2)

    def values(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        fps = t.column("fp").to_numpy().view(U64)
        return fps, (fps[:, None] ^ masks[None, :]).ravel()

    return _met(distinct, "fp", values, len(masks), _stars)


def _met(distinct: DataFrame, key: str, values: Callable, per: int, pairs: Callable) -> DataFrame:
    """(a, b): what ``pairs`` makes of the nodes that share a value.

    ``values`` gives the nodes of a batch and ``per`` values of each, one after another.
    """
    batches = packed(distinct.repartition(partitions(distinct), key), rows=BATCH)
    total = distinct.count() * per
    cell, parts = cell_bits(total), bucket_bits(total)

    def cells(variants: np.ndarray) -> np.ndarray:
        return mix(variants.copy()) >> U64(64 - cell)

    def first(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        keys = np.sort(cells(values(t)[1]))
        yield [(k, batch, dump_sorted(keys[a:z])) for k, a, z in buckets(keys, cell - parts)]

    met = ask(batches, first, repeated)

    def second(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        fps, variants = values(t)
        own = cells(variants)
        keys = np.sort(own)
        hit = flags_of(said["met"], buckets(keys, cell - parts), len(keys))
        shared = np.unique(keys[hit])
        if not len(shared):
            return
        at = np.searchsorted(shared, own)
        at[at == len(shared)] = 0
        some = np.flatnonzero(shared[at] == own)
        some = some[np.argsort(own[some], kind="stable")]
        keys, full, who = own[some], variants[some], fps[some // per]
        yield [
            (k, batch, dump(full[a:z], who[a:z])) for k, a, z in buckets(keys, cell - parts)
        ]

    def join(table: pa.Table) -> pa.Table:
        loads = [load(p.as_py()) for p in table.column("payload")]
        value, who = (np.concatenate([x[i] for x in loads]) for i in range(2))
        a, b = pairs(value, who)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    asked = mapped(told(batches, met=met), each(second), "bucket long, batch long, payload binary")
    return asked.groupBy("bucket").applyInArrow(join, "a long, b long")


def _stars(value: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member that shares a value, linked to a member of its group in this bucket."""
    order = np.lexsort((who, value))
    value, who = value[order], who[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    sizes = np.diff(np.append(start, len(value)))
    group = np.repeat(np.arange(len(start)), sizes)
    many = sizes[group] > 1
    nodes, at = np.unique(who[many], return_inverse=True)
    _, group = np.unique(group[many], return_inverse=True)
    label = np.arange(len(nodes))
    while True:  # the smallest label of a group, then of a member's groups
        low = np.full(int(group.max(initial=-1)) + 1, len(nodes))
        np.minimum.at(low, group, label[at])
        new = label.copy()
        np.minimum.at(new, at, low[group])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that a document is linked with.

    Links join into groups. Texts without words have fingerprint zero and are linked
    like others; a null text counts as empty. Repeated doc_ids are separate rows. A
    null doc_id is never the smallest, unless a group has no other.
    """
    marked = stored(fingerprints(docs))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    label = classes.join(joined, "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    lowest = label.groupBy("component").agg(F.min("first").alias("component_id"))
    found = label.join(lowest, "component").select("fp", "component_id")
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Documents whose doc_id is the smallest of their group, with all columns.

    Of repeated rows with that doc_id all stay. Documents without doc_id stay only in
    groups that have no other.
    """
    found = near_duplicates(docs.select("doc_id", "text"), radius)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    kept = kept.distinct().withColumnRenamed("doc_id", "_kept")
    return docs.join(kept, docs.doc_id.eqNullSafe(kept["_kept"]), "left_semi")
