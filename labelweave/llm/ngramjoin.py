"""Groups of documents with similar n-gram sets, by adaptive multi-match prefixes.

A document is the set of its distinct shingles, in one order for all: rare ones first.
Two sets with a Jaccard similarity of at least ``LEAST`` percent differ in few shingles,
so of a set of n at most e = n - ceil(LEAST n / 100) are missing from the other one, and
the first e + m shingles of both have m in common. Each document picks its own m: a
longer prefix reads more partners, but needs m matches before a pair is looked at. With
f partners in all that its prefix meets, at most f / m pairs can have m matches; the
document takes the m up to ``MOST_MATCHES`` for which f + VERIFY f / m is least. A pair
counts the matches that lie in the prefixes for the smaller of its two m, and has to
have that many.

1. Sets are written once, in batches bucketed by number. Documents with equal sets are
   one class, which only its first document stands for from here on.
2. How often a shingle occurs is counted by buckets of hashed cells (``rounds``). It is
   known as a power of two, rounded up, the same for all who ask.
3. Prefix shingles that others have go to buckets, with a sketch of the set (the parity
   of its shingles in 512 cells; sketches differ in no more bits than sets do in
   shingles). Pairs that meet and pass the sizes and sketches are counted.
4. A shingle of more than ``MANY`` classes makes no pairs. Its classes are a group, whose
   pivot is the set of the shingles that more than half of them have; hot shingles with the
   same first class, by hash, share a group. Each class becomes its difference from the
   pivot, and between differences the same holds: with d_x, d_y shingles in them, x and y
   are similar exactly if the differences share (v_x + v_y) / (2 A), where v = A d - B n,
   A = 100 + LEAST and B = 100 - LEAST. If v_x + v_y <= 0 they are similar, and so are
   both to the class with the smallest v: a star says it all. Others meet on the rare part
   of their differences; a shingle that again has more than ``MANY`` is a group of its
   own, of at most half the classes, as no difference of a group is in more than half.
5. Pairs are verified on whole sets. First each class with its nearest partner; then, of
   all other pairs, those whose classes are not yet in one component. No link is lost,
   and no pair inside a component is looked at twice.

Hashes of shingles and of sets count as the shingles and the sets (64 and 128 bits).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import U64, flat, mix, pair, runs, word_names, words
from .rounds import (
    ask,
    bucket_bits,
    bucketed,
    buckets,
    cell_bits,
    dump,
    dump_sorted,
    each,
    load,
    load_sorted,
    mapped,
    pack_table,
    packed,
    row_numbers,
    stored,
    told,
)

SHINGLE = 3
LEAST = 90
MOST_MATCHES = 16
#: What verifying a pair costs, in matches read.
VERIFY = 16
#: A shingle that more classes have makes no pairs but a pivot; a power of two.
MANY = 128
SKETCH_WORDS = 8
#: Parts of a group that meet its pivot in tasks of their own; far fewer than its classes.
PARTS = 32
#: Buckets of pivots are numbered from here on.
HOT = 1 << 40
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_PAIRS = "a long, b long, need int, matches long, gap int"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts that each end in white space, rising, and their numbers.

    A text with fewer words than ``size`` has its whole sequence as one.
    """
    raw = _LOWER[raw]
    starts, ends = words(raw)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    name = word_names(raw, starts, ends)
    h, of = name, np.repeat(np.arange(len(n)), n)
    for k in range(1, size):
        h = pair(h[:-1], name[k:]) if len(h) > 1 else h[:0]
    whole = of[size - 1 :] == of[: len(h)]  # shingles within one text
    keys, docs = [h[whole]], [of[: len(h)][whole]]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        one = name[first[short]]
        for j in range(1, k):
            one = pair(one, name[first[short] + j])
        keys.append(mix(one + U64(k)))
        docs.append(short)
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], np.bincount(docs[new], minlength=len(n))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _sketches(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parity of each set's shingles in 64 * ``SKETCH_WORDS`` cells."""
    cell = mix(keys * U64(0xA0761D6478BD642F)) >> U64(55)
    bit = U64(1) << (cell & U64(63))
    out = np.zeros((len(sizes), SKETCH_WORDS), U64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        for w in range(SKETCH_WORDS):
            own = np.where(cell >> U64(6) == U64(w), bit, U64(0))
            out[some, w] = np.bitwise_xor.reduceat(own, starts)
    return out


def set_batches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Batches of (doc_id, n, d1, d2, set), bucketed by number."""

    def build(batch: int, t: pa.Table, said: dict) -> Iterator[pa.RecordBatch]:
        keys, n = shingle_sets(*flat(t.column("text"), b"\n"), size)
        d1, d2 = (_sums(mix(keys * U64(k)), n) for k in (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB))
        first = np.concatenate([[0], np.cumsum(n)])
        table = pa.table({
            "doc_id": t.column("doc_id"), "n": pa.array(n),
            "d1": pa.array(d1.view(np.int64)), "d2": pa.array(d2.view(np.int64)),
            "set": pa.LargeListArray.from_arrays(pa.array(first), pa.array(keys)),
        })
        yield pa.record_batch([pa.array([batch]), pa.array([pack_table(table)])], ["batch", "payload"])

    texts = packed(docs.select("doc_id", "text"), rows=1 << 20, keep=False)
    return bucketed(mapped(texts, each(build), "batch long, payload binary"))


def _node() -> str:
    """SQL of ``row_numbers``."""
    return "shiftleft(shiftright(rep.batch, 32), 40) + shiftleft(rep.batch & 4294967295, 20) + rep.at"


def _placed(nodes: DataFrame) -> DataFrame:
    """Answers that tell batches of their rows among the nodes: the bucket is the row."""
    return nodes.selectExpr(
        "shiftleft(shiftright(node, 40), 32) + (shiftright(node, 20) & 1048575) as batch",
        "node & 1048575 as bucket", "binary('') as payload",
    )


class _Classes:
    """The sets of the rows of a batch that stand for a class, by their place ``at``."""

    def __init__(self, t: pa.Table, said: dict) -> None:
        self.at = np.sort(np.fromiter(said, np.int64, len(said)))
        n = t.column("n").to_numpy()
        first = np.concatenate([[0], np.cumsum(n)])
        self.n = n[self.at]
        of, place = runs(self.n)
        self.keys = t.column("set").combine_chunks().flatten().to_numpy()[first[self.at][of] + place]
        self.of, self.place = of, place
        self.first = np.cumsum(self.n) - self.n


class _Plan:
    """Cells and buckets for so many shingles, and the similarity asked for."""

    def __init__(self, total: int, least: int) -> None:
        self.cell, self.parts = cell_bits(total), bucket_bits(total)
        self.near = bucket_bits(total * 0.02, 1e5)
        self.least, self.a, self.b = least, 100 + least, 100 - least

    def cuts(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        return list(buckets(cells, self.cell - self.parts))

    def cells(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted cells, each key's among them, and how many keys a cell has."""
        return np.unique(keys >> U64(64 - self.cell), return_inverse=True, return_counts=True)

    def linked(self, differ: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether sets with so many shingles in one only, and so many in both sizes, link."""
        return self.a * differ <= self.b * sizes


def _count(bucket: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """How often each cell occurs, as a power of two, rounded up; for those that others have."""
    loads = [load(p) for _, p in asked]
    keys = [load_sorted(k.tobytes()) for k, _ in loads]
    cells, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([c for _, c in loads]), len(cells)).astype(np.int64)
    codes = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)[at]
    for (batch, _), own in zip(asked, np.split(codes, np.cumsum([len(k) for k in keys])[:-1])):
        if own.any():
            yield batch, dump(np.packbits(own > 0), own[own > 0])


class _Prefixes:
    """The prefix shingles of a batch's classes that others have, too."""

    def __init__(self, x: _Classes, plan: _Plan, said: dict) -> None:
        cells, inverse, _ = plan.cells(x.keys)
        code = np.zeros(len(cells), np.uint8)
        for bucket, a, z in plan.cuts(cells):
            if bucket in said:
                flags, found = load(said[bucket])
                code[a:z][np.unpackbits(flags, count=z - a) > 0] = found
        code = code[inverse]
        order = np.lexsort((x.keys, code, x.of))
        code, keys = code[order], x.keys[order]
        partners = np.where(code > 0, (1 << code.astype(np.int64)) - 1, 0)
        upto = np.concatenate([[0], np.cumsum(partners)])
        common = -(-plan.least * x.n // 100)
        differ = x.n - common
        matches, cheapest = np.ones(len(x.n), np.int64), np.full(len(x.n), np.inf)
        for m in range(1, MOST_MATCHES + 1):
            read = upto[x.first + differ + np.minimum(m, common)] - upto[x.first]
            cost = np.where(m <= common, read + VERIFY * read / m, np.inf)
            better = cost < cheapest
            matches[better], cheapest[better] = m, cost[better]
        some = np.flatnonzero((code > 0) & (x.place < (differ + matches)[x.of]))
        self.key, self.code, self.of = keys[some], code[some], x.of[some]
        self.least_matches = np.maximum(1, x.place[some] - differ[self.of] + 1)
        self.matches = matches
        self.hot = self.code > MANY.bit_length() - 1


def _meet(plan: _Plan, asked: list[tuple[int, bytes]]) -> Iterator[bytes]:
    """Pairs of classes that share a shingle, with their matches in this bucket."""
    loads = [load(p) for _, p in asked]
    which = np.repeat(np.arange(len(loads)), [len(x[0]) for x in loads])
    key, row, least = (np.concatenate([x[i] for x in loads]) for i in range(3))
    shift = np.cumsum([0, *(len(x[3]) for x in loads)])
    row = row.astype(np.int64) + shift[which]
    node, n, matches = (np.concatenate([x[i] for x in loads]).astype(np.int64) for i in (3, 4, 5))
    sketch = np.concatenate([x[6] for x in loads]).reshape(-1, SKETCH_WORDS)
    order = np.lexsort((row, key))
    key, row, least = key[order], row[order], least[order].astype(np.int64)
    found, held = [], 0
    for step in range(1, len(key)):
        i = np.flatnonzero(key[step:] == key[:-step])
        if not len(i):
            break
        j = i + step
        x, y = row[i], row[j]
        need = np.minimum(matches[x], matches[y])
        ok = np.maximum(least[i], least[j]) <= need
        ok &= plan.least * np.maximum(n[x], n[y]) <= 100 * np.minimum(n[x], n[y])
        x, y, need = x[ok], y[ok], need[ok]
        gap = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
        ok = plan.linked(gap, n[x] + n[y])
        x, y = node[x[ok]], node[y[ok]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y), need[ok], gap[ok]]))
        held += found[-1].shape[1]
        if held > 1 << 21:
            yield _counted(found)
            found, held = [], 0
    if held:
        yield _counted(found)


def _counted(found: list[np.ndarray]) -> bytes:
    pairs, matches = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
    return dump(*(np.ascontiguousarray(c) for c in pairs), matches)


def _asked(batches: DataFrame, plan: _Plan) -> DataFrame:
    """Pairs that meet on rare shingles, packed, and the pivots of the others, by bucket."""

    def prefixes(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        x = _Classes(t, said["own"])
        p = _Prefixes(x, plan, said["met"])
        node = row_numbers(batch, x.at)
        cold = np.flatnonzero(~p.hot)
        cold = cold[np.argsort(p.key[cold], kind="stable")]
        docs = np.unique(p.of[cold])
        own = np.isin(x.of, docs)
        sketch = _sketches(x.keys[own], x.n[docs])
        out = []
        for k, a, z in buckets(p.key[cold], 64 - plan.near):
            i = cold[a:z]
            rows, at = np.unique(p.of[i], return_inverse=True)
            out.append((k, batch, dump(
                p.key[i], at.astype(np.uint32), p.least_matches[i].astype(np.uint8), node[rows],
                x.n[rows], p.matches[rows], sketch[np.searchsorted(docs, rows)].ravel(),
            )))
        keys, low = _lowest(p, node)
        out += [(HOT + k, batch, dump(keys[a:z], low[a:z])) for k, a, z in buckets(keys, 64 - plan.near)]
        yield out

    def answer(bucket: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        if bucket < HOT:
            yield from ((asked[0][0], payload) for payload in _meet(plan, asked))
            return
        loads = [load(p) for _, p in asked]
        keys, low = (np.concatenate([x[i] for x in loads]) for i in range(2))
        order = np.lexsort((low, mix(low.astype(U64)), keys))
        keys, low = keys[order], low[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for (batch, _), (own, _) in zip(asked, loads):
            yield batch, dump(low[first[np.searchsorted(keys[first], own)]])

    return ask(batches, prefixes, answer)


def _lowest(p: _Prefixes, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hot shingles of a batch, rising, each with the class whose hash is smallest."""
    i = np.flatnonzero(p.hot)
    own = node[p.of[i]]
    order = np.lexsort((own, mix(own.astype(U64)), p.key[i]))
    key, own = p.key[i][order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key[new], own[new]


def _cold_pairs(answers: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column("payload"):
                a, z, need, gap, matches = load(payload.as_py())
                yield pa.record_batch(
                    [pa.array(a), pa.array(z), pa.array(need.astype(np.int32)), pa.array(matches), pa.array(gap.astype(np.int32))],
                    ["a", "b", "need", "matches", "gap"],
                )

    met = mapped(answers.filter(F.col("bucket") < HOT).select("payload"), run, _PAIRS)
    counted = met.groupBy("a", "b", "need", "gap").agg(F.sum("matches").alias("matches"))
    return counted.filter("matches >= need").select("a", "b", "gap")


def _hot_members(batches: DataFrame, plan: _Plan) -> DataFrame:
    """(grp, x): classes that share a hot shingle; a group has the name of its pivot."""

    def run(batch: int, t: pa.Table, said: dict) -> Iterator[pa.RecordBatch]:
        x = _Classes(t, said["own"])
        p = _Prefixes(x, plan, said["met"])
        node = row_numbers(batch, x.at)
        keys, _ = _lowest(p, node)
        if not len(keys):
            return
        pivot = np.empty(len(keys), np.int64)
        for k, a, z in buckets(keys, 64 - plan.near):
            pivot[a:z] = load(said["pivots"][HOT + k])[0]
        i = np.flatnonzero(p.hot)
        both = np.unique(np.stack([pivot[np.searchsorted(keys, p.key[i])], node[p.of[i]]]), axis=1)
        yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], ["grp", "x"])

    return mapped(batches, each(run), "grp long, x long")


def _whole_sets(batches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, set): the sets of some classes, bucketed by class."""

    def run(batch: int, t: pa.Table, said: dict) -> Iterator[pa.RecordBatch]:
        x = _Classes(t, said["wanted"])
        sets = pa.ListArray.from_arrays(
            pa.array(np.append(x.first, len(x.keys)).astype(np.int32)), pa.array(x.keys.view(np.int64))
        )
        yield pa.record_batch([pa.array(row_numbers(batch, x.at)), pa.array(x.n), sets], ["node", "n", "set"])

    wanted = told(batches.select("batch", "payload"), wanted=_placed(nodes))
    return bucketed(mapped(wanted.filter("wanted is not null"), each(run), "node long, n long, set array<long>"), "node")


def _verified(pairs: DataFrame, sets: DataFrame, plan: _Plan) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [b.column(c) for c in ("left", "right")]
            values = [c.flatten().to_numpy() for c in sides]
            ends = [np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())]) for c in sides]
            differ = [
                len(np.setxor1d(*(v[e[i] : e[i + 1]] for v, e in zip(values, ends)), assume_unique=True))
                for i in range(b.num_rows)
            ]
            ok = plan.linked(np.array(differ, np.int64), b.column("sizes").to_numpy())
            yield b.select(["a", "b"]).filter(pa.array(ok))

    both = pairs.join(sets.selectExpr("node as a", "n as n_a", "set as left"), "a").join(
        sets.selectExpr("node as b", "n as n_b", "set as right"), "b"
    )
    return mapped(both.selectExpr("a", "b", "n_a + n_b as sizes", "left", "right"), run, "a long, b long")


def _salted(groups: DataFrame) -> DataFrame:
    """The row of a group for each of its parts. A group has more classes than parts, by far."""
    return groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def _counts(rows: DataFrame) -> DataFrame:
    """(grp, token, df): how many differences of a group have a shingle; combined before they are sent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token = b.column("differ").flatten().to_numpy()
            grp = np.repeat(b.column("grp").to_numpy(), b.column("differ").value_lengths().to_numpy())
            (grp, token), df = np.unique(np.stack([grp, token]), axis=1, return_counts=True)
            yield pa.record_batch([pa.array(grp), pa.array(token), pa.array(df)], ["grp", "token", "df"])

    found = mapped(rows.select("grp", "differ"), run, "grp long, token long, df long")
    return found.groupBy("grp", "token").agg(F.sum("df").alias("df"))


def _hot_links(rows: DataFrame, plan: _Plan) -> list[DataFrame]:
    """Links inside groups of classes that share a hot shingle: (grp, x, n, differ), level by level."""
    links = []
    while rows.take(1):
        rows = rows.withColumn("part", F.expr(f"cast(pmod(xxhash64(x), {PARTS}) as int)"))
        size = rows.groupBy("grp").agg(F.count("*").alias("size"))
        most = _counts(rows).join(size, "grp").filter("2 * df > size").groupBy("grp").agg(F.collect_list("token").alias("most"))
        most = size.join(most, "grp", "left").select("grp", F.coalesce("most", F.array().cast("array<long>")).alias("most"))
        rows = rows.join(_salted(most), ["grp", "part"]).selectExpr(
            "grp", "part", "x", "n", "concat(array_except(differ, most), array_except(most, differ)) as differ"
        )
        rows = stored(rows.withColumn("v", F.expr(f"{plan.a} * size(differ) - {plan.b} * n")))
        low = rows.groupBy("grp").agg(F.min(F.struct("v", "x")).alias("low"))
        rows = rows.join(_salted(low), ["grp", "part"]).drop("part")
        links.append(rows.filter("v + low.v <= 0 and x <> low.x").selectExpr("x as a", "low.x as b"))
        spelt = rows.select("grp", "x", F.explode("differ").alias("token"))
        shared = spelt.groupBy("grp", "token").agg(F.count("*").alias("df")).filter("df > 1")
        # in order of rarity; those that nobody shares come first and need no row
        known = spelt.join(shared, ["grp", "token"]).groupBy("grp", "x").agg(
            F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens")
        )
        entry = rows.join(known, ["grp", "x"]).select(
            "grp", "x", "n", "v", "low", "differ", F.size("tokens").alias("size"), F.posexplode("tokens").alias("i", "token")
        )
        # partners that this entry has to be found by have a v of at most ``reach``
        entry = entry.withColumn("reach", F.expr(f"{2 * plan.a} * (size - i) - v")).filter("low.v <= reach")
        entry = stored(entry.selectExpr("grp", "token.token", "x", "n", "v", "reach", "differ"))
        df = entry.groupBy("grp", "token").agg(F.count("*").alias("df"))
        few = entry.join(df.filter(f"df between 2 and {MANY}").select("grp", "token"), ["grp", "token"])
        one, other = (
            few.select("grp", "token", *(F.col(c).alias(f"{c}_{k}") for c in ("x", "n", "v", "reach", "differ")))
            for k in "ab"
        )
        met = one.join(other, ["grp", "token"]).filter("x_a < x_b and v_a + v_b > 0 and v_b <= reach_a and v_a <= reach_b")
        common = f"{2 * plan.a} * size(array_intersect(differ_a, differ_b))"
        links.append(stored(met.filter(f"v_a + v_b <= {common}").selectExpr("x_a as a", "x_b as b").distinct()))
        many = entry.join(df.filter(f"df > {MANY}").select("grp", "token"), ["grp", "token"])
        rows = stored(many.select(F.xxhash64("grp", "token").alias("grp"), "x", "n", "differ"))
    return links


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def similar_groups(docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that a document is linked with.

    Two documents link if their shingle sets have a Jaccard similarity of ``least``
    percent or more. A document without words, or a null text, has an empty set and only
    itself. Repeated doc_ids are separate rows; a null doc_id is never the smallest,
    unless a group has no other. Other columns are not looked at.
    """
    batches = set_batches(docs, size)

    def marks(batch: int, t: pa.Table, said: dict) -> Iterator[pa.RecordBatch]:
        at = np.arange(t.num_rows)
        yield pa.record_batch(
            [pa.array(np.full(len(at), batch)), pa.array(at), *(t.column(c).combine_chunks() for c in ("doc_id", "n", "d1", "d2"))],
            ["batch", "at", "doc_id", "n", "d1", "d2"],
        )

    marked = stored(mapped(batches, each(marks), "batch long, at long, doc_id long, n long, d1 long, d2 long"))
    some = marked.filter("n > 0")
    classes = stored(
        some.groupBy("d1", "d2").agg(
            F.min(F.struct("batch", "at")).alias("rep"), F.min("doc_id").alias("lowest"), F.first("n").alias("n")
        ).selectExpr("d1", "d2", "lowest", "n", f"{_node()} as node")
    )
    plan = _Plan(classes.agg(F.sum("n")).first()[0] or 0, least)
    links = _links(batches, classes.select("node"), plan)
    joined = components(links)
    label = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = label.groupBy("component").agg(F.min("lowest").alias("component_id"))
    found = stored(label.join(first, "component").select("d1", "d2", "component_id"))
    linked = some.join(found, ["d1", "d2"]).selectExpr("doc_id", "n as n_shingles", "component_id")
    alone = marked.filter("n = 0").selectExpr("doc_id", "n as n_shingles", "doc_id as component_id")
    return linked.unionByName(alone)


def _links(batches: DataFrame, nodes: DataFrame, plan: _Plan) -> DataFrame:
    """(a, b): links that join all classes that are linked at all, directly or by others."""

    def cells(batch: int, t: pa.Table, said: dict) -> Iterator[list]:
        x = _Classes(t, said["own"])
        found, _, counts = plan.cells(x.keys)
        counts = np.minimum(counts, 255).astype(np.uint8)
        yield [
            (k, batch, dump(np.frombuffer(dump_sorted(found[a:z]), np.uint8), counts[a:z]))
            for k, a, z in plan.cuts(found)
        ]

    own = told(batches, own=_placed(nodes)).filter("own is not null")
    met = told(own, met=ask(own, cells, _count)).filter("met is not null")
    answers = _asked(met, plan)
    cold = stored(_cold_pairs(answers))
    hot = answers.filter(F.col("bucket") >= HOT)
    members = stored(_hot_members(told(met, pivots=hot).filter("pivots is not null"), plan))
    ends = [cold.select("a"), cold.select("b"), members.select("x")]
    wanted = _union([e.toDF("node") for e in ends]).distinct()
    sets = _whole_sets(batches, wanted)
    links = _hot_links(members.join(sets.selectExpr("node as x", "n", "set as differ"), "x"), plan)

    # each class with its nearest partner
    both = cold.unionByName(cold.selectExpr("b as a", "a as b", "gap"))
    near = both.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("near")).selectExpr("a", "near.b as b")
    near = stored(near.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct())
    links = stored(_union([*links, _verified(near, sets, plan)]).distinct())

    # of the others those that no component holds
    of = stored(components(links))
    rest = cold.select("a", "b").join(near, ["a", "b"], "left_anti")
    for side in "ab":
        rest = rest.join(of.selectExpr(f"node as {side}", f"component as of_{side}"), side, "left")
    rest = rest.filter("not (coalesce(of_a, a) = coalesce(of_b, b))").select("a", "b")
    return stored(links.unionByName(_verified(rest, sets, plan)))
