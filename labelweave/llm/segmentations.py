"""Sampled SentencePiece segmentations without replacement, by Gumbel top-k.

The pieces of a public model span a lattice over a text. A segmentation's probability
is the product of its pieces' weights, 1 / (rank + 2) by the model's order of merges,
over the sum for all segmentations; sums over what follows a place give each edge its
exact probability, which is a perfect bound for a best-first search. The search works
on sets of segmentations: a set's perturbed value, a Gumbel variable at the logarithm
of its probability, is the largest among its members. It takes the set with the largest
value, walks down to the member that holds it, and splits the rest into the sets that
leave the walk at each edge, whose values are drawn below the one taken. The first k
walks are k different segmentations, a sample without replacement. The value of the
best set that is left is the threshold: a segmentation is included with probability
1 - exp(-exp(log_prob - threshold)), the inclusion score, given the threshold.

Draws depend on the seed, doc_id and the place in the text only, so reruns agree
however the rows are dealt. Pieces never cross a blank's left side, as in the model but
for its 14 pieces of several blanks, which are not used. A character without a piece is
spelled in byte pieces. Whole texts are segmented, of any length; lattices are built
once per distinct word and kept by the worker.

An empty or null text has one segmentation, without pieces. A text with fewer than k
has them all, with inclusion 1. Rows with the same doc_id and text have the same
samples.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .kernels import U64, mix, runs
from .rounds import mapped

#: Words whose lattices a worker keeps.
KEPT_WORDS = 150_000
SLICE_BYTES = 1 << 20
BLANK = "▁"
#: A private character that parts words; a text that holds it is cut one by one.
_CUT = "\ue000"
_BASE = U64(0x9E3779B97F4A7C15)
_SLOT = U64(0xD6E8FEB86659FD93)
_TABLE_BITS = 18
#: Sums over many rows at once are taken in integers, so that they don't depend on the
#: rows before.
_FIXED = 2.0**32


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: str) -> None:
        self.data, self.size = np.empty(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.empty(max(need, len(self.data)) - len(self.data) + len(self.data) // 2, self.data.dtype)])
        self.data[self.size : need] = values
        self.size = need


class Lattice:
    """Lattices of words: nodes with edges of rising cumulative probability."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int], byte_weight: float) -> None:
        """``pieces``: (piece, id, log weight). ``byte_ids``: the ids of the 256 bytes."""
        self.byte_ids, self.byte_weight = np.array(byte_ids), byte_weight
        self.vocabulary = max([i for _, i, _ in pieces] + byte_ids) + 1
        table: dict[int, tuple[int, float]] = {}
        for piece, number, weight in pieces:
            h = 0
            for c in piece:
                h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
                table.setdefault(h, (-1, 0.0))
            table[h] = (number, weight)
        self.longest = max((len(p) for p, _, _ in pieces), default=1)
        size = 1 << _TABLE_BITS
        self.keys, self.ids, self.weights = np.zeros(size, U64), np.full(size, -1), np.zeros(size)
        for h, (number, weight) in table.items():
            slot = (h * int(_SLOT) & (1 << 64) - 1) >> 64 - _TABLE_BITS
            while self.keys[slot]:
                slot = (slot + 1) % size
            self.keys[slot], self.ids[slot], self.weights[slot] = h, number, weight
        self._texts(pieces)
        self.spelled: dict[str, int] = {}
        self.spelling: list[np.ndarray] = []
        self.forget()

    @classmethod
    def of_model(cls, path: str) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [
            i for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        texts = [model.id_to_piece(i) for i in plain]
        rank = np.argsort(np.argsort([-model.get_score(i) for i in plain], kind="stable"), kind="stable")
        total = np.log((1 / (np.arange(size) + 2)).sum())
        weights = -np.log(rank + 2.0) - total
        usable = [(t, i, w) for t, i, w in zip(texts, plain, weights.tolist()) if BLANK not in t[1:]]
        return cls(usable, byte_ids, float(-np.log(size + 2.0) - total))

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.start, self.chars, self.mass = _Grown("i4"), _Grown("i4"), _Grown("f8")
        self.first, self.at = _Grown("i4"), _Grown("i4")
        self.cum, self.log, self.to, self.id = _Grown("f4"), _Grown("f4"), _Grown("i4"), _Grown("i4")
        self.first.add(np.zeros(1, np.int32))

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words, of which new ones get their lattices now."""
        if len(self.words) > KEPT_WORDS:
            self.forget()
        known = self.words
        new = list(set(words).difference(known))
        known.update(zip(new, range(len(known), len(known) + len(new))))
        for i in range(0, len(new), 20_000):
            self._build(new[i : i + 20_000])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes, -1 where there is none."""
        slot = ((h * _SLOT) >> U64(64 - _TABLE_BITS)).astype(np.int64)
        out = np.full(len(h), -1)
        open_ = np.arange(len(h))
        while len(open_):
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (key != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << _TABLE_BITS) - 1)
        return out

    def _build(self, words: list[str]) -> None:
        """Nodes stand by their distance from the end, so that sums run in one sweep."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        word, at = runs(size)
        left = size[word] - at  # distance to the end
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 65536 else left, kind="stable")
        node = np.empty(len(order), np.int64)
        node[order] = np.arange(len(order))
        found: list[tuple[np.ndarray, ...]] = []
        count = np.zeros(len(chars), np.int64)
        live, h = np.arange(len(chars)), np.zeros(len(chars), U64)
        whole = np.zeros(len(chars), bool)
        for n in range(1, self.longest + 1):
            keep = left[live] >= n
            live, h = live[keep], h[keep]
            h = h * _BASE + (chars[live + n - 1].astype(U64) + U64(1))
            slot = self._find(h)
            keep = slot >= 0
            live, h, slot = live[keep], h[keep], slot[keep]
            piece = self.ids[slot] >= 0
            where = live[piece]
            if n == 1:
                whole[where] = True
            found.append((where, np.full(len(where), n), self.ids[slot[piece]], self.weights[slot[piece]], count[where]))
            count[where] += 1
            if not len(live):
                break
        bare = np.flatnonzero(~whole)
        if len(bare):
            ids, weights = zip(*(self._bytes(chr(c)) for c in chars[bare].tolist()))
            found.append((bare, np.ones(len(bare), np.int64), np.array(ids), np.array(weights), count[bare]))
            count[bare] += 1
        total = int(count.sum())
        sizes = count[order]
        ends = np.cumsum(sizes)
        first = ends - sizes  # first edge of each node
        source, to, number, weight = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total)
        for where, n, ids, weights, place in found:
            e = first[node[where]] + place
            source[e], number[e], weight[e] = node[where], ids, weights
            after = where + n
            to[e] = np.where(left[where] == n, -1, node[np.minimum(after, len(node) - 1)])
        # sums over all that follows, nearest to the end first
        follow = np.zeros(len(node) + 1)  # the last entry is the end
        bounds = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        for a, z in zip(bounds[:-1], bounds[1:]):
            if z > a:
                e0, e1 = first[a], ends[z - 1]
                value = weight[e0:e1] + follow[to[e0:e1]]
                cuts = first[a:z] - e0
                top = np.maximum.reduceat(value, cuts)
                follow[a:z] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, sizes[a:z])), cuts))
        log = weight + follow[to] - follow[source]
        p = np.exp(log)
        exact = np.rint(p * _FIXED).astype(np.int64)
        sums = np.cumsum(exact)
        cum = (sums - np.repeat(sums[first] - exact[first], sizes)) / _FIXED
        cum[ends - 1] = 2.0  # the last edge takes what rounding leaves
        base, edges = self.at.size, self.cum.size
        self.mass.add(follow[node[np.cumsum(size) - size]])
        self.start.add(base + node[np.cumsum(size) - size])
        self.chars.add(size)
        self.at.add(at[order])
        self.first.add(edges + ends)
        for grown, values in ((self.cum, cum), (self.log, log), (self.to, np.where(to < 0, -1, to + base)), (self.id, number)):
            grown.add(values)

    def _bytes(self, char: str) -> tuple[int, float]:
        """Id and weight of a character that is spelled in bytes."""
        raw = char.encode("utf-8", "surrogatepass")
        if len(raw) == 1:
            return int(self.byte_ids[raw[0]]), self.byte_weight
        if char not in self.spelled:
            self.spelled[char] = len(self.spelling)
            self.spelling.append(self.byte_ids[np.frombuffer(raw, np.uint8)])
        return self.vocabulary + self.spelled[char], self.byte_weight * len(raw)

    def _texts(self, pieces: list[tuple[str, int, float]]) -> None:
        """Bytes of all pieces by id, with blanks for their marks."""
        raw = [b""] * self.vocabulary
        for b, number in enumerate(self.byte_ids.tolist()):
            raw[number] = bytes([b])
        for piece, number, _ in pieces:
            raw[number] = piece.replace(BLANK, " ").encode()
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of ids, and their bounds; each begins with the model's own blank."""
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], size)]
        return data, ends[bounds]

    def sums(self, edges: np.ndarray) -> np.ndarray:
        """Sums of the logarithms before each step, as integers."""
        logs = np.rint(self.log.data[edges].astype(np.float64) * _FIXED).astype(np.int64)
        return np.concatenate([[0], np.cumsum(logs)])

    def piece_ids(self, edges: np.ndarray) -> np.ndarray:
        """Ids of a row of edges, spelled ones included."""
        ids = self.id.data[edges]
        odd = np.flatnonzero(ids >= self.vocabulary)
        if not len(odd):
            return ids
        parts, last = [], 0
        for i in odd.tolist():
            parts += [ids[last:i], self.spelling[ids[i] - self.vocabulary]]
            last = i + 1
        return np.concatenate([*parts, ids[last:]])


def words_of(text: str) -> list[str]:
    """Words of a text, each with the blank before it; line breaks stand alone."""
    marked = BLANK + text.replace(" ", BLANK)
    if _CUT not in marked:
        marked = marked.replace(BLANK, _CUT + BLANK).replace("\n", f"{_CUT}\n{_CUT}")
        return [w for w in marked.split(_CUT) if w]
    out, word = [], ""
    for c in marked:
        if c in (BLANK, "\n") or word == "\n":
            out.append(word)
            word = ""
        word += c
    return [w for w in [*out, word] if w]


def _uniform(key: np.ndarray, *counters: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key and the counters."""
    h = key.copy()
    for c in counters:
        h += np.atleast_1d(c).astype(U64) * _BASE + U64(1)
        mix(h)
    return ((h >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


@dataclass
class _Paths:
    """One path per document: edges, nodes and words of all its steps, document by document."""

    edges: np.ndarray
    nodes: np.ndarray
    at: np.ndarray
    bounds: np.ndarray
    #: Step of the branch of each path; the steps up to it belong to older sets.
    branch: np.ndarray | None = None


class Sampler:
    """The search, for a slice of documents at once."""

    def __init__(self, lattice: Lattice, texts: list[str], keys: np.ndarray, k: int) -> None:
        self.lattice, self.k, self.keys = lattice, k, keys
        split = [words_of(t) if t else [] for t in texts]
        self.n_words = np.fromiter(map(len, split), np.int64, len(split))
        self.word = lattice.numbers([w for own in split for w in own])
        self.first_word = np.concatenate([[0], np.cumsum(self.n_words)])
        chars = np.cumsum(lattice.chars.data[self.word])
        self.before = chars - lattice.chars.data[self.word]  # characters of the text before each word
        self.before -= np.repeat(self.before[self.first_word[:-1][self.n_words > 0]], self.n_words[self.n_words > 0])

    def walk(self, words: np.ndarray, nodes: np.ndarray, keys: np.ndarray, draw: int) -> tuple[np.ndarray, ...]:
        """(edges, nodes, word index, steps per row) of walks from nodes to the words' ends."""
        x = self.lattice
        first, at, cum, to = x.first.data, x.at.data, x.cum.data, x.to.data
        n, steps = len(words), []
        row = np.flatnonzero(nodes >= 0)
        node = nodes[row]
        counts = np.zeros(n, np.int64)
        while len(row):
            u = _uniform(keys[row], 2 * draw, self.before[words[row]] + at[node])
            e = first[node].astype(np.int64)
            more = np.flatnonzero(u > cum[e])
            while len(more):
                e[more] += 1
                more = more[u[more] > cum[e[more]]]
            steps.append((row, node, e))
            counts[row] += 1
            node = to[e]
            on = node >= 0
            row, node = row[on], node[on]
        start = np.cumsum(counts) - counts
        edges, path = np.empty(int(counts.sum()), np.int64), np.empty(int(counts.sum()), np.int64)
        for i, (row, node, e) in enumerate(steps):
            place = start[row] + i
            edges[place], path[place] = e, node
        return edges, path, np.repeat(words, counts), counts

    def run(self) -> list[dict[str, np.ndarray]]:
        """Per sample: the documents that have it, their paths, log_prob and value."""
        x, k, docs = self.lattice, self.k, np.flatnonzero(self.n_words)
        of, _ = runs(self.n_words[docs])
        edges, nodes, at, counts = self.walk(np.arange(len(self.word)), x.start.data[self.word].astype(np.int64), self.keys[docs][of], 0)
        per_doc = np.add.reduceat(counts, self.first_word[docs]) if len(docs) else counts
        path = _Paths(edges, nodes, at, np.concatenate([[0], np.cumsum(per_doc)]))
        value = -np.log(-np.log(_uniform(self.keys[docs], 1, 0, 9)))
        n = len(docs)
        # sets that are left: value, path and step where they leave, edges of that node that are taken
        width = k * (k + 1)
        left = np.full((n, width), -np.inf)
        where = np.zeros((n, width, 2), np.int64)
        taken = np.full((n, width, k + 1), -1)
        paths, out = [], []
        rows = np.arange(n)
        for draw in range(k):
            paths.append((rows, path))
            sums = x.sums(path.edges)
            log_prob = (sums[path.bounds[1:]] - sums[path.bounds[:-1]]) / _FIXED
            out.append({"rows": docs[rows], "path": path, "log_prob": log_prob, "value": value})
            self._leave(draw, rows, path, sums, value, left, where, taken)
            if draw == k - 1 or not n:
                break
            slot = left.argmax(1)
            value = left[np.arange(n), slot]
            rows = np.flatnonzero(value > -np.inf)
            slot, value = slot[rows], value[rows]
            path = self._branch(draw + 1, docs, rows, slot, value, paths, left, where, taken)
        threshold = np.full(len(self.n_words), -np.inf)
        threshold[docs] = left.max(1) if n else 0
        for o in out:
            o["inclusion"] = -np.expm1(-np.exp(np.minimum(o["log_prob"] - threshold[o["rows"]], 50.0)))
        return out

    def _leave(self, draw, rows, path, sums, value, left, where, taken) -> None:
        """Add the best sets that leave a path (after its branch) to those that are left."""
        x = self.lattice
        n = np.diff(path.bounds)
        of, step = runs(n)
        p = np.exp(x.log.data[path.edges].astype(np.float64))
        only = x.first.data[path.nodes + 1] - x.first.data[path.nodes] == 1
        rest = np.where(only, -np.inf, np.log(np.maximum(1 - p, 1e-12)))
        before = (sums[:-1] - sums[path.bounds[:-1]][of]) / _FIXED
        place = self.before[path.at] + x.at.data[path.nodes]
        u = _uniform(self.keys_of(rows)[of], 2 * draw + 1, place)
        score = before + rest - np.log(-np.log(u))
        if path.branch is not None:
            score[step <= path.branch[of]] = -np.inf
        full = n > 0
        starts = path.bounds[:-1][full]
        for i in range(self.k):
            slot = draw * (self.k + 1) + i
            if slot >= left.shape[1] or not len(starts):
                break
            top = np.full(len(n), -np.inf)
            top[full] = np.maximum.reduceat(score, starts)
            hit = np.flatnonzero((score == top[of]) & (score > -np.inf))
            hit = hit[np.unique(of[hit], return_index=True)[1]]
            doc = of[hit]
            left[rows[doc], slot] = -np.logaddexp(-value[doc], -score[hit])
            where[rows[doc], slot, 0], where[rows[doc], slot, 1] = draw, step[hit]
            taken[rows[doc], slot, 0] = path.edges[hit]
            score[hit] = -np.inf

    def keys_of(self, rows: np.ndarray) -> np.ndarray:
        return self.keys[np.flatnonzero(self.n_words)][rows]

    def _branch(self, draw, docs, rows, slot, value, paths, left, where, taken) -> _Paths:
        """Walk down from the sets that were taken; what is left of them stays as sets."""
        x = self.lattice
        parent, step = where[rows, slot, 0], where[rows, slot, 1]
        begin = np.empty(len(rows), np.int64)  # first step of the parent's path
        node, word = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        heads: list[np.ndarray | None] = [None] * len(rows)
        base = np.empty(len(rows))
        for j, (owners, path) in enumerate(paths):
            mine = np.flatnonzero(parent == j)
            if not len(mine):
                continue
            own = np.searchsorted(owners, rows[mine])
            begin[mine] = path.bounds[own]
            at = begin[mine] + step[mine]
            node[mine], word[mine] = path.nodes[at], path.at[at]
            sums = x.sums(path.edges)
            base[mine] = (sums[at] - sums[begin[mine]]) / _FIXED
            for m, a, z in zip(mine.tolist(), begin[mine].tolist(), at.tolist()):
                heads[m] = slice(a, z)
        gone = taken[rows, slot]
        chosen, rest = self._sibling(rows, node, word, gone, draw)
        n_gone = (gone >= 0).sum(1)
        taken[rows, slot, n_gone] = chosen
        u = _uniform(self.keys_of(rows), 2 * draw + 1, 0, 7)
        fresh = base + rest - np.log(-np.log(u))
        left[rows, slot] = np.where(rest > -np.inf, -np.logaddexp(-value, -fresh), -np.inf)
        # the rest of the branch's word, then all later words
        last = self.first_word[docs[rows] + 1]
        of, i = runs(last - word)
        words = word[of] + i
        start = np.where(i == 0, x.to.data[chosen][of], x.start.data[self.word[words]])
        edges, nodes, at, counts = self.walk(words, start.astype(np.int64), self.keys_of(rows)[of], draw)
        tails = np.bincount(of, counts, len(rows)).astype(np.int64)
        ends = np.cumsum(tails)
        parts: tuple[list, list, list] = ([], [], [])
        for m, (j, head) in enumerate(zip(parent.tolist(), heads)):
            old, a, z = paths[j][1], ends[m] - tails[m], ends[m]
            for to, was, mid, new in zip(parts, (old.edges, old.nodes, old.at), (chosen, node, word), (edges, nodes, at)):
                to += [was[head], mid[m : m + 1], new[a:z]]
        sizes = step + 1 + tails
        joined = [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]
        return _Paths(*joined, np.concatenate([[0], np.cumsum(sizes)]), step)

    def _sibling(self, rows, node, word, gone, draw) -> tuple[np.ndarray, np.ndarray]:
        """One of a node's edges that are not taken, and the logarithm of what is left then."""
        x = self.lattice
        first, end = x.first.data[node].astype(np.int64), x.first.data[node + 1]
        of, i = runs(end - first)
        e = first[of] + i
        free = ~(gone[of] == e[:, None]).any(1)
        p = np.where(free, np.exp(x.log.data[e].astype(np.float64)), 0.0)
        u = _uniform(self.keys_of(rows)[of], 2 * draw, self.before[word][of] + x.at.data[node][of], e - first[of])
        # the largest of exponential races picks by probability
        with np.errstate(divide="ignore"):
            race = np.where(free, np.log(p) - np.log(-np.log(u)), -np.inf)
        starts = np.cumsum(end - first) - (end - first)
        best = np.maximum.reduceat(race, starts)
        hit = np.flatnonzero(race == best[of])
        hit = hit[np.unique(of[hit], return_index=True)[1]]
        chosen = e[hit]
        p[hit] = 0
        some = np.add.reduceat(free, starts, dtype=np.int64) > 1
        total = np.add.reduceat(p, starts)
        with np.errstate(divide="ignore"):
            return chosen, np.where(some, np.log(total), -np.inf)


_LATTICES: dict[str, Lattice] = {}


def _lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice.of_model(path)
    return _LATTICES[path]


def row_keys(ids: list, seed: int) -> np.ndarray:
    values = np.array([0 if i is None else i for i in ids], np.int64).view(U64)
    return mix(values * _SLOT + U64(seed & (1 << 63) - 1))


_ROWS = (
    "doc_id long, sample int, n_pieces int, log_prob double, perturbed double,"
    " inclusion double, round_trip boolean, ids binary"
)


def segmentations(docs: DataFrame, model: str, k: int = 2, seed: int = 42) -> DataFrame:
    """k rows per document: its doc_id, the sample's number, n_pieces, log_prob, the
    perturbed value, the inclusion score, round_trip and ids.

    ``ids`` are the piece ids as little-endian 16-bit integers, or 32-bit ones for a model
    with more pieces; ``round_trip`` says that they decode to the text itself, which fails
    only where a text holds the model's own mark for a blank.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for b in batches:
            texts = pc.fill_null(b.column("text"), "").cast(pa.binary()).to_pylist()
            size = np.cumsum([len(t) for t in texts])
            cuts = np.searchsorted(size, np.arange(SLICE_BYTES, int(size[-1]) if texts else 0, SLICE_BYTES))
            cuts = [0, *np.unique(cuts).tolist(), len(texts)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z > a:
                    yield _rows(lattice, b.column("doc_id").slice(a, z - a), texts[a:z], k, seed)

    return mapped(docs.select("doc_id", "text"), run, _ROWS)


def _id_kind(lattice: Lattice) -> str:
    return "<u2" if lattice.vocabulary <= 1 << 16 else "<u4"


def _rows(lattice: Lattice, ids: pa.Array, texts: list[bytes], k: int, seed: int) -> pa.RecordBatch:
    keys = row_keys(ids.to_pylist(), seed)
    found = Sampler(lattice, [t.decode("utf-8", "replace") for t in texts], keys, k).run()
    empty = np.array([i for i, t in enumerate(texts) if not t], np.int64)
    zero = np.zeros(len(empty))
    columns = [(empty, np.ones(len(empty), np.int32), zero, zero, zero + 1)]
    pieces, sizes, trips = [b""] * len(empty), [np.zeros(len(empty), np.int32)], [True] * len(empty)
    kind = _id_kind(lattice)
    for i, o in enumerate(found):
        rows, path = o["rows"], o["path"]
        flat = lattice.piece_ids(path.edges)
        more = np.where(lattice.id.data[path.edges] < lattice.vocabulary, 1, 0)
        odd = np.flatnonzero(more == 0)
        more[odd] = [len(lattice.spelling[n - lattice.vocabulary]) for n in lattice.id.data[path.edges[odd]]]
        bounds = np.concatenate([[0], np.cumsum(more)])[path.bounds]
        data, ends = lattice.decode(flat, bounds)
        packed = flat.astype(kind)
        for row, a, z, b, e in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            pieces.append(packed[a:z].tobytes())
            trips.append(data[b + 1 : e].tobytes() == texts[row])
        sizes.append(np.diff(bounds).astype(np.int32))
        columns.append((rows, np.full(len(rows), i + 1, np.int32), o["log_prob"], o["value"], o["inclusion"]))
    rows, sample, *scores = (np.concatenate(x) for x in zip(*columns))
    return pa.record_batch(
        [ids.take(pa.array(rows)), pa.array(sample), pa.array(np.concatenate(sizes)), *map(pa.array, scores),
         pa.array(trips, pa.bool_()), pa.array(pieces, pa.binary())],
        ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip", "ids"],
    )


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, sample, text) of rows with ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for b in batches:
            parts = [np.frombuffer(i, _id_kind(lattice)) for i in b.column("ids").to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            data, ends = lattice.decode(np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64), bounds)
            text = [data[min(a + 1, z) : z].tobytes() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("sample"), pa.array(text, pa.binary()).cast(pa.string())],
                ["doc_id", "sample", "text"],
            )

    return rows.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")
