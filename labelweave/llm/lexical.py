"""Ranked lexical search over impact lists, by the Best Position Algorithm.

``indexed`` writes documents once as shards of some megabytes: the terms of a shard,
and for each term the documents that hold it, with their counts. A search reads the
shards and orders the lists of the terms it asks for by impact, the part of a score
that depends on the document.

In a shard the lists of an item are read side by side from the top, each round twice
as far. Each document met is looked up in all lists of the item (direct access), which
gives its whole score and its places in the lists. Besides the places read, these
places count as seen; a list's best position is the last one with all before it seen,
often far beyond the last one read. No document unseen so far can score more than the
impacts at the best positions together, and a list seen to its end gives nothing more.
A shard is done when that sum is strictly below the kth score, so documents with equal
scores are all met and the smaller doc_id wins. A task keeps the best of its earlier
shards, so that later ones begin with their kth score; it sends at most ``k`` rows an
item, and a window over an item's rows ends the search.

Items go out in blocks of bounded size (``BLOCK_BYTES``); each block reads the shards.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import flat
from .rounds import each, mapped, opened, pack_table, packed, stored

K = 10
SHARD_BYTES = 16 << 20
#: Text of the items of a block; a longer item is a block of its own.
BLOCK_BYTES = 4 << 20
#: Places read of each list in the first round.
FIRST_READ = 4
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
INDEX = "n_docs long, n_terms long, terms binary, postings binary"
FOUND = "_item long, item_id long, doc_id long, score long"


def terms(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of texts that each end in a byte outside terms."""
    own = _TERM[raw]
    edges = np.flatnonzero(own[1:] != own[:-1]) + 1
    if len(own) and own[0]:
        edges = np.concatenate([[0], edges])
    return edges[::2], edges[1::2]


def term_column(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    data = _LOWER[raw[_TERM[raw]]]
    return pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    raw = np.frombuffer((text or "").encode() + b"\n", np.uint8)
    return term_column(raw, *terms(raw)).to_pylist()


def indexed(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Shards of documents: counts, the terms with their numbers of documents, and lists."""

    def build(batch: int, t: pa.Table, said: dict) -> Iterator[pa.RecordBatch]:
        raw, offsets = flat(t.column("text"), b"\n")
        starts, ends = terms(raw)
        first = np.searchsorted(starts, offsets)
        n = np.diff(first)
        coded = term_column(raw, starts, ends).dictionary_encode()
        doc = np.repeat(np.arange(len(n)), n)
        key = coded.indices.to_numpy().astype(np.int64) * len(n) + doc
        key, tf = np.unique(key, return_counts=True)
        df = np.bincount(key // max(1, len(n)), minlength=len(coded.dictionary))
        dictionary = pa.table({"term": coded.dictionary, "df": df.astype(np.int64)})
        listed = {
            "doc_id": t.column("doc_id").combine_chunks(),
            "n": pa.array(n),
            "doc": pa.array((key % max(1, len(n))).astype(np.int32)),
            "tf": pa.array(tf.astype(np.int32)),
        }
        one = [pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), v) for v in listed.values()]
        yield pa.record_batch(
            [
                pa.array([int((n > 0).sum())]), pa.array([len(starts)]),
                pa.array([pack_table(dictionary)]), pa.array([pack_table(pa.table(one, list(listed)))]),
            ],
            ["n_docs", "n_terms", "terms", "postings"],
        )

    rows = packed(docs.select("doc_id", "text"), limit=limit, keep=False)
    return stored(mapped(rows, each(build), INDEX))


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(item_id, terms) of the items, in blocks of about ``limit`` bytes of text."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, terms_of(row.text)))
        size += len((row.text or "").encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 75 + 75 * n.astype(np.int64) * n_docs // n_terms
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Shard:
    """The lists of some terms in a shard, by falling impact, with direct access.

    ``local`` has the place of each asked term among the shard's terms, -1 if absent.
    """

    def __init__(self, dictionary: pa.Table, postings: pa.Table, asked: pa.Array, stats: tuple) -> None:
        doc_id, n, doc, tf = (c.combine_chunks().flatten() for c in postings.columns)
        self.doc_id = pc.fill_null(doc_id, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.null = doc_id.is_null().to_numpy(zero_copy_only=False)
        self.size = len(n)
        found = pc.index_in(asked, value_set=dictionary.column("term").combine_chunks())
        self.local = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        df = dictionary.column("df").to_numpy()
        wanted = np.zeros(len(df), bool)
        wanted[self.local[self.local >= 0]] = True
        own = np.repeat(wanted, df)
        doc = doc.to_numpy()[own].astype(np.int64)
        term = np.repeat(np.arange(len(df)), df)[own]
        self.impact = impacts(tf.to_numpy()[own], n.to_numpy()[doc], *stats)
        # places by term and document, for direct access, and by term and impact, for reading
        self.key = term * self.size + doc
        self.order = np.lexsort((doc, -self.impact, term))
        self.first = np.concatenate([[0], np.cumsum(np.where(wanted, df, 0))])
        self.place = np.empty(len(doc), np.int64)
        self.place[self.order] = np.arange(len(doc))
        self.doc = doc

    def best(self, asked: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best, with their scores.

        ``asked`` are places of terms; ``weight`` is what a term's impact counts.
        ``floor`` is a score that the kth best has at least.
        """
        local = self.local[asked]
        some = (local >= 0) & (weight > 0)
        local, weight = local[some], weight[some]
        begin, end = self.first[local], self.first[local + 1]
        seen = np.zeros(int((end - begin).sum()), bool)  # places of all lists, one after another
        shift = np.concatenate([[0], np.cumsum(end - begin)])[:-1]
        length, best = end - begin, np.zeros(len(local), np.int64)
        met = np.zeros(self.size, bool)
        docs, scores = [], []
        read, upto, kth = 0, FIRST_READ, floor
        top = np.empty(0, np.int64)
        while len(local):
            a, z = np.minimum(read, length), np.minimum(upto, length)
            of = np.repeat(np.arange(len(local)), z - a)
            at = np.arange(len(of)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + a[of]
            seen[shift[of] + at] = True
            new = np.unique(self.doc[self.order[begin[of] + at]])
            new = new[~met[new]]
            met[new] = True
            # direct access to all lists
            key = (local[:, None] * self.size + new).ravel()
            hit = np.searchsorted(self.key, key)
            hit[hit == len(self.key)] = 0
            there = np.flatnonzero(self.key[hit] == key)
            hit, which = hit[there], there // max(1, len(new))
            seen[shift[which] + self.place[hit] - begin[which]] = True
            score = np.zeros(len(new), np.int64)
            np.add.at(score, there % max(1, len(new)), weight[which] * self.impact[hit])
            docs.append(new)
            scores.append(score)
            top = np.concatenate([top, score])
            if len(top) >= k:
                top = np.partition(top, len(top) - k)[-k:]
                kth = max(floor, int(top.min()))
            bound = 0
            for i in range(len(local)):
                left = seen[shift[i] + best[i] : shift[i] + length[i]]
                next_ = int(left.argmin()) if not left.all() else len(left)
                best[i] += next_
                if best[i] < length[i]:
                    bound += int(weight[i] * self.impact[self.order[begin[i] + best[i] - 1]])
            if bound < kth or (best == length).all():
                break
            read, upto = upto, 2 * upto
        if not docs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        some = (scores > 0) & (scores >= kth)
        return docs[some], scores[some]


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Equal scores are ranked by doc_id, a null one last. Repeated rows of either table
    are documents and items of their own; null and empty texts have no terms. Other
    columns are not looked at. An item without terms that a document has gets no rows.
    """
    index = indexed(docs)
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = docs.sparkSession.createDataFrame([], FOUND)
    if n_terms:
        number = 0
        for block in blocks(items):
            found = searched(index, block, (n_docs, n_terms), k)
            out = out.unionByName(found.withColumn("_item", F.col("_item") + number))
            number += len(block)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def searched(index: DataFrame, block: list, stats: tuple[int, int], k: int) -> DataFrame:
    """The best rows of every task for the items of a block; ``_item`` is the item's place."""
    number: dict[bytes, int] = {}
    for _, own in block:
        for term in own:
            number.setdefault(term, len(number))
    asked = pa.array(list(number), pa.large_binary())
    df = np.zeros(len(number), np.int64)
    for row in _document_counts(index, asked).toLocalIterator():
        df[row.term] = row.df
    weight = weights(stats[0], df)
    items = []
    for item_id, own in block:
        counts = Counter(number[t] for t in own)
        at = np.fromiter(counts, np.int64, len(counts))
        times = np.fromiter(counts.values(), np.int64, len(counts))
        items.append((item_id, at, times * weight[at]))

    sent = index.sparkSession.sparkContext.broadcast((items, asked))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, asked = sent.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(items)
        floor = np.zeros(len(items), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                tables = [opened(b.column(c)[i].as_buffer()) for c in ("terms", "postings")]
                shard = Shard(*tables, asked, stats)
                for x, (_, own, weight) in enumerate(items):
                    docs, scores = shard.best(own, weight, k, int(floor[x]))
                    if not len(docs):
                        continue
                    new = (scores, shard.doc_id[docs], shard.null[docs])
                    score, doc_id, null = (np.concatenate(c) for c in zip(best[x], new))
                    first = np.lexsort((doc_id, null, -score))[:k]
                    best[x] = score[first], doc_id[first], null[first]
                    if len(first) == k:
                        floor[x] = best[x][0][-1]
        counts = [len(s) for s, _, _ in best]
        if not sum(counts):
            return
        of = np.repeat(np.arange(len(items)), counts)
        score, doc_id, null = (np.concatenate(c) for c in zip(*best))
        ids = pa.array([item_id for item_id, _, _ in items], pa.int64()).take(pa.array(of))
        yield pa.record_batch(
            [pa.array(of), ids, pa.array(doc_id, mask=null), pa.array(score)],
            ["_item", "item_id", "doc_id", "score"],
        )

    return mapped(index.select("terms", "postings"), run, FOUND)


def _document_counts(index: DataFrame, asked: pa.Array) -> DataFrame:
    """(term, df): in how many documents of all shards an asked term, given by its place, is."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for payload in b.column("terms"):
                t = opened(payload.as_buffer())
                found = pc.index_in(sent.value, value_set=t.column("term").combine_chunks())
                at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
                own = np.flatnonzero(at >= 0)
                total[own] += t.column("df").to_numpy()[at[own]]
        own = np.flatnonzero(total)
        yield pa.record_batch([pa.array(own), pa.array(total[own])], ["term", "df"])

    counted = mapped(index.select("terms"), run, "term long, df long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))
