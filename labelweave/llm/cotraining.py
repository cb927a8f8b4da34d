"""Quality classifier by co-training a text view and a page view.

The text view reads the text: shares of letters, capitals, digits and of each mark,
shares of hashed words and of hashed stretches of three bytes, word lengths, words that
come again at once, size, number and length of lines. The page view sees what is known
of the page without reading it: language and source. Each is a ridge logistic
regression. In each round either view names the pages of an unlabelled pool of which it
is surest, in the proportion of the classes, and the other view learns from them. How
sure a view has to be is read off the labelled pages, each judged by a fit without its
fifth of them: where it is not right in ``SURE`` of the cases, it names none. At the end
the logits of both views, of such fits again, are combined and calibrated on the labels.

The fit reads a bounded sample, drawn by a hash of doc_id: at most ``LABELLED``
labelled and ``POOL`` unlabelled documents, whatever the size of the corpus; of rows
with one doc_id it takes one. Every
document is scored, in one pass over its whole text.

Defined results: a null or empty text is scored by its page view and zeros; a null
language or source is a value of its own; labels of one doc_id are averaged, null labels
ignored. Without two classes among the labels there is no model: probabilities are
null and every document is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U64, flat, mix, slices, word_names, words
from .rounds import mapped, numbered, release

LABELLED = 12_288
POOL = 12_288
ROUNDS = 4
#: Share of the pool that a view names per round, and how sure it must be.
NAMED = 0.05
SURE = 0.95
#: Labelled documents that a view has to be right about before it names any.
PROVEN = 20
#: Labelled documents are judged by fits without their part of so many.
FOLDS = 5
THRESHOLD = 0.5
#: Rows that a fit holds at once in double precision.
ROWS = 1024
LANGS, SOURCES = 8, 32
#: Cells of hashed words and of hashed stretches of three bytes.
WORD_CELLS, GRAM_CELLS = 64, 64

_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASSES = np.zeros(256, np.int64)
for _i, _c in enumerate(_MARKS):
    _CLASSES[_c] = 8 + _i
_CLASSES[ord("a") : ord("z") + 1] = 1
_CLASSES[ord("A") : ord("Z") + 1] = 2
_CLASSES[ord("0") : ord("9") + 1] = 3
_CLASSES[[9, 11, 12, 13, 32]] = 4
_CLASSES[10] = 5
_CLASSES[128:192] = 6
_CLASSES[192:] = 7
N_CLASSES = 8 + len(_MARKS)
TEXT_WIDTH = N_CLASSES + WORD_CELLS + GRAM_CELLS + 8


def features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text and page features of each document."""
    raw, offsets = flat(b.column(b.schema.get_field_index("text")), b"\n")
    text = [np.empty((0, TEXT_WIDTH))]
    for i, j in slices(offsets):
        part, bounds = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        size = np.diff(bounds)
        byte_doc = np.repeat(np.arange(j - i), size)

        def shares(doc: np.ndarray, cell: np.ndarray, cells: int, n: np.ndarray, count=j - i) -> np.ndarray:
            seen = np.bincount(doc * cells + cell, minlength=count * cells).reshape(count, cells)
            return np.log1p(100 * seen / np.maximum(n, 1)[:, None])

        letters = np.delete(part, bounds[1:] - 1), np.delete(byte_doc, bounds[1:] - 1)
        lines = 1 + np.bincount(letters[1], letters[0] == 10, j - i)
        starts, ends = words(part)
        named = word_names(part, starts, ends)
        doc = np.searchsorted(bounds, starts, "right") - 1
        n_words = np.bincount(doc, minlength=j - i)
        wide = part.astype(np.uint64)
        gram = wide[:-2] | wide[1:-1] << U64(8) | wide[2:] << U64(16)

        def per_word(values: np.ndarray, doc=doc, n=np.maximum(n_words, 1), count=j - i) -> np.ndarray:
            return np.bincount(doc, values, count) / n

        length = (ends - starts).astype(float)
        again = []
        for lag in (1, 2, 5):
            same = np.zeros(len(named))
            same[lag:] = (named[lag:] == named[:-lag]) & (doc[lag:] == doc[:-lag])
            again.append(per_word(same))
        mean = per_word(length)
        spread = np.sqrt(np.maximum(per_word(length * length) - mean * mean, 0))
        layout = np.log1p(size - 1), np.log1p(lines), np.log1p((size - 1) / lines)
        text.append(np.column_stack([
            shares(letters[1], _CLASSES[letters[0]], N_CLASSES, size - 1),
            shares(doc, (named >> U64(40)).astype(np.int64) % WORD_CELLS, WORD_CELLS, n_words),
            shares(byte_doc[: len(gram)], (mix(gram) >> U64(40)).astype(np.int64) % GRAM_CELLS, GRAM_CELLS, size),
            mean, spread, *again, *layout,
        ]))
    kinds = [_one_hot(b.column(b.schema.get_field_index(c)), k) for c, k in (("lang", LANGS), ("source", SOURCES))]
    return np.concatenate(text), np.column_stack(kinds)


def _one_hot(column: pa.Array, size: int) -> np.ndarray:
    coded = pc.dictionary_encode(column, null_encoding="encode")
    values = [None if v is None else str(v) for v in coded.dictionary.to_pylist()]
    place = np.array([size - 1 if v is None else zlib.crc32(v.encode()) % (size - 1) for v in values], int)
    out = np.zeros((len(column), size))
    if len(column):
        out[np.arange(len(column)), place[coded.indices.to_numpy()]] = 1
    return out


@dataclass
class View:
    """A ridge logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, parts: list[np.ndarray], y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> View:
        """Newton steps from sums over some rows of the parts at a time."""
        mean = sum(b.sum(0) for b in _blocks(parts)) / len(y)
        scale = np.sqrt(sum(((b - mean) ** 2).sum(0) for b in _blocks(parts)) / len(y))
        scale[scale < 1e-9] = 1
        w = np.zeros(len(mean) + 1)
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            slope, curve, at = penalty * w, np.diag(penalty), 0
            for b in _blocks(parts):
                z = np.column_stack([np.ones(len(b)), (b - mean) / scale])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                slope += z.T @ (p - y[at : at + len(b)])
                curve += (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
                at += len(b)
            step = np.linalg.solve(curve, slope)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [((b - self.mean) / self.scale) @ self.weights[1:] + self.weights[0] for b in _blocks([x])]
        return np.clip(np.concatenate([np.empty(0), *out]), -30, 30)


def _blocks(parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Some rows at a time, in double precision."""
    for x in parts:
        for a in range(0, len(x), ROWS):
            yield x[a : a + ROWS].astype(float)


def _probability(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logits))


@dataclass
class CoTrained:
    text: View
    page: View
    both: View

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, ...]:
        """Probability of good quality by text, by page, and by both, calibrated."""
        a, b = self.text.logits(text), self.page.logits(page)
        return _probability(a), _probability(b), _probability(self.both.logits(np.column_stack([a, b])))


def co_train(
    text: np.ndarray, page: np.ndarray, y: np.ndarray, pool: tuple[np.ndarray, np.ndarray],
    rounds: int = ROUNDS,
) -> CoTrained:
    """Fit both views on labelled rows and a pool without labels."""
    data = (text, page)
    own, labels = [[x] for x in data], [[y] for _ in data]
    open_ = np.ones(len(pool[0]), bool)
    share = y.mean()
    for _ in range(rounds):
        views = [View.fit(x, np.concatenate(l)) for x, l in zip(own, labels)]
        named = []
        for view, x, seen, l in zip(views, pool, own, labels):
            p, judged = _probability(view.logits(x)), _probability(_judged(seen, l))
            n = NAMED * open_.sum()
            for value, sure, said, part in ((1, p, judged, share), (0, 1 - p, 1 - judged, 1 - share)):
                some = np.flatnonzero(open_ & (sure >= _least_sure(said, y == value)))
                best = some[np.argsort(-sure[some], kind="stable")[: int(np.ceil(n * part))]]
                named.append((value, best))
        for other, (value, best) in zip((1, 1, 0, 0), named):
            own[other].append(pool[other][best])
            labels[other].append(np.full(len(best), value))
        taken = np.concatenate([best for _, best in named])
        if not len(taken):
            break
        open_[taken] = False
    views = [View.fit(x, np.concatenate(l)) for x, l in zip(own, labels)]
    logits = np.column_stack([_judged(x, l) for x, l in zip(own, labels)])
    return CoTrained(*views, View.fit([logits], y, ridge=1.0))


def _judged(own: list[np.ndarray], labels: list[np.ndarray]) -> np.ndarray:
    """Logits of the labelled rows, the first of ``own``, by fits that have not seen them."""
    x, y = own[0], labels[0]
    out = np.zeros(len(y))
    for fold in range(FOLDS):
        held = np.arange(len(y)) % FOLDS == fold
        rest = np.concatenate([y[~held], *labels[1:]])
        if held.any() and len(np.unique(rest)) == 2:
            out[held] = View.fit([x[~held], *own[1:]], rest).logits(x[held])
    return out


def _least_sure(said: np.ndarray, right: np.ndarray) -> float:
    """How sure a view has to be of a class to be right in ``SURE`` of the labelled rows."""
    order = np.argsort(-said, kind="stable")
    rate = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    some = np.flatnonzero((rate >= SURE) & (np.arange(len(order)) >= PROVEN - 1) & (said[order] > 0.5))
    return max(SURE, float(said[order][some[-1]])) if len(some) else np.inf


_COLUMNS = ("doc_id", "text", "lang", "source")


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality",
    labelled: int = LABELLED, pool: int = POOL, seed: int = 42,
) -> CoTrained | None:
    """The model, from a bounded sample; None without two classes."""
    hashed = F.xxhash64(F.col("doc_id"), F.lit(seed))
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    )
    docs = docs.select(*_COLUMNS)
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text", "lang", "source")).alias("_h"))
    with_label = ids.join(known, "doc_id").orderBy(hashed, "doc_id").limit(labelled)
    without = ids.join(known, "doc_id", "left_anti").orderBy(hashed, "doc_id").limit(pool)
    # at most labelled + pool rows of three numbers; one row is measured of each
    drawn = F.broadcast(with_label.unionByName(without.withColumn("_y", F.lit(-1))))
    sample = docs.withColumn("_h", F.xxhash64("text", "lang", "source")).join(drawn, ["doc_id", "_h"])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, page = features(b)
            both = np.column_stack([text, page]).astype(np.float32)
            yield pa.record_batch(
                [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "_y")]
                + [pa.array([r.tobytes() for r in both], pa.binary())],
                ["doc_id", "y", "x"],
            )

    measured = mapped(sample, measure, "doc_id long, y int, x binary")
    # the features stay in the buffers they come in; a fit reads some rows of them at a time
    rows = measured.groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow().combine_chunks()
    y, ids = rows["y"].to_numpy(), rows["doc_id"].to_numpy()
    if not {0, 1} <= set(y.tolist()):
        return None
    # labelled rows in an order that has nothing to do with their id
    order = np.lexsort((ids, y))
    order = order[np.argsort([zlib.crc32(str(i).encode()) for i in ids[order].tolist()], kind="stable")]
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(len(y), -1)
    del rows
    known, other = order[y[order] >= 0], order[y[order] < 0]
    page = x[:, TEXT_WIDTH:]
    model = co_train(x[known, :TEXT_WIDTH], page[known], y[known], (x[other, :TEXT_WIDTH], page[other]))
    del x, page
    release()
    return model


def scored(docs: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents and p_text, p_page, p_quality and keep.

    A column that already has one of these names is replaced.
    """
    names = ["p_text", "p_page", "p_quality", "keep"]
    docs = docs.drop(*names)
    columns = docs.columns
    kinds = [T.DoubleType()] * 3 + [T.BooleanType()]
    new = [T.StructField(n, kind) for n, kind in zip(names, kinds)]
    schema = T.StructType([*docs.schema.fields, *new])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.rename_columns(columns)
            if model is None:
                p = [pa.nulls(b.num_rows, pa.float64())] * 3
                keep = pa.array(np.ones(b.num_rows, bool))
            else:
                p = model.score(*features(b))
                keep = pa.array(p[2] >= threshold)
                p = [pa.array(x) for x in p]
            yield pa.record_batch([*b.columns, *p, keep], [*b.schema.names, *names])

    return mapped(numbered(docs), run, schema)


def good_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their own columns only, that the classifier keeps."""
    model = fit(docs, labels, label)
    if model is None:
        return docs
    columns = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = model.score(*features(b.rename_columns(columns)))[2] >= threshold
            yield b.filter(pa.array(keep)).rename_columns(columns)

    return mapped(numbered(docs), run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Fit on the labels and score every document."""
    return scored(docs, fit(docs, labels, label))
