"""Token ids in files: frequency-ranked ids, byte-aligned lengths, separate control bytes.

A token's code is its rank by corpus frequency, so the 256 most frequent tokens take
one byte. Two bits per id, four ids to a control byte, give the number of bytes
(1 to 4); control bytes and data bytes are stored apart, and a whole block is
decoded by looking the control bytes up in a table of lengths. Each document starts
at a new control byte, the ids that fill its last one are zeros.

``<path>/ids`` holds one row per block: (shard, block, doc_ids, counts, control,
data) in ascending doc_id; shards are ranges of doc_id. ``<path>/ranks`` holds
(token, rank). Both are parquet tables, so that any store Spark reaches will do and a
lost executor's tasks are repeated without half-written files.

A null text counts as empty (only the end id); a null doc_id comes first; repeated
doc_ids are all kept, in the order of their ids. Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import Numbering, flat, runs, slices, word_names, words
from .ranges import ranged
from .rounds import mapped, partitions, shared_path, stored

#: Words a worker remembers the ids of.
KNOWN_WORDS = 1_000_000
KNOWN_BITS = 22
BLOCK_IDS = 1 << 20
#: Number of bytes of each of the four ids of a control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_SPECIAL = b"<|"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Letters of Latin-1, then marks but for the apostrophe, which may begin a word.
_PLAIN = re.compile(r"([a-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)?")
#: Words that the tokenizer makes of them, without and with marks.
_ENDS = {False: 1, True: 2}


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    This equals encoding whole texts when the tokenizer splits at white space, drops it
    and lower-cases, and marks the last token of each of its own words, as a vocabulary
    with word ends does. Texts that may hold a special token go to the tokenizer whole.
    Words are known by 128-bit names.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], np.uint32)
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = Numbering(KNOWN_BITS)
        self.ids, self.size = np.empty(1 << 16, np.uint32), 0
        self.starts, self.counts = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.filled = 0

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        total, n = len(ids), len(counts)
        while self.size + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.filled + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.empty_like(self.counts)])
        self.ids[self.size : self.size + total] = ids
        self.starts[self.filled : self.filled + n] = self.size + np.cumsum(counts) - counts
        self.counts[self.filled : self.filled + n] = counts
        self.size, self.filled = self.size + total, self.filled + n

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has.

        Plain words (letters, then marks) go in long rows and are told apart by the tokens
        that end a word; others go one by one.
        """
        ends = np.array([_ENDS.get(bool(m[2])) if (m := _PLAIN.fullmatch(w)) else 0 for w in words], np.int64)
        counts = np.zeros(len(words), np.int64)
        plain, parts = np.flatnonzero(ends), []
        for i in range(0, len(plain), 500):
            some = plain[i : i + 500]
            row = self.tokenizer.encode_batch_fast([" ".join(words[k] for k in some)], add_special_tokens=False)[0]
            ids = np.array(row.ids, np.uint32)
            last = np.flatnonzero(self.ends_word[ids])
            upto = np.cumsum(ends[some])
            if len(last) != upto[-1]:  # not plain to this tokenizer
                ends[some] = 0
                continue
            counts[some] = np.diff(last[upto - 1] + 1, prepend=0)
            parts.append(ids)
        other = np.flatnonzero(ends == 0)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in other], add_special_tokens=False)]
        counts[other] = list(map(len, found))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for some, ids in ((np.flatnonzero(ends), np.concatenate([np.empty(0, np.uint32), *parts])),
                          (other, np.fromiter(chain.from_iterable(found), np.uint32))):
            _, place = runs(counts[some])
            out[np.repeat(starts[some], counts[some]) + place] = ids
        return out, counts

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by the end id, and the number of ids per text.

        Texts end in white space.
        """
        text = raw.tobytes()
        if _SPECIAL in text:
            return self._by_text(text, offsets)
        if self.known.count > KNOWN_WORDS:
            self.forget()
        low = _LOWER[raw]
        starts, ends = words(low)
        first, second = (word_names(low, starts, ends, lane) for lane in (0, 1))
        first[first == 0] = 1  # an empty slot
        number = self.known.find(first, second)
        new = np.flatnonzero(number < 0)
        if len(new):
            new = new[np.unique(first[new], return_index=True)[1]]
            small = low.tobytes()
            found = [small[a:z].decode("utf-8", "replace") for a, z in zip(starts[new].tolist(), ends[new].tolist())]
            for i in range(0, len(new), 50_000):
                some = new[i : i + 50_000]
                self._add(*self._encode_words(found[i : i + 50_000]))
                self.known.add(first[some], second[some])
            number = self.known.find(first, second)
        counts = self.counts[number]
        bounds = np.searchsorted(starts, offsets)
        upto = np.concatenate([[0], np.cumsum(counts)])
        per_text = upto[bounds[1:]] - upto[bounds[:-1]] + 1
        of, place = runs(counts)
        ids = np.empty(int(per_text.sum()), np.uint32)
        text_of = np.repeat(np.arange(len(per_text)), np.diff(bounds))
        ids[np.arange(len(of)) + text_of[of]] = self.ids[self.starts[number][of] + place]
        ids[np.cumsum(per_text) - 1] = self.end
        return ids, per_text

    def _by_text(self, text: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, text by text."""
        parts, counts = [], []
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = text[a:z]
            if _SPECIAL in own:
                whole = own.decode("utf-8", "replace")
                ids = np.array([*self.tokenizer.encode(whole, add_special_tokens=False).ids, self.end[0]], np.uint32)
                counts.append(np.array([len(ids)]))
            else:
                ids, n = self.encode(np.frombuffer(own, np.uint8), np.array([0, z - a]))
                counts.append(n)
            parts.append(ids)
        return np.concatenate(parts), np.concatenate(counts)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, *keep: str) -> DataFrame:
    """(doc_id, keep.., ids): the ids of whole texts as little-endian 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end_id)
        for b in batches:
            raw, offsets = flat(b.column("text"), b"\n")
            for i, j in slices(offsets):
                ids, counts = encoder.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = pa.Array.from_buffers(
                    pa.binary(), j - i,
                    [None, pa.py_buffer(np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)), pa.py_buffer(ids)],
                )
                kept = [b.column(c).slice(i, j - i) for c in ("doc_id", *keep)]
                yield pa.record_batch([*kept, rows], ["doc_id", *keep, "ids"])

    source = docs.select("doc_id", *keep, "text")
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *keep))
    return mapped(source, run, f"{schema}, ids binary")


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, end_id: int) -> WordEncoder:
    """One per worker process, so that tasks share what it has learnt."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def token_ranks(ids: DataFrame) -> DataFrame:
    """(token, rank) by falling corpus frequency, ties to the smaller token.

    As many rows as the vocabulary has tokens in use, which bounds the sort.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            raw, _ = flat(b.column("ids"))
            found = np.bincount(raw.view("<u4"))
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
        tokens = np.flatnonzero(total)
        yield pa.record_batch([pa.array(tokens), pa.array(total[tokens])], ["token", "n"])

    counted = ids.select("ids").mapInArrow(count, "token long, n long")
    order = Window.orderBy(F.desc("n"), "token")
    return (
        counted.groupBy("token").agg(F.sum("n").alias("n"))
        .select("token", (F.row_number().over(order) - 1).cast("long").alias("rank"))
    )


def code(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of padded documents, and how many of each a document has."""
    quads = -(-counts // 4)
    starts = np.cumsum(quads * 4) - quads * 4
    padded = np.zeros(int(quads.sum()) * 4, np.uint32)
    padded[np.arange(len(values)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)] = values
    size = 1 + (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = np.left_shift(size.reshape(-1, 4) - 1, np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    planes = padded.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = planes[np.arange(4) < size[:, None]]
    upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    data_of = upto[starts + quads * 4] - upto[starts]
    return control, data, quads, data_of


def decode(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """All values of a stretch of control and data bytes, padding included."""
    size = LENGTHS[control].ravel()
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for byte in (1, 2, 3):
        longer = np.flatnonzero(size > byte)
        if not len(longer):
            break
        out[longer] |= data[at[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> str:
    """Encode whole texts and write them to the folder; returns the folder."""
    spark = docs.sparkSession
    n = partitions(docs)
    docs = ranged(docs.select("doc_id", "text"), "doc_id", n, "shard")
    ids = stored(encoded(docs, tokenizer, end_id, "shard"))
    token_ranks(ids).write.parquet(f"{path}/ranks")
    table = _rank_table(spark, path)

    def to_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = flat(b.column("ids"))
            for i, j in slices(offsets, 4 << 20):
                counts = np.diff(offsets[i : j + 1]) // 4
                control, data, quads, data_of = code(table[raw[offsets[i] : offsets[j]].view("<u4")], counts)
                yield pa.record_batch(
                    [b.column("doc_id").slice(i, j - i), b.column("shard").slice(i, j - i), pa.array(counts),
                     _binaries(control, quads), _binaries(data, data_of)],
                    ["doc_id", "shard", "n", "control", "data"],
                )

    rows = ids.mapInArrow(to_codes, "doc_id long, shard int, n long, control binary, data binary")
    ordered = rows.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "control", "data")

    def to_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        shard, block, size = None, 0, 0
        for b in batches:
            for row in b.to_pylist():
                if held and (row["shard"] != shard or size >= BLOCK_IDS):
                    yield _block(shard, block, held)
                    block, held, size = block + 1 if row["shard"] == shard else 0, [], 0
                shard = row["shard"]
                held.append(row)
                size += row["n"]
        if held:
            yield _block(shard, block, held)

    ordered.mapInArrow(to_blocks, _BLOCK).write.option("compression", "zstd").parquet(f"{path}/ids")
    return path


_BLOCK = "shard int, block int, n_ids long, doc_ids array<long>, counts array<long>, control binary, data binary"


def _block(shard: int, block: int, rows: list[dict]) -> pa.RecordBatch:
    counts = [r["n"] for r in rows]
    columns = {
        "shard": pa.array([shard], pa.int32()),
        "block": pa.array([block], pa.int32()),
        "n_ids": pa.array([sum(counts)], pa.int64()),
        "doc_ids": pa.array([[r["doc_id"] for r in rows]], pa.list_(pa.int64())),
        "counts": pa.array([counts], pa.list_(pa.int64())),
        "control": pa.array([b"".join(r["control"] for r in rows)], pa.binary()),
        "data": pa.array([b"".join(r["data"] for r in rows)], pa.binary()),
    }
    return pa.record_batch(list(columns.values()), list(columns))


def _binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


def _rank_table(spark: SparkSession, path: str, to_token: bool = False) -> np.ndarray:
    """The ranks of all tokens in use, or the tokens of all ranks: one entry per token
    of the vocabulary, a fixed size whatever the corpus."""
    rows = spark.read.parquet(f"{path}/ranks").toPandas()
    a, b = rows["token"].to_numpy(np.int64), rows["rank"].to_numpy(np.int64)
    if to_token:
        a, b = b, a
    table = np.zeros(int(a.max(initial=0)) + 1, np.uint32)
    table[a] = b
    return table


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of each document, or its crc32 for ids.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is taken over the
    ids as little-endian 32-bit integers.
    """
    tokens = _rank_table(spark, path, to_token=True)
    table = spark.read.schema(_BLOCK).parquet(f"{path}/ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                get = {n: b.column(k)[row] for k, n in enumerate(b.schema.names)}
                counts = get["counts"].values.to_numpy(zero_copy_only=False)
                ids = tokens[decode(*(np.frombuffer(get[c].as_buffer(), np.uint8) for c in ("control", "data")))].astype("<u4")
                quads = -(-counts // 4) * 4
                starts = np.cumsum(quads) - quads
                ranges = list(zip(starts.tolist(), (starts + counts).tolist()))
                if digest:
                    out = pa.array([zlib.crc32(ids[a:z]) for a, z in ranges], pa.int64())
                else:
                    out = pa.array([ids[a:z].astype(np.int32) for a, z in ranges], pa.list_(pa.int32()))
                same = {c: pa.array([get[c].as_py()] * len(counts), pa.int32()) for c in ("shard", "block")}
                yield pa.record_batch(
                    [get["doc_ids"].values, same["shard"], same["block"], pa.array(np.cumsum(counts) - counts), pa.array(counts), out],
                    ["doc_id", "shard", "block", "at", "n_tokens", "out"],
                )

    kind = "long" if digest else "array<int>"
    rows = table.select("shard", "block", "doc_ids", "counts", "control", "data").mapInArrow(
        run, f"doc_id long, shard int, block int, at long, n_tokens long, out {kind}"
    )
    shards = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    # one row per shard, a number that write_token_files fixes
    of_shards = table.groupBy("shard").agg(F.sum("n_ids").alias("_n")).select(
        "shard", F.coalesce(F.sum("_n").over(shards), none).alias("_shard_start")
    )
    of_blocks = (
        table.select("shard", "block", F.coalesce(F.sum("n_ids").over(blocks), none).alias("_start"))
        .join(of_shards, "shard")
    )
    return rows.join(of_blocks, ["shard", "block"]).select(
        "doc_id",
        (F.col("_shard_start") + F.col("_start") + F.col("at")).alias("start"),
        "n_tokens",
        F.col("out").alias("ids_crc32" if digest else "ids"),
    )


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the files and give what reading them back says of each document."""
    path = write_token_files(docs, path or shared_path(docs), tokenizer, end_id)
    return read_token_files(docs.sparkSession, path, digest=True)
