"""Rounds of questions between batches of texts and buckets of hashed keys.

Deduplication asks of very many small keys (k-grams, variants, windows) which occur
elsewhere. Sending a row for each key costs far more than the key. Here a batch of
some megabytes of text sorts its keys, drops its own repeats and sends one packed
row per bucket; a key that fills a third of all texts then counts once per batch,
so no bucket grows with it. The bucket answers with bits in the order of the keys,
and the batch, which derives the same keys again from its stored text, reads them
off. What is sent back is thus an eighth of a byte a key.

Batches are written once, bucketed by their number, so no later round moves a text.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .kernels import U64

BATCH_BYTES = 4 << 20
ARROW_BYTES = 8 << 20
ASKED = "bucket long, batch long, payload binary"
_ASKED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("payload", pa.binary())])


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """Give memory back when a task ends, since workers live on."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches of some megabytes, whatever the texts' length.

    This sets the session's size of Arrow batches, which later jobs keep.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(lean(run), schema)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared_path(df: DataFrame) -> str:
    return f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write the rows to the shared folder and read them from there."""
    path = shared_path(df)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """The rows with columns named by their place, for any names the columns have."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def packed(
    df: DataFrame, limit: int = BATCH_BYTES, rows: int = 1 << 30, keep: bool = True
) -> DataFrame:
    """Rows as compressed Arrow batches: (batch, payload), one row per ``limit`` bytes.

    With ``keep`` the batches are a table bucketed by their number, so that joins
    on it move nothing.
    """

    columns = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size, count = [], 0, 0

        def emit() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return pa.record_batch([pa.array([number]), pa.array([pack_table(table)])], ["batch", "payload"])

        for b in batches:
            b, at = b.rename_columns(columns), 0
            while at < b.num_rows:
                row = max(1, b.nbytes // b.num_rows)
                n = min(b.num_rows - at, rows - count, max(1, (limit - size) // row))
                piece = b.slice(at, n)
                at += n
                held.append(piece)
                size, count = size + piece.nbytes, count + n
                if size >= limit - row or count >= rows:
                    yield emit()
                    number, held, size, count = number + 1, [], 0, 0
        if held:
            yield emit()

    out = mapped(numbered(df), run, "batch long, payload binary")
    return bucketed(out) if keep else out


def bucketed(df: DataFrame, key: str = "batch") -> DataFrame:
    """Write the rows to the shared folder, bucketed by a key, so that joins on it move nothing."""
    name = f"llm_{uuid.uuid4().hex}"
    df.write.option("path", shared_path(df)).option("compression", "none").bucketBy(
        partitions(df), key
    ).saveAsTable(name)
    # the frame knows the files and their buckets; the catalog need not
    table = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")
    return table


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def opened(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


_SHORT = {"b1": np.dtype("<u1"), "b2": np.dtype("<u2"), "b4": np.dtype("<u4")}


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each with its type and length.

    Signed 64-bit integers are kept as distances from the smallest, in as few bytes
    as hold them."""
    parts = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        kind, base = a.dtype.str, 0
        if kind == "<i8" and len(a):
            base, top = int(a.min()), int(a.max())
            short = next((k for k, d in _SHORT.items() if top - base <= np.iinfo(d).max), None)
            if short:
                kind, a = short, (a - base).astype(_SHORT[short])
            else:
                base = 0
        parts += [kind.encode().ljust(4), len(a).to_bytes(6, "little"), base.to_bytes(8, "little", signed=True), a.tobytes()]
    return b"".join(parts)


def load(data: bytes) -> list[np.ndarray]:
    out, at = [], 2
    for _ in range(int.from_bytes(data[:2], "little")):
        name, n = data[at : at + 4].decode().strip(), int.from_bytes(data[at + 4 : at + 10], "little")
        base = int.from_bytes(data[at + 10 : at + 18], "little", signed=True)
        kind = _SHORT.get(name) or np.dtype(name)
        a = np.frombuffer(data, kind, n, at + 18)
        out.append(a.astype(np.int64) + base if name in _SHORT else a)
        at += 18 + n * kind.itemsize
    return out


def dump_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps, cut into byte planes, which the shuffle's codec shrinks."""
    gaps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return b"".join((int(keys[0]).to_bytes(8, "little"), bytes([width]), planes.tobytes()))


def load_sorted(data: bytes) -> np.ndarray:
    width = data[8]
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :width] = planes.T
    keys = gaps.view("<u8").ravel()
    keys[0] = U64(int.from_bytes(data[:8], "little"))
    return np.cumsum(keys, dtype=U64)


def buckets(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys; the bucket is what is left above ``shift`` bits."""
    if not len(keys):
        return
    high = keys >> U64(shift) if shift < 64 else np.zeros(len(keys), U64)
    cuts = np.flatnonzero(high[1:] != high[:-1]) + 1
    ends = [*cuts.tolist(), len(keys)]
    for a, b in zip([0, *ends], ends):
        yield int(high[a]), a, b


def question(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ASKED)], schema=_ASKED
    )


def each(fn: Callable) -> Callable:
    """Make a function of (batch, table, answers by name) a function of Arrow batches.

    It yields lists of (bucket, batch, payload) rows or ready record batches.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(k)[i] for k, n in enumerate(b.schema.names)}
                number = row.pop("batch").as_py()
                table = opened(row.pop("payload").as_buffer())
                said = {
                    n: {x["bucket"]: x["payload"] for x in v.as_py() or ()} for n, v in row.items()
                }
                for out in fn(number, table, said):
                    if isinstance(out, list):
                        if out:
                            yield question(out)
                    else:
                        yield out

    return run


def ask(batches: DataFrame, fn: Callable, answer: Callable) -> DataFrame:
    """One round. ``answer`` gets (bucket, [(batch, payload)]) and gives (batch, payload)."""

    def reply(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        order = np.argsort(table.column("batch").to_numpy(), kind="stable")
        numbers, loads = table.column("batch"), table.column("payload")
        asked = [(numbers[int(i)].as_py(), loads[int(i)].as_py()) for i in order]
        rows = [(bucket, n, p) for n, p in answer(bucket, asked)]
        return pa.Table.from_batches([question(rows)], _ASKED)

    asked = mapped(batches, each(fn), ASKED)
    return stored(asked.groupBy("bucket").applyInArrow(reply, ASKED))


def told(batches: DataFrame, **answers: DataFrame) -> DataFrame:
    """Batches with the answers they got, one array of (bucket, payload) per round."""
    for name, rows in answers.items():
        got = rows.groupBy("batch").agg(
            F.collect_list(F.struct("bucket", "payload")).alias(name)
        )
        batches = batches.join(got, "batch", "left")
    return batches


def row_numbers(batch: int, at: np.ndarray) -> np.ndarray:
    """One number for each row of a batch of ``packed`` with at most 2**20 rows.

    The partition has 23 bits, its batch 20 and the row 20.
    """
    return np.int64((batch >> 32 << 40) + ((batch & 0xFFFFFFFF) << 20)) + at


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(said: dict[int, bytes], cuts: Iterable[tuple[int, int, int]], n: int) -> np.ndarray:
    """Answers of one bit a key, in the order of the sorted keys."""
    out = np.zeros(n, bool)
    for bucket, a, b in cuts:
        if bucket in said:
            out[a:b] = np.unpackbits(np.frombuffer(said[bucket], np.uint8), count=b - a)
    return out


def repeated(bucket: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Answer which of a batch's sorted keys occur more than once in the bucket."""
    keys = [load_sorted(p) for _, p in asked]
    everything = np.sort(np.concatenate(keys))
    twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
    if not len(twice):
        return
    for (batch, _), own in zip(asked, keys):
        at = np.searchsorted(twice, own)
        at[at == len(twice)] = 0
        hit = twice[at] == own
        if hit.any():
            yield batch, bits(hit)


def cell_bits(keys: float) -> int:
    """Bits of a cell so that about one key in 128 meets another by chance."""
    return min(64, max(20, int(np.ceil(np.log2(max(keys, 1)))) + 7))


def bucket_bits(keys: float, each_holds: float = 2e6) -> int:
    return max(0, int(np.ceil(np.log2(max(keys, 1) / each_holds))))
