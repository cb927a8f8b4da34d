"""Document fingerprints by winnowing, in DataFrame and SQL functions only.

Every stretch of ``K`` code points is hashed; of each ``W`` consecutive hashes the
smallest is kept, of equal ones the rightmost, with its position. Two texts that share
``K + W - 1`` code points in a row thus share a kept hash. A text with fewer hashes
than ``W`` is one window, one shorter than ``K`` is hashed as a whole.

A kept value is one long: 35 bits of hash above 28 bits that fall with the position.
Its minimum is then the smallest hash and the rightmost position at once, so the
minimum over windows is four rounds of ``least`` over the array shifted by 1, 2, 4 and
8. (An array of longs ends at 2**28 entries, so no position is lost.) Texts are
encoded with four bytes a code point, so that a stretch is cut out without a walk
from the start. A hash is taken anew for each stretch: SQL has no running state per
row that would make rolling cheaper.

A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import ranged
from .rounds import partitions

K = 16
W = 16
POSITION_BITS = 28
_POSITIONS = (1 << POSITION_BITS) - 1
_HASHES = (1 << 63 - POSITION_BITS) - 1


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` stands for the value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def kept_values(text: str, first: str = "0L") -> str:
    """SQL of the kept values of a text, whose first code point has position ``first``."""
    hashes = (
        f"transform(sequence(0, greatest(0, length(bytes) div 4 - {K})), i -> "
        f"shiftleft(xxhash64(substring(bytes, 4 * i + 1, {4 * K})) & {_HASHES}L, {POSITION_BITS})"
        f" + ({_POSITIONS}L - start - i))"
    )
    shifts, at = [], 1
    while at < W:
        shifts.append(min(at, W - at))
        at += shifts[-1]
    lowest = "h0"
    for k, by in reversed(list(enumerate(shifts))):
        step = f"zip_with(slice(h{k}, 1, size(h{k}) - {by}), slice(h{k}, {by + 1}, size(h{k}) - {by}), (x, y) -> least(x, y))"
        lowest = step if k == len(shifts) - 1 else let(step, f"h{k + 1}", lowest)
    windows = f"if(size(h0) <= {W}, array(array_min(h0)), {lowest})"
    found = let(let(f"encode({text}, 'UTF-32')", "bytes", hashes), "h0", f"array_distinct({windows})")
    return let(f"cast({first} as bigint)", "start", found)


def position(value: str) -> str:
    return f"({_POSITIONS}L - ({value} & {_POSITIONS}L))"


def hash_set(kept: str) -> str:
    return f"array_distinct(transform({kept}, v -> shiftright(v, {POSITION_BITS})))"


def likeness(a: str, b: str) -> str:
    """SQL of the share of hashes of two sets that both have."""
    return let(
        f"cast(size(array_intersect({a}, {b})) as double)", "common",
        f"common / (size({a}) + size({b}) - common)",
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds ``kept``: array<struct<hash, position>> of the whole text, by position."""
    listed = f"transform(kept, v -> struct(shiftright(v, {POSITION_BITS}) as hash, {position('v')} as position))"
    return docs.withColumn("kept", F.expr(kept_values("coalesce(text, '')"))).withColumn(
        "kept", F.expr(listed)
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, kept, next_text, next_kept): documents and the next by doc_id.

    After the last comes the first. Equal doc_ids follow each other by text; a null one
    comes first. Texts are shuffled once, into ranges of doc_id; each range also gets the
    first document of the next one.
    """
    n = 4 * partitions(docs)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = ranged(docs, "doc_id", n).withColumn("_at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # one row per range
    by_range = Window.orderBy("_range")
    firsts = (
        docs.groupBy("_range").agg(F.min("_at").alias("_at"))
        .withColumn("_to", F.lag("_range").over(by_range))
        .withColumn("_to", F.coalesce("_to", F.max("_range").over(by_range.rowsBetween(0, Window.unboundedFollowing))))
    )
    guests = (
        docs.join(F.broadcast(firsts), ["_range", "_at"])
        .groupBy("_range").agg(F.first("_to").alias("_to"), F.first("doc_id").alias("doc_id"), F.min("text").alias("text"), F.first("_at").alias("_at"))
        .select("doc_id", "text", F.col("_to").alias("_range"), "_at", F.lit(True).alias("_guest"))
    )
    order = Window.partitionBy("_range").orderBy("_guest", "_at", "text")
    return (
        docs.withColumn("_guest", F.lit(False))
        .unionByName(guests)
        .repartition(n, "_range")
        .withColumn("kept", F.expr(kept_values("text")))
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_kept", F.lead("kept").over(order))
        .filter("not _guest")
        .select("doc_id", "text", "kept", "next_text", "next_kept")
    )


def compared(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and the next document.

    The edited text has the last quarter of its code points replaced by as many from the
    start of the next text. Windows that lie before the edit are taken from the document;
    only those from ``W`` before it on are hashed again.
    """
    pairs = with_next(docs).selectExpr(
        "doc_id", "cast(char_length(text) as bigint) as n_chars", "kept", "next_kept",
        f"char_length(text) - char_length(text) div 4 - {K + W - 1}L as last_window",
        "concat(left(text, char_length(text) - char_length(text) div 4), left(next_text, char_length(text) div 4)) as edited",
    )
    tail = let(
        f"greatest(0L, last_window - {W - 1}L)", "begin",
        kept_values("substring(edited, cast(begin as int) + 1)", "begin"),
    )
    before = let("last_window", "stop", f"filter(kept, v -> {position('v')} <= stop)")
    return pairs.withColumn("edited_kept", F.expr(f"array_union({before}, {tail})"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next): fingerprints as digests of their kept values, likeness from 0 to 1."""
    digest = "sha2(array_join(cast({} as array<string>), ','), 256)"
    sets = let(
        f"struct({hash_set('kept')} as own, {hash_set('edited_kept')} as edited, {hash_set('next_kept')} as next)", "s",
        f"struct({likeness('s.own', 's.edited')} as edited, {likeness('s.own', 's.next')} as next)",
    )
    return (
        compared(docs)
        .selectExpr(
            "doc_id", "n_chars", "sha2(edited, 256) as edited_sha256",
            f"{digest.format('kept')} as fingerprint", f"{digest.format('edited_kept')} as edited_fingerprint",
            f"{sets} as near", "size(kept) as n_kept",
        )
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"), "n_kept")
    )
