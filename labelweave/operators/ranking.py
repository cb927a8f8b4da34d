"""Order, ranks, splits and folds without a one-task window.

Three tools cover every global-order need:

* ``order_statistics`` finds exact order statistics by narrowing histograms; each
  pass is one small aggregate over one column for all of them. Splits and folds are then plain
  row-wise predicates, so no row is moved.
* ``global_rank`` numbers all rows: range partitioning, a sort inside each
  partition, and per-partition offsets. Equal keys spread over partitions.
* ``rank_within`` numbers rows inside groups of any size by ranking hash ranges
  of a group separately.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

HISTOGRAM_BINS = 4096
HASH_KEY_DIGITS = 15
MD5_DIGITS = 32
CUT_DIGITS = 3
LOCAL_INDEX_MASK = (1 << 33) - 1


def hash_order(seed: int | str, *cols: Column | str) -> Column:
    """Seeded pseudo-random order key: md5 of the seed and the given values."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_number(hash_hex: Column) -> Column:
    """The leading 60 bits of an md5 value; same order as the value itself."""
    return F.conv(F.substring(hash_hex, 1, HASH_KEY_DIGITS), 16, 10).cast("bigint")


def column_span(df: DataFrame, column: str) -> tuple[int, int, int]:
    """Smallest value, largest value and number of values of an integer column."""
    low, high, total = df.agg(F.min(column), F.max(column), F.count(column)).first()
    return low, high, total


def kth_smallest(
    df: DataFrame, column: str, k: int, span: tuple[int, int, int] | None = None
) -> tuple[int, int] | None:
    """Exact k-th smallest value (1-based) of an integer column.

    Returns the value and the number of rows strictly below it, None when k is
    out of range.
    """
    return order_statistics(df, column, [k], span)[0]


def order_statistics(
    df: DataFrame, column: str, ks: Sequence[int], span: tuple[int, int, int] | None = None
) -> list[tuple[int, int] | None]:
    """``kth_smallest`` for several k, all narrowed in the same passes over the column.

    A pass collects at most ``HISTOGRAM_BINS`` counts for each k; once the bin that
    holds an answer has few rows, its distinct values end the search.
    """
    low, high, total = span or column_span(df, column)
    # where the answer for k lies: smallest and largest value, rows below, rows inside
    found = {k: (low, high, 0, total) for k in ks if 1 <= k <= total}
    while open_ranges := sorted({(lo, hi, inside) for lo, hi, _, inside in found.values() if lo < hi}):
        number, bin_of, widths = F.lit(None).cast("int"), F.lit(None).cast("bigint"), {}
        for i, (lo, hi, inside) in enumerate(open_ranges):
            # few rows: count per value; many rows: count per equally wide bin
            widths[lo, hi] = i, 1 if inside <= HISTOGRAM_BINS else (hi - lo) // HISTOGRAM_BINS + 1
            here = F.col(column).between(lo, hi)
            number = F.when(here, F.lit(i)).otherwise(number)
            bin_of = F.when(here, F.expr(f"(`{column}` - {lo}L) div {widths[lo, hi][1]}L")).otherwise(bin_of)
        rows = df.select(number.alias("_range"), bin_of.alias("_bin")).filter("_range is not null")
        counts = sorted(tuple(r) for r in rows.groupBy("_range", "_bin").count().collect())
        for k, (lo, hi, below, inside) in found.items():
            if lo == hi:
                continue
            mine, width = widths[lo, hi]
            for bin_no, count in ((b, c) for i, b, c in counts if i == mine):
                if below + count >= k:
                    found[k] = lo + bin_no * width, min(hi, lo + (bin_no + 1) * width - 1), below, count
                    break
                below += count
    return [found[k][0::2][:2] if k in found else None for k in ks]


def hash_cut(df: DataFrame, row_id: str, k: int | Callable[[int], int], seed: int | str) -> Column:
    """Row-wise predicate that is true for the first k rows in seeded hash order.

    Order is (md5, row_id); row ids are unique. ``k`` may follow from the number of
    rows. The cut is a literal, so using the predicate needs no shuffle. Hashes fill
    their range evenly, so a pass counts by the next three of their digits: one pass
    counts the rows as well, and the rows that share six digits are few.
    """
    hashed = hash_order(seed, row_id)
    keys = df.select(F.col(row_id).alias("_id"), hashed.alias("_h"))
    prefix, below, inside = "", 0, None
    while inside is None or (inside > HISTOGRAM_BINS and len(prefix) < MD5_DIGITS):
        digits = F.substring("_h", len(prefix) + 1, CUT_DIGITS).alias("_d")
        inner = keys.filter(F.col("_h").startswith(prefix)) if prefix else keys
        counts = sorted(tuple(r) for r in inner.groupBy(digits).count().collect())
        if inside is None:
            total = sum(n for _, n in counts)
            k = k(total) if callable(k) else k
            if k <= 0:
                return F.lit(False)
            if k > total:
                return F.lit(True)
        for part, inside in counts:
            if below + inside >= k:
                prefix += part
                break
            below += inside
    last = keys.filter(F.col("_h").startswith(prefix)).orderBy("_h", "_id").limit(k - below).collect()[-1]
    return (hashed < F.lit(last["_h"])) | (
        (hashed == F.lit(last["_h"])) & (F.col(row_id) <= F.lit(last["_id"]))
    )


def mark_hash_split(
    df: DataFrame, row_id: str, size_of, seed: int | str = 42, out: str = "is_test"
) -> DataFrame:
    """Exact-size seeded split; ``size_of(n)`` gives the size of the marked part."""
    return df.withColumn(out, hash_cut(df, row_id, size_of, seed))


def test_size(fraction: float):
    """Size rule of a train/test split: the fraction rounded up."""
    # the small slack keeps 0.3 * 10 = 3.0000000000000004 at 3
    return lambda n: math.ceil(n * fraction - 1e-9)


def validation_size(fraction: float):
    """At least one, half-even rounding, and at least one row left for training."""
    return lambda n: min(max(1, round(n * fraction)), n - 1)


def holdout_size(fraction: float):
    """At least one, rounded down."""
    return lambda n: max(1, int(n * fraction))


def split_by_text(
    df: DataFrame, text: str, fraction: float, seed: int | str = 42, out: str = "is_validation"
) -> DataFrame:
    """Mark rows by their text, so that equal texts stay on one side."""
    ensure_checkpoint_dir(df.sparkSession)
    # written once, as the search for the cut reads it several times
    texts = df.select(F.md5(text).alias("_t")).distinct().checkpoint()
    cut = hash_cut(texts, "_t", validation_size(fraction), seed)
    return df.withColumn("_t", F.md5(text)).withColumn(out, cut).drop("_t")


def mark_prefix(df: DataFrame, row_id: str, fraction: float, out: str = "is_train") -> DataFrame:
    """Mark the first ``int(fraction * n)`` rows by integer row id."""
    span = column_span(df, row_id)
    found = kth_smallest(df, row_id, int(span[2] * fraction), span)
    return df.withColumn(out, F.lit(False) if found is None else F.col(row_id) <= found[0])


def contiguous_folds(df: DataFrame, row_id: str, k: int, out: str = "fold") -> DataFrame:
    """Unshuffled folds by integer row id; the first ``n % k`` folds are one larger."""
    span = column_span(df, row_id)
    size, extra = divmod(span[2], k)
    sizes = [size + (1 if i < extra else 0) for i in range(k - 1)]
    found = order_statistics(df, row_id, list(accumulate(sizes)), span)
    ends = [f[0] for f in found if f is not None]
    passed = [F.when(F.col(row_id) > e, 1).otherwise(0) for e in ends]
    return df.withColumn(out, reduce(lambda a, b: a + b, passed, F.lit(0)))


def global_rank(
    df: DataFrame, order: Sequence[Column | str], out: str = "position"
) -> DataFrame:
    """Number all rows from 1 in the given order.

    Pass only the columns that are needed: the sorted rows are written once to
    the checkpoint folder, so that counting and numbering see the same layout
    even when an executor is lost. ``order`` must end in a unique column.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid_out = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL_INDEX_MASK)))
        .checkpoint()
    )
    # one row per partition: small by construction
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid_out.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return laid_out.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + F.col("_at") + 1).alias(out)
    )


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order_hash: str,
    row_id: str,
    out: str = "rn",
    digits: int = 3,
    size: str | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in (hash, row_id) order.

    A group is cut into ``16**digits`` hash ranges that are ranked on their own
    and shifted by the counts before them, so a hot group uses many tasks. ``size``
    names a column for the number of rows of the group.
    """
    # one struct as the key: rows without a key stay, and window and join share a layout
    cut = df.withColumn("_g", F.struct(*keys, F.substring(order_hash, 1, digits).alias("_b")))
    parts = [F.col(f"_g.{k}") for k in keys]
    before = (
        Window.partitionBy(*parts).orderBy("_g._b").rowsBetween(Window.unboundedPreceding, -1)
    )
    all_of = [F.sum("_n").over(Window.partitionBy(*parts)).alias(size)] if size else []
    offsets = (
        cut.groupBy("_g")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *all_of)
    )
    if not keys:
        # at most 16**digits rows
        offsets = F.broadcast(offsets)
    local = F.row_number().over(Window.partitionBy("_g").orderBy(order_hash, row_id))
    return (
        cut.withColumn("_at", local)
        .join(offsets, "_g")
        .withColumn(out, F.col("_at") + F.col("_before"))
        .drop("_g", "_at", "_before")
    )


def shuffled(df: DataFrame, row_id: str, seed: int | str = 42) -> DataFrame:
    """All rows in seeded random order."""
    return df.orderBy(hash_order(seed, row_id), row_id)
