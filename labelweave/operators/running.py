"""Running values over all rows.

Rows are cut into ranges of the order column. A window covers one range, and what the
earlier ranges add up to is carried in by a join on the range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"
QUANTILE_ACCURACY = 10_000


def with_ranges(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``: equally filled, ordered ranges of a numeric column."""
    spark = df.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(order, cuts, QUANTILE_ACCURACY)).first()[0] if cuts else []
    splits = [float("-inf"), *sorted({float(x) for x in found or []}), float("inf")]
    if len(splits) < 3:
        return df.withColumn(RANGE, F.lit(0))
    keyed = df.withColumn("_order", F.col(order).cast("double"))
    marked = Bucketizer(splits=splits, inputCol="_order", outputCol="_b").transform(keyed)
    return marked.withColumn(RANGE, F.col("_b").cast("int")).drop("_order", "_b")


def running_total_and_peak(
    df: DataFrame, order: str, value: str, total: str, peak: str
) -> DataFrame:
    """Sum of the value over all rows so far and the largest such sum so far.

    Inside a range both start at zero; the ranges before shift them. Only one row
    per range is combined across ranges.
    """
    so_far = (
        Window.partitionBy(RANGE)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # read twice, from the same exchange
    local = df.withColumn("_sum", F.sum(value).over(so_far)).withColumn("_top", F.max("_sum").over(so_far))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        local.groupBy(RANGE)
        .agg(F.sum(value).alias("_s"), F.max("_sum").alias("_m"))
        .withColumn("_start", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
        .withColumn("_high", F.max(F.col("_start") + F.col("_m")).over(earlier))
        .select(RANGE, "_start", "_high")
    )
    # one row per range, a number fixed by with_ranges
    return (
        local.join(F.broadcast(carry), RANGE)
        .withColumn(total, F.col("_start") + F.col("_sum"))
        .withColumn(peak, F.greatest("_high", F.col("_start") + F.col("_top")))
        .drop("_sum", "_top", "_start", "_high")
    )
