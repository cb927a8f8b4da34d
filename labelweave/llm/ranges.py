"""Contiguous ranges of a numeric id, about equally filled, and running values over them."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def ranged(df: DataFrame, column: str, n: int, out: str = "_range") -> DataFrame:
    """Add the number of the row's range of a column, 0 .. n - 1; nulls are in range 0.

    The n - 1 cuts are approximate quantiles of all rows, found in one aggregate.
    Equal values share a range.
    """
    value = F.coalesce(F.col(column).cast("double"), F.lit(float("-inf")))
    steps = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(column, steps, ACCURACY)).first()[0] if steps else None
    cuts = sorted({float(x) for x in found or ()})
    if not cuts:
        return df.withColumn(out, F.lit(0))
    marked = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="_value", outputCol="_cut"
    ).transform(df.withColumn("_value", value))
    return marked.withColumn(out, F.col("_cut").cast("int")).drop("_value", "_cut")


def before_each(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of the value over the earlier rows of the group.

    Needs the column ``_range``, whose ranges follow the order. A window covers one
    range of one group, so a hot group is spread over as many tasks as ranges.
    """
    local = (
        Window.partitionBy(*keys, "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        df.groupBy(*keys, "_range")
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
    )
    return (
        df.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(carried, [*keys, "_range"])
        .withColumn(out, F.col("_local") + F.col("_carry"))
        .drop("_local", "_carry")
    )
