"""Connected components of links as rows, by alternating star contractions.

Each round links every node's larger neighbours to the smallest node it sees, first
over all links, then over those to smaller nodes. All work is grouped minima and
joins on the node, so a hub with very many links is combined before the shuffle and
its join can be split. Rounds are written to the shared folder; their number grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import stored

#: A node with more than one in so many of the rows is a hub.
SHARE = 1024

#: Up to so many rows (of 16 bytes) all may be in one task.
FEW = 1 << 21


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))


def _with_lowest(pairs: DataFrame, low: DataFrame, rows: int) -> DataFrame:
    """(a, b, low) of all pairs; ``rows``: how many there are, at most."""
    if rows <= FEW:
        return pairs.join(low, "a").select("a", "b", "low")
    most = rows // SHARE + 1
    hubs = F.broadcast(low.filter(F.col("n") > most))
    hot = pairs.join(hubs, "a")
    rest = pairs.join(hubs.select("a"), "a", "left_anti").join(low.filter(F.col("n") <= most), "a")
    return hot.select("a", "b", "low").unionByName(rest.select("a", "b", "low"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in the links (a, b); a component is its smallest node."""
    links = stored(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    size = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while size[0]:
        # every node's larger neighbours to the smallest of the node and its neighbours
        both = _both(links)
        low = _lowest(both).select("a", F.least("a", "low").alias("low"), "n")
        large = _with_lowest(both, low, 2 * size[0]).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.filter("a <> b").distinct())
        # every node's smaller neighbours, and the node, to the smallest of them
        low = _lowest(large)
        small = _with_lowest(large, low, size[0]).select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = stored(
            small.unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()
        )
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == size:
            break
        size = now
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.unionByName(roots)
