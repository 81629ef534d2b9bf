"""Connected components of links held in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, stored


#: Links of a file of a round's tables.
FILE_LINKS = 250_000


def _stars(both: DataFrame, small: bool, files: int) -> tuple[DataFrame, DataFrame]:
    """One step: every node passes its smallest neighbour on to its larger (or, if small, its other smaller) neighbours."""
    # both: (u, v) with each link in both directions, or with v < u alone
    # stored, so that both sides of the join are shuffled for it alone and Spark can split a star's centre
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", files)
    joined = both.join(broadcast_if_small(least, 16), "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = out.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return out, least


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that can be reached.

    Links stay in tables: each round is two joins on a node, written to the shared folder, after which the round before
    is deleted; the smallest neighbours are broadcast if they are few, else a hot node is a skewed join, which Spark splits.
    The rounds grow with the logarithm of the longest path.  Links of a node to itself and null ends are ignored; repeated
    links count once; no links give no rows.
    """
    now = stored(
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    files = max(8, -(-now.count() // FILE_LINKS))
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        out, least = _stars(both, False, files)
        large = stored(out, "large-stars", files)
        discard(least, now)
        out, least = _stars(large.select(F.col("a").alias("u"), F.col("b").alias("v")), True, files)
        now = stored(out, "small-stars", files)
        discard(least, large)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    # now every link leads from a node to its component
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
