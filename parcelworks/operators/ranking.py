"""Exact places in a sorted order without one task that sees all of a group: range partitions, and what lies before each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.storage import broadcast_if_small, stored


def cumulated(frame: DataFrame, weight: str, *order: str) -> DataFrame:
    """frame, stored, with upto: the sum of weight over the rows up to this one in the order, its own included.

    Rows are dealt out by ranges of the order, summed within a range, and the ranges' sums before theirs are added.  The order's columns
    must tell rows apart or rows alike must be few, as they share a range.  Null weights count nothing.  An empty frame stays empty.
    """
    spark = frame.sparkSession
    placed = stored(frame.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for row in placed.groupBy("__part").agg(F.sum(weight).alias("s")).orderBy("__part").collect():  # one row a range
        offsets.append((row["__part"], before))
        before += row["s"] or 0
    offsets = spark.createDataFrame(offsets, "__part int, __before bigint")
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("upto", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    return summed.join(F.broadcast(offsets), "__part").withColumn("upto", F.col("upto") + F.col("__before")).drop("__part", "__before")


def at_shares(frame: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group, n, low, high and, for each of shares, the element at int(n * share) of the group's sorted values, counted from 0.

    Values are counted by (group, value), so rows alike come together before they are dealt out; the distinct values of one group
    then spread over all ranges.  The wanted element is the value whose rows, by their sums up to there, hold the rank.  Null
    values count nothing; a null group is a group; an empty frame gives no rows.
    """
    counts = frame.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    rows = stored(cumulated(counts, "c", "g", "v"), "ranks")
    groups = stored(rows.groupBy("g").agg(F.min(F.col("upto") - F.col("c")).alias("__first"), F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "groups")
    own = groups.select(F.col("g").alias("__g"), "__first", "n")
    met = rows.join(broadcast_if_small(own, 64), F.col("g").eqNullSafe(F.col("__g")))
    at = F.col("upto") - F.col("__first")  # rows of the group up to this value
    holds = lambda share: (at > F.floor(F.col("n") * share)) & (at - F.col("c") <= F.floor(F.col("n") * share))
    some = None
    for share in shares.values():
        some = holds(share) if some is None else some | holds(share)
    # at most one row a share and group is left before anything is gathered by group
    picked = met.filter(some).groupBy("g").agg(*[F.max(F.when(holds(share), F.col("v"))).alias(name) for name, share in shares.items()])
    joined = groups.join(picked.withColumnRenamed("g", "__g"), F.col("g").eqNullSafe(F.col("__g")))
    return joined.select(F.col("g").alias(group), "n", *shares, "low", "high")
