"""First-wins operators: best record of a key, prioritised unions with caps, scored unions, keyed upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(frame: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of every key in the given order, with Spark's limited partial ranking before the shuffle."""
    ranked = frame.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("__rank = 1").drop("__rank")


def first_per_key(frame: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of every key in the given order; nulls are a key."""
    ranked = frame.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.filter(F.col("__rank") <= limit).drop("__rank")


def merge_index(parcels: DataFrame) -> DataFrame:
    """One parcel a upc: archives (.kmz) before plain files, then the longer plat, then the earlier row.

    The result stands where the key first occurred (its pos); parcels without a upc all stay, after the others.
    """
    keyed = parcels.filter("upc IS NOT NULL AND upc <> ''")
    archive = F.lower("source").contains(".kmz")
    place = keyed.withColumn("__first", F.min("pos").over(Window.partitionBy("upc")))
    best = best_per_key(place, "upc", archive.desc(), F.length(F.coalesce("plat", F.lit(""))).desc(), F.col("pos"))
    rest = parcels.filter("upc IS NULL OR upc = ''").withColumn("__first", F.col("pos"))
    both = best.withColumn("__rest", F.lit(0)).unionByName(rest.withColumn("__rest", F.lit(1)))
    return both.withColumn("order_key", F.struct("__rest", "__first")).drop("__rest", "__first")


def prioritised_union(sources: list[tuple[DataFrame, int | None]], key: Column, total: int | None = None, pos: str = "pos") -> DataFrame:
    """Ordered union of (frame, cap): each source gives its first ``cap`` rows, the first source to name a key wins.

    Adds prio, the source's place in the list.  The caps come before the union: each is a distributed top-N.
    """
    capped = [
        (frame if cap is None else frame.orderBy(pos).limit(cap)).withColumn("prio", F.lit(n)) for n, (frame, cap) in enumerate(sources)
    ]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), capped).withColumn("__key", key)
    kept = best_per_key(both.filter("__key IS NOT NULL AND __key <> ''"), "__key", F.col("prio"), F.col(pos)).drop("__key")
    return kept if total is None else kept.orderBy("prio", pos).limit(total)


def first_nonempty(sources: list[DataFrame]) -> DataFrame:
    """Rows of the first source that has any."""
    tagged = reduce(lambda a, b: a.unionByName(b), [s.withColumn("__way", F.lit(n)) for n, s in enumerate(sources)])
    best = tagged.agg(F.min("__way").alias("__best"))
    return tagged.join(F.broadcast(best), F.col("__way") == F.col("__best")).drop("__way", "__best")


def score_union(hits: DataFrame, key: str = "upc", limit: int | None = 30) -> DataFrame:
    """hits (key, score, reason, seq) -> key, score (sum), reasons joined by ` + ` in the order of seq, best first.

    A key may be hit more than once by the same rule; rows without a key are dropped.
    """
    order = F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda x: x["reason"])
    out = hits.filter(f"{key} IS NOT NULL AND {key} <> ''").groupBy(key).agg(
        F.sum("score").alias("score"), F.concat_ws(" + ", order).alias("reasons"), F.min("seq").alias("__seq")
    )
    out = out.orderBy(F.desc("score"), "__seq")
    return (out if limit is None else out.limit(limit)).drop("__seq")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Field-wise merge: a new row's non-null fields replace the old row's, unknown keys are added."""
    names = [c for c in old.columns if c != key]
    other = new.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in names if c in new.columns])
    both = old.join(other, F.col(key) == F.col("__key"), "full_outer")
    fields = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in names]
    return both.select(F.coalesce("__key", key).alias(key), *fields).select(*old.columns)


def latest_per_key(frame: DataFrame, key: list[str], when: str, tie: str, keep: int = 1) -> DataFrame:
    """The ``keep`` newest rows of each key, as for backups kept or a search history."""
    ranked = frame.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(when), F.desc(tie))))
    return ranked.filter(F.col("__rank") <= keep).drop("__rank")


def search_history(frame: DataFrame, keep: int = 20) -> DataFrame:
    """(user_id, query, at, id): a user's newest row of each query, upper and lower case being equal, and of these the last ``keep``."""
    newest = latest_per_key(frame.withColumn("__q", F.lower("query")), ["user_id", "__q"], "at", "id")
    return latest_per_key(newest, ["user_id"], "at", "id", keep).drop("__q")
