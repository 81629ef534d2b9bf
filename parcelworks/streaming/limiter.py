"""Stateful throttling: a sliding-window limiter and a login lockout, on streams and as batch folds.

Admission depends on earlier admissions, so a plain count over a window is wrong: rejected calls don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _admit(held: list[float], now: float, limit: int, window: float) -> tuple[list[float], bool, int]:
    """Calls still held, whether this one passes, and the seconds to wait if not."""
    held = [t for t in held if now - t <= window]
    if len(held) >= limit:
        return held, False, max(1, int(window - (now - held[0])) + 1)
    return [*held, now], True, 0


def limited(events: DataFrame, limit: int, window: float, key: str = "key", ts: str = "ts", id_: str = "id") -> DataFrame:
    """Batch form: (key, id, ts, allowed, retry_after).  A key's events run in order of time and id.

    The state is at most ``limit`` times; events stream through it in sorted order within their partition, so a
    key of any size needs no array in memory.
    """
    ordered = events.select(F.col(key).cast("string").alias("key"), F.col(id_).cast("bigint").alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.col(ts).cast("timestamp").cast("double").alias("at"))
    ordered = ordered.repartition("key").sortWithinPartitions("key", "at", "id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            rows = []
            for k, at in zip(batch["key"], batch["at"]):
                if k != key:
                    key, held = k, []
                held, ok, wait = _admit(held, at, limit, window)
                rows.append((ok, wait))
            out = batch[["key", "id", "ts"]].copy()
            out["allowed"], out["retry_after"] = zip(*rows) if rows else ([], [])
            yield out

    return ordered.mapInPandas(fold, "key string, id bigint, ts timestamp, allowed boolean, retry_after int")


class Limiter(StatefulProcessor):
    """Stream form, for transformWithStateInPandas over (key, id, ts) grouped by key."""

    OUTPUT = StructType([StructField("key", StringType()), StructField("id", LongType()), StructField("ts", TimestampType()), StructField("allowed", BooleanType()), StructField("retry_after", IntegerType())])

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", StructType([StructField("at", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues):
        held = [r[0] for r in self.held.get()]
        for batch in rows:
            batch = batch.sort_values(["ts", "id"])
            out = []
            for at in batch["ts"]:
                held, ok, wait = _admit(held, at.timestamp(), self.limit, self.window)
                out.append((ok, wait))
            batch = batch[["key", "id", "ts"]].copy()
            batch["allowed"], batch["retry_after"] = zip(*out)
            yield batch
        self.held.put([(t,) for t in held])

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, limit: int, window: float) -> DataFrame:
    """events: streaming (key string, id bigint, ts timestamp)."""
    return events.groupBy("key").transformWithStateInPandas(Limiter(limit, window), Limiter.OUTPUT, "Append", "None")


def lockouts(attempts: DataFrame, failures: int = 5, minutes: int = 15) -> DataFrame:
    """attempts (user, id, ts, ok) -> with blocked and locked_until after each attempt.

    So many failures in a row lock for some minutes; attempts while locked are blocked and change nothing.  Only a
    success clears the count, so one failure after the lock has run out locks again.
    """
    ordered = attempts.select("user", "id", "ts", "ok").repartition("user").sortWithinPartitions("user", "ts", "id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, count, until = None, 0, pd.NaT
        for batch in batches:
            out = []
            for who, at, ok in zip(batch["user"], batch["ts"], batch["ok"]):
                if who != user:
                    user, count, until = who, 0, pd.NaT
                blocked = until is not pd.NaT and at < until
                if not blocked:
                    count = 0 if ok else count + 1
                    until = at + pd.Timedelta(minutes=minutes) if count >= failures else pd.NaT
                out.append((blocked, until))
            batch = batch.copy()
            batch["blocked"], batch["locked_until"] = zip(*out) if out else ([], [])
            batch["locked_until"] = pd.to_datetime(batch["locked_until"])
            yield batch

    schema = f"{attempts.select('user', 'id', 'ts', 'ok')._jdf.schema().toDDL()}, blocked boolean, locked_until timestamp"
    return ordered.mapInPandas(fold, schema)


#: Searches a month of a tier; null has no limit.
QUOTA = {"free": 10}


def monthly_quota(searches: DataFrame, limit: int = QUOTA["free"], user: str = "user_id", ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """Adds month, nth (the user's running number in the month) and within."""
    from pyspark.sql import Window

    month = F.date_trunc("month", F.col(ts))
    w = Window.partitionBy(user, "month").orderBy(ts, id_)
    return searches.withColumn("month", month).withColumn("nth", F.row_number().over(w)).withColumn("within", F.col("nth") <= limit)


#: What a subscription's state does to a tier.
KEEPS, LOSES = ("active", "trialing"), ("canceled", "unpaid", "incomplete_expired")


def subscription_tiers(events: DataFrame) -> DataFrame:
    """events (user, at, id, type, status, tier) -> the tier after the last event that changes it, else free.

    A finished checkout or an active or trialing update gives the event's tier; a deletion or an ended state gives
    free; failed payments change nothing.
    """
    up = F.col("type").isin("checkout.session.completed") | ((F.col("type") == "customer.subscription.updated") & F.col("status").isin(*KEEPS))
    down = (F.col("type") == "customer.subscription.deleted") | ((F.col("type") == "customer.subscription.updated") & F.col("status").isin(*LOSES))
    to = F.when(up, F.coalesce("tier", F.lit("pro"))).when(down, "free")
    changed = events.withColumn("__to", to)
    return changed.groupBy("user").agg(F.coalesce(F.max_by("__to", F.when(F.col("__to").isNotNull(), F.struct("at", "id"))), F.lit("free")).alias("tier"))
