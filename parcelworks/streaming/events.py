"""Streams of logins and subscription events with state and timers, equal to their batch forms on the same events.

Events may come late and out of order: they wait in a key's state until the watermark has passed them, told by a timer, and are then
taken in order of time and id.  State that says no more than a new key's would is cleared, so it does not grow with the users ever seen.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from parcelworks.streaming.limiter import KEEPS, LOSES


class Ordered(StatefulProcessor):
    """Holds a key's events until the watermark has passed them and hands them on in order; subclasses say what to do with each.

    An event at or before the watermark is handed on with the next timer.  WAITING: the events' columns without the key; at is microseconds.
    """

    WAITING: StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)

    def arrived(self, key: tuple, rows) -> None:
        for batch in rows:
            own = [(int(r.ts.value // 1000), *(getattr(r, c) for c in self.WAITING.names[1:])) for r in batch.itertuples(index=False)]
            if own:
                self.waiting.appendList([tuple(None if v is None or v is pd.NaT or v != v else v for v in r) for r in own])
                for at in {r[0] for r in own}:
                    self.handle.registerTimer(max(at // 1000, 0) + 1)

    def due(self, upto_ms: int) -> list[tuple]:
        """Events that the watermark has passed, in order; the others keep waiting."""
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1]))
        ready = [r for r in held if r[0] // 1000 < upto_ms]
        rest = held[len(ready) :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        return ready

    def handleInputRows(self, key, rows, timerValues):
        self.arrived(key, rows)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ready = self.due(timerValues.getCurrentWatermarkInMs())
        if ready:
            yield self.handled(key, ready)

    def handled(self, key: tuple, events: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Lockout(Ordered):
    """So many failures in a row lock a user for some minutes; see limiter.lockouts."""

    WAITING = StructType([StructField("at", LongType()), StructField("id", LongType()), StructField("ok", BooleanType())])
    OUTPUT = StructType([StructField("user", StringType()), StructField("id", LongType()), StructField("ts", TimestampType()), StructField("ok", BooleanType()), StructField("blocked", BooleanType()), StructField("locked_until", TimestampType())])

    def __init__(self, failures: int, minutes: int):
        self.failures, self.lock = failures, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", StructType([StructField("count", LongType()), StructField("until", LongType())]))

    def handled(self, key, events):
        count, until = tuple(self.state.get()) if self.state.exists() else (0, None)
        out = []
        for at, id_, ok in events:
            blocked = until is not None and at < until
            if not blocked:
                count = 0 if ok else count + 1
                until = at + self.lock if count >= self.failures else None
            out.append((key[0], id_, pd.Timestamp(at, unit="us"), ok, blocked, pd.Timestamp(until, unit="us") if until is not None else pd.NaT))
        if count:
            self.state.update((count, until))
        else:  # as if the user had never failed
            self.state.clear()
        return pd.DataFrame(out, columns=self.OUTPUT.names)


def lockout_stream(attempts: DataFrame, failures: int = 5, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """attempts: streaming (user string, id bigint, ts timestamp, ok boolean) -> with blocked and locked_until, as limiter.lockouts gives them.

    An attempt comes out once the watermark, the latest time less ``late``, has passed it.
    """
    rows = attempts.select(F.col("user").cast("string").alias("user"), F.col("id").cast("bigint").alias("id"), "ts", "ok").withWatermark("ts", late)
    return rows.groupBy("user").transformWithStateInPandas(Lockout(failures, minutes), Lockout.OUTPUT, "Append", "EventTime")


#: What is read of a webhook's event.
EVENT = "id string, type string, created bigint, data struct<object: struct<customer: string, client_reference_id: string, status: string, metadata: struct<tier: string>>>"


def parsed_events(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(user, id, ts, type, status, tier) of webhook bodies as JSON; what is no JSON, or names no user or type, is left out.

    The user is the checkout's reference, else the customer.
    """
    e = F.from_json(F.col(body), EVENT)
    own = bodies.select(e.alias("e")).select("e.*")
    thing = F.col("data.object")
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = own.select(
        F.coalesce(given(thing["client_reference_id"]), given(thing["customer"])).alias("user"), "id", F.timestamp_seconds("created").alias("ts"), "type", thing["status"].alias("status"), given(thing["metadata"]["tier"]).alias("tier"),
    )
    return out.filter(F.col("user").isNotNull() & F.col("type").isNotNull() & F.col("ts").isNotNull())


def tier_change(kind: Column, status: Column, tier: Column) -> Column:
    """The tier that an event gives; null if it changes none (failed payments among them)."""
    up = (kind == "checkout.session.completed") | ((kind == "customer.subscription.updated") & status.isin(*KEEPS))
    down = (kind == "customer.subscription.deleted") | ((kind == "customer.subscription.updated") & status.isin(*LOSES))
    return F.when(up, F.coalesce(tier, F.lit("pro"))).when(down, "free")


class Tiers(Ordered):
    """A row a change of a user's tier; see limiter.subscription_tiers."""

    WAITING = StructType([StructField("at", LongType()), StructField("id", StringType()), StructField("tier", StringType())])
    OUTPUT = StructType([StructField("user", StringType()), StructField("id", StringType()), StructField("ts", TimestampType()), StructField("tier", StringType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tier = handle.getValueState("tier", StructType([StructField("tier", StringType())]))

    def handled(self, key, events):
        now = self.tier.get()[0] if self.tier.exists() else "free"
        out = []
        for at, id_, tier in events:
            if tier != now:
                now = tier
                out.append((key[0], id_, pd.Timestamp(at, unit="us"), tier))
        if now == "free":
            self.tier.clear()
        else:
            self.tier.update((now,))
        return pd.DataFrame(out, columns=self.OUTPUT.names)


def tier_stream(bodies: DataFrame, late: str = "1 hour", body: str = "body") -> DataFrame:
    """A user's changes of tier (user, id, ts, tier) from a stream of webhook bodies; the last one is what subscription_tiers gives."""
    own = parsed_events(bodies, body)
    rows = own.select("user", "id", "ts", tier_change(F.col("type"), F.col("status"), F.col("tier")).alias("tier")).filter("tier IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("user").transformWithStateInPandas(Tiers(), Tiers.OUTPUT, "Append", "EventTime")
