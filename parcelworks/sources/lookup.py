"""Attributes and outlines of parcels by key from a feature service, a bounded batch of keys a request.

``keyed_lookup`` is a data source for a filter on the key (`upc = …`, `upc IN (…)`): the filter's keys become batches, a
batch a partition.  ``looked_up`` serves a table of keys of any size: tasks ask for their own keys and nothing passes through the driver.
A request that fails costs its own batch alone.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Keys of a request, seconds between two requests of a task, seconds until a request is given up.
BATCH, DELAY, TIMEOUT = 40, 0.25, 20.0


@dataclass(frozen=True)
class Service:
    """Where a feature service is and how it names things: fields maps our column to its field, the first one is the key."""

    url: str
    fields: tuple[tuple[str, str], ...]
    geometry: bool = False
    batch: int = BATCH
    delay: float = DELAY
    timeout: float = TIMEOUT

    @classmethod
    def of(cls, options: dict) -> Service:
        """From a reader's options: url, fields (`upc=UPC,owner=OWNER_1`), and as wanted geometry, batch, delay, timeout."""
        fields = tuple(tuple(p.strip() for p in pair.split("=", 1)) for pair in options["fields"].split(",") if pair.strip())
        return cls(options["url"], fields, str(options.get("geometry", "false")).lower() == "true", int(options.get("batch", BATCH)), float(options.get("delay", DELAY)), float(options.get("timeout", TIMEOUT)))

    @property
    def columns(self) -> list[str]:
        return [name for name, _ in self.fields] + ["geometry"] * self.geometry

    def request(self, keys: list[str]) -> list[tuple[str | None, ...]]:
        """The rows of some keys: the fields as text, then the outline as JSON."""
        listed = ",".join("'" + k.replace("'", "''") + "'" for k in keys)
        asked = {"where": f"{self.fields[0][1]} IN ({listed})", "outFields": ",".join(f for _, f in self.fields), "returnGeometry": str(self.geometry).lower(), "f": "json"}
        body = urllib.parse.urlencode(asked).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body), timeout=self.timeout) as answer:
            found = json.load(answer)
        if "error" in found:
            raise OSError(str(found["error"]))
        rows = []
        for feature in found.get("features", []):
            own = feature.get("attributes") or {}
            text = [None if own.get(f) is None else str(own[f]).strip() for _, f in self.fields]
            rows.append((*text, json.dumps(feature["geometry"]) if feature.get("geometry") else None) if self.geometry else tuple(text))
        return rows

    def rows(self, batches: Iterator[list[str]]) -> Iterator[tuple[list[tuple[str | None, ...]], str | None]]:
        """For each batch of keys its rows, or none and what went wrong; a pause before all requests but the first."""
        for n, keys in enumerate(batches):
            if n:
                time.sleep(self.delay)
            try:
                yield self.request(keys), None
            except (OSError, ValueError) as error:  # no answer, a refusal, or no JSON
                yield [], f"{type(error).__name__}: {error}"


@dataclass
class Keys(InputPartition):
    keys: tuple[str, ...]


class KeyedReader(DataSourceReader):
    """Takes over filters on the key; without one there is nothing to ask for, so it refuses to plan."""

    def __init__(self, service: Service):
        self.service = service
        self.keys: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        key = (self.service.fields[0][0],)
        for f in filters:
            asked = [f.value] if isinstance(f, EqualTo) and f.attribute == key else list(f.value) if isinstance(f, In) and f.attribute == key else None
            if asked is None:
                yield f
            else:
                own = dict.fromkeys(str(k) for k in asked if k is not None)
                self.keys = sorted(own) if self.keys is None else [k for k in self.keys if k in own]

    def partitions(self) -> list[InputPartition]:
        if self.keys is None:
            raise ValueError(f"keyed_lookup needs a filter on {self.service.fields[0][0]}")
        return [Keys(tuple(self.keys[i : i + self.service.batch])) for i in range(0, len(self.keys), self.service.batch)] or [Keys(())]

    def read(self, partition: Keys) -> Iterator[tuple]:
        if partition.keys:
            time.sleep(self.service.delay)
            for rows, _ in self.service.rows(iter([list(partition.keys)])):
                yield from rows


class KeyedLookup(DataSource):
    """spark.read.format("keyed_lookup").options(url=…, fields="upc=UPC,owner=OWNER").load().filter(col("upc").isin(…))

    Load anew for each query: Spark keeps a frame's reader, and with it the keys of its last filter.
    """

    @classmethod
    def name(cls) -> str:
        return "keyed_lookup"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in Service.of(self.options).columns)

    def reader(self, schema) -> KeyedReader:
        return KeyedReader(Service.of(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyedLookup)


def looked_up(keys: DataFrame, service: Service) -> DataFrame:
    """The rows that the service has for a table of keys (its first column), and error for keys whose batch failed.

    A key is asked for once; a failed batch gives a row a key with its error, so it can be asked for again; keys that the service
    doesn't know have no row; nulls and empty keys are not asked for.
    """
    key = service.fields[0][0]
    own = keys.select(F.trim(F.col(keys.columns[0]).cast("string")).alias(key)).filter(F.length(key) > 0).distinct()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grouped() -> Iterator[list[str]]:
            held: list[str] = []
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    held.append(k)
                    if len(held) == service.batch:
                        asked.append(held)
                        yield held
                        held = []
            if held:
                asked.append(held)
                yield held

        asked: list[list[str]] = []
        width = len(service.columns)
        for rows, error in service.rows(grouped()):
            some = asked.pop()
            full = [(*r, None) for r in rows] if error is None else [(k, *[None] * (width - 1), error) for k in some]
            columns = list(zip(*full)) if full else [[]] * (width + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [*service.columns, "error"])

    return own.mapInArrow(ask, ", ".join(f"{c} string" for c in [*service.columns, "error"]))


def outline(geometry):
    """array<struct<lng,lat>> of the first ring of an outline as JSON; null for anything else."""
    rings = F.from_json(geometry, "struct<rings: array<array<array<double>>>>")["rings"]
    return F.transform(F.get(rings, 0), lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat")))
