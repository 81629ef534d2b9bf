"""Exact nearest vectors through cluster lists: rows in cells round centres, cells in bands of distance, bands left out by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.functions.text import found
from parcelworks.operators.similarity import _nearest, _unit
from parcelworks.storage import broadcast_if_small, stored

#: Centres; rows of the sample that they are fitted on, by hash of the id; rounds of fitting.
CENTRES, SAMPLE, ROUNDS = 128, 4096, 5
#: Bands of a cell by distance from its centre (0 to 2), rows of a list, and queries that meet a list at once.
BANDS, LIST_ROWS, LIST_QUERIES = 16, 8192, 2048
#: By how much a similarity and a bound may be off through rounding.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.compute.list_flatten(flat).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(vectors: DataFrame, id_: str, vector: str, dim: int) -> DataFrame:
    """(id, v) of rows whose vector has dim finite components that are not all zero."""
    rows = vectors.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.filter((F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0))


@dataclass
class VectorIndex:
    """Stored lists (id, v, cell, band, part), the centres, and the directory: cell, band, parts, rows, least and greatest distance."""

    lists: DataFrame
    centres: np.ndarray
    directory: np.ndarray
    dim: int


def vector_index(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", dim: int | None = None, centres: int = CENTRES, sample: int = SAMPLE) -> VectorIndex:
    """Lists of all vectors of ``dim`` components (by default the length most frequent in the sample).

    The centres are fitted on the ``sample`` rows of the smallest hashes; every row is listed.  The directory has at most
    centres * BANDS rows.  A list of more than LIST_ROWS rows is cut in parts by hash of the id, so no cell is one task's.  Rows
    with null, NaN or infinite components, zero vectors and those of another length are in no list, as they are no neighbours.
    """
    size = F.size(F.col(vector))
    if dim is None:
        common = vectors.filter(size > 0).groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = common["n"] if common else 1
    rows = _usable(vectors, id_, vector, dim)
    held = [r.v for r in rows.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).select("v").collect()]
    own = _unit(np.array(held).reshape(-1, dim))[1]
    middle = own[:: max(1, len(own) // max(1, min(centres, len(own) // 4)))][:centres].copy()
    for _ in range(ROUNDS if len(own) else 0):
        near = np.argmax(own @ middle.T, axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, own)
        full = np.linalg.norm(sums, axis=1) > 0
        middle[full] = sums[full] / np.linalg.norm(sums[full], axis=1)[:, None]
    shared = vectors.sparkSession.sparkContext.broadcast(middle)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1), dim))[1]
            cell = np.argmax(unit @ shared.value.T, axis=1)
            far = np.linalg.norm(unit - shared.value[cell], axis=1)
            band = np.minimum(far * BANDS / 2, BANDS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(band), pa.array(far)], ["id", "v", "cell", "band", "far"])

    placed = stored(rows.mapInArrow(place, "id bigint, v array<double>, cell int, band int, far double"), "placed")
    parts = F.ceil(F.count("*") / LIST_ROWS).cast("int")
    cut = stored(placed.groupBy("cell", "band").agg(parts.alias("parts"), F.count("*").alias("rows"), F.min("far").alias("low"), F.max("far").alias("high")), "directory")
    lists = placed.join(F.broadcast(cut.select("cell", "band", "parts")), ["cell", "band"])  # at most centres * BANDS rows
    lists = lists.select("id", "v", "cell", "band", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    directory = np.array([tuple(r) for r in cut.orderBy("cell", "band").collect()], np.float64).reshape(-1, 6)
    return VectorIndex(lists, middle, directory, dim)


def _met(index: VectorIndex, pairs: DataFrame, k: int, queries: int) -> DataFrame:
    """(number, id, similarity) of the k best rows of every list for each query that meets it; pairs: number, v, cell, band."""
    groups = -(-max(queries, 1) // LIST_QUERIES)
    pairs = pairs.withColumn("many", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int"))
    wanted = stored(pairs.select("cell", "band", "many").distinct(), "wanted-lists")
    rows = index.lists.join(broadcast_if_small(wanted, 16), ["cell", "band"])
    parts = index.lists.sparkSession.createDataFrame([(int(c), int(b), int(p)) for c, b, p, *_ in index.directory], "cell int, band int, parts int")
    asked = pairs.join(F.broadcast(parts), ["cell", "band"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dim = index.dim

    def compare(own: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"number": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not own.num_rows or not asked.num_rows:
            return none
        q, similarity, ids = _nearest(own.select(["id", "v"]).to_batches(), _matrix(asked.column("v"), dim), k)
        return pa.table({"number": asked.column("number").take(pa.array(q)), "id": pa.array(ids), "similarity": pa.array(similarity)})

    by = ["cell", "band", "part", "many"]
    return rows.groupBy(*by).cogroup(asked.select(*by, "number", "v").groupBy(*by)).applyInArrow(compare, "number bigint, id bigint, similarity double")


def nearest(index: VectorIndex, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id_, similarity, nth, compared): for every row of queries (id_, vector) the k nearest by cosine, exact; ties go by id.

    A query first meets the nearest lists that hold k rows together; its k-th similarity there is a bar.  Then it meets those
    lists alone that can reach the bar: a row at distance r from its centre is at least |d - r| from a query at distance d, so a band
    gives a bound.  ``compared`` counts the rows that a query met.  Queries are rows all the way: none goes through the driver.
    Queries that can have no neighbours give no rows; repeated ones count each on their own.  Where vectors are spread evenly in all
    directions no list can be left out and vector_topk_each does the same with less to shuffle.
    """
    own = _usable(queries, id_, vector, index.dim).withColumn("number", F.monotonically_increasing_id())
    own = stored(own, "queries")
    shared = index.lists.sparkSession.sparkContext.broadcast((index.centres, index.directory))

    def lists_of(first: bool):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, directory = shared.value
            cell = directory[:, 0].astype(np.int64)
            for batch in batches:
                vectors, bars = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
                unit = _unit(_matrix(vectors, centres.shape[1]))[1]
                for low in range(0, len(unit), 512):
                    part = unit[low : low + 512]
                    away = np.sqrt(np.maximum(2 - 2 * part @ centres.T, 0))[:, cell]
                    least = np.maximum(np.maximum(away - directory[:, 5], directory[:, 4] - away), 0)
                    order = np.argsort(least, axis=1, kind="stable")
                    before = np.cumsum(directory[order, 3], axis=1) - directory[order, 3]
                    seed = np.zeros(least.shape, bool)
                    np.put_along_axis(seed, order, before < k, axis=1)
                    reach = 1 - np.maximum(least - 1e-6, 0) ** 2 / 2 + SLACK >= bars[low : low + 512, None]
                    q, d = np.nonzero(seed if first else reach & ~seed)
                    for at in range(0, len(q), 4096):
                        rows, of = pa.array(q[at : at + 4096] + low), directory[d[at : at + 4096]]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(rows), vectors.take(rows), pa.array(of[:, 0].astype(np.int32)), pa.array(of[:, 1].astype(np.int32)), pa.array(of[:, 3].astype(np.int64))],
                            ["number", "v", "cell", "band", "rows"],
                        )

        return choose

    kind = "number bigint, v array<double>, cell int, band int, rows bigint"
    n = own.count()
    near = stored(own.select("number", "v", F.lit(-2.0).alias("bar")).mapInArrow(lists_of(True), kind), "first-lists")
    first = stored(_met(index, near, k, n), "first-hits")
    place = Window.partitionBy("number").orderBy(F.desc("similarity"), "id")
    bars = first.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") == k).select("number", F.col("similarity").alias("bar"))
    barred = own.join(bars, "number", "left").select("number", "v", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
    rest = stored(barred.mapInArrow(lists_of(False), kind), "other-lists")
    hits = first.unionByName(_met(index, rest, k, n)).withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k)
    work = near.select("number", "rows").unionByName(rest.select("number", "rows")).groupBy("number").agg(F.sum("rows").alias("compared"))
    out = hits.join(own.select("number", F.col("id").alias("query_id")), "number").join(work, "number")
    return out.select("query_id", F.col("id").alias(id_), "similarity", "nth", "compared")


def hashed_vectors(rows: DataFrame, id_: str, text: str, dim: int = 64, vector: str = "embedding") -> DataFrame:
    """(id_, vector): words of three letters or more counted in ``dim`` components by hash, with a sign by hash, in every row.

    Counts are summed by row and component before anything is gathered, so a text of any length gives dim numbers.  Null texts
    and texts without words give zero vectors; repeated rows count each on their own.
    """
    numbered = rows.select(F.monotonically_increasing_id().alias("__row"), F.col(id_), F.col(text).alias("__text"))
    numbered = stored(numbered, "texts")
    words = numbered.select("__row", F.explode(found(F.lower(F.coalesce("__text", F.lit(""))), "([a-z]{3,})")).alias("w"))
    digest = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint")
    signed = words.select("__row", (digest % dim).cast("int").alias("i"), F.when(F.floor(digest / dim) % 2 == 0, 1).otherwise(-1).alias("s"))
    sums = signed.groupBy("__row", "i").agg(F.sum("s").alias("s")).groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    return numbered.select("__row", id_).join(sums, "__row", "left").select(id_, every.alias(vector))
