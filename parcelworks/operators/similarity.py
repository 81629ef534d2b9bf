"""Set and vector similarity with top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.functions import text as T


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two arrays of distinct values; 0 if one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def vector_topk(vectors: DataFrame, query: list[float], k: int = 10, id_: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest vectors by cosine, exact; ``where`` filters on metadata before the ranking."""
    own = vectors if where is None else vectors.filter(where)
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = own.select(id_, cosine(F.col(vector), wanted).alias("similarity")).filter("similarity IS NOT NULL")
    return scored.orderBy(F.desc("similarity"), id_).limit(k)


#: Queries sent to the tasks at once; queries and rows of a tile of similarities; rounding by which a tile's products may differ.
QUERIES, TILE, ROWS, MARGIN = 4096, 256, 4096, 1e-9


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows, and the rows over them.  Sums run in the order of the columns, as in cosine()."""
    square = np.zeros(len(m))
    for j in range(m.shape[1]):
        square += m[:, j] * m[:, j]
    norm = np.sqrt(square)
    return norm, m / np.where(norm > 0, norm, 1.0)[:, None]


def _best(q: np.ndarray, similarity: np.ndarray, ids: np.ndarray, k: int):
    """The k rows a query that come first by similarity (descending) and id."""
    order = np.lexsort((ids, -similarity, q))
    q, similarity, ids = q[order], similarity[order], ids[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], similarity[keep], ids[keep]


def _nearest(batches: Iterator[pa.RecordBatch], queries: np.ndarray, k: int):
    """(query's row, similarity, id) of the k nearest of all batches (id, vector), for each query."""
    q_norm, q_unit = _unit(queries)
    none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    best, least = [none] * -(-len(queries) // TILE), np.full(len(queries), -np.inf)
    for batch in batches:
        own = pa.Table.from_batches([batch]).combine_chunks()
        fits = pa.compute.equal(pa.compute.list_value_length(own.column(1)), queries.shape[1]).fill_null(False)
        own = own.filter(fits)
        for low in range(0, own.num_rows, ROWS):
            part = own.slice(low, ROWS)
            ids = part.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            flat = pa.compute.list_flatten(part.column(1)).cast(pa.float64()).to_numpy()
            rows = flat.reshape(-1, queries.shape[1])
            norm, unit = _unit(rows)
            good = norm > 0  # neither zero nor NaN
            ids, rows, norm, unit = ids[good], rows[good], norm[good], unit[good]
            if not len(ids):
                continue
            for t, start in enumerate(range(0, len(queries), TILE)):
                about = q_unit[start : start + TILE] @ unit.T
                bar = least[start : start + TILE]
                if len(ids) >= k:
                    bar = np.maximum(bar, np.partition(about, -k, axis=1)[:, -k])
                q, v = np.nonzero(about >= bar[:, None] - MARGIN)
                q += start
                dot = np.zeros(len(q))
                for j in range(queries.shape[1]):  # one order of summing, so equal vectors tie
                    dot += rows[v, j] * queries[q, j]
                found = (q, dot / (norm[v] * q_norm[q]), ids[v])
                best[t] = _best(*[np.concatenate(x) for x in zip(best[t], found)], k)
                n = np.bincount(best[t][0] - start, minlength=min(TILE, len(queries) - start))
                full = np.flatnonzero(n == k)
                least[start + full] = best[t][1][np.cumsum(n)[full] - 1]
    return [np.concatenate(x) for x in zip(*best)]


def _query_blocks(queries: DataFrame, id_: str, vector: str, size: int) -> Iterator[tuple[int, list, np.ndarray]]:
    """(number of the first, ids, matrix) of blocks of the queries; the driver holds one block.  Zero and null vectors have no neighbours."""
    held: dict[int, list] = {}
    number = 0
    for key, values in queries.select(id_, F.col(vector).cast("array<double>")).toLocalIterator():
        if not values or None in values or not any(values):
            continue
        own = held.setdefault(len(values), [])
        own.append((key, values))
        if len(own) == size:
            yield number, [x[0] for x in own], np.array([x[1] for x in own])
            number, held[len(values)] = number + size, []
    for own in held.values():
        if own:
            yield number, [x[0] for x in own], np.array([x[1] for x in own])
            number += len(own)


def vector_topk_each(vectors: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding", size: int = QUERIES) -> DataFrame:
    """(query_id, id_, similarity, nth): for every row of queries the k nearest vectors by cosine, exact; ties go by id.

    Both frames have id_ (integers) and vector.  Queries come in broadcast blocks of ``size``; a task keeps k rows a query, and a
    group-limited window takes the first k of the tasks' rows.  Zero vectors, and those of another length, are no neighbours.
    """
    kind = "number bigint, query_id bigint, id bigint, similarity double"
    found = None
    for number, keys, matrix in _query_blocks(queries, id_, vector, size):
        held = vectors.sparkSession.sparkContext.broadcast((number, keys, matrix))

        def near(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            number, keys, matrix = held.value
            q, similarity, ids = _nearest(batches, matrix, k)
            lost = ids == np.iinfo(np.int64).min
            columns = [pa.array(q + number), pa.array(keys, pa.int64()).take(pa.array(q)), pa.array(ids, mask=lost), pa.array(similarity)]
            yield pa.RecordBatch.from_arrays(columns, ["number", "query_id", "id", "similarity"])

        hits = vectors.select(F.col(id_).cast("bigint"), F.col(vector).cast("array<double>")).mapInArrow(near, kind)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], kind)
    nth = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k).select("query_id", F.col("id").alias(id_), "similarity", "nth")


def token_overlap(rows: DataFrame, queries: DataFrame, id_: str, query_id: str, tokens: str = "tokens", bound: int = 100_000) -> DataFrame:
    """(id_, query_id, common, whole) of every row and query whose sets of tokens (arrays of distinct values) meet.

    The queries' tokens are an inverted list, broadcast if it has at most ``bound`` entries.  A row's tokens are counted
    where they are, so a frequent token makes no task large.  Repeated rows and queries count each on their own.
    """
    # the numbers are given before the explode, else every token would get one
    lists = queries.select(F.monotonically_increasing_id().alias("__q"), query_id, F.size(tokens).alias("__m"), F.col(tokens).alias("__tokens"))
    lists = lists.withColumn("__token", F.explode("__tokens")).drop("__tokens")
    lists = F.broadcast(lists) if lists.limit(bound + 1).count() <= bound else lists
    own = rows.select(F.monotonically_increasing_id().alias("__row"), id_, F.size(tokens).alias("__n"), F.col(tokens).alias("__tokens"))
    own = own.withColumn("__token", F.explode("__tokens")).drop("__tokens")
    met = own.join(lists, "__token").groupBy("__row", "__q", id_, query_id, "__n", "__m").agg(F.count("*").alias("common"))
    return met.select(id_, query_id, "common", (F.col("__n") + F.col("__m") - F.col("common")).alias("whole"))


def novelty(rows: DataFrame, queries: DataFrame, id_: str, query_id: str, tokens: str = "tokens", known: float = 0.2) -> DataFrame:
    """For every query its verdict against all rows: (query_id, docs, similar, mean_hits, share, verdict).

    similar counts the rows that share a token with the query, mean_hits is the mean number of tokens shared over all rows.
    A query that shares tokens with at most ``known`` of the rows is novel.  Pairs without a common token are never built.
    """
    docs = rows.agg(F.count("*").alias("docs"))  # one row
    met = token_overlap(rows, queries, id_, query_id, tokens).groupBy(query_id).agg(F.count("*").alias("similar"), F.sum("common").alias("__hits"))
    out = queries.select(query_id).join(met, query_id, "left").crossJoin(F.broadcast(docs)).na.fill(0, ["similar", "__hits"])
    share = F.when(F.col("docs") > 0, F.col("similar") / F.col("docs")).otherwise(0.0)
    mean = F.when(F.col("docs") > 0, F.col("__hits") / F.col("docs")).otherwise(0.0)
    return out.select(query_id, "docs", "similar", mean.alias("mean_hits"), share.alias("share"), F.when(share <= known, "novel").otherwise("known").alias("verdict"))


#: Weights of the parts of legal similarity (fixed values).
WEIGHTS = {"trs": 40.0, "text": 25.0, "cab": 20.0, "names": 10.0, "lot_block": 5.0}


def legal_parts(frame: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Adds what two descriptions are compared by: trs, township, tokens, cabs, names, lots, each an array."""
    c = F.col(column)
    trs = T.trs_fingerprints(c)
    return frame.withColumns({
        f"{prefix}trs": trs,
        f"{prefix}township": F.array_distinct(F.transform(trs, lambda t: F.regexp_replace(t, r"-S[^-]*$", ""))),
        f"{prefix}tokens": T.legal_tokens(c),
        f"{prefix}cabs": T.cabinet_refs(c),
        f"{prefix}names": T.legal_names(c),
        f"{prefix}lots": T.lot_block_tract(c),
    })


def legal_score(a: str = "a_", b: str = "b_", weights: dict[str, float] | None = None) -> dict[str, Column]:
    """Parts from 0 to 100 and their weighted mean, of columns made by legal_parts with two prefixes."""
    w = WEIGHTS | (weights or {})
    c = lambda side, name: F.col(f"{side}{name}")
    both = lambda name: F.size(F.array_intersect(c(a, name), c(b, name)))
    some = lambda name: (F.size(c(a, name)) > 0) & (F.size(c(b, name)) > 0)
    trs = F.when(both("trs") > 0, 100.0).when(some("trs") & (both("township") > 0), 30.0).otherwise(0.0)
    text = jaccard(c(a, "tokens"), c(b, "tokens")) * 100.0
    cab = F.when(both("cabs") > 0, 100.0).otherwise(0.0)
    names = F.when(some("names"), both("names") / F.least(F.size(c(a, "names")), F.size(c(b, "names"))) * 100.0).otherwise(0.0)
    lots = F.when(both("lots") > 0, 100.0).otherwise(0.0)
    total = sum(w.values())
    score = (trs * w["trs"] + text * w["text"] + cab * w["cab"] + names * w["names"] + lots * w["lot_block"]) / total
    return {"trs_match": trs, "text_similarity": text, "cab_overlap": cab, "name_overlap": names, "lot_block_match": lots, "score": score}


def similar_descriptions(frame: DataFrame, query: str, column: str = "description", least: float = 20.0, limit: int = 20, pos: str = "pos") -> DataFrame:
    """Rows whose description is like the query: score (1 decimal) of at least ``least``, best first, then in listing order.

    Descriptions under ten characters are left out.  The query's parts are constants of one row.
    """
    spark = frame.sparkSession
    one = legal_parts(spark.createDataFrame([(query or "",)], "__q string"), "__q", "b_").drop("__q")
    own = legal_parts(frame.filter(F.length(F.trim(column)) >= 10), column, "a_")
    parts = legal_score()
    scored = own.crossJoin(F.broadcast(one)).withColumns({k: F.round(v, 1) for k, v in parts.items()})  # one row
    keep = [*frame.columns, *parts]
    return scored.select(*keep).filter(F.col("score") >= least).orderBy(F.desc("score"), pos).limit(limit)
