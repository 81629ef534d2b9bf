"""Neighbour joins: near boxes by a grid, rings within a distance, keys in a band, centroids in a box."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

THRESHOLD = 0.0003
RADIUS = 0.002


def cells(low: Column, high: Column, size: float) -> Column:
    """The grid cells that an interval touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def box_pairs(boxes: DataFrame, margin: float, size: float | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of boxes (id, x0, y0, x1, y1) that overlap when one of them is widened by margin.

    Boxes are dealt to grid cells and meet in an equi-join on the cell.  A pair is taken only in the cell that
    holds the lower left corner of where the widened boxes overlap, so no distinct is needed.  Cells should be
    about as large as a box; with smaller ones a box goes to more cells, with larger ones more pairs are tested.
    """
    size = size or max(4 * margin, 1e-9)
    half = margin / 2
    wide = boxes.select("id", *[(F.col(c) - half).alias(c) for c in ("x0", "y0")], *[(F.col(c) + half).alias(c) for c in ("x1", "y1")])
    dealt = wide.withColumn("gx", F.explode(cells(F.col("x0"), F.col("x1"), size))).withColumn("gy", F.explode(cells(F.col("y0"), F.col("y1"), size)))
    a, b = dealt.alias("a"), dealt.alias("b")
    c = F.col
    over = (c("a.x0") <= c("b.x1")) & (c("b.x0") <= c("a.x1")) & (c("a.y0") <= c("b.y1")) & (c("b.y0") <= c("a.y1"))
    here = (F.floor(F.greatest("a.x0", "b.x0") / size) == c("a.gx")) & (F.floor(F.greatest("a.y0", "b.y0") / size) == c("a.gy"))
    met = a.join(b, (c("a.gx") == c("b.gx")) & (c("a.gy") == c("b.gy")) & (c("a.id") < c("b.id")) & over & here)
    return met.select(c("a.id").alias("a"), c("b.id").alias("b"))


def near_points(points: DataFrame, radius: float) -> DataFrame:
    """Pairs (a, b), a < b, of points (id, x, y) that differ by less than radius in both axes.

    A point meets those of its own grid cell and of half of the cells around it, so each pair is seen once.  Coordinates are
    compared in their own type: between floats the radius is a float too, so that a distance of just the radius isn't below it.
    Cells are a little wider than the radius, so that rounding moves no pair two cells apart.
    """
    size = radius * (1 + 1e-6)
    cell = points.select("id", "x", "y", F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy"))
    within = lambda n: F.lit(radius).cast(points.schema[n].dataType if isinstance(points.schema[n].dataType, FloatType) else DoubleType())
    steps = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
    to = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    sent = cell.withColumn("d", to).select("id", "x", "y", (F.col("gx") + F.col("d.dx")).alias("gx"), (F.col("gy") + F.col("d.dy")).alias("gy"), ((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("own"))
    a, b, c = sent.alias("a"), cell.alias("b"), F.col
    near = (F.abs(c("a.x") - c("b.x")) < within("x")) & (F.abs(c("a.y") - c("b.y")) < within("y")) & (~c("a.own") | (c("a.id") < c("b.id"))) & (c("a.id") != c("b.id"))
    met = a.join(b, (c("a.gx") == c("b.gx")) & (c("a.gy") == c("b.gy")) & near)
    return met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def band_pairs(frame: DataFrame, key: str, value: str, width: float, id_: str = "id") -> DataFrame:
    """Pairs (a, b), a < b by id, with an equal key and values at most ``width`` apart.

    A key's rows are cut into bands of the width; a row meets its own band and the next one, so a hot key is
    spread over as many join keys as it has bands.
    """
    rows = frame.select(F.col(id_).alias("id"), F.col(key).alias("k"), F.col(value).alias("v"), F.floor(F.col(value) / width).alias("band"))
    sent = rows.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("up"))
    a, b, c = sent.alias("a"), rows.alias("b"), F.col
    met = a.join(b, (c("a.k") == c("b.k")) & (c("a.band") == c("b.band")) & (F.abs(c("a.v") - c("b.v")) <= width) & (c("a.id") != c("b.id")) & ((c("a.up") == 1) | (c("a.id") < c("b.id"))))
    return met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def key_neighbours(parcels: DataFrame, upc: str, prefix: int = 10, away: int = 8, limit: int = 12) -> DataFrame:
    """Parcels whose upc starts alike and differs by at most ``away`` as a number, in listing order."""
    number = F.try_to_number(F.col("upc"), F.lit("9" * 30)).cast("decimal(38,0)")
    near = (F.substring("upc", 1, prefix) == upc[:prefix]) & (F.abs(number - F.lit(int(upc)).cast("decimal(38,0)")) <= away) & (F.col("upc") != upc)
    return parcels.filter(near).orderBy("pos").limit(limit)


def key_neighbours_each(parcels: DataFrame, queries: DataFrame, prefix: int = 10, away: int = 8, limit: int = 12) -> DataFrame:
    """For each of queries (upc) the parcels that key_neighbours gives, as a join on the prefix and bands of the number; adds query."""
    number = F.try_to_number(F.col("upc"), F.lit("9" * 30)).cast("decimal(38,0)")
    rows = parcels.filter(F.length("upc") >= prefix).withColumns({"__n": number, "__p": F.substring("upc", 1, prefix)}).filter("__n IS NOT NULL")
    asked = queries.select(F.col("upc").alias("query"), number.alias("__q"), F.substring("upc", 1, prefix).alias("__qp")).distinct()
    band = lambda c: F.floor(F.col(c) / (away + 1))
    sent = asked.withColumn("__band", F.explode(F.array(band("__q") - 1, band("__q"), band("__q") + 1)))
    near = (F.abs(F.col("__n") - F.col("__q")) <= away) & (F.col("upc") != F.col("query"))
    met = rows.withColumn("__rb", band("__n")).join(sent, (F.col("__p") == F.col("__qp")) & (F.col("__rb") == F.col("__band")) & near)
    nth = F.row_number().over(Window.partitionBy("query").orderBy("pos"))
    return met.withColumn("__nth", nth).filter(F.col("__nth") <= limit).select("query", *parcels.columns)


def _segment_distances(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Least squared distance of any of the points to any of the segments a-b."""
    d = b - a
    size = (d * d).sum(axis=1)
    rel = p[:, None, :] - a[None, :, :]
    t = np.clip(np.divide((rel * d).sum(axis=2), size, out=np.zeros((len(p), len(a))), where=size > 0), 0, 1)
    off = rel - t[..., None] * d
    return float((off * off).sum(axis=2).min())


#: Vertices of a stretch of a ring at least, and stretches of a ring at most.
STRETCH, STRETCHES = 64, 1024


def _stretches(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(starts, lowest corners, highest corners, length) of the stretches of a ring; one ends where the next begins."""
    step = max(STRETCH, -(-len(v) // STRETCHES))
    starts = np.arange(0, max(1, len(v) - 1), step)
    ends = np.minimum(starts + step, len(v) - 1)
    low = np.minimum(np.minimum.reduceat(v, starts, axis=0), v[ends])
    high = np.maximum(np.maximum.reduceat(v, starts, axis=0), v[ends])
    return starts, low, high, step


def ring_distance(a: list, b: list) -> float:
    """Least distance between vertices of one ring and edges of the other, both ways, over all vertices.

    Rings are cut into stretches; pairs of stretches are looked at by the distance of their boxes, until that is no less than
    what was found.  So far stretches never meet, and memory grows with the rings, not with their product.
    """
    p, q = np.asarray(a, float).reshape(-1, 2), np.asarray(b, float).reshape(-1, 2)
    if not len(p) or not len(q) or len(p) + len(q) < 3:
        return float("inf")
    (ps, p0, p1, pn), (qs, q0, q1, qn) = _stretches(p), _stretches(q)
    gap = np.maximum(np.maximum(p0[:, None] - q1[None], q0[None] - p1[:, None]), 0)
    least = (gap * gap).sum(axis=2).ravel()
    best = float("inf")
    for k in np.argsort(least, kind="stable"):
        if least[k] >= best:
            break
        i, j = divmod(int(k), len(qs))
        own, other = p[ps[i] : ps[i] + pn + 1], q[qs[j] : qs[j] + qn + 1]
        if len(other) > 1:
            best = min(best, _segment_distances(own, other[:-1], other[1:]))
        if len(own) > 1:
            best = min(best, _segment_distances(other, own[:-1], own[1:]))
    return best**0.5


@F.pandas_udf(DoubleType())
def _ring_distances(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    return pd.Series([ring_distance(np.column_stack(r[:2]), np.column_stack(r[2:])) for r in zip(ax, ay, bx, by)], dtype="float64")


def ring_distance_of(a: Column, b: Column) -> Column:
    """ring_distance of two polygon columns, handed over as flat lists of numbers."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    axis = lambda ring, name: F.transform(ring, lambda p: p[name].cast("double"))
    return _ring_distances(axis(a, "lng"), axis(a, "lat"), axis(b, "lng"), axis(b, "lat"))


def with_box(parcels: DataFrame) -> DataFrame:
    """Adds x0, y0, x1, y1 of polygon array<struct<lng,lat>>."""
    axis = lambda name: F.transform("polygon", lambda p: p[name])
    return parcels.withColumns({"x0": F.array_min(axis("lng")), "y0": F.array_min(axis("lat")), "x1": F.array_max(axis("lng")), "y1": F.array_max(axis("lat"))})


def adjacent_pairs(parcels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs (a, b, distance) of parcels (upc, polygon) whose rings come within threshold of each other.

    Boxes with a margin of twice the threshold meet on the grid first; only those pairs get the exact distance.
    """
    rings = parcels.filter(F.size("polygon") >= 3)
    boxes = with_box(rings).select(F.col("upc").alias("id"), "x0", "y0", "x1", "y1")
    pairs = box_pairs(boxes, 2 * threshold, max(0.002, 4 * threshold))
    own = rings.select("upc", "polygon")
    met = pairs.join(own.select(F.col("upc").alias("a"), F.col("polygon").alias("__p")), "a").join(own.select(F.col("upc").alias("b"), F.col("polygon").alias("__q")), "b")
    return met.withColumn("distance", ring_distance_of("__p", "__q")).filter(F.col("distance") <= threshold).select("a", "b", "distance")


def find_adjacent(parcels: DataFrame, upc: str, limit: int = 20, threshold: float = THRESHOLD) -> DataFrame:
    """Neighbours of one parcel, nearest first, with _adjacency_dist and _adjacency_type.

    Without a ring of its own the parcel's centroid is used: the first ``limit`` centroids in listing order within
    RADIUS, then ordered by distance.
    """
    client = parcels.filter(F.col("upc") == upc).orderBy("pos").limit(1)
    one = with_box(client).select(*[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")], F.col("polygon").alias("__ring"), F.col("centroid").alias("__c"))
    others = with_box(parcels.filter((F.col("upc") != upc) | F.col("upc").isNull())).crossJoin(F.broadcast(one))  # one row
    m = 2 * threshold
    c = F.col
    close = (c("x0") <= c("__x1") + m) & (c("__x0") <= c("x1") + m) & (c("y0") <= c("__y1") + m) & (c("__y0") <= c("y1") + m)
    has_ring = F.size("__ring") >= 3
    own = [x for x in parcels.columns]
    by_edge = others.filter(has_ring & (F.size("polygon") >= 3) & close).withColumn("_adjacency_dist", ring_distance_of("polygon", "__ring"))
    by_edge = by_edge.filter(c("_adjacency_dist") <= threshold).select(*own, "_adjacency_dist", F.lit("edge").alias("_adjacency_type"))
    dx, dy = c("centroid.lng") - c("__c.lng"), c("centroid.lat") - c("__c.lat")
    by_centre = others.filter(~F.coalesce(has_ring, F.lit(False)) & (F.abs(dx) < RADIUS) & (F.abs(dy) < RADIUS))
    by_centre = by_centre.orderBy("pos").limit(limit).select(*own, F.hypot(dx, dy).alias("_adjacency_dist"), F.lit("centroid").alias("_adjacency_type"))
    return by_edge.unionByName(by_centre).orderBy("_adjacency_dist", "pos").limit(limit)
