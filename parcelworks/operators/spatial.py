"""Polygon joins over edges dealt to a grid: points in polygons, and how polygons of two tables lie to each other.

A polygon is an array<struct<lng,lat>> of at least three points, closed or not, a simple ring; others are left out.  Its edges
are rows.  A row of grid cells (a strip) holds all edges that a level line in it can cross, so a point is judged by the edges
of the polygon's strip alone; edges of two polygons meet in the cells that both pass.  All joins are on strips and cells,
so a ring of a hundred thousand edges spreads over many tasks and none is gathered.  What is nearer than the tolerance lies on the boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.storage import broadcast_if_small, stored

TOLERANCE = 1e-9
#: The most parcels of a spatial query, and the letters of a legal text that it gives.
SPATIAL_LIMIT, LEGAL_LETTERS = 100, 200


def edges(polygons: DataFrame, id_: str = "id") -> DataFrame:
    """(id, k, ax, ay, bx, by): the edges of each ring that have a length, the closing one included."""
    ring = F.col("polygon")
    fine = (F.size(ring) >= 3) & F.forall(ring, lambda p: p.isNotNull() & p["lng"].isNotNull() & p["lat"].isNotNull() & ~F.isnan(p["lng"]) & ~F.isnan(p["lat"]))
    shifted = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))
    own = polygons.filter(F.col(id_).isNotNull() & fine).select(F.col(id_).alias("id"), F.posexplode(F.arrays_zip(ring.alias("a"), shifted.alias("b"))).alias("k", "e"))
    flat = own.select("id", "k", F.col("e.a.lng").alias("ax"), F.col("e.a.lat").alias("ay"), F.col("e.b.lng").alias("bx"), F.col("e.b.lat").alias("by"))
    return flat.filter("ax <> bx OR ay <> by")


def cell_size(rows: DataFrame) -> float:
    """A cell as large as polygons are on the average, at least a hundred times the tolerance."""
    boxes = rows.groupBy("id").agg((F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx"))).alias("w"), (F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))).alias("h"))
    return max(boxes.agg(F.avg(F.greatest("w", "h"))).first()[0] or 1.0, 100 * TOLERANCE)


def _steps(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor((low - TOLERANCE) / size), F.floor((high + TOLERANCE) / size))


def strips(rows: DataFrame, size: float) -> DataFrame:
    """Every edge in each strip gy that it passes."""
    return rows.withColumn("gy", F.explode(_steps(F.least("ay", "by"), F.greatest("ay", "by"), size)))


def in_cells(rows: DataFrame, size: float) -> DataFrame:
    """Every edge in each cell (gx, gy) that it passes: in a strip, from where it comes in to where it goes out."""
    c, dy = F.col, F.col("by") - F.col("ay")
    at = lambda y: c("ax") + (c("bx") - c("ax")) * F.least(F.greatest((y - c("ay")) / F.nullif(dy, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    margin = TOLERANCE * (1 + F.abs((c("bx") - c("ax")) / F.nullif(dy, F.lit(0.0))))
    one, two = at(c("gy") * size), at((c("gy") + 1) * size)
    low = F.greatest(F.coalesce(F.least(one, two) - margin, F.least("ax", "bx")), F.least("ax", "bx"))
    high = F.least(F.coalesce(F.greatest(one, two) + margin, F.greatest("ax", "bx")), F.greatest("ax", "bx"))
    return strips(rows, size).withColumn("gx", F.explode(_steps(low, high, size)))


def _foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(share of the edge a-b at which a point's foot lies, within 0 and 1, squared distance of the point from there)."""
    dx, dy = bx - ax, by - ay
    t = F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    ox, oy = px - ax - t * dx, py - ay - t * dy
    return t, ox * ox + oy * oy


def judged(points: DataFrame, rows: DataFrame, size: float, *keys: str) -> DataFrame:
    """keys, side: whether points (keys, id of a polygon, x, y) lie inside, on the boundary or outside of the polygon; keys tell points apart."""
    c = F.col
    own = strips(rows, size).select("id", "gy", "ax", "ay", "bx", "by")
    met = points.withColumn("gy", F.floor(c("y") / size)).join(own, ["id", "gy"], "left")
    crosses = ((c("ay") > c("y")) != (c("by") > c("y"))) & (c("x") < (c("bx") - c("ax")) * (c("y") - c("ay")) / F.nullif(c("by") - c("ay"), F.lit(0.0)) + c("ax"))
    on = _foot(c("x"), c("y"), c("ax"), c("ay"), c("bx"), c("by"))[1] <= TOLERANCE**2
    sums = met.groupBy(*keys, "id").agg(F.count_if(crosses).alias("n"), F.max(F.coalesce(on, F.lit(False))).alias("on"))
    return sums.withColumn("side", F.when(c("on"), "boundary").when(c("n") % 2 == 1, "inside").otherwise("outside")).drop("n", "on")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float | None = None) -> DataFrame:
    """(point, id, side): for each of points (point, x, y) the polygons (id, polygon) that hold it, inside or on the boundary.

    Points that share a place are judged once.  A point first meets the polygons whose part in its strip spans its cell, then the edges of
    these in the strip.  Points without coordinates, and polygons that are none, are left out; so are repeated ids' differences: the edges of
    one id are one polygon.
    """
    rows = stored(edges(polygons), "edges")
    size = size or cell_size(rows)
    c = F.col
    places = points.filter(c("point").isNotNull() & c("x").isNotNull() & c("y").isNotNull() & ~F.isnan(c("x").cast("double")) & ~F.isnan(c("y").cast("double")))
    places = places.select("point", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))
    spans = strips(rows, size).groupBy("id", "gy").agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"))
    spans = spans.withColumn("gx", F.explode(_steps(c("x0"), c("x1"), size)))
    spots = places.select("x", "y").distinct().withColumn("gx", F.floor(c("x") / size)).withColumn("gy", F.floor(c("y") / size))
    near = spots.join(spans, ["gx", "gy"]).filter((c("x") >= c("x0") - TOLERANCE) & (c("x") <= c("x1") + TOLERANCE)).select("x", "y", "id")
    held = judged(near, rows, size, "x", "y").filter("side <> 'outside'")
    return places.join(held, ["x", "y"]).select("point", "id", "side")


def _contacts(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """(a, b, ka, kb, proper, of_a, of_b): edges that meet; of_a, of_b: shares of the edge where the other one touches it."""
    c = F.col
    a = in_cells(left, size).select("gx", "gy", c("id").alias("a"), c("k").alias("ka"), *[c(n).alias(f"p_{n}") for n in ("ax", "ay", "bx", "by")])
    b = in_cells(right, size).select("gx", "gy", c("id").alias("b"), c("k").alias("kb"), *[c(n).alias(f"q_{n}") for n in ("ax", "ay", "bx", "by")])
    met = a.join(b, ["gx", "gy"])
    p = [c(f"p_{n}") for n in ("ax", "ay", "bx", "by")]
    q = [c(f"q_{n}") for n in ("ax", "ay", "bx", "by")]
    box = lambda e, i: (F.least(e[i], e[i + 2]) - TOLERANCE, F.greatest(e[i], e[i + 2]) + TOLERANCE)
    for i in (0, 1):
        (p0, p1), (q0, q1) = box(p, i), box(q, i)
        met = met.filter((p0 <= q1) & (q0 <= p1))

    def off(e, x, y):
        """Signed distance of a point from an edge's line."""
        dx, dy = e[2] - e[0], e[3] - e[1]
        return (dx * (y - e[1]) - dy * (x - e[0])) / F.sqrt(dx * dx + dy * dy)

    apart = lambda s, t: (s * t < 0) & (F.abs(s) > TOLERANCE) & (F.abs(t) > TOLERANCE)
    proper = apart(off(p, q[0], q[1]), off(p, q[2], q[3])) & apart(off(q, p[0], p[1]), off(q, p[2], p[3]))

    def touched(e, other):
        """Shares of e where an end of the other lies on it, and its own ends that lie on the other."""
        shares = []
        for x, y in ((other[0], other[1]), (other[2], other[3])):
            t, d = _foot(x, y, *e)
            shares.append(F.when(d <= TOLERANCE**2, t))
        for t, x, y in ((0.0, e[0], e[1]), (1.0, e[2], e[3])):
            shares.append(F.when(_foot(x, y, *other)[1] <= TOLERANCE**2, F.lit(t)))
        return F.array_compact(F.array(*shares))

    out = met.select("a", "b", "ka", "kb", proper.alias("proper"), touched(p, q).alias("of_a"), touched(q, p).alias("of_b"))
    return out.filter(c("proper") | (F.size("of_a") > 0) | (F.size("of_b") > 0))


def _pieces(cuts: DataFrame, rows: DataFrame, own: str) -> DataFrame:
    """Midpoints (a, b, x, y) of the pieces into which edges (a, b, k, cuts) are cut; own: the side that the edges are of."""
    joined = cuts.join(rows.select(F.col("id").alias(own), "k", "ax", "ay", "bx", "by"), [own, "k"])
    marks = F.array_sort(F.array_distinct(F.concat("cuts", F.array(F.lit(0.0), F.lit(1.0)))))
    long = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    spans = F.zip_with(F.slice(marks, F.lit(1), F.size(marks) - 1), F.slice(marks, F.lit(2), F.size(marks) - 1), lambda s, t: F.struct(((s + t) / 2).alias("m"), (t - s).alias("w")))
    parts = joined.withColumn("s", F.explode(spans)).filter(F.col("s.w") * long > 4 * TOLERANCE)
    at = lambda p, q: F.col(p) + F.col("s.m") * (F.col(q) - F.col(p))
    return parts.select("a", "b", at("ax", "bx").alias("x"), at("ay", "by").alias("y"))


def relations(left: DataFrame, right: DataFrame, size: float | None = None) -> DataFrame:
    """(a, b, relation) of all polygons a of left and b of right (id, polygon each) that share a point.

    touches: boundaries meet, interiors don't; equal; contains: b lies in a; within: a lies in b; overlaps: all others.  Boundaries that
    cross overlap.  Where they only touch, the edges that touch are cut there, and each piece lies inside, outside or on the other
    polygon.  Polygons whose boundaries don't meet are judged by one corner.  A pair comes once, whatever the number of cells it meets in.
    """
    c = F.col
    one, two = stored(edges(left), "left-edges"), stored(edges(right), "right-edges")
    size = size or max(cell_size(two), cell_size(one))
    met = stored(_contacts(one, two, size), "contacts")
    pairs = met.groupBy("a", "b").agg(F.max("proper").alias("proper"))
    quiet = met.join(pairs.filter("NOT proper").select("a", "b"), ["a", "b"])
    cut = lambda k, of: quiet.filter(F.size(of) > 0).groupBy("a", "b", c(k).alias("k")).agg(F.array_distinct(F.flatten(F.collect_set(of))).alias("cuts"))  # noqa: E731  of one edge
    of_a = judged(_pieces(cut("ka", "of_a"), one, "a").distinct().withColumn("id", c("b")), two, size, "a", "b", "x", "y").select("a", "b", F.lit("a").alias("own"), "side")
    of_b = judged(_pieces(cut("kb", "of_b"), two, "b").distinct().withColumn("id", c("a")), one, size, "a", "b", "x", "y").select("a", "b", F.lit("b").alias("own"), "side")
    any_ = lambda own, side: F.coalesce(F.max((c("own") == own) & (c("side") == side)), F.lit(False))
    seen = of_a.unionByName(of_b).groupBy("a", "b").agg(any_("a", "inside").alias("ai"), any_("a", "outside").alias("ao"), any_("b", "inside").alias("bi"), any_("b", "outside").alias("bo"))
    told = pairs.join(seen, ["a", "b"], "left").na.fill(False)
    inner = c("ai") | c("bi") | (~c("ao") & ~c("bo"))
    kind = F.when(c("proper"), "overlaps").when(~inner, "touches").when(~c("ao") & ~c("bo"), "equal").when(~c("bo"), "contains").when(~c("ao"), "within").otherwise("overlaps")
    told = told.select("a", "b", kind.alias("relation"))

    def corner(rows: DataFrame) -> DataFrame:
        return rows.groupBy(c("id").alias("point")).agg(F.min(F.struct("k", "ax", "ay")).alias("m")).select("point", c("m.ax").alias("x"), c("m.ay").alias("y"))

    within = points_in_polygons(corner(one), right, size).filter("side = 'inside'").select(c("point").alias("a"), c("id").alias("b"), F.lit("within").alias("relation"))
    contains = points_in_polygons(corner(two), left, size).filter("side = 'inside'").select(c("id").alias("a"), c("point").alias("b"), F.lit("contains").alias("relation"))
    return told.unionByName(within.unionByName(contains).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))


def spatial_adjoiners(queries: DataFrame, parcels: DataFrame, limit: int = SPATIAL_LIMIT) -> DataFrame:
    """For each of queries (query, polygon) the parcels (pos, upc, polygon, legal and others) that touch it, else those that share a point with it.

    Adds query, spatial_rel (touches or intersects) and nth; the first ``limit`` by pos; legal is cut to 200 letters.
    """
    met = relations(queries.select(F.col("query").alias("id"), "polygon"), parcels.select(F.col("upc").alias("id"), "polygon"))
    touches = F.col("relation") == "touches"
    best = Window.partitionBy("a")
    met = met.withColumn("__some", F.max(touches).over(best)).filter(touches | ~F.col("__some"))
    rows = met.select(F.col("a").alias("query"), F.col("b").alias("upc"), F.when(touches, "touches").otherwise("intersects").alias("spatial_rel"))
    out = parcels.drop("polygon").join(broadcast_if_small(stored(rows, "adjoiners"), 128), "upc")
    if "legal" in parcels.columns:
        out = out.withColumn("legal", F.substring(F.trim("legal"), 1, LEGAL_LETTERS))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("pos", "upc"))
    return out.withColumn("nth", nth).filter(F.col("nth") <= limit)


def sections_of(points: DataFrame, sections: DataFrame) -> DataFrame:
    """(point, trs) of points (point, x, y) in survey sections (id, polygon, twp, twp_dir, rng, rng_dir, sec): `T26N R13E S12`.

    A point on a boundary gets the section that comes first by id; points in none have no row, nor has one at 0 degrees in either axis.
    """
    c = F.col
    text = lambda n: F.coalesce(c(n).cast("string"), F.lit(""))
    trs = F.concat(F.lit("T"), text("twp"), text("twp_dir"), F.lit(" R"), text("rng"), text("rng_dir"), F.when(text("sec") != "", F.concat(F.lit(" S"), text("sec"))).otherwise(""))
    held = points_in_polygons(points.filter("x <> 0 AND y <> 0"), sections.select("id", "polygon"))
    first = held.groupBy("point").agg(F.min("id").alias("id"))
    return first.join(sections.select("id", trs.alias("trs")).dropDuplicates(["id"]), "id").select("point", "trs")
