"""Geometry of parcels and traverses as columns; rings are array<struct<lng,lat>>, traverses array<struct<x,y>>."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Feet of a unit.
FEET = {
    "feet": 1.0, "foot": 1.0, "ft": 1.0, "yards": 3.0, "yard": 3.0, "yd": 3.0, "chains": 66.0, "chain": 66.0, "ch": 66.0,
    "poles": 16.5, "pole": 16.5, "rods": 16.5, "rod": 16.5, "rd": 16.5, "links": 0.66, "link": 0.66, "lk": 0.66,
    "meters": 3.28084, "meter": 3.28084, "m": 3.28084, "varas": 2.7778, "vara": 2.7778, "v": 2.7778,
}


def points_of(coordinates: Column) -> Column:
    """Points of `lng,lat[,alt] …`; null if a number can't be read, or if there is none.  Chunks without a comma are left out."""
    chunks = F.filter(F.split(F.trim(coordinates), r"\s+"), lambda c: c.contains(","))
    part = lambda c, i: F.element_at(F.split(c, ","), i).try_cast("double")
    points = F.transform(chunks, lambda c: F.struct(part(c, 1).alias("lng"), part(c, 2).alias("lat")))
    bad = F.exists(points, lambda p: p["lng"].isNull() | p["lat"].isNull())
    return F.when((F.size(points) > 0) & ~bad, points)


def centroid(points: Column) -> Column:
    """Mean of the vertices, a closing vertex counting twice, to 8 decimals."""
    mean = lambda f: F.round(F.aggregate(points, F.lit(0.0), lambda s, p: s + p[f]) / F.size(points), 8)
    return F.when(points.isNotNull(), F.struct(mean("lng").alias("lng"), mean("lat").alias("lat")))


def ring(points: Column) -> Column:
    """Vertices to 6 decimals; null for fewer than three."""
    return F.when(F.size(points) >= 3, F.transform(points, lambda p: F.struct(F.round(p["lng"], 6).alias("lng"), F.round(p["lat"], 6).alias("lat"))))


def shoelace(points: Column, x: str = "x", y: str = "y") -> Column:
    """Area of a closed or open ring; 0 for fewer than three points."""
    shifted = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, shifted, lambda a, b: a[x] * b[y] - b[x] * a[y])
    return F.when(F.size(points) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(0.0)


def square_metres(polygon: Column, latitude: float = 36.4) -> Column:
    """Area of a ring in degrees, on a plane at a fixed latitude."""
    kx, ky = 111_000.0 * math.cos(math.radians(latitude)), 111_000.0  # metres a degree (fixed values)
    return shoelace(F.transform(polygon, lambda p: F.struct((p["lng"] * kx).alias("x"), (p["lat"] * ky).alias("y"))))


def azimuth(ns: Column, degrees: Column, minutes: Column, seconds: Column, ew: Column) -> Column:
    """Clockwise from north, of a quadrant bearing."""
    d = degrees + minutes / 60.0 + seconds / 3600.0
    n, e = F.upper(ns) == "N", F.upper(ew) == "E"
    return F.when(n & e, d).when(~n & e, 180.0 - d).when(~n & ~e, 180.0 + d).otherwise(360.0 - d)


def to_feet(value: Column, unit: Column) -> Column:
    """Unknown units count as feet."""
    table = F.create_map(*[F.lit(v) for pair in FEET.items() for v in pair])
    return value * F.coalesce(F.element_at(table, F.rtrim(F.lower(F.trim(F.coalesce(unit, F.lit("feet")))), F.lit("."))), F.lit(1.0))


def traverse(calls: Column) -> Column:
    """Corners of calls array<struct<azimuth_deg,distance>> from the origin, to 6 decimals; a call without a distance adds none."""
    used = F.filter(calls, lambda c: c["azimuth_deg"].isNotNull() & (c["distance"] > 0))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    kind = "struct<at:struct<x:double,y:double>,all:array<struct<x:double,y:double>>>"
    start = F.struct(zero.alias("at"), F.array(zero).alias("all")).cast(kind)

    def step(s, c):
        a = F.radians(c["azimuth_deg"])
        x, y = s["at"]["x"] + c["distance"] * F.sin(a), s["at"]["y"] + c["distance"] * F.cos(a)
        corner = F.struct(F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
        return F.struct(F.struct(x.alias("x"), y.alias("y")).alias("at"), F.concat(s["all"], F.array(corner)).alias("all")).cast(kind)

    return F.aggregate(used, start, step, lambda s: s["all"])


def closure(points: Column) -> Column:
    """Distance from the last corner to the first."""
    first, last = F.get(points, 0), F.get(points, F.size(points) - 1)
    return F.hypot(last["x"] - first["x"], last["y"] - first["y"])


def closing_error(calls: Column) -> Column:
    """Distance from where the calls end to where they begin, of the sums before they are rounded to corners."""
    used = F.filter(calls, lambda c: c["azimuth_deg"].isNotNull() & (c["distance"] > 0))
    end = lambda turn: F.aggregate(used, F.lit(0.0), lambda s, c: s + c["distance"] * turn(F.radians(c["azimuth_deg"])))
    x, y = end(F.sin), end(F.cos)
    return F.sqrt(x * x + y * y)


def closure_class(error: Column) -> Column:
    return F.when(error <= 0.5, "ok").when(error <= 1.0, "info").when(error <= 5.0, "warn").otherwise("critical")


def perimeter(calls: Column) -> Column:
    return F.aggregate(calls, F.lit(0.0), lambda s, c: s + F.coalesce(c["distance"], F.lit(0.0)))


def closure_ratio(length: Column, error: Column) -> Column:
    """`1:5000`, cut to a whole number; null where the error is nothing."""
    return F.when(error > 0.001, F.concat(F.lit("1:"), F.floor(length / error).cast("string")))


def acres(area: Column) -> Column:
    return F.round(area / 43560.0, 3)


CALL = StructType([
    StructField("type", StringType()), StructField("bearing_label", StringType()), StructField("azimuth_deg", DoubleType()),
    StructField("distance", DoubleType()), StructField("raw_distance", DoubleType()), StructField("unit", StringType()),
    StructField("direction", StringType()), StructField("radius", DoubleType()), StructField("arc_length", DoubleType()),
    StructField("delta_deg", DoubleType()), StructField("chord_length", DoubleType()), StructField("chord_bearing", StringType()),
])

_UNIT = "feet|foot|ft|yards?|yd|chains?|ch|poles?|rods?|rd|links?|lk|meters?|m|varas?|v"
_BEARING = re.compile(
    rf"""\b(?P<ns>N(?:orth)?|S(?:outh)?)\s*(?P<d>\d{{1,3}})(?:\s*(?:°|deg(?:rees?)?\b)|[\s-]+|(?=[EW]))\s*
    (?:(?P<m>\d{{1,2}})(?:\s*(?:['′]|min(?:utes?)?\b)|[\s-]+|(?=\s*[EW])))?\s*
    (?:(?P<s>\d{{1,2}})(?:\s*(?:["″]|sec(?:onds?)?\b)|[\s-]+|(?=\s*[EW])))?\s*-?\s*
    (?P<ew>E(?:ast)?|W(?:est)?)\b[,\s]*(?:(?P<dist>\d[\d,]*\.?\d*)\s*(?P<unit>(?:{_UNIT})\b|')?)?""",
    re.I | re.X,
)
_CURVE = re.compile(r"\bcurve\s+to\s+the\s+(left|right)\b", re.I)
#: What a curve may tell, anywhere in its clause.
_CURVE_PARTS = {
    "radius": re.compile(r"\bradius(?:\s+of)?[\s:=]+(\d[\d,]*\.?\d*)", re.I),
    "arc_length": re.compile(r"\barc\s+(?:length|len)(?:\s+of)?[\s:=]+(\d[\d,]*\.?\d*)", re.I),
    "delta_deg": re.compile(r"\bdelta(?:\s+of)?[\s:=]+(\d[\d,]*\.?\d*)", re.I),
}
_CHORD = re.compile(r"\bchord\s+(?:bears?|bearing)\s*", re.I)


def _number(text: str | None) -> float:
    return float(text.replace(",", "").rstrip(".") or 0) if text else 0.0


def _bearing(match: re.Match) -> tuple[str, float]:
    ns, ew = match["ns"][0].upper(), match["ew"][0].upper()
    d, m, s = (_number(match[k]) for k in ("d", "m", "s"))
    angle = d + m / 60 + s / 3600
    turned = {"NE": angle, "SE": 180 - angle, "SW": 180 + angle, "NW": 360 - angle}[ns + ew]
    label = " ".join([ns, f"{int(d)}°", *([f"{int(m):02d}'"] if m or s else []), *([f'{int(s):02d}"'] if s else []), ew])
    return label, round(turned, 6)


def calls_of(text: str | None) -> list[dict]:
    """Boundary calls of a description in text order: bearings with a distance, and curves with a radius.

    A curve's clause runs to the next semicolon, full stop before a blank, bearing call after it or 400 characters;
    its radius, arc, delta and chord may stand anywhere in the clause.  Arc and chord follow from radius and delta
    where they are not given.
    """
    out, taken = [], []
    for start in _CURVE.finditer(text or ""):
        end = min(len(text), start.start() + 400)
        stop = re.compile(r";|\.\s|\bcurve\s+to\s+the\b", re.I).search(text, start.end(), end)
        clause = text[start.start() : stop.start() if stop else end]
        part = {k: _number(m[1]) if (m := r.search(clause)) else 0.0 for k, r in _CURVE_PARTS.items()}
        if not part["radius"]:
            continue
        chord = (found := _CHORD.search(clause)) and _BEARING.match(clause, found.end())
        arc, delta, radius = part["arc_length"], part["delta_deg"], part["radius"]
        arc = arc or radius * math.radians(delta)
        delta = delta or math.degrees(arc / radius)
        length = 2 * radius * math.sin(math.radians(delta) / 2)
        side = start[1].lower()
        last = max([chord.end("ew") if chord else 0, start.end() - start.start(), *(m.end() for r in _CURVE_PARTS.values() if (m := r.search(clause)))])
        taken.append((start.start(), start.start() + last))
        out.append((start.start(), {
            "type": "curve", "bearing_label": f"Curve {side} R={radius:.1f}' Δ={delta:.2f}°", "azimuth_deg": _bearing(chord)[1] if chord else None,
            "distance": round(arc or length, 2), "direction": side, "radius": radius, "arc_length": round(arc, 2), "delta_deg": round(delta, 4),
            "chord_length": round(length, 2), "chord_bearing": clause[chord.start() : chord.end("ew")] if chord else None,
        }))
    for match in _BEARING.finditer(text or ""):
        if not match["dist"] or any(match.start() < e and match.end() > s for s, e in taken):
            continue
        label, turned = _bearing(match)
        unit = (match["unit"] or "ft").lower()
        raw = _number(match["dist"])
        out.append((match.start(), {
            "type": "straight", "bearing_label": label, "azimuth_deg": turned, "distance": raw * FEET.get(unit, 1.0), "raw_distance": raw,
            "unit": "ft" if unit in ("feet", "foot", "ft", "'") else unit,
        }))
    return [{f.name: c.get(f.name) for f in CALL} for _, c in sorted(out, key=lambda x: x[0])]


@F.pandas_udf(ArrayType(CALL))
def parse_calls(texts: pd.Series) -> pd.Series:
    """Column form of calls_of: the pattern's positions are needed, which SQL's regular expressions don't give."""
    return pd.Series([calls_of(t) for t in texts], dtype=object)


def simplify(points: list, limit: int = 500, digits: int = 7) -> list:
    """Ramer-Douglas-Peucker from a tolerance of 1e-7, doubled up to twenty times until at most ``limit`` points stay, else every k-th."""
    ring_ = np.asarray([[p["lng"], p["lat"]] for p in points], float).reshape(-1, 2)
    if len(ring_) > limit:
        for n in range(20):
            kept = _peucker(ring_, 1e-7 * 2**n)
            if len(kept) <= limit:
                ring_ = ring_[kept]
                break
        else:
            ring_ = ring_[:: -(-len(ring_) // limit)]
    return [{"lng": round(float(x), digits), "lat": round(float(y), digits)} for x, y in ring_]


def _peucker(ring_: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(ring_), bool)
    keep[[0, -1]] = True
    spans = [(0, len(ring_) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d = ring_[b] - ring_[a]
        rel = ring_[a + 1 : b] - ring_[a]
        size = float(d @ d)
        t = np.clip(rel @ d / size, 0, 1) if size else np.zeros(len(rel))
        off = ((rel - t[:, None] * d) ** 2).sum(axis=1)
        far = int(off.argmax())
        if off[far] > tolerance**2:
            keep[a + 1 + far] = True
            spans += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.flatnonzero(keep)


POINT = StructType([StructField("lng", DoubleType()), StructField("lat", DoubleType())])


def simplified(polygon: Column, limit: int = 500) -> Column:
    @F.pandas_udf(ArrayType(POINT))
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else simplify(r, limit) for r in rings], dtype=object)

    return run(polygon)


def feature(polygon: Column, point: Column, properties: Column) -> Column:
    """GeoJSON text: a closed ring, else a point, else null; empty properties are left out."""
    pair = lambda p: F.array(p["lng"], p["lat"])
    first, last = F.get(polygon, 0), F.get(polygon, F.size(polygon) - 1)
    closed = F.when((first["lng"] == last["lng"]) & (first["lat"] == last["lat"]), polygon).otherwise(F.concat(polygon, F.array(first)))
    area = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, pair)).alias("coordinates")).alias("geometry"), properties.alias("properties")))
    spot = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), pair(point).alias("coordinates")).alias("geometry"), properties.alias("properties")))
    return F.when(F.size(polygon) >= 3, area).when(point.isNotNull(), spot)


def haversine_miles(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    p, q = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng_b - lng_a) / 2), 2)
    return 2 * 3958.8 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_ring(lng: Column, lat: Column, polygon: Column) -> Column:
    """Whether a point lies in a ring, by crossings."""
    shifted = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    crossing = lambda a, b: ((a["lat"] > lat) != (b["lat"] > lat)) & (lng < (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lng"])
    return F.aggregate(F.zip_with(polygon, shifted, lambda a, b: F.when(crossing(a, b), 1).otherwise(0)), F.lit(0), lambda s, v: s + v) % 2 == 1
