"""Writers: index, sessions, GeoJSON, feedback, snapshots, drawings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions import geometry as G


def write_index(parcels: DataFrame, path: str) -> None:
    parcels.write.mode("overwrite").parquet(path)


def write_sessions(sessions: DataFrame, path: str) -> None:
    """One folder a range; only the ranges at hand are replaced."""
    sessions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range_folder").json(path)


def write_cabinet_index(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cabinet").parquet(path)


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_geojson(parcels: DataFrame, path: str, limit: int = 100_000, source: str | None = None, vertices: int = 500) -> None:
    """Features of the first ``limit`` parcels in listing order, a line each, gzip; the source filter comes after the limit."""
    rows = parcels.orderBy("pos").limit(limit)
    if source:
        rows = rows.filter(F.lower("source").contains(source.lower()))
    properties = F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("upc", "owner", "plat", "book", "page") if c in parcels.columns])
    lines = rows.select(G.feature(G.simplified(F.col("polygon"), vertices), F.col("centroid"), properties).alias("value")).filter("value IS NOT NULL")
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def missing_only(wanted: DataFrame, done: DataFrame, key: str, per_group: str | None = None, limit: int = 50) -> DataFrame:
    """What is not done yet, at most ``limit`` a group: for caches and downloads."""
    rest = wanted.join(done.select(key), key, "left_anti")
    if per_group is None:
        return rest
    from pyspark.sql import Window

    return rest.withColumn("__r", F.row_number().over(Window.partitionBy(per_group).orderBy(key))).filter(F.col("__r") <= limit).drop("__r")


def closure_report(length: Column, error: Column, area: Column) -> Column:
    """A line of text on a traverse."""
    return F.concat_ws(
        "; ", F.concat(F.lit("perimeter "), F.format_number(length, 2)), F.concat(F.lit("closure error "), F.format_number(error, 3)),
        F.concat(F.lit("precision "), F.coalesce(G.closure_ratio(length, error), F.lit("exact"))), F.concat(F.lit("area "), F.format_number(area, 2)),
    )


def drawing(rows: DataFrame, label_height: float = 2.0) -> DataFrame:
    """DXF entities as text, a row each of (label, layer, calls): a closed polyline and a label a call, 1.2 heights off its middle."""
    pts = G.traverse(F.col("calls"))
    number = lambda c: F.format_string("%.4f", c)
    vertex = lambda p: F.concat(F.lit("10\n"), number(p["x"]), F.lit("\n20\n"), number(p["y"]))
    line = F.concat(F.lit("0\nLWPOLYLINE\n8\n"), F.col("layer"), F.lit("\n90\n"), F.size("pts").cast("string"), F.lit("\n70\n1\n"), F.array_join(F.transform("pts", vertex), "\n"))
    used = F.filter("calls", lambda c: c["azimuth_deg"].isNotNull() & (c["distance"] > 0))

    def text(c, i):
        a, b = F.get(F.col("pts"), i), F.get(F.col("pts"), i + 1)
        turn = F.radians(c["azimuth_deg"])
        x = (a["x"] + b["x"]) / 2 + 1.2 * label_height * F.cos(turn)
        y = (a["y"] + b["y"]) / 2 - 1.2 * label_height * F.sin(turn)
        return F.concat(F.lit("0\nTEXT\n8\nLABELS\n10\n"), number(x), F.lit("\n20\n"), number(y), F.lit(f"\n40\n{label_height}\n1\n"), F.coalesce(c["bearing_label"], F.lit("")), F.lit(" "), F.format_number(c["distance"], 2))

    made = rows.withColumn("pts", pts).withColumn("texts", F.transform(used, text))
    return made.select("label", F.concat_ws("\n", line, F.array_join("texts", "\n")).alias("entities"))


#: A drawing's layers with their colours and line types, and the closure error in feet up to which a boundary is drawn closed.
LAYERS = (("CLIENT", 2, "CONTINUOUS"), ("ADJOINERS", 3, "DASHED"), ("LABELS", 7, "CONTINUOUS"), ("ENDPOINTS", 6, "CONTINUOUS"), ("INFO", 8, "CONTINUOUS"))
CLOSE_TOLERANCE = 0.5


def _dxf(*pairs) -> str:
    """Group codes and values, a line each."""
    return "\n".join(str(x) for pair in pairs for x in pair)


def _dxf_text(layer: str, x: Column, y: Column, height: float, value: Column) -> Column:
    number = lambda c: F.format_string("%.4f", c.cast("double"))
    plain = F.translate(value, "\n\r", "  ")
    return F.concat_ws("\n", F.lit(_dxf((0, "TEXT"), (8, layer), (10, "")).rstrip("\n")), number(x), F.lit("20"), number(y), F.lit(_dxf((40, height), (1, "")).rstrip("\n")), plain)


def drawings(parcels: DataFrame, today: Column, label_height: float = 2.0, tolerance: float = CLOSE_TOLERANCE) -> DataFrame:
    """A drawing a job: (file, body, errors) of parcels (job_number, client_name, job_type, pos, label, layer, calls), for sources.files.write_files.

    body is a whole drawing: header in feet, layers, a boundary a parcel (closed if its error is within the tolerance, else with a note), a bearing
    and a distance beside each call, 1.2 heights off its middle, and the job's data below the origin.  errors: (label, error) by pos.  Parcels
    without calls are left out; a job is gathered in one row, as it is one file.
    """
    calls = F.filter("calls", lambda c: c["azimuth_deg"].isNotNull() & (c["distance"] > 0))
    own = parcels.withColumn("calls", calls).filter(F.size("calls") > 0).withColumn("pts", G.traverse(F.col("calls")))
    own = own.withColumn("error", F.round(G.closure(F.col("pts")), 4))
    number = lambda c: F.format_string("%.4f", c)
    corner = lambda p: F.concat_ws("\n", F.lit(_dxf((0, "VERTEX"), (8, ""))[:-1]), F.col("layer"), F.lit("10"), number(p["x"]), F.lit("20"), number(p["y"]))
    closed = F.col("error") <= tolerance
    ring = F.concat_ws("\n", F.lit("0\nPOLYLINE\n8"), F.col("layer"), F.lit("66\n1\n70"), F.when(closed, "1").otherwise("0"), F.array_join(F.transform("pts", corner), "\n"), F.lit("0\nSEQEND"))

    def labels(c: Column, i: Column) -> Column:
        a, b, turn = F.get(F.col("pts"), i), F.get(F.col("pts"), i + 1), F.radians(c["azimuth_deg"])
        x = (a["x"] + b["x"]) / 2 + 1.2 * label_height * F.cos(turn)
        y = (a["y"] + b["y"]) / 2 - 1.2 * label_height * F.sin(turn)
        return F.concat_ws("\n", _dxf_text("LABELS", x, y, label_height, F.coalesce(c["bearing_label"], F.lit(""))), _dxf_text("LABELS", x, y - 1.2 * label_height, label_height, F.format_string("%.2f'", c["distance"])))

    first = F.get(F.col("pts"), 0)
    note = F.when(~closed & (F.col("error") > 0.01), _dxf_text("INFO", first["x"], first["y"] - 4 * label_height, label_height, F.concat(F.lit("! Closure error: "), F.format_string("%.3f", F.col("error")), F.lit(" ft  Parcel: "), F.col("label"))))
    parts = own.withColumn("part", F.concat_ws("\n", ring, F.array_join(F.transform("calls", labels), "\n"), note))
    jobs = parts.groupBy("job_number").agg(F.min("client_name").alias("client_name"), F.min("job_type").alias("job_type"), F.sort_array(F.collect_list(F.struct("pos", "label", "error", "part"))).alias("parts"))
    client = F.coalesce("client_name", F.lit(""))
    low = -8 * label_height
    lines = [F.concat(F.lit("Job #"), F.col("job_number"), F.lit("  "), client), F.concat(F.lit("Type: "), F.coalesce("job_type", F.lit(""))), F.concat(F.lit("Generated: "), F.date_format(today, "yyyy-MM-dd"))]
    info = [_dxf_text("INFO", F.lit(0.0), F.lit(low - 1.2 * label_height * i), 0.8 * label_height, line) for i, line in enumerate(lines)]
    head = _dxf((0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, "AC1009"), (9, "$INSUNITS"), (70, 2), (9, "$MEASUREMENT"), (70, 0), (0, "ENDSEC"), (0, "SECTION"), (2, "TABLES"), (0, "TABLE"), (2, "LTYPE"), (70, 2))
    for name, dashes in (("CONTINUOUS", ()), ("DASHED", (0.5, -0.25))):
        head += "\n" + _dxf((0, "LTYPE"), (2, name), (70, 0), (3, ""), (72, 65), (73, len(dashes)), (40, float(sum(map(abs, dashes)))), *((49, d) for d in dashes))
    head += "\n" + _dxf((0, "ENDTAB"), (0, "TABLE"), (2, "LAYER"), (70, len(LAYERS)))
    for name, colour, kind in LAYERS:
        head += "\n" + _dxf((0, "LAYER"), (2, name), (70, 0), (62, colour), (6, kind))
    head += "\n" + _dxf((0, "ENDTAB"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"))
    body = F.concat_ws("\n", F.lit(head), F.array_join(F.transform("parts", lambda p: p["part"]), "\n"), *info, F.lit(_dxf((0, "ENDSEC"), (0, "EOF")) + "\n"))
    name = F.concat_ws(" ", F.col("job_number").cast("string"), F.initcap(F.trim(F.substring_index(client, ",", 1))), F.lit("Boundary.dxf"))
    errors = F.transform("parts", lambda p: F.struct(p["label"].alias("label"), p["error"].alias("error")))
    return jobs.select(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]', "")).alias("file"), body.alias("body"), errors.alias("errors"))
