"""Parcels from KML and KMZ files.

A KML file is read as text cut at its Placemark tags, so a county's file of any size is split over tasks and no row is
larger than a placemark.  Members of KMZ archives are cut in the same way while they are unpacked.  Each placemark goes
through Spark's XML functions with an explicit schema, so identifiers keep their leading zeros.
"""

from __future__ import annotations

import codecs
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelworks.functions import geometry as G
from parcelworks.functions import text as T
from parcelworks.storage import broadcast_if_small, stored

#: Where texts are cut: the end of every opening tag without attributes and of every closing tag, with and without a prefix.
CUT = "Placemark>"
DATA = "struct<SimpleData:array<struct<_name:string,_VALUE:string>>>"
RING = "struct<LinearRing:struct<coordinates:string>>"
SHAPE = f"Point struct<coordinates:string>, Polygon struct<outerBoundaryIs:{RING}>"
PLACEMARK = f"name string, ExtendedData struct<SchemaData:{DATA},SimpleData:array<struct<_name:string,_VALUE:string>>>, {SHAPE}, MultiGeometry struct<Polygon:array<struct<outerBoundaryIs:{RING}>>>"


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Files below path that end in .kml or .kmz, in any case: path, name, size_mb (1 decimal), format; by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    found = files.filter(F.lower("path").rlike(r"\.km[lz]$"))
    return found.select(
        "path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.round(F.col("length") / (1 << 20), 1).alias("size_mb"), F.lower(F.substring("path", -3, 3)).alias("format")
    ).orderBy("name")


def _file(column: str):
    return F.regexp_extract(F.url_decode(column), "([^/]+)$", 1)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, at, piece): the texts of all .kml files and .kml members of .kmz files below path, cut at CUT.

    Pieces of a source are in the order of (block, at).  The source of a member is `<archive>/<member>`; unreadable archives
    give nothing.
    """
    read = lambda kind, glob: spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    plain = read("text", "*.[kK][mM][lL]").option("lineSep", CUT).load(path)
    # ids grow by one from row to row of a task, and a task reads a block of a file in order
    kml = plain.select(_file("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    archives = read("binaryFile", "*.[kK][mM][zZ]").load(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cut(name: str, member) -> Iterator[pd.DataFrame]:
            decode, rest, at = codecs.getincrementaldecoder("utf-8")("replace"), "", 0
            while True:
                data = member.read(1 << 20)
                *whole, rest = (rest + decode.decode(data, final=not data)).split(CUT)
                if not data:
                    whole.append(rest)
                yield pd.DataFrame({"source": name, "block": 0, "at": range(at, at + len(whole)), "piece": whole})
                at += len(whole)
                if not data:
                    return

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                name = file.rsplit("/", 1)[-1]
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for m in archive.namelist():
                            if m.lower().endswith(".kml"):
                                with archive.open(m) as member:
                                    yield from cut(f"{name}/{m}", member)
                except zipfile.BadZipFile:
                    continue

    return kml.unionByName(archives.select("path", "content").mapInPandas(unpack, "source string, block bigint, at bigint, piece string"))


def placemarks(pieces_: DataFrame) -> DataFrame:
    """(source, block, at, p): each placemark of pieces with its place in the source, parsed by Spark's XML functions.

    A piece that ends in a closing tag holds a placemark's content, after an opening tag with attributes if that is in it.
    Prefixes of element names are taken off first, so files with and without a namespace prefix read alike.
    """
    whole = pieces_.filter(F.col("piece").rlike(r"</(?:\w+:)?$"))
    inner = F.regexp_replace(F.regexp_replace("piece", r"(?s)^.*<(?:\w+:)?Placemark\s[^>]*>", ""), r"</(?:\w+:)?$", "")
    bare = F.regexp_replace(F.regexp_replace(inner, r"<(/?)\w+:", "<$1"), r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", "")
    return whole.select("source", "block", "at", F.from_xml(F.concat(F.lit("<Placemark>"), bare, F.lit("</Placemark>")), PLACEMARK).alias("p"))


def parcels(placemarks_: DataFrame) -> DataFrame:
    """Parcel rows: owner, upc, plat, book, page, centroid, polygon, cab_refs, source, and every ring's points.

    Field names count after their last colon and in upper case.  An OWNER field replaces a name that is missing or a
    number; without any owner the label is `UPC <upc>`, else `Unknown Owner`.  The first coordinates give centroid
    and ring; a placemark with neither is left out.
    """
    data = F.coalesce(F.col("p.ExtendedData.SchemaData.SimpleData"), F.col("p.ExtendedData.SimpleData"), F.array().cast("array<struct<_name:string,_VALUE:string>>"))
    fields = F.transform(data, lambda d: F.struct(F.upper(F.trim(F.element_at(F.split(d["_name"], ":"), -1))).alias("k"), F.trim(F.coalesce(d["_VALUE"], F.lit(""))).alias("v")))
    of = lambda *names: F.try_element_at(F.transform(F.filter(F.col("fields"), lambda f: f["k"].isin(*names)), lambda f: f["v"]), F.lit(-1))
    first = lambda *names: F.get(F.transform(F.filter(F.col("fields"), lambda f: f["k"].isin(*names) & (f["v"] != "")), lambda f: f["v"]), 0)
    rows = placemarks_.select("source", "block", "at", "p", fields.alias("fields"))
    many = F.coalesce(F.transform("p.MultiGeometry.Polygon", lambda g: g["outerBoundaryIs"]["LinearRing"]["coordinates"]), F.array().cast("array<string>"))
    coordinates = F.filter(F.concat(F.array(F.col("p.Polygon.outerBoundaryIs.LinearRing.coordinates"), F.col("p.Point.coordinates")), many), lambda c: F.trim(c) != "")
    name = F.trim(F.coalesce("p.name", F.lit("")))
    given = F.when((name == "") | name.rlike(r"^\d+$"), F.coalesce(first("OWNER", "OWNERALL", "OWNER_ALL"), name)).otherwise(name)
    upc = F.nullif(of("UPC"), F.lit(""))
    rows = rows.select(
        "source", "block", "at", upc.alias("upc"), *[F.nullif(of(k.upper()), F.lit("")).alias(k) for k in ("plat", "book", "page")], given.alias("given"),
        coordinates.alias("coordinates_all"), G.points_of(F.get(coordinates, 0)).alias("points"),
    )
    owner = F.when(F.col("given") != "", F.col("given")).when(F.col("upc").isNotNull(), F.concat(F.lit("UPC "), F.col("upc"))).otherwise("Unknown Owner")
    return rows.filter("points IS NOT NULL").select(
        owner.alias("owner"), "upc", "plat", "book", "page", G.centroid(F.col("points")).alias("centroid"), G.ring(F.col("points")).alias("polygon"),
        T.plat_cabinet_refs(F.col("plat")).alias("cab_refs"), "source", "block", "at", "coordinates_all",
    )


def with_places(rows: DataFrame) -> DataFrame:
    """Stored rows with pos, their listing order by (source, block, at): places grow in that order and leave gaps.

    Every task numbers its own rows; only a row per source and block, the span of its numbers, is put in order.
    """
    spans = rows.groupBy("source", "block").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    before = F.sum(F.col("high") - F.col("low") + 1).over(Window.orderBy("source", "block").rowsBetween(Window.unboundedPreceding, -1))
    bases = stored(spans.select("source", "block", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("__base")), "places")
    return rows.join(broadcast_if_small(bases, 64), ["source", "block"]).withColumn("pos", F.col("at") + F.col("__base")).drop("__base", "block", "at")


def build_index(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Read all files below path, keep one parcel a upc and write the index as Parquet with its places (pos)."""
    from parcelworks.operators.ordering import merge_index

    rows = stored(parcels(placemarks(pieces(spark, path))), "parcels")
    merged = merge_index(with_places(rows))
    merged.drop("order_key").withColumn("built_at", F.current_timestamp()).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def enrich(index: DataFrame, attributes: DataFrame) -> DataFrame:
    """Left join of attributes (upc, seq, …) by upc; of several rows of a key the last by seq counts."""
    rest = [c for c in attributes.columns if c not in ("upc", "seq")]
    last = attributes.groupBy("upc").agg(F.max_by(F.struct(*rest), "seq").alias("arcgis"))
    return index.join(last, "upc", "left")
