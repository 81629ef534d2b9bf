"""Golden rows of the text, geometry and score functions."""

import math

import pytest
from pyspark.sql import functions as F

from parcelworks.functions import geometry as G
from parcelworks.functions import scores as S
from parcelworks.functions import text as T


def values(spark, rows, column, schema="t string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in frame.select("i", column.alias("v")).orderBy("i").collect()]


def test_tokens_and_references(spark):
    t = F.col("t")
    assert values(spark, ["The Lot of ADELA Rael, 12 acres", None], T.legal_tokens(t)) == [["lot", "adela", "rael", "acres"], []]
    assert values(spark, ["T26N R13E Sec 12; T.26N., R.13E", "t5n r5e", ""], T.trs_fingerprints(t)) == [["T26N-R13E-S12", "T26N-R13E"], ["T5N-R5E"], []]
    assert values(spark, ["CAB C-191A", "CAB. E-139A", "C-191-A ADELA RAEL", "C-84", "none", None], T.plat_cabinet_refs(t)) == [["C-191A"], ["E-139A"], ["C-191A"], ["C-84"], [], []]
    assert values(spark, ["see Cabinet b - 45a and CAB C-1"], T.cabinet_refs(t)) == [["B-45A", "C-1"]]
    assert values(spark, ["Rael, Adela and lands of the Garcia"], T.legal_names(t)) == [["rael", "adela", "garcia"]]
    assert values(spark, ["Lot 3, Block 7 of Tract 2a"], T.lot_block_tract(t)) == [["lot-3", "block-7", "tract-2A"]]
    assert values(spark, ["iron rod and a nail; old fence corner"], T.monuments(t)) == [["iron pin", "fence", "nail"]]
    book, page = T.book_page(F.col("t"))
    assert values(spark, ["M568-482", "568-482 x", "x-1"], F.concat_ws("/", book, page)) == ["568/482", "568/482", ""]


def test_names(spark):
    t = F.col("t")
    cleaned = ["GARCIA JUAN & AND", "SMITH OR", "SMITH, AND", "Doe,", "Doe, J, &, or", "& AND", "", "A AND B", "X & & & &"]
    assert values(spark, cleaned, T.owner_cleaned(t)) == ["GARCIA JUAN", "SMITH", "SMITH", "Doe", "Doe, J", "", "", "A AND B", "X &"]
    assert values(spark, ["Smith, John Jr.", "ACME L.L.C", "Rael Trust"], T.owner_key(t)) == ["SMITH JOHN", "ACME L L C", "RAEL"]
    assert values(spark, ["Rael, Adela", "Zed Abe"], T.person_key(t)) == ["adela rael", "abe zed"]
    assert T.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert T.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert T.jaro_winkler("", "a") == 0 and T.jaro_winkler("a", "a") == 1
    parts = T.deed_filename_parts(F.col("t"))
    assert values(spark, ["12-3 Rael to Garcia.pdf", "Rael to Garcia.PDF"], F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in parts.values()])) == ["12-3|Rael|Garcia", "-|Rael|Garcia"]


def test_coordinates(spark):
    points = G.points_of(F.col("t"))
    rows = ["-105.5,36.4,0 -105.6,36.5", "1,2 3,4 5,6", "x,1", "", None, "0,0 2,0 2,2 0,2 0,0"]
    got = values(spark, rows, G.centroid(points))
    assert [None if g is None else (g.lng, g.lat) for g in got] == [(-105.55, 36.45), (3.0, 4.0), None, None, None, (0.8, 0.8)]
    assert [None if g is None else len(g) for g in values(spark, rows, G.ring(points))] == [None, 3, None, None, None, 5]
    assert values(spark, rows[-1:], G.in_ring(F.lit(1.0), F.lit(1.0), points)) == [True] and values(spark, rows[-1:], G.in_ring(F.lit(3.0), F.lit(1.0), points)) == [False]


def square(side):
    return [(0.0, side), (90.0, side), (180.0, side), (270.0, side)]


def test_traverse_closes(spark):
    frame = spark.createDataFrame([(1, square(100.0)), (2, square(100.0)[:3]), (3, [])], "i int, calls array<struct<azimuth_deg:double,distance:double>>")
    pts = G.traverse(F.col("calls"))
    rows = frame.select("i", pts.alias("p"), G.closure(pts).alias("e"), G.shoelace(pts).alias("a"), G.perimeter(F.col("calls")).alias("l")).orderBy("i").collect()
    assert len(rows[0].p) == 5 and rows[0].e < 0.01 and rows[0].a == pytest.approx(10_000) and rows[0].l == 400
    assert rows[1].e == pytest.approx(100) and rows[2].p == [(0.0, 0.0)] and rows[2].a == 0
    assert [r.c for r in frame.select(G.closure_class(F.lit(0.7)).alias("c")).limit(1).collect()] == ["info"]


def test_closing_error_is_not_rounded(spark):
    # two calls of opposite directions, 24.3 and 19.3: 4.999999999999999, where corners of six decimals give 5.000000116
    frame = spark.createDataFrame([([(44.0, 19.3), (224.0, 24.3)],)], "calls array<struct<azimuth_deg:double,distance:double>>")
    error = G.closing_error(F.col("calls"))
    row = frame.select(error.alias("e"), G.closure_class(error).alias("c"), G.closure_class(G.closure(G.traverse(F.col("calls")))).alias("rounded")).first()
    assert abs(row.e - 5.0) < 1e-12 and row.c == "warn" and row.rounded == "critical"


def test_calls():
    got = G.calls_of("beginning; thence S 45°30'00\" E, 125.50 feet; N45-30-00E 66 ft, thence N 10 degrees 15 minutes West 2 chains to a point")
    assert [(c["bearing_label"], c["azimuth_deg"], c["distance"]) for c in got] == [("S 45° 30' E", 134.5, 125.5), ("N 45° 30' E", 45.5, 66.0), ("N 10° 15' W", 349.75, 132.0)]
    (curve,) = G.calls_of("curve to the left, radius 150 feet, with a delta of 30 degrees, chord bears N45°30'00\"E; end")
    assert curve["direction"] == "left" and curve["arc_length"] == pytest.approx(78.54) and curve["azimuth_deg"] == 45.5
    assert curve["chord_length"] == pytest.approx(300 * math.sin(math.radians(15)), abs=0.01)
    assert G.calls_of("") == [] and G.calls_of(None) == [] and G.calls_of("N 5 apples") == []
    assert [c["azimuth_deg"] for c in G.calls_of("N45°W 87.20 and S45E 125.50")] == [315.0, 135.0]


def test_simplify():
    line = [{"lng": i / 1000, "lat": 0.0} for i in range(100)]
    assert len(G.simplify(line, 20)) == 2
    rough = [{"lng": i / 10, "lat": (i % 2) * 1.0} for i in range(100)]
    assert len(G.simplify(rough, 20)) <= 20
    assert G.simplify([{"lng": 0.123456789, "lat": 1.0}])[0]["lng"] == 0.1234568


def test_feature(spark):
    ring = G.ring(G.points_of(F.col("t")))
    got = values(spark, ["0,0 1,0 1,1", "0,0"], G.feature(ring, G.centroid(G.points_of(F.col("t"))), F.struct(F.lit("x").alias("upc"))))
    assert '"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]' in got[0] and '"Point","coordinates":[0.0,0.0]' in got[1]


def test_scores(spark):
    row = {k: F.col("r")[k] for k in ("grantor", "grantee", "location", "instrument_type", "recorded_date")}
    score, tags = S.search_relevance(row, {"section": "12", "name": "Rael, Adela", "subdivision": "Vista", "adjoiner": "Garcia"})
    rows = [("RAEL ADELA", "X", "Sec 12 Vista", "WARRANTY DEED", "2019-01-02"), (None, None, None, None, None), ("GARCIA", "", "", "MORTGAGE", "03/04/2001")]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r struct<grantor:string,grantee:string,location:string,instrument_type:string,recorded_date:string>")
    got = [(r.s, r.t) for r in frame.select("i", score.alias("s"), tags.alias("t")).orderBy("i").collect()]
    assert got == [(100, ["trs_match", "same_subdivision", "client_name", "deed"]), (0, []), (18, ["adjoiner"])]
    dates = values(spark, ["01/02/2020", "2020-01-02", "01/02/20", "Jan 2, 2020", "x"], S.parsed_date(F.col("t")))
    assert [str(d) for d in dates] == ["2020-01-02"] * 4 + ["None"]
