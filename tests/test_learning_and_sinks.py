import random

import pytest
from pyspark.sql import functions as F

from parcelworks import sinks
from parcelworks.operators import learning


def history(spark, n=60):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        kind = rng.choice(["BDY", "ALTA", "SUB"])
        count = {"BDY": 3, "ALTA": 8, "SUB": 14}[kind] + rng.randint(0, 1)
        rows.append((2900 + i, f"client {i % 7}", kind, count, count // 2, 1, {"BDY": "A", "ALTA": "B", "SUB": "C"}[kind], float(count * 2)))
    return spark.createDataFrame(rows, "job_number long, client_name string, job_type string, adjoiner_count int, deed_count int, plat_count int, primary_cabinet string, duration_days double")


def test_features_do_not_know_the_label(spark):
    kind = "job_number long, client_name string, job_type string, adjoiner_count int, deed_count int, plat_count int"
    rows = spark.createDataFrame([(3, "a", "BDY", 4, 1, 0), (1, "a", "BDY", 8, 1, 0), (2, "a", "SUB", None, 0, 0), (9, "b", "ALTA", 6, 0, 0), (5, None, "BDY", 0, 0, 0)], kind)
    got = {r.job_number: (r.prior_jobs, r.type_average) for r in learning.features(rows).collect()}
    assert got == {1: (0, 4.0), 2: (1, 0.0), 3: (2, 8.0), 5: (0, 6.0), 9: (0, 0.0)}
    codes = learning.features(rows).select("job_type", "type_code").distinct().collect()
    assert len({r.type_code for r in codes}) == 3 and learning.features(rows.limit(0)).count() == 0


def test_models_learn_the_types(spark, tmp_path):
    rows = history(spark)
    model, error = learning.train_adjoiners(rows)
    assert error < 1.0
    learning.save(model, f"file://{tmp_path}/model")
    same = lambda m: sorted((r.job_number, r.predicted) for r in learning.predict_adjoiners(m, rows).collect())
    assert same(learning.load(f"file://{tmp_path}/model")) == same(model)
    got = {(r.job_type, r.complexity) for r in learning.predict_adjoiners(model, rows).collect()}
    assert got == {("BDY", "low"), ("ALTA", "moderate"), ("SUB", "high")}
    assert learning.train_duration(rows) is not None
    assert learning.train_adjoiners(rows.limit(5)) is None
    assert {r.predicted for r in learning.predict_adjoiners(None, rows).collect()} == {5.0, 6.0, 8.0}


def test_sinks(spark, tmp_path):
    kind = "pos int, upc string, owner string, source string, polygon array<struct<lng:double,lat:double>>, centroid struct<lng:double,lat:double>"
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    parcels = spark.createDataFrame([(0, "1", "A", "x.kml", ring, (0.5, 0.5)), (1, "2", "", "y.kmz", None, (0.1, 0.2)), (2, "3", "C", "x.kml", None, None)], kind)
    sinks.write_geojson(parcels, f"file://{tmp_path}/g")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/g").collect()]
    assert len(lines) == 2 and any('"Polygon"' in x for x in lines) and any('"Point"' in x and '"owner"' not in x for x in lines)
    sinks.write_geojson(parcels, f"file://{tmp_path}/h", source="KMZ")
    assert spark.read.text(f"file://{tmp_path}/h").count() == 1
    done = spark.createDataFrame([("1",)], "upc string")
    assert [r.upc for r in sinks.missing_only(parcels, done, "upc", "source", 1).orderBy("upc").collect()] == ["2", "3"]
    sinks.append_feedback(done, f"file://{tmp_path}/f")
    sinks.append_feedback(done, f"file://{tmp_path}/f")
    assert spark.read.json(f"file://{tmp_path}/f").count() == 2
    calls = [("N 0° E", 0.0, 100.0), ("N 90° E", 90.0, 100.0), (None, None, 5.0)]
    draw = sinks.drawing(spark.createDataFrame([("p", "PARCEL", calls)], "label string, layer string, calls array<struct<bearing_label:string,azimuth_deg:double,distance:double>>")).first()
    assert draw.entities.count("TEXT") == 2 and draw.entities.startswith("0\nLWPOLYLINE\n8\nPARCEL\n90\n3")
    text = spark.range(1).select(sinks.closure_report(F.lit(400.0), F.lit(0.1), F.lit(10_000.0)).alias("t")).first().t
    assert "1:4000" in text or "1:3999" in text
