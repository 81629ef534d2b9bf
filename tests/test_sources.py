import json
import zipfile

from pyspark.sql import functions as F

from parcelworks.sources import html, kml, sessions


def mark(name, fields, coordinates, prefix=""):
    data = "".join(f'<{prefix}SimpleData name="Taos_County:{k}">{v}</{prefix}SimpleData>' for k, v in fields.items())
    shape = f"<{prefix}Polygon><{prefix}outerBoundaryIs><{prefix}LinearRing><{prefix}coordinates>{coordinates}</{prefix}coordinates></{prefix}LinearRing></{prefix}outerBoundaryIs></{prefix}Polygon>" if coordinates else ""
    return f"<{prefix}Placemark><{prefix}name>{name}</{prefix}name><{prefix}ExtendedData><{prefix}SchemaData>{data}</{prefix}SchemaData></{prefix}ExtendedData>{shape}</{prefix}Placemark>"


def test_kml_and_kmz(spark, tmp_path):
    ring = "0,0 1,0 1,1 0,0"
    a = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + mark("123", {"UPC": "001", "OwnerAll": "RAEL", "PLAT": "CAB C-1"}, ring) + mark("", {"UPC": "002"}, ring) + mark("x", {}, "") + "</Document></kml>"
    b = "<kml:kml xmlns:kml='k'><kml:Document>" + mark("GARCIA", {"UPC": "001", "BOOK": "568"}, ring, "kml:") + mark("", {}, "0,0", "kml:") + "</kml:Document></kml:kml>"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.KML").write_text(a)
    with zipfile.ZipFile(tmp_path / "in" / "b.kmz", "w") as z:
        z.writestr("doc.kml", b)
        z.writestr("other.txt", "x")
    (tmp_path / "in" / "bad.kmz").write_bytes(b"no archive")
    path = f"file://{tmp_path}/in"
    assert [(r.name, r.format) for r in kml.discover(spark, path).collect()] == [("a.KML", "kml"), ("b.kmz", "kmz"), ("bad.kmz", "kmz")]
    found = sorted(kml.parcels(kml.placemarks(kml.pieces(spark, path))).collect(), key=lambda r: (r.source, r.block, r.at))
    rows = {(r.source, sum(o.source == r.source for o in found[:i])): r for i, r in enumerate(found)}
    assert {k: (r.owner, r.upc) for k, r in rows.items()} == {("a.KML", 0): ("RAEL", "001"), ("a.KML", 1): ("UPC 002", "002"), ("b.kmz/doc.kml", 0): ("GARCIA", "001"), ("b.kmz/doc.kml", 1): ("Unknown Owner", None)}
    assert rows["a.KML", 0].cab_refs == ["C-1"] and rows["a.KML", 0].centroid == (0.5, 0.25) and len(rows["a.KML", 0].polygon) == 4
    assert rows["b.kmz/doc.kml", 1].polygon is None
    index = kml.build_index(spark, path, f"file://{tmp_path}/out")
    assert sorted((r.upc or "", r.owner) for r in index.collect()) == [("", "Unknown Owner"), ("001", "GARCIA"), ("002", "UPC 002")]
    more = spark.createDataFrame([("001", 1, "old"), ("001", 2, "new")], "upc string, seq int, trs string")
    assert {r.upc: r.arcgis and r.arcgis.trs for r in kml.enrich(index, more).collect()} == {"001": "new", "002": None, None: None}


def test_sessions(spark, tmp_path):
    def put(range_, job, kind, text):
        folder = tmp_path / range_ / job / kind / "E Research"
        folder.mkdir(parents=True)
        (folder / "research.json").write_text(text)

    put("2900", "2950 Rael", "2950-01-BDY Rael", json.dumps({"subjects": [{"id": "1", "type": "client", "deed_saved": True}]}))
    put("2900", "2951 Garcia", "2951-01-ALTA Garcia", json.dumps({"client_name": "G"}))
    put("2900", "2952 Bad", "2952-01-BDY Bad", "{no")
    put("00 Old", "2960 Old", "2960-01-BDY Old", "{}")
    got = sessions.read_sessions(spark, f"file://{tmp_path}")
    assert [(r.job_number, r.client_name, r.job_type, len(r.subjects)) for r in got.collect()] == [(2951, "G", "ALTA", 0), (2950, "Rael", "BDY", 1)]
    assert tuple(sessions.next_job_number(got).first()) == (2952, 2900)
    new = spark.createDataFrame([(2950, [{"id": "1", "plat_saved": True}, {"id": "2", "name": "N"}])], f"job_number long, subjects array<{sessions.SUBJECT}>")
    (row,) = sessions.merge_subjects(got.filter("job_number = 2950"), new).collect()
    assert [(s.id, s.type, s.deed_saved, s.plat_saved, s.name) for s in row.subjects] == [("1", "client", True, True, None), ("2", None, None, None, "N")]
    marked = sessions.mark_saved(got.filter("job_number = 2950"), "1", "plat", "/x").first().subjects[0]
    assert marked.plat_saved and marked.plat_path == "/x" and marked.deed_saved


def test_html(spark):
    row = lambda no: f"<tr><td><a href='x'>{no}</a></td>" + "".join(f"<td>c{i} &amp; d</td>" for i in range(9)) + "</tr>"
    page = f"<table><tr><th>h</th></tr>{row('A12')}{row('no!')}<tr><td>1</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    got = html.result_rows(pages).collect()
    assert [(r.id, r.ordinal, r.doc_no, r.location, r.grantee) for r in got] == [(1, 1, "A12", "c0 & d", "c8 & d")]
    detail = spark.createDataFrame([("<tr><td>Grantor:</td><td>Rael</td></tr><tr><td>Grantor:</td><td>Rael 2</td></tr>",), ("<b>Book:</b> 568<br><strong>Page</strong> 2",), ("x",)], "h string")
    assert [r.m for r in detail.select(html.label_values(F.col("h")).alias("m")).collect()] == [{"Grantor": "Rael 2"}, {"Book": "568", "Page": "2"}, {}]
    form = spark.createDataFrame([('<form><input name="a" value="1"><input type=x name=\'b\'></form>',)], "h string")
    assert form.select(html.form_defaults(F.col("h")).alias("m")).first().m == {"a": "1", "b": ""}
    feed = spark.createDataFrame([('<feed xmlns="http://a"><entry><title>T\n x</title><id>u</id><published>2020-01-02T00</published><author><name>A</name></author></entry></feed>',)], "xml string")
    assert [(r.title, r.url, r.authors, r.published) for r in html.feed_entries(feed).collect()] == [("T x", "u", ["A"], "2020-01-02")]
