import json
import re
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from parcelworks.sources import lookup as L


@pytest.fixture(scope="module")
def service():
    """A stand-in for a feature service: knows the keys 0 to 499, fails on any batch with a key that begins with BAD."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            form = dict(urllib.parse.parse_qsl(self.rfile.read(int(self.headers["Content-Length"])).decode()))
            keys = [k.replace("''", "'") for k in re.findall(r"'((?:[^']|'')*)'", form["where"])]
            asked.append(keys)
            known = [k for k in keys if k.isdigit() and int(k) < 500 or k == "O'B"]
            geometry = {"geometry": {"rings": [[[0, 0], [1, 0], [1, 1]]]}} if form["returnGeometry"] == "true" else {}
            answer = {"features": [{"attributes": {"UPC": k, "OWNER_1": f" Owner {k} ", "AREA": None}, **geometry} for k in known]}
            broken = any(k.startswith("BAD") for k in keys)
            body = json.dumps({"error": {"code": 500}} if "BAD2" in keys else answer).encode()
            self.send_response(503 if broken and "BAD2" not in keys else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/query", asked
    server.shutdown()


FIELDS = "upc=UPC, owner=OWNER_1, area=AREA"


def test_a_filter_on_the_key_becomes_batches(spark, service):
    url, asked = service
    L.register(spark)
    source = spark.read.format("keyed_lookup").options(url=url, fields=FIELDS, delay="0").load()
    with pytest.raises(Exception, match="needs a filter"):
        spark.read.format("keyed_lookup").options(url=url, fields=FIELDS).load().count()
    asked.clear()
    wanted = [str(i) for i in range(0, 600, 6)]
    rows = source.filter(F.col("upc").isin(*wanted)).collect()
    assert sorted(int(r.upc) for r in rows) == list(range(0, 500, 6)) and {len(a) for a in asked} == {40, 20}
    assert all(r.owner == f"Owner {r.upc}" and r.area is None for r in rows)
    assert [r.owner for r in source.filter("upc = '7' AND owner LIKE '%7'").collect()] == ["Owner 7"]
    assert source.filter("upc = '7' AND upc IN ('8')").count() == 0


def test_a_failed_batch_costs_itself_alone(spark, service):
    url, _ = service
    L.register(spark)
    source = spark.read.format("keyed_lookup").options(url=url, fields=FIELDS, delay="0", batch="10").load()
    for bad in ("BAD1", "BAD2"):
        got = source.filter(F.col("upc").isin(*[str(i) for i in range(15)], bad)).count()
        assert got == 10


def test_tables_of_keys(spark, service):
    url, asked = service
    keys = spark.createDataFrame([(str(i),) for i in range(700)] + [(None,), ("",), ("3",), (" 4 ",), ("O'B",)], "upc string").repartition(3)
    asked.clear()
    rows = L.looked_up(keys, L.Service(url, (("upc", "UPC"), ("owner", "OWNER_1")), delay=0)).collect()
    assert sorted(r.upc for r in rows) == sorted([str(i) for i in range(500)] + ["O'B"]) and not any(r.error for r in rows)
    assert max(map(len, asked)) == 40 and sum(map(len, asked)) == 701
    few = spark.createDataFrame([("1",), ("2",), ("BAD1",)], "upc string").coalesce(1)
    rows = L.looked_up(few, L.Service(url, (("upc", "UPC"), ("owner", "OWNER_1")), delay=0)).collect()
    assert {r.upc for r in rows} == {"1", "2", "BAD1"} and all("503" in r.error and r.owner is None for r in rows)
    assert L.looked_up(keys.limit(0), L.Service(url, (("upc", "UPC"),), delay=0)).count() == 0


def test_outlines(spark, service):
    url, _ = service
    one = spark.createDataFrame([("1",)], "upc string")
    rows = L.looked_up(one, L.Service(url, (("upc", "UPC"),), geometry=True, delay=0)).select("upc", L.outline(F.col("geometry")).alias("polygon")).collect()
    assert [(p.lng, p.lat) for p in rows[0].polygon] == [(0, 0), (1, 0), (1, 1)]
    assert spark.createDataFrame([("x",), (None,)], "g string").select(L.outline(F.col("g")).alias("p")).filter("p IS NOT NULL").count() == 0
