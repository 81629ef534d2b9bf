"""Hand-computed cases of the operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parcelworks.operators import adjacency, graph, ordering, search, similarity, stats
from parcelworks.streaming import limiter


def test_search(spark):
    rows = [(1, "RAEL ADELA", "001", "568", "1", "CAB C-191A", ["C-191A"]), (2, "GARCIA", "002", "568", "2", "", []), (3, None, None, None, None, None, None)]
    p = spark.createDataFrame(rows, "pos int, owner string, upc string, book string, page string, plat string, cab_refs array<string>")
    ids = lambda **c: [r.pos for r in search.search_parcels(p, **c).collect()]
    assert ids() == [1, 2, 3] and ids(limit=1) == [1]
    assert ids(owner="rael") == [1] and ids(owner="adela", operator="begins") == [] and ids(owner="garcia", operator="exact") == [2]
    assert ids(book="568") == [1, 2] and ids(book="568", page="2") == [2] and ids(upc="1") == [] and ids(cabinet_ref="c-191a") == [1]
    fallback = lambda q: [r.pos for r in search.search_with_fallback(p, q).collect()]
    assert fallback("002") == [2] and fallback("rael") == [1] and fallback("x") == []
    names = spark.createDataFrame([("RAEL",), ("12-3",), ("1234A",), ("UPC 12",), ("AB",)], "n string")
    assert [r.n for r in names.filter(search.is_person_name(F.col("n"))).collect()] == ["RAEL"]


def test_merge_index(spark):
    rows = [(0, "a", "x", "f.kml"), (1, "", "y", "f.kml"), (2, "a", "longer", "f.kml"), (3, "b", "", "f.kml"), (4, "a", "z", "g.kmz/doc.kml"), (5, None, "q", "f.kml"), (6, "b", "", "f.kml")]
    got = ordering.merge_index(spark.createDataFrame(rows, "pos int, upc string, plat string, source string")).orderBy("order_key").collect()
    assert [r.pos for r in got] == [4, 3, 1, 5]


def test_unions(spark):
    hits = spark.createDataFrame([("a", 10, "Name", 1), ("b", 50, "Book", 2), ("a", 10, "Name2", 3), (None, 9, "x", 4), ("c", 50, "Cab", 5)], "upc string, score int, reason string, seq int")
    assert [tuple(r) for r in ordering.score_union(hits).collect()] == [("b", 50, "Book"), ("c", 50, "Cab"), ("a", 20, "Name + Name2")]
    f = lambda *names: spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")
    got = ordering.prioritised_union([(f("A", "B", "C"), 2), (f("b", "D", "C"), None)], F.lower("name"), 3).collect()
    assert [(r.name, r.prio) for r in got] == [("A", 0), ("B", 0), ("D", 1)]
    assert [r.name for r in ordering.first_nonempty([f("x").limit(0), f("y"), f("z")]).collect()] == ["y"]
    old = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id int, v string, w boolean")
    new = spark.createDataFrame([(2, None, False), (3, "c", None)], "id int, v string, w boolean")
    assert sorted(tuple(r) for r in ordering.upsert(old, new, "id").collect()) == [(1, "a", True), (2, "b", False), (3, "c", None)]


def box(x, y, d=0.001):
    return [(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]


def test_adjacency(spark):
    kind = "pos int, upc string, polygon array<struct<lng:double,lat:double>>, centroid struct<lng:double,lat:double>"
    rows = [(0, "c", box(0.0, 0.0), (0.0005, 0.0005)), (1, "touch", box(0.001, 0.0), (0.0015, 0.0005)), (2, "near", box(0.0, 0.00118), (0.0, 0.0015)), (3, "far", box(0.01, 0.01), (0.01, 0.01)), (4, "point", None, (0.0008, 0.0008)), (5, None, box(5.0, 5.0), None)]
    p = spark.createDataFrame(rows, kind)
    got = adjacency.find_adjacent(p, "c").collect()
    assert [(r.upc, r._adjacency_type) for r in got] == [("touch", "edge"), ("near", "edge")]
    assert got[0]._adjacency_dist == 0 and got[1]._adjacency_dist == pytest.approx(0.00018)
    assert sorted((r.a, r.b) for r in adjacency.adjacent_pairs(p).collect()) == [("c", "near"), ("c", "touch"), ("near", "touch")]
    assert {r.upc for r in adjacency.find_adjacent(p, "point").collect()} == {"c", "touch", "near"}
    assert adjacency.find_adjacent(p, "none").count() == 0


def test_baselines_and_flags(spark):
    rows = [(i, "a", 1.0 + (i % 3) * 0.1) for i in range(40)] + [(90, "a", 9.0), (91, "b", 5.0)]
    f = spark.createDataFrame(rows, "id int, g string, v double")
    base = {r.g: (r.n, r["std"]) for r in stats.baselines(f, "g", "v").collect()}
    assert base["b"] == (1, 0.0) and base["_global"][0] == 42
    assert [(r.id, r.level) for r in stats.zscore_flags(f, "g", "v", "id").orderBy("id").collect()][0] == (90, "error")
    q = stats.indexed_quartiles(spark.createDataFrame([("x", i) for i in (4, 1, 3, 2)], "g string, v int"), "g", "v").first()
    assert (q.n, q.q1, q.q3) == (4, 2, 4)


def test_sessions_and_users(spark):
    kind = "id int, subjects array<struct<name:string,type:string,deed_saved:boolean,plat_saved:boolean>>"
    rows = [(1, [("c", "client", True, True), ("x", "adjoiner", True, None), ("y", "adjoiner", None, False)]), (2, []), (3, None)]
    got = {r.id: r for r in stats.completeness(spark.createDataFrame(rows, kind)).collect()}
    assert (got[1].adjoiner_count, got[1].deed_count, got[1].both_count, got[1].completion_pct, got[1].missing) == (2, 2, 1, 33.3, ["x", "y"])
    assert got[2].completion_pct == 0.0 and got[3].subject_count == 0
    users = stats.user_stats(spark.createDataFrame([("free", True), ("pro", True)], "tier string, active boolean"))
    assert {r.tier: (r.users, r.revenue) for r in users.collect()} == {"free": (1, 0), "pro": (1, 29), "team": (0, 0)}
    history = spark.createDataFrame([("BDY", 3)] * 5 + [("ALTA", 20)], "job_type string, adjoiner_count int")
    row = stats.predict_complexity(history, "BDY").first()
    assert (row.n, row.predicted, row.complexity, row.confidence) == (5, 3.0, "simple", "medium")
    assert stats.predict_complexity(history, "none").first().n == 6


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "x", 1), ("b", "a", "y", 2), ("b", "c", "x", 3), ("c", "a", "x", 4), ("c", "d", "x", 5), ("d", "d", "x", 6), ("q", "r", "x", 7)], "src string, dst string, relationship string, seq int")
    edges = graph.canonical_edges(e)
    assert {(r.src, r.dst): r.relationship for r in edges.collect()}[("a", "b")] == "y" and edges.count() == 5
    got = {r.id: (r.hops, r.parent) for r in graph.bfs(edges, spark.createDataFrame([("a",), (None,), ("a",)], "id string"), 5).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "c")}
    people = spark.createDataFrame([("1", "Rael, Adela"), ("2", "RAEL ADELA"), ("3", "Rael, Adelia"), ("4", "Garcia, Juan")], "id string, name string")
    assert ("1", "3") in {(r.a, r.b) for r in graph.duplicates(people).collect()}
    kept = graph.keep_of_pair(spark.createDataFrame([("a", "d"), ("q", "d")], "a string, b string"), edges).collect()
    assert sorted(r.keep for r in kept) == ["a", "q"]


def test_legal_similarity(spark):
    rows = [(1, "T26N R13E Sec 12 Lot 3 lands of Rael, CAB C-191"), (2, "T26N R13E Sec 13 other words"), (3, "unrelated text about something"), (4, "short")]
    f = spark.createDataFrame(rows, "pos int, description string")
    got = similarity.similar_descriptions(f, rows[0][1], least=0.0).collect()
    assert [r.pos for r in got] == [1, 2, 3] and got[0].score == 100.0 and got[1].trs_match == 30.0
    j = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"])], "a array<string>, b array<string>").select(similarity.jaccard(F.col("a"), F.col("b")).alias("j")).first().j
    assert j == 0.5


def test_limiter(spark):
    t0 = datetime(2024, 1, 1)
    events = spark.createDataFrame([("k", i, t0 + timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3, 59, 61, 61])] + [("other", 50, t0)], "key string, id long, ts timestamp")
    got = {r.id: (r.allowed, r.retry_after) for r in limiter.limited(events, 3, 60.0).collect()}
    assert [got[i][0] for i in range(7)] == [True, True, True, False, False, True, False]
    assert got[3][1] == 58 and got[50] == (True, 0)


def test_lockout(spark):
    t0 = datetime(2024, 1, 1)
    at = [0, 1, 2, 3, 4, 5, 20, 21, 40]
    ok = [False] * 5 + [True, False, True, True]
    rows = [("u", i, t0 + timedelta(minutes=m), o) for i, (m, o) in enumerate(zip(at, ok))]
    got = limiter.lockouts(spark.createDataFrame(rows, "user string, id long, ts timestamp, ok boolean")).orderBy("id").collect()
    # the fifth failure locks until 19; one failure after that locks again
    assert [r.blocked for r in got] == [False] * 5 + [True, False, True, False]
    assert got[6].locked_until == t0 + timedelta(minutes=35)


def test_subscriptions(spark):
    rows = [("a", 1, 1, "checkout.session.completed", None, "team"), ("a", 2, 2, "invoice.payment_failed", None, None), ("b", 1, 3, "customer.subscription.updated", "active", "pro"), ("b", 2, 4, "customer.subscription.deleted", None, None), ("c", 1, 5, "ping", None, None)]
    events = spark.createDataFrame(rows, "user string, at int, id int, type string, status string, tier string")
    assert {r.user: r.tier for r in limiter.subscription_tiers(events).collect()} == {"a": "team", "b": "free", "c": "free"}


def test_topk_of_many_queries(spark):
    import numpy as np

    from parcelworks.operators.similarity import cosine, vector_topk_each

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(400, [0.0] * 6), (401, None), (402, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.filter("vec_id % 50 = 0")
    got = sorted((r.query_id, r.nth, r.vec_id) for r in vector_topk_each(vectors, queries, 12, size=3).collect())
    both = queries.select(F.col("vec_id").alias("q"), F.col("embedding").alias("e")).crossJoin(vectors).select("q", "vec_id", cosine(F.col("embedding"), F.col("e")).alias("s"))
    want = {}
    for q, v, s in both.filter("s IS NOT NULL").collect():
        want.setdefault(q, []).append((-s, v))
    assert got == sorted((q, n, v) for q, found in want.items() for n, (_, v) in enumerate(sorted(found)[:12], 1)) and len(want) == 7
    assert vector_topk_each(vectors, queries.limit(0)).count() == 0


def test_tokens_of_many_queries(spark):
    from parcelworks.operators.similarity import token_overlap

    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["a"]), (2, []), (3, ["z"]), (None, ["b"])], "doc_id long, tokens array<string>")
    items = spark.createDataFrame([(10, ["a", "b"]), (20, ["b", "y"]), (30, [])], "item_id long, tokens array<string>")
    want = [(1, 10, 1, 2), (1, 10, 2, 3), (1, 20, 1, 4), (None, 10, 1, 2), (None, 20, 1, 2)]
    for bound in (100, 0):
        assert sorted(map(tuple, token_overlap(docs, items, "doc_id", "item_id", bound=bound).collect()), key=str) == want


def test_searches_for_all_queries(spark):
    from parcelworks.plans import more, registry  # noqa: F401

    d = "/root/testdata/sf0.001"
    ids = lambda name, c: {r[0] for r in registry.QUERIES[name](spark, d).select(c).distinct().collect()}
    asked = lambda name, c: {r[0] for r in registry.table(spark, d, name).filter(f"{c} % 50 = 0").select(c).collect()}
    assert ids("vector_topk_all", "query_id") == asked("embeddings", "vec_id")
    assert ids("novelty_all", "item_id") == asked("benchmark", "item_id") >= ids("token_jaccard_all", "item_id") > set()


def test_calls_and_search_of_the_whole_table(spark):
    from parcelworks.plans import more, registry  # noqa: F401

    d = "/root/testdata/sf0.001"
    rows = registry.table(spark, d, "lineitem").select("l_suppkey", "l_partkey").collect()
    assert registry.QUERIES["call_parse_all"](spark, d).filter("azimuth IS NOT NULL AND distance IS NOT NULL").count() == len(rows)
    ways = {}
    for s, p in rows:
        ways.setdefault(f"s{s}", set()).add(f"p{p}")
        ways.setdefault(f"p{p}", set()).add(f"s{s}")
    front = {min(x for x in ways if x[0] == "s")}
    want = {x: 0 for x in front}
    for hop in (1, 2, 3):
        front = {y for x in front for y in ways[x]} - want.keys()
        want |= dict.fromkeys(front, hop)
    assert {r.id: r.hops for r in registry.QUERIES["graph_bfs_all"](spark, d).collect()} == want
