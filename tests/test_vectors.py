import numpy as np
from pyspark.sql import functions as F

from parcelworks.operators import vectors as V
from parcelworks.operators.similarity import vector_topk_each


def _clustered(n, dim, groups, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + rng.normal(size=dim) * 0.05).tolist()) for i in range(n)]


def test_same_rows_as_the_scan_with_most_lists_left_out(spark, monkeypatch):
    monkeypatch.setattr(V, "LIST_ROWS", 100)
    rows = _clustered(3000, 8, 30)
    rows += [(5000 + i, rows[7][1]) for i in range(700)]  # a group of copies, more than a list holds
    odd = [(9000, None), (9001, [0.0] * 8), (9002, [1.0]), (9003, [float("nan")] * 8), (9004, [None] * 8), (9005, [float("inf")] + [1.0] * 7), (9006, [])]
    extra = "vec_id long, embedding array<double>, cell string, part string"
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows + odd], extra).repartition(3)
    queries = frame.filter("vec_id % 50 = 0 OR vec_id > 9000").unionByName(frame.filter("vec_id = 100"))
    index = V.vector_index(frame, centres=40, sample=800)
    got = V.nearest(index, queries, 4).collect()
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = vector_topk_each(plain, plain.filter("vec_id % 50 = 0").unionByName(plain.filter("vec_id = 100")), 4).collect()
    key = lambda r: (r.query_id, r.nth, r.vec_id, r.similarity)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 4 * 75
    # a third of the rows may be copies; the other queries meet few rows
    assert np.median([r.compared for r in got]) < 0.1 * len(rows)


def test_fewer_rows_than_asked_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    index = V.vector_index(frame)
    assert [(r.vec_id, r.nth) for r in V.nearest(index, frame.filter("vec_id = 1"), 5).orderBy("nth").collect()] == [(1, 1), (2, 2)]
    assert V.nearest(index, frame.limit(0), 5).count() == 0
    assert V.nearest(V.vector_index(frame.limit(0), dim=2), frame, 5).count() == 0


def test_hashed_vectors(spark):
    rows = [(1, "Mesa mesa river"), (1, "mesa RIVER mesa"), (2, None), (3, "a b"), (4, "")]
    frame = spark.createDataFrame(rows, "id long, text string")
    got = sorted((r.id, r.embedding) for r in V.hashed_vectors(frame, "id", "text", 16).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4] and got[0][1] == got[1][1] and sum(map(abs, got[0][1])) in (1.0, 3.0)
    assert all(g[1] == [0.0] * 16 for g in got[2:])
    assert V.hashed_vectors(frame.limit(0), "id", "text").count() == 0
