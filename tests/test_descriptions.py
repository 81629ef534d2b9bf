import random

import pytest
from pyspark.sql import functions as F

from parcelworks.operators import descriptions as D
from parcelworks.operators import similarity
from parcelworks.storage import stored


def _texts(n, seed=5):
    rng = random.Random(seed)
    words = ["mesa", "river", "fence", "acequia", "road", "corner", "stone", "iron", "brass", "willow", "orchard", "canyon"]
    out = []
    for _ in range(n):
        parts = rng.sample(words, rng.randint(1, 6))
        if rng.random() < 0.7:
            parts += [f"T{rng.randint(20, 22)}N R13E" + (f" Sec {rng.randint(1, 3)}" if rng.random() < 0.6 else "")]
        if rng.random() < 0.3:
            parts += [f"CAB {rng.choice('ABC')}-{rng.randint(1, 3)}"]
        parts += [f"lands of {rng.choice(['Rael', 'Garcia', 'Trujillo', 'Luna'])}"] * (rng.random() < 0.5) + [f"LOT {rng.randint(1, 4)}"] * (rng.random() < 0.4)
        out.append(" ; ".join(parts))
    return out


def _plain(spark, rows, queries, least, limit, weights=None):
    """All pairs by the score's own definition."""
    parts = similarity.legal_score(weights=weights)
    own = stored(similarity.legal_parts(rows.filter(F.length(F.trim("description")) >= 10), "description", "a_"), "own")
    asked = stored(similarity.legal_parts(queries.withColumn("query", F.coalesce("query", F.lit(""))), "query", "b_"), "asked")
    met = own.crossJoin(asked).withColumn("s", F.round(parts["score"], 1)).filter(F.col("s") >= least).select("query_id", "s", "pos", "id").collect()
    out = []
    for q in {r.query_id for r in met}:
        out += [(q, r.id, r.s, n) for n, r in enumerate(sorted((r for r in met if r.query_id == q), key=lambda r: (-r.s, r.pos, r.id))[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "limit", "weights"), [(20.0, 20, None), (50.0, 3, None), (30.0, 8, {"text": 60.0, "cab": 0.0}), (1.0, 2, None)])
def test_against_all_pairs(spark, least, limit, weights):
    texts = _texts(240)
    rows = [(i, i % 97, t, "x") for i, t in enumerate(texts)]
    rows += [(1000 + i, 500 - i, texts[3], "x") for i in range(60)] + [(2000, 1, None, "x"), (2001, 2, "short", "x"), (2002, 3, "zzz yyyy " * 2000, "x"), (2002, 3, "zzz yyyy " * 2000, "x")]
    frame = spark.createDataFrame(rows, "id long, pos long, description string, sid string").repartition(3)
    asked = [(i, texts[i * 7]) for i in range(25)] + [(90, texts[3]), (91, None), (92, ""), (93, "T21N R13E"), (94, "zzz yyyy")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    got = D.similar_descriptions_each(frame, queries, "id", "query_id", least=least, limit=limit, weights=weights)
    assert sorted((r.query_id, r.id, r.score, r.nth) for r in got.collect()) == _plain(spark, frame, queries, least, limit, weights)


def test_empty_frames_and_low_bars(spark):
    frame = spark.createDataFrame([(1, 1, "T21N R13E Sec 4 mesa")], "id long, pos long, description string")
    queries = spark.createDataFrame([(1, "T21N R13E Sec 4")], "query_id long, query string")
    assert D.similar_descriptions_each(frame.limit(0), queries, "id", "query_id").count() == 0
    assert D.similar_descriptions_each(frame, queries.limit(0), "id", "query_id").count() == 0
    with pytest.raises(ValueError):
        D.similar_descriptions_each(frame, queries, "id", "query_id", least=0.0)


def test_classes_need_less_the_more_is_shared():
    found = dict(D.classes(20.0, similarity.WEIGHTS))
    assert found[()] == pytest.approx(0.8) and found[("names",)] == pytest.approx(0.4) and found[("township", "lots")] == pytest.approx(0.12)
    assert found[("trs",)] == found[("cabs",)] == found[("township", "names")] == 0 and ("trs", "names") not in found
    assert ("cabs",) not in dict(D.classes(60.0, similarity.WEIGHTS))


def test_no_nested_loop_without_broadcasts(spark):
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(_texts(30))], "id long, pos long, description string")
    queries = spark.createDataFrame([(1, "T21N R13E Sec 2 mesa river")], "query_id long, query string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = D.similar_descriptions_each(frame, queries, "id", "query_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_what_a_query_lacks_makes_no_pairs(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(D, "stored", lambda frame, what: held.setdefault(what, stored(frame, what)))
    rows = [(i, i, f"mesa river T21N R13E CAB A-{i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, pos long, description string")
    queries = spark.createDataFrame([(1, "mesa river T21N R13E")], "query_id long, query string")
    got = D.similar_descriptions_each(frame, queries, "id", "query_id", limit=3).collect()
    assert sorted((r.id, r.nth) for r in got) == [(0, 1), (1, 2), (2, 3)]
    assert held["pairs"].count() == 1
