import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from parcelworks.operators import research as R
from parcelworks.operators.matching import beginning_with, containing
from parcelworks.operators.ranking import at_shares, cumulated

TEXTS = "id int, t string, name string"


def made(n, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abçd 𝒳_%") for _ in range(draw.randint(0, 9)))
    return [word() for _ in range(n)]


def test_containing_and_beginning_with_against_all_pairs(spark):
    texts = [(i, t, "x") for i, t in enumerate(made(300, 1))] + [(900, None, "x"), (901, "", None), (902, "hot", "x")] + [(903 + i, "abab" * 9, "y") for i in range(150)]
    names = [*{n[:4] for n in made(60, 2)}, "", None, "ab", "ab", "hot", "hotter", "a", "bab", "zzz"]
    left = spark.createDataFrame(texts, TEXTS)
    right = spark.createDataFrame([(n,) for n in names], "name string")
    for join, test in ((containing, lambda t, n: n in t), (beginning_with, lambda t, n: t.startswith(n))):
        want = sorted((i, n) for i, t, _ in texts if t is not None for n in {n for n in names if n} if test(t, n))
        assert sorted((r.id, r.name) for r in join(left, "t", right, "name").collect()) == want and len(want) > 200
        assert join(left.limit(0), "t", right, "name").count() == 0 and join(left, "t", right.limit(0), "name").count() == 0


def test_containing_within_a_key(spark):
    left = spark.createDataFrame([("A", "blue house"), ("B", "blue house"), (None, "blue house"), ("A", "red")], "k string, t string")
    right = spark.createDataFrame([("A", "house"), ("B", "red"), ("B", "lu")], "k string, n string")
    assert sorted(tuple(r) for r in containing(left, "t", right, "n", by=("k",)).select("k", "t", "n").collect()) == [("A", "blue house", "house"), ("B", "blue house", "lu")]


def plan(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("extended")
    return out.getvalue()


def test_no_nested_loops(spark):
    parcels = spark.createDataFrame([(1, "1", "RAEL ADELA", "1", "2", ["A-1"])], "pos int, upc string, owner string, book string, page string, cab_refs array<string>")
    deeds = spark.createDataFrame([(1, "Rael, A", "X", "M1-2", None, "CAB A-1")], "deed int, grantor string, grantee string, location string, map_upc string, body string")
    nodes = spark.createDataFrame([("person:rael adela", "person", "Rael")], "id string, type string, name string")
    people = spark.createDataFrame([(1, "Rael, A", None)], "client int, name string, map_upc string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            frames = [R.cross_reference(deeds, parcels), R.plats_of_client(parcels, people), R.find_nodes(nodes, people.select("name"))]
            assert [f.count() for f in frames] == [1, 1, 1]
            for frame in frames:
                assert "NestedLoop" not in plan(frame) and "Cartesian" not in plan(frame)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cumulated_and_shares_against_sorted_lists(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, round(draw.gauss(0, 1), 2), 7.0])) for _ in range(3000)] + [("hot", float(i)) for i in range(2000)] + [("one", 1.0), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    want = {g: (len(v), sorted(v)[int(len(v) * 0.25)], sorted(v)[int(len(v) * 0.75)], min(v), max(v)) for g, v in groups.items()}
    got = {r.g: (r.n, r.q1, r.q3, r.low, r.high) for r in at_shares(frame, "g", "v", {"q1": 0.25, "q3": 0.75}).collect()}
    assert got == want
    assert at_shares(frame.limit(0), "g", "v", {"q": 0.5}).count() == 0
    sums = cumulated(spark.range(1000).withColumn("w", F.when(F.col("id") % 3 == 0, F.lit(None).cast("bigint")).otherwise(F.col("id"))), "w", "id").collect()
    total, expect = 0, []
    for i in range(1000):
        total += 0 if i % 3 == 0 else i
        expect.append((i, total))
    assert sorted((r.id, r.upto) for r in sums) == expect
