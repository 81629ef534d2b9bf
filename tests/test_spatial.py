import random

import numpy as np
from pyspark.sql import functions as F

from parcelworks.operators import adjacency as A
from parcelworks.operators import spatial as S

POLYGONS = "id int, polygon array<struct<lng:double,lat:double>>"


def rect(x0, y0, x1, y1, turned=False):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    ring = [(x - y, x + y) for x, y in ring] if turned else ring
    return [(float(x), float(y)) for x, y in ring]


def told(p, q):
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = p, q
    if ax1 < bx0 or bx1 < ax0 or ay1 < by0 or by1 < ay0:
        return None
    if ax1 == bx0 or bx1 == ax0 or ay1 == by0 or by1 == ay0:
        return "touches"
    if p == q:
        return "equal"
    if ax0 <= bx0 and ay0 <= by0 and bx1 <= ax1 and by1 <= ay1:
        return "contains"
    if bx0 <= ax0 and by0 <= ay0 and ax1 <= bx1 and ay1 <= by1:
        return "within"
    return "overlaps"


def test_relations_against_rectangles(spark):
    draw = random.Random(5)

    def some(n):
        out = []
        for _ in range(n):
            x, y = draw.randint(0, 12), draw.randint(0, 12)
            out.append((x, y, x + draw.randint(1, 6), y + draw.randint(1, 6)))
        return out

    left, right = some(40), [*some(40), (0, 0, 18, 18)]
    want = {(i, j): kind for i, p in enumerate(left) for j, q in enumerate(right) if (kind := told(p, q))}
    assert set(want.values()) == {"touches", "equal", "contains", "within", "overlaps"} or len(set(want.values())) >= 4
    for turned in (False, True):
        frame = lambda rows: spark.createDataFrame([(i, rect(*r, turned)) for i, r in enumerate(rows)], POLYGONS)
        for size in (None, 1.3):
            got = {(r.a, r.b): r.relation for r in S.relations(frame(left), frame(right), size).collect()}
            assert got == want


def test_relations_of_rings_that_are_no_rectangles(spark):
    comb = [(0, 0), (10, 0), (10, 6), (8, 6), (8, 2), (6, 2), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0)]  # closed, three teeth
    others = {1: rect(2, 2, 4, 6), 2: rect(2.5, 3, 3.5, 5), 3: [(5, 0), (7, -3), (3, -3)], 4: rect(0.5, 0.5, 9.5, 1.5), 5: rect(3, 3, 7, 5), 6: [(0, 0), (1, 1)], 7: None, 8: [(0, 0), None, (1, 1)], 9: rect(4, 1, 6, 2)}
    left = spark.createDataFrame([(0, [(float(x), float(y)) for x, y in comb])], POLYGONS)
    right = spark.createDataFrame([(i, r and [p and (float(p[0]), float(p[1])) for p in r]) for i, r in others.items()], POLYGONS)
    assert {r.b: r.relation for r in S.relations(left, right).collect()} == {1: "touches", 3: "touches", 4: "contains", 5: "overlaps", 9: "contains"}
    assert S.relations(left.limit(0), right).count() == 0


def test_points_in_polygons(spark):
    draw = random.Random(2)
    star = [(np.cos(t) * (5 if i % 2 else 2), np.sin(t) * (5 if i % 2 else 2)) for i, t in enumerate(np.arange(0, 2 * np.pi - 1e-9, np.pi / 8))]
    rings = {1: [(float(x), float(y)) for x, y in star], 2: rect(-3, -3, 0, 0), 3: rect(-1, -1, 4, 4)}
    points = [(i, draw.uniform(-6, 6), draw.uniform(-6, 6)) for i in range(400)] + [(900, 0.0, 0.0), (901, -3.0, -1.5), (902, None, 1.0), (903, float("nan"), 0.0)] + [(1000 + i, 1.0, 1.0) for i in range(300)]

    def inside(ring, x, y):
        n = 0
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return n % 2 == 1

    want = {(p, i) for p, x, y in points if x is not None and x == x for i, r in rings.items() if inside(r, x, y)} | {(900, 2), (901, 2), (900, 3)}
    polygons = spark.createDataFrame(list(rings.items()), POLYGONS)
    frame = spark.createDataFrame(points, "point int, x double, y double")
    for size in (None, 0.7):
        got = S.points_in_polygons(frame, polygons, size).collect()
        assert {(r.point, r.id) for r in got} == want and len(got) == len(want)
        assert {(r.point, r.id) for r in got if r.side == "boundary"} == {(900, 2), (901, 2)}


def test_adjoiners_and_sections(spark):
    parcels = spark.createDataFrame([(i, f"u{i}", rect(i, 0, i + 1, 1), "x" * 300) for i in range(6)], "pos int, upc string, polygon array<struct<lng:double,lat:double>>, legal string")
    asked = spark.createDataFrame([(1, rect(2, 0, 3, 1)), (2, rect(2.2, 0.2, 4.5, 0.8)), (3, rect(50, 50, 51, 51))], "query int, polygon array<struct<lng:double,lat:double>>")
    got = sorted((r.query, r.upc, r.spatial_rel, r.nth, len(r.legal)) for r in S.spatial_adjoiners(asked, parcels).collect())
    assert got == [(1, "u1", "touches", 1, 200), (1, "u3", "touches", 2, 200), (2, "u2", "intersects", 1, 200), (2, "u3", "intersects", 2, 200), (2, "u4", "intersects", 3, 200)]
    assert {r.nth for r in S.spatial_adjoiners(asked, parcels, 1).collect()} == {1}
    sections = spark.createDataFrame([(1, rect(-4, -4, -2, -2), 26, "N", 13, "E", "12"), (2, rect(-2, -4, 1, -2), 26, "N", 14, "E", None)], POLYGONS + ", twp int, twp_dir string, rng int, rng_dir string, sec string")
    points = spark.createDataFrame([(1, -3.0, -3.0), (2, -2.0, -3.0), (3, -1.0, -3.0), (4, 0.0, -3.0), (5, 9.0, 9.0)], "point int, x double, y double")
    assert sorted(tuple(r) for r in S.sections_of(points, sections).collect()) == [(1, "T26N R13E S12"), (2, "T26N R13E S12"), (3, "T26N R14E")]


def brute_distance(p, q):
    def one(a, b):
        best = np.inf
        for x in a:
            for s, t in zip(b[:-1], b[1:]):
                d = t - s
                u = np.clip((x - s) @ d / (d @ d), 0, 1) if d @ d else 0
                best = min(best, float(((x - s - u * d) ** 2).sum()))
        return best

    return min(one(p, q), one(q, p)) ** 0.5


def test_ring_distance_against_all_segments():
    draw = np.random.default_rng(1)
    for n, m in ((4, 5), (150, 7), (200, 300), (1, 3), (2, 1)):
        for _ in range(4):
            p, q = draw.normal(size=(n, 2)).cumsum(axis=0), draw.normal(size=(m, 2)).cumsum(axis=0) + draw.normal(scale=40, size=2)
            assert abs(A.ring_distance(p, q) - brute_distance(p, q)) < 1e-9
    assert A.ring_distance([], [[0, 0]]) == A.ring_distance([[0, 0]], [[1, 1]]) == float("inf")


def test_ring_distance_of_long_rings_needs_little_memory():
    import tracemalloc

    t = np.linspace(0, 2 * np.pi, 100_000)
    ring = lambda x, r: np.column_stack([x + r * np.cos(t), r * np.sin(t)])
    a, b = ring(0, 1), ring(3, 1.5)
    tracemalloc.start()
    found = A.ring_distance(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(found - 0.5) < 1e-6 and most < 200e6


def test_near_points_of_floats(spark):
    # 0.01 as a float lies below 0.01 as a double, but not below itself
    r = float(np.float32(0.01))
    points = [(1, 0.0, 0.0), (2, r, 0.0), (3, float(np.nextafter(np.float32(r), np.float32(0))), 0.0)]
    frame = spark.createDataFrame(points, "id int, x float, y float")
    assert sorted(map(tuple, A.near_points(frame, 0.01).collect())) == [(1, 3), (2, 3)]
    assert sorted(map(tuple, A.near_points(frame.selectExpr("id", "cast(x as double) x", "cast(y as double) y"), 0.01).collect())) == [(1, 2), (1, 3), (2, 3)]
    # the quotients 1 - 2**-53 and 2 - 2**-52 are less than one apart, and rounding may move them two cells apart
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 50, 300) * 0.01, rng.random(300) * 0.5])
    want = sorted((i, j) for i in range(600) for j in range(i + 1, 600) if abs(x[i] - x[j]) < 0.01)
    frame = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(x)], "id int, x double, y double")
    assert sorted(map(tuple, A.near_points(frame, 0.01).collect())) == want


def test_many_alike_rows_are_not_broadcast(spark):
    # a million alike rows take some KB of file, and would be gathered in the driver
    from parcelworks.storage import broadcast_if_small, stored

    many = stored(spark.range(1_000_000).selectExpr("id div 100000 AS k", "1.5D AS x"), "alike")
    few = stored(spark.range(100).selectExpr("id AS k"), "few")
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    own = many.select(F.col("k").alias("j"), (F.col("x") + 1).alias("y")).filter("y > 0")
    assert "Broadcast" not in plan(many.join(own, F.col("k") == F.col("j")))
    assert "Broadcast" in plan(many.join(broadcast_if_small(few, 16), "k"))
    assert "Broadcast" not in plan(many.join(broadcast_if_small(many.select("k"), 16), "k"))


def test_adjoiners_are_joined_without_gathering_parcels(spark):
    parcels = spark.createDataFrame([(i, i, rect(4 * i, 0, 4 * i + 4, 4), "tract") for i in range(20)], "pos int, upc int, polygon array<struct<lng:double,lat:double>>, legal string")
    plan = S.spatial_adjoiners(parcels.select(F.col("pos").alias("query"), "polygon"), parcels)._jdf.queryExecution().executedPlan().toString()
    # the pairs found are the broadcast side, not the parcels with their texts
    assert "legal" not in plan[plan.index("BroadcastExchange") :].split("\n", 1)[1]
