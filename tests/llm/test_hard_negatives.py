import math

import numpy as np
from pyspark.sql import Row

from parcelworks.llm import hard_negatives
from parcelworks.llm.hard_negatives import Best, Side, best_positives, mined


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = (label, [max(min(math.floor(256 * x), 1 << 23), -(1 << 23)) for x in v])
        own[i] = min(own.get(i, new), new)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in own.items():
        if a % every:
            continue
        scored = sorted(((-dot(v, w), i, m == label) for i, (m, w) in own.items() if i != a))
        for s, p, same in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([Row(vec_id=i, label=m, embedding=v, block=1, scores="x") for i, m, v in rows], "vec_id bigint, label int, embedding array<float>, block int, scores string")


def clustered(n, dims=16, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dims))
    return [(i, int(draw.integers(4)), [float(np.float32(x)) for x in centres[draw.integers(6)] + 0.3 * draw.normal(size=dims)]) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    for name, value in (("ROW_BLOCK", 64), ("ANCHOR_BLOCK", 8), ("SLICE", 3), ("HELD", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(500)
    odd = [(None, 1, [1.0] * 16), (600, None, [1.0] * 16), (601, 1, None), (602, 1, [None] * 16), (603, 1, [math.nan] * 16), (604, 2, [math.inf] * 16),
           (650, 1, []), (651, 1, [0.5]), (700, 3, [1e30] * 3), (701, 3, [-1e30] * 3), (50, 0, [0.1] * 16), (100, rows[100][1], rows[100][2])]
    rows += odd
    want = brute(rows, every=10)
    assert len(want) > 300
    assert sorted(tuple(r) for r in mined(frame(spark, rows), every=10).collect()) == want
    monkeypatch.setattr(hard_negatives, "BROADCAST_BYTES", 0)  # dealt to the grid's cells
    monkeypatch.setattr(hard_negatives, "CELL", 2)
    assert sorted(tuple(r) for r in mined(frame(spark, rows), every=10).collect()) == want


def test_one_vector_for_a_third_of_all_rows(spark):
    rows = [(i, i % 3, [0.5, 0.25, 0.0, 0.125] if i % 3 == 0 or i % 7 == 0 else [0.3, i % 11 / 10, 0.1, -0.2]) for i in range(400)]
    assert sorted(tuple(r) for r in mined(frame(spark, rows)).collect()) == brute(rows)


def test_empty(spark):
    assert mined(frame(spark, [])).count() == 0
    assert mined(frame(spark, [(1, 1, [0.5])])).count() == 0
    assert mined(frame(spark, [(50, 1, [0.5])])).count() == 0


def test_most_pairs_are_left_out_on_clustered_vectors():
    rows = clustered(4000, 32)
    grid = np.array([[math.floor(256 * x) for x in v] for _, _, v in rows])
    turn = np.linalg.eigh(grid.T.astype(float) @ grid)[1][:, ::-1]
    side = Side(np.arange(4000), np.zeros(4000, int), grid, np.ascontiguousarray(turn))
    anchors = Side(np.arange(0, 4000, 50), np.zeros(80, int), grid[::50], np.ascontiguousarray(turn))
    best = Best(80, 5)
    assert best_positives(anchors, side, best) < 0.05 * 80 * 4000
    scores = grid[::50] @ grid.T
    scores[np.arange(80), np.arange(0, 4000, 50)] = -(1 << 60)
    assert (best.scores == -np.sort(-scores, axis=1)[:, :5]).all()


def test_ties_go_to_the_smaller_id():
    best = Best(1, 2)
    best.add(np.array([0, 0, 0, 0]), np.array([5, 5, 5, 5]), np.array([9, 4, 7, 4]))
    assert best.ids.tolist() == [[4, 7]]
    best.add(np.array([0, 0]), np.array([5, 6]), np.array([1, 30]))
    assert best.ids.tolist() == [[30, 1]] and best.scores.tolist() == [[6, 5]]
