import random

from parcelworks.operators.graph import components, contracted


def test_components_of_chains_and_stars(spark):
    draw = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (200, 201), (201, 200)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(pairs, "a int, b int")
    assert {r.id: r.root for r in components(frame).collect()} == {x: find(x) for x in list(root)}
    assert components(frame.limit(0)).count() == 0


def test_contraction(spark):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(1, 8)], "id int, name string")
    edges = spark.createDataFrame([(1, 5, "client_of", 1), (2, 5, "client_of", 2), (2, 6, "client_of", 3), (1, 2, "adjoins", 4), (3, 6, "adjoins", 5), (7, 5, "adjoins", 6)], "src int, dst int, relationship string, seq int")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    left, led = contracted(nodes, edges, pairs)
    assert {r.id: r.aliases for r in left.collect()} == {2: ["n1", "n3"], 4: [], 5: [], 6: [], 7: []}
    assert sorted(tuple(r) for r in led.collect()) == [(2, 5, "client_of", 2), (2, 6, "adjoins", 5), (2, 6, "client_of", 3), (5, 7, "adjoins", 6)]
    left, led = contracted(nodes, edges, pairs.limit(0))
    assert left.count() == 7 and led.count() == 6
