import re

import numpy as np

from parcelworks.llm import graph
from parcelworks.llm import near_duplicates as N
from parcelworks.llm.common import table


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, per_cent=85):
    sets = [(i, plain(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets:
        for v in s:
            by.setdefault(v, []).append(i)
    of = dict(sets)
    seen = set()
    for i, s in sets:
        for j in {j for v in s for j in by[v]}:
            if j > i and (i, j) not in seen:
                seen.add((i, j))
                n = len(s & of[j])
                if n and 100 * n >= per_cent * len(s | of[j]):
                    p, q = root(i), root(j)
                    parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def family():
    rng = np.random.default_rng(4)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  TWO"), (5, "one two three four five")]
    n = 10
    for size in (2, 5, 30, 120):
        base = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(40, 200))]
        for _ in range(size):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, max(2, len(own) // 30))):
                own[at] = f"e{rng.integers(0, 10**9)}"
            rows.append((n, " ".join(own)))
            n += 1
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(n + i, passage + " " + " ".join(f"u{i}x{j}" for j in range(int(rng.integers(2, 150))))) for i in range(80)]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


def test_against_plain_comparison(spark):
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) < len(rows) - 50
    for longest, chunk, total in ((50, 256, 200_000), (8, 16, 1500)):
        got = sorted(tuple(r) for r in N.grouped(docs, 85, longest=longest, chunk_docs=chunk, chunk_shingles=total).collect())
        assert got == want


def test_real_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(tuple(r) for r in N.op10(spark, "/root/testdata/sf0.01").collect()) == want
    assert any(not k for *_, k in want)


def test_edges(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", "z"), (None, "a b c d e f", "n"), (7, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in N.grouped(docs).collect()))
    assert got == [(0, 2, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (7, 0, 7, True)]
    kept = N.keep_first(docs)
    left = sorted(r.kept for r in kept.collect())
    assert kept.columns == docs.columns and left in (["q", "x"], ["q", "y"])
    rows = [(None, "p q r s t u", "a"), (None, "p q r s t u", "b"), (None, "", "c"), (None, None, "d"), (5, "one two", "e"), (5, "three four", "f"), (None, "", "g")]
    left = [r.kept for r in N.keep_first(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()]
    assert sorted(set(left) - {"a", "b"}) == ["c", "d", "e", "f", "g"] and len(set(left) & {"a", "b"}) == 1
    assert N.grouped(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (100, 300), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 300: 100}


def test_rest_of_a_large_cluster_meets_every_chunk_of_the_group(spark):
    base = [f"w{i}" for i in range(200)]
    edited = lambda own, n, places: [f"e{n}x{i}" if i in places else w for i, w in enumerate(own)]
    rows = [(0, " ".join(base))]
    for n in range(1, 13):  # n is like the base, 100 + n like n alone
        one = edited(base, n, (20 + n, 60 + n, 100 + n))
        rows += [(n, " ".join(one)), (100 + n, " ".join(edited(one, 100 + n, (40 + n, 80 + n, 120 + n))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clusters = N.sketches(docs).selectExpr("doc_id AS node", "0L AS component", "n", "sketch")
    found = {tuple(sorted(r)) for r in N.links(docs, clusters, 85, chunk_docs=4).collect()}
    assert found == {(0, n) for n in range(1, 13)} | {(n, 100 + n) for n in range(1, 13)}
