import numpy as np

from parcelworks.llm import decontaminate as D


def brute_near(words, own, slack):
    from collections import defaultdict

    at = defaultdict(list)
    for j, w in enumerate(words):
        at[w].append(j)
    for i in range(max(1, len(own) - D.WINDOW + 1) if own else 0):
        part = own[i : i + D.WINDOW]
        for a in range(-slack, len(words) + slack):
            if all(any(abs(q - (a + k)) <= slack for q in at[w]) for k, w in enumerate(part)):
                return True
    return False


def cases():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(30)]
    items = [(str(k), " ".join(rng.choice(vocab, n))) for k, n in enumerate([20, 13, 5, 1, 14, 30])] + [("e", ""), ("n", None), ("1", "Zz yy")]
    docs = [(0, None), (1, ""), (2, "..."), (None, "w1 w2")]
    for k in range(40):
        words = list(rng.choice(vocab, rng.integers(1, 60)))
        if k % 3 == 0:
            item = items[k % 6][1].split()
            words[3:3] = [w.upper() for w in item]
        if k % 5 == 0:
            item = items[0][1].split()
            item[4], item[5] = item[5], item[4]
            words += item
        docs.append((10 + k, " ".join(words)))
    return docs + docs[4:8], items


def test_against_plain_search(spark):
    docs, items = cases()
    for block, shard in ((1 << 20, 1 << 20), (60, 300)):
        index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "y").repartition(3), shard_chars=shard)
        got = D.find(index, spark.createDataFrame(items, "item_id string, text string"), block_chars=block)
        rows = got.select("doc_id", "n_words", D.covered().alias("hit"), "items", "near_items").collect()
        assert len(rows) == len(docs)
        have = sorted(((r.doc_id or 0, r.n_words, r.hit, sorted(r["items"]), sorted(r.near_items)) for r in rows))
        want = []
        for doc_id, text in docs:
            words = D.alnum_words(text)
            hit, n, sha, bad = D.reference_hits(text, items)
            exact = sorted({i for i, t in items if D.reference_hits(text, [(i, t)])[1]})
            near = sorted({i for i, t in items if brute_near(words, D.alnum_words(t), D.NEAR_SLACK)})
            want.append((doc_id or 0, len(words), hit, exact, near))
        assert have == sorted(want)


def test_verdict_and_edges(spark):
    item = " ".join(f"a{i}" for i in range(13))
    docs = spark.createDataFrame([(1, item + " b" * 247, "x"), (2, item + " b" * 248, "x"), (3, None, "x")], "doc_id long, text string, contaminated string")
    items = spark.createDataFrame([(7, item, 1)], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in D.decontaminate(D.build_index(docs), items).collect()}
    assert got == {1: (260, 13, True), 2: (261, 13, False), 3: (0, 0, False)}
    kept = D.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    more = spark.createDataFrame([(None, item, "a"), (1, "clean words", "b"), (1, item, "c"), (None, None, "d")], "doc_id long, text string, __contaminated string")
    assert sorted(r[2] for r in D.keep_clean(more, items).collect()) == ["b", "d"]
    assert D.decontaminate(D.build_index(docs), items.limit(0)).filter("n_hit > 0").count() == 0
    assert D.decontaminate(D.build_index(docs.limit(0)), items).count() == 0


def test_query_returns_near_items(spark, tmp_path):
    from parcelworks.llm.registry import QUERIES

    words = [f"a{i}" for i in range(13)]
    swapped = [*words[:4], words[5], words[4], *words[6:]]
    texts = [" ".join(words), " ".join(swapped), "nothing of it"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_items, r.n_near, r.contaminated) for r in QUERIES["op1_near_items"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, 1, True), 1: (0, 1, False), 2: (0, 0, False)}
