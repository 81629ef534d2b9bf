import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from parcelworks.llm import suffix_tree as S
from parcelworks.llm.common import table


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_tree(texts, depth, least, divergence):
    """Contexts and scores by dictionaries, straight from the definition."""
    n = defaultdict(Counter)
    for t in texts:
        raw = bytes([255]) * depth + low(t).encode() + bytes([254])
        for i in range(depth, len(raw)):
            for d in range(depth + 1):
                n[raw[i - d : i]][raw[i]] += 1
    n = {c: v for c, v in n.items() if not c or sum(v.values()) >= least}

    def p(c, s):
        v = n.get(c, Counter())
        if not c:
            return (v[s] + 0.5) / (sum(v.values()) + 128)
        return (v[s] + len(v) * p(c[1:], s)) / (sum(v.values()) + len(v))

    keep = {b""}
    for c, v in n.items():
        if c and sum(2 * m * math.log(m / sum(v.values()) / p(c[1:], s)) for s, m in v.items()) > divergence:
            keep |= {c[i:] for i in range(len(c) + 1)}

    def score(text):
        raw = bytes([255]) * depth + low(text).encode() + bytes([254])
        out = 0
        for i in range(depth, len(raw)):
            c = next(raw[i - d : i] for d in range(depth, -1, -1) if raw[i - d : i] in keep)
            out += math.log10(p(c, raw[i]))
        return out

    return keep, score


def test_tree_and_base_against_plain_definition(spark):
    rows = [(i, t) for i, t in enumerate(["The cat sat. THE cat", "a cat sat on the mat, é ñ", "the the the", None, "", "zebra cat ü", "on the mat the cat sat"] * 3)]
    rows += [(100, "x" * 3000), (None, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = S.F.col("doc_id") % 4 != 1
    got = {(-1 if r.doc_id is None else r.doc_id): r for r in S.scored(docs, learn, depth=3, least=4, divergence=5.0, block_chars=300, chunk_rows=4).collect()}
    train = [t for i, t in rows if i is not None and i % 4 != 1]
    keep, score = plain_tree(train, 3, 4, 5.0)
    assert len(keep) > 10
    c = Counter(w for t in train for w in [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None])
    total, kinds = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[-1 if i is None else i]
        tokens = [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens))
        assert r.score == pytest.approx(score(t))


def test_real_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = S.op7(spark, sf).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    size = {i: len(low(t).encode()) + 1 for i, t in texts.items()}
    held = [r for r in rows if r.held_out]
    # bits a byte of held-out text: far below the 8 of a flat model
    assert -sum(r.score for r in held) / sum(size[r.doc_id] for r in held) / math.log10(2) < 3.5


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert S.scored(docs.limit(0), S.F.lit(True)).count() == 0
    (row,) = S.scored(docs, S.F.lit(False)).collect()
    assert row.n_known == 0 and row.score == pytest.approx(4 * math.log10(0.5 / 128))


def test_the_tree_grows_with_the_corpus_and_with_depth(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{chr(97 + i // 40)}{chr(97 + j)}{chr(97 + (i // 40 * 7 + j * 3) % 26)}" for j in range(26))) for i in range(400)], "doc_id long, text string")

    def states(frame):
        grams = S.counted(S.located(frame), S.F.lit(True), 4).filter(S.F.col("kind") == S._GRAMS).groupBy("key").agg(S.F.sum("n").alias("n"))
        return S.grow(grams, 4, 4, 5.0)[0].count()

    assert states(docs) > 3 * states(docs.filter("doc_id < 40")) > 10
    deep = S.scored(docs, S.F.col("doc_id") % 5 != 0, depth=7, least=4, divergence=5.0).agg(S.F.sum("score")).first()[0]
    flat = S.scored(docs, S.F.col("doc_id") % 5 != 0, depth=1, least=4, divergence=5.0).agg(S.F.sum("score")).first()[0]
    assert deep > flat
    for depth in (0, 8):
        with pytest.raises(ValueError):
            S.scored(docs, S.F.lit(True), depth=depth)
