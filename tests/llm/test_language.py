import zlib
from collections import Counter

from parcelworks.llm import language as L
from parcelworks.llm.common import table


def plain_grams(text):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    code = " " + " ".join(low.split()) + " "
    if not code.strip():
        return Counter()
    found = Counter(c for c in code if c != " ")
    found.update(code[i : i + 2] for i in range(len(code) - 1))
    found.update(g for g in (code[i : i + 3] for i in range(len(code) - 2)) if g[1] != " ")
    return found


def unpack(v):
    out = ""
    while v:
        out = chr(v & 0x1FFFFF) + out
        v >>= 21
    return out


def test_grams_match_plain_counts():
    for text in [None, "", "123 ##", "a", "Ab, cD\n\nÉé ß 12x", "Привет мир", "日本 語", " lead", "trail ", "İx ŉy"]:
        values, counts = L.grams(text)
        assert {unpack(int(v)): int(c) for v, c in zip(values, counts)} == dict(plain_grams(text)), text


def test_out_of_place():
    model = L.Profiles([("x", 0, ord("a")), ("x", 1, ord("b")), ("y", 0, ord("c"))], 10)
    assert model.predict("123") == ("und", 0.0) and model.predict(None) == ("und", 0.0)
    # grams of "b": " b", "b", "b ", " b " -> ranks by packed value; only "b" is known
    values, counts = L.grams("b")
    rank = sorted(range(len(values)), key=lambda i: (-counts[i], values[i])).index([int(v) for v in values].index(ord("b")))
    assert model.predict("b") == ("x", 1 - (abs(rank - 1) + 30) / 40)


def test_held_out_accuracy(spark):
    rows = L.op4(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 0.5), (2, "12 %", "en", 0.5), (3, "the cat", None, 0.5), (None, "the cat and the dog", "en", 0.5), (1, None, "en", 0.5)], "doc_id long, text string, lang string, score double")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in L.identified(docs).collect())
    assert [g for g in got if g[0] in (1, 2)] == [(1, "und"), (1, "und"), (2, "und")]
    assert L.identified(docs.limit(0)).count() == 0
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {3, None}
