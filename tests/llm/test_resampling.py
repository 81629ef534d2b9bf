import hashlib
import math
import re
import zlib

from pyspark.sql import Row

from parcelworks.llm.resampling import ngrams, resampled, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, target, longest=1, buckets=10000, least=20, percent=10, seed=2024):
    def features(text):
        own = WORD.findall((text or "").translate(LOW))
        return len(own), [" ".join(own[i : i + n]) for n in range(1, longest + 1) for i in range(len(own) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for k, (i, text) in enumerate(docs):
        n, own = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        rows.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, k])
    long = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(long[: percent * len(long) // 100]):
        r[5] = k + 1
    return rows


def texts(n):
    vocabulary = ["alpha", "Beta", "ÉTÉ", "été", "gamma-ray", "x1", "delta", "9", "𝒳", "epsilon"]
    return [" ".join(vocabulary[(i * 7 + j * j) % (2 + i % 9)] for j in range(i % 60)) for i in range(n)]


def test_against_brute_force(spark):
    docs = [*enumerate(texts(200)), (None, "alpha beta " * 30), (None, None), (7, "Beta " * 25), (7, "Beta " * 25), (500, ""), (501, "-- !")]
    target = ["alpha beta gamma", None, "", "delta " * 50]
    frame = spark.createDataFrame([Row(doc_id=i, text=t, score=1.5, rank="x", bucket=3) for i, t in docs])
    bench = spark.createDataFrame([Row(item_id=i, text=t) for i, t in enumerate(target)])
    for longest in (1, 2):
        got = [tuple(r) for r in resampled(frame, bench, longest=longest, percent=35).collect()]
        want = [tuple(r[:6]) for r in brute(docs, target, longest=longest, percent=35)]
        key = lambda r: tuple((x is None, x or 0) for x in r)
        if longest == 1:
            assert sorted(got, key=key) == sorted(want, key=key)
        assert sorted(r[:5] for r in got if r[0] is not None) == sorted(r[:5] for r in want if r[0] is not None)
        ranks = sorted(r[5] for r in got if r[5])
        assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 35 * sum(r[1] >= 20 for r in want) // 100


def test_empty_tables_and_very_long_text(spark):
    schema = "doc_id bigint, text string"
    none = spark.createDataFrame([], schema)
    assert resampled(none, none).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000), (2, "other " * 30)], schema)
    rows = {r.doc_id: r for r in resampled(long, none, percent=100).collect()}
    assert rows[1].n_features == 300_000 and {rows[1]["rank"], rows[2]["rank"]} == {1, 2}


def test_ngrams_of_short_texts(spark):
    frame = spark.createDataFrame([("One two",), ("",), (None,)], "text string")
    assert [r[0] for r in frame.select(ngrams(words(frame.text), 3)).collect()] == [["one", "two", "one two"], [], []]
