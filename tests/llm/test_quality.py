import re

import numpy as np
from pyspark.sql import functions as F

from parcelworks.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def texts():
    rng = np.random.default_rng(3)
    out = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "é ü ß # \n# \n# \x1c b\x85c", "l1\nl1\n\nl1 \n"]
    for _ in range(40):
        words = list(rng.choice(["a", "bb", "c#", "é", "Dog."], rng.integers(1, 60)))
        out.append(" ".join(words) + "\n" * int(rng.integers(0, 3)) + " ".join(words[:9]))
    return out


def test_measures_match_plain_definition():
    for text in texts():
        assert Q.measure(text)[:5] == brute(text), text


def test_em_finds_the_better_rules():
    rng = np.random.default_rng(0)
    y = rng.random(5000) < 0.7
    right = [0.95, 0.9, 0.85, 0.6, 0.55]
    votes = np.stack([np.where(rng.random(5000) < 0.2, 0, np.where(y == (rng.random(5000) < a), 1, 2)) for a in right], 1)
    patterns = ["".join(map(str, v)) for v in votes]
    kinds, counts = np.unique(patterns, return_counts=True)
    prior, good, bad, posterior = Q.expectation_maximisation(list(kinds), list(counts))
    assert abs(prior - 0.7) < 0.05
    accuracy = good[:, 1] / (good[:, 1] + good[:, 2])
    assert accuracy[0] > accuracy[2] > accuracy[4]
    verdict = dict(zip(kinds, posterior))
    assert np.mean([(verdict[p] > 0.5) == v for p, v in zip(patterns, y)]) > 0.95


def test_judged(spark):
    good = ". ".join("alpha beta gamma delta %d epsilon zeta" % i for i in range(20)) + "."
    docs = spark.createDataFrame([(1, good, 5), (1, good, 6), (2, None, 5), (3, "x " * 100, 1), (4, "#### " * 15, 1)], "doc_id long, text string, votes int")
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in Q.judged(docs).collect())
    assert [g[:2] for g in got] == [(1, False), (1, False), (2, True), (3, True), (4, True)]
    assert not any(k for _, failed, k in got if failed)
    assert Q.judged(docs.limit(0)).count() == 0


def test_classes_are_never_turned_round():
    # most documents have bad votes: the class with more of them is the bad one all the same
    kinds, counts = ["222", "221", "111", "112"], [700, 50, 200, 50]
    _, good, bad, posterior = Q.expectation_maximisation(kinds, counts)
    assert good[:, Q.BAD].sum() < bad[:, Q.BAD].sum() and posterior[2] > 0.5 > posterior[0]


def test_kept_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    rows = Q.op3(spark, sf).filter("NOT base_failed").join(truth, "doc_id").collect()
    good, bad = [r for r in rows if r.good == 1], [r for r in rows if r.good == 0]
    assert sum(not r.kept for r in good) <= 0.02 * len(good) and sum(r.kept for r in bad) <= 0.1 * max(10, len(bad))
