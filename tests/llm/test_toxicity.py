import itertools
import random

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from parcelworks.llm import toxicity
from parcelworks.llm.toxicity import DECAY, LENGTH, SPAN, Model, features, flat, kernel, learn, scored, unit_texts, units

INSULTS = ["blockhead", "numbskull", "dimwit"]


def corpus(n=900, seed=3):
    draw = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        own = [word() for _ in range(draw.randint(20, 80))]
        bad = i % 3 == 0
        for _ in range(2 * bad):
            own.insert(draw.randrange(len(own)), draw.choice(INSULTS))
        docs.append(Row(doc_id=i, text=" ".join(own) + ".", lang="en"))
        labels.append(Row(doc_id=i, toxic=int(bad)))
    return docs, labels


def test_kernel_against_all_sequences():
    def brute(a, b):
        def phi(u):
            u, out = b"\0" + u + b"\0", {}
            for at in itertools.combinations(range(len(u)), LENGTH):
                if at[-1] - at[0] < SPAN:
                    key = bytes(u[i] for i in at)
                    out[key] = out.get(key, 0) + DECAY ** (at[-1] - at[0] + 1)
            return out, sum(x * x for x in out.values()) ** 0.5

        (x, nx), (y, ny) = phi(a), phi(b)
        return sum(x[k] * y.get(k, 0) for k in x) / (nx * ny)

    own = unit_texts(units(["moron aaaaaaaa scum banana no mo-ron abracadabra"]))
    found = kernel(own, own)
    assert np.allclose(found, [[brute(a, b) for b in own] for a in own])


def test_units():
    cut = lambda text: ["".join(chr(96 + c) for c in u) for u in unit_texts(units([text]))]
    assert cut("You, i d i o t! id-iot i.d.i.o.t Id1ot x") == ["you", "idiot", "idiot", "idiot", "idiot", "x"]
    assert cut("") == cut("12 ... -- 1!") == []
    assert units([None, "", "a b", "cc"]).text.tolist() == [2, 3]


def test_sliding_equals_the_sum_over_sequences(monkeypatch):
    draw = np.random.default_rng(0)
    model = Model(draw.normal(size=toxicity.CLASSES**LENGTH).astype(np.float32), 0.5)
    own = [bytes(draw.integers(1, 30, draw.integers(1, 14)).tolist()) for _ in range(300)] + [b"\1" * 40, b"\2\3" * 9]

    def brute(u):
        _, codes, weights = features([u])
        return float((model.weights[codes] * weights).sum()) + 0.5

    for slab in (1 << 20, 97):
        monkeypatch.setattr(toxicity, "SLAB", slab)
        got, want = model.margins(flat(own)), np.array([brute(u) for u in own])
        sure = want > 0.5  # a positive sum, whose output is over 0
        assert sure.sum() > 100 and np.allclose(got[sure], want[sure], atol=1e-4) and (got[~sure] < 0.5 + 1e-4).all()


def test_held_out_accuracy_gaps_and_edge_cases(spark):
    docs, labels = corpus()
    train = spark.createDataFrame(docs[:600])
    model = learn(train, spark.createDataFrame(labels))
    odd = [Row(doc_id=None, text=None, lang="en"), Row(doc_id=1000, text="", lang="en"), Row(doc_id=1001, text="123 ...", lang=None)]
    bad = ["on the d i m w i t of", "then numb-skull er", "in blockxhead to", "numbskkull"]
    odd += [Row(doc_id=2000 + i, text=t, lang="en") for i, t in enumerate(bad)]
    odd += [Row(doc_id=3000, text="theon erhe " * 50_000 + "dimwit", lang="en")]
    test = spark.createDataFrame(docs[600:] + odd, "doc_id bigint, text string, lang string").withColumn("predicted", F.lit("x"))
    rows = scored(test, model).collect()
    got = {r.doc_id: r for r in rows}
    right = [got[d.doc_id].predicted == lab.toxic for d, lab in zip(docs[600:], labels[600:])]
    assert np.mean(right) > 0.98
    assert all(got[i].score == 0 and got[i].predicted == 0 for i in (None, 1000, 1001))
    assert [got[2000 + i].predicted for i in range(4)] == [1] * 4
    assert got[3000].predicted == 1


def test_without_labels(spark):
    docs, labels = corpus(30)
    frame = spark.createDataFrame(docs)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert learn(frame, none) is None
    assert learn(frame, spark.createDataFrame([Row(doc_id=1, toxic=1), Row(doc_id=2, toxic=None)])) is None
    assert {r.score for r in scored(frame, None).collect()} == {0.0}
    assert scored(frame.limit(0), None).count() == 0
