"""Toxic documents by a gap-weighted subsequence kernel, a support vector machine over Nystroem landmarks and its scan.

A unit is a word, or single letters standing in a row ("i d i o t" is one unit), with marks inside words left out
("id-iot").  The kernel of two units sums, over all sequences of four letters, marked ends included, that both hold, gaps
allowed, a decay for every letter that the sequences span; it is divided by the units' lengths.  So a letter put in or a
gap costs a part of the likeness, not all of it.

Training follows the labelled sentences of a bounded sample of documents: a sentence of a toxic document counts as toxic
for a unit that toxic documents hold, in ever other surroundings, far more often than clean ones do; every sentence of a clean document is clean in
all its units, of which those that the machine scores highest are put in again (hard negatives).  Landmarks carry the
kernel to a small space in which the machine is fitted.

The fitted score is a sum over landmarks of kernels, and so a sum over the sequences that landmarks hold: one table of
weights for four letters.  Scoring slides over whole texts with a few table look-ups a letter; nothing depends on the
number of landmarks or on the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, tidy, unsigned_crc_fold

#: Letters fall into so many classes; 0 marks a unit's ends.
CLASSES = 32
#: Letters of a sequence, most letters that it may span, and what each of these costs.
LENGTH, SPAN, DECAY = 4, 6, 0.6
#: Bounds of what is learnt from: documents of each class, distinct units of each class, landmarks.
TOXIC_DOCS, CLEAN_DOCS, TOXIC_UNITS, CLEAN_UNITS, LANDMARKS = 4000, 8000, 1000, 12000, 384
#: A toxic unit is met between different neighbours in toxic documents so often that its log likelihood ratio is at least
#: this (chance gives e ** -13), and so many times as often as in clean ones.
SURE, OFTEN = 13.0, 12.0
#: Rounds of hard negatives, and how much a mistake costs.
ROUNDS, COST = 3, 10.0
#: What a mistake on a unit with a letter put in costs, of one on the unit itself.
ALTERED = 0.2
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Letters scored together.
SLAB = 1 << 20

#: Places of a sequence's letters after its first, gaps allowed.
_OFFSETS = list(combinations(range(1, SPAN), LENGTH - 1))


SIGN = 64


def _class_table() -> np.ndarray:
    """Class of each code point below 2 ** 16: 0 no letter, 1 to 31 a letter, 64 more for a sign that may stand for one, 255 a mark inside words."""
    out = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            low = c.lower()[0]
            out[code] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 5
    for sign, letter in zip("013457@$!", "oieastasi"):
        out[ord(sign)] = SIGN + ord(letter) - 96
    for mark in ".-_*'’·~+^​‌‍­":
        out[ord(mark)] = 255
    return out


CLASS = _class_table()


@dataclass
class Units:
    """Units of some texts, flat: classes with a 0 before and behind each unit, where each starts and ends, and its text."""

    symbols: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    lengths: np.ndarray


def units(texts: list[str | None]) -> Units:
    """Cuts texts, as wholes, into units; null and empty texts have none."""
    joined = " \n ".join(t or "" for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") + 3 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(raw)]
    kind = CLASS[np.minimum(raw, (1 << 16) - 1)]
    kind[raw >= 1 << 16] = 0
    # a sign stands for a letter between two letters only
    plain = (kind > 0) & (kind < SIGN)
    sign = (kind > SIGN) & (kind < 255)
    between = np.zeros(len(kind), bool)
    between[1:-1] = plain[:-2] & plain[2:]
    kind = np.where(sign, np.where(between, kind - SIGN, 0), kind)
    letter = (kind > 0) & (kind < SIGN)
    at = np.flatnonzero(letter)
    if not len(at):
        empty = np.empty(0, np.int64)
        return Units(np.zeros(SPAN, np.uint8), empty, empty, empty, empty)
    gap = np.diff(at)
    # next letter belongs to the same word: adjacent, or behind one or two marks
    marks = np.r_[0, np.cumsum(kind == 255)]
    joint = (gap == 1) | ((gap <= 3) & (marks[at[1:]] - marks[at[:-1] + 1] == gap - 1))
    word = np.r_[0, np.cumsum(~joint)]
    n_words = word[-1] + 1
    length = np.bincount(word, minlength=n_words)
    first = np.r_[0, np.flatnonzero(~joint) + 1]
    last = np.r_[first[1:] - 1, len(at) - 1]
    # single letters a blank apart are one unit
    single = length == 1
    near = np.zeros(n_words, bool)
    near[1:] = single[1:] & single[:-1] & (at[first[1:]] - at[last[:-1]] <= 2)
    unit = np.cumsum(~near) - 1
    of = unit[word]
    n_units = of[-1] + 1
    lengths = np.bincount(of, minlength=n_units)
    place = np.arange(len(at)) + 2 * of + 1  # a 0 before and behind each unit
    symbols = np.zeros(len(at) + 2 * n_units + SPAN, np.uint8)
    symbols[place] = kind[at]
    starts = np.r_[0, np.cumsum(lengths)[:-1]] + 2 * np.arange(n_units)
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return Units(symbols, starts, starts + lengths + 2, owner[at[begin]], lengths)


def spread(lengths: np.ndarray) -> np.ndarray:
    """The root of the kernel with itself of a unit of so many letters in which no sequence comes twice; with repeats it is more."""
    total = np.zeros(len(lengths))
    for places in _OFFSETS:
        total += np.maximum(lengths + 2 - places[-1], 0) * DECAY ** (2 * (places[-1] + 1))
    return np.sqrt(np.maximum(total, 1e-12))


def sequences(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, decayed weight) of all sequences of a unit with its marked ends."""
    codes, weights = [], []
    s = symbols.astype(np.int64)
    for places in _OFFSETS:
        n = len(s) - places[-1]
        if n > 0:
            code = s[:n]
            for i in places:
                code = code * CLASSES + s[i : i + n]
            codes.append(code)
            weights.append(np.full(n, DECAY ** (places[-1] + 1)))
    return (np.concatenate(codes), np.concatenate(weights)) if codes else (np.empty(0, np.int64), np.empty(0))


def features(own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, sequence number, weight) of units given by their classes; the weights of a unit have length 1."""
    rows, codes, weights = [], [], []
    for k, u in enumerate(own):
        c, w = sequences(np.frombuffer(b"\0" + u + b"\0", np.uint8))
        c, place = np.unique(c, return_inverse=True)
        w = np.bincount(place, w, len(c))
        rows.append(np.full(len(c), k))
        codes.append(c)
        weights.append(w / max(np.sqrt((w * w).sum()), 1e-9))
    return tuple(np.concatenate(x) if x else np.empty(0) for x in (rows, codes, weights))


def kernel(own: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The subsequence kernel of every unit with every landmark."""
    rows, codes, weights = features(landmarks)
    known, place = np.unique(codes, return_inverse=True)
    n = len(known)
    table = np.bincount(rows.astype(np.int64) * n + place, weights, len(landmarks) * n).reshape(len(landmarks), n)
    out = np.zeros((len(own), len(landmarks)))
    for s in range(0, len(own), 500):
        part = own[s : s + 500]
        rows, codes, weights = features(part)
        at = np.minimum(np.searchsorted(known, codes), n - 1)
        hit = known[at] == codes
        out[s : s + 500] = np.bincount(rows[hit].astype(np.int64) * n + at[hit], weights[hit], len(part) * n).reshape(len(part), n) @ table.T
    return out


@dataclass
class Model:
    """weights: what each sequence of classes adds; bias; slope and offset turn the highest unit into a probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, found: Units) -> np.ndarray:
        """The machine's output for every unit, by sliding over the symbols.

        The sums are divided as if no sequence came twice in a unit, which bounds positive sums from above; where that bound is over 0,
        the unit's own kernel takes its place.
        """
        n = len(found.starts)
        out = np.zeros(n)
        if not n:
            return out
        total = len(found.symbols) - SPAN
        inside = np.repeat(np.arange(n, dtype=np.int32), found.ends - found.starts)
        gain = np.empty(0)
        for s in range(0, total, SLAB):
            e = min(s + SLAB, total)
            gain = np.zeros(e - s)
            symbols = found.symbols[s : min(e + SPAN, total)].astype(np.int32)
            own = inside[s : min(e + SPAN, total)]
            for places in _OFFSETS:
                m, last = min(e - s, len(own) - places[-1]), places[-1]
                if m > 0:
                    code = symbols[:m]
                    for i in places:
                        code = code * CLASSES + symbols[i : i + m]
                    gain[:m] += np.where(own[:m] == own[last : last + m], self.weights[code] * np.float32(DECAY ** (last + 1)), 0)
            out += np.bincount(own[: e - s], gain, n)
        bound = out / spread(found.lengths) + self.bias
        for k in np.flatnonzero((bound > 0) & (out > 0)):
            weights = features([found.symbols[found.starts[k] + 1 : found.ends[k] - 1].tobytes()])
            bound[k] = (self.weights[weights[1]] * weights[2]).sum() + self.bias
        return bound

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The highest margin among each text's units; -inf without any."""
        found = units(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, found.text, self.margins(found))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities from the highest margins; 0 for texts without a unit."""
        best = self.highest(texts)
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(self.slope * np.where(np.isfinite(best), best, 0) + self.offset, -500, 500))), 0.0)


def unit_texts(found: Units) -> list[bytes]:
    """Each unit's classes as bytes."""
    raw = found.symbols.tobytes()
    return [raw[s + 1 : e - 1] for s, e in zip(found.starts, found.ends)]


def flat(own: list[bytes]) -> Units:
    """Units given by their classes, each a text of its own."""
    lengths = np.array([len(u) for u in own], np.int64)
    symbols = np.frombuffer(b"".join(b"\0" + bytes(u) + b"\0" for u in own) + b"\0" * SPAN, np.uint8)
    starts = np.r_[0, np.cumsum(lengths + 2)[:-1]] if len(own) else np.empty(0, np.int64)
    return Units(symbols, starts, starts + lengths + 2, np.arange(len(own)), lengths)


def fitted(toxic: list[bytes], altered: list[bytes], clean: list[bytes]) -> Model:
    """The machine on toxic, altered toxic and clean units: squared hinge loss in the landmarks' space, by Newton steps on its support vectors.

    Landmarks are the first toxic units, up to half of LANDMARKS, and the first clean ones.
    """
    landmarks = [*toxic[: LANDMARKS // 2], *clean[: LANDMARKS - min(len(toxic), LANDMARKS // 2)]]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    own = [*toxic, *altered, *clean]
    x = np.hstack([kernel(own, landmarks) @ root, np.ones((len(own), 1))])
    y = np.r_[np.ones(len(toxic) + len(altered)), -np.ones(len(clean))]
    each = COST * len(clean) / len(toxic)
    weight = np.r_[np.full(len(toxic), each), np.full(len(altered), ALTERED * each), np.full(len(clean), COST)]
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    support = np.ones(len(y), bool)
    for _ in range(30):
        xs, cs = x[support], weight[support]
        w = np.linalg.solve(ridge + (xs * cs[:, None]).T @ xs, (xs * cs[:, None]).T @ y[support])
        now = y * (x @ w) < 1
        if (now == support).all():
            break
        support = now
    beta = root @ w[:-1]
    rows, codes, weights = features(landmarks)
    table = np.zeros(CLASSES**LENGTH)
    np.add.at(table, codes.astype(int), weights * beta[rows.astype(int)])
    return Model(table.astype(np.float32), float(w[-1]))


def sampled(docs: DataFrame, labels: DataFrame, toxic: int, most: int) -> DataFrame:
    """Texts of the documents with the first `most` ids, by hash, of one label; their ids are few by that bound."""
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").select(F.col("text").cast("string").alias("text"), F.lit(toxic).alias("toxic"))


def altered(own: list[bytes], seed: int = 7) -> list[bytes]:
    """Each unit of five letters or more twice with a letter put in at a place inside."""
    draw = np.random.default_rng(seed)
    more = []
    for u in own:
        for _ in range(2 * (len(u) >= 5)):
            at = int(draw.integers(1, len(u)))
            more.append(u[:at] + bytes([int(draw.integers(1, 27))]) + u[at:])
    return sorted(set(more) - set(own))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled documents among docs; None if one of the classes is missing or no unit tells them apart."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = stored(sampled(docs, labels, 1, TOXIC_DOCS).unionByName(sampled(docs, labels, 0, CLEAN_DOCS)), "toxic-sample")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units with the two beside them."""
        for batch in batches:
            found = units(batch.column("text").to_pylist())
            own, toxic = unit_texts(found), batch.column("toxic").to_numpy()
            beside = zip(own, found.text, [b"", *own[:-1]], [*own[1:], b""])
            seen = sorted({(int(toxic[t]), u, before + b" " + after) for u, t, before, after in beside})
            yield pa.RecordBatch.from_arrays([pa.array([u for _, u, _ in seen], pa.binary()), pa.array([c for _, _, c in seen], pa.binary()), pa.array([t for t, _, _ in seen], pa.int32())], ["unit", "beside", "toxic"])

    sizes = dict(sample.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return None
    # places with the same neighbours count once, so that copies of a document don't make its words toxic
    places = sample.repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(held, "unit binary, beside binary, toxic int").distinct()
    counts = stored(places.groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "units")
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    whole = counts.agg(F.sum("t"), F.sum("c")).first()
    share = whole[0] / (whole[0] + whole[1])
    times = (t / sizes[1]) / ((c + 0.5) / sizes[0])
    ratio = t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0)
    marked = counts.filter((t > 0) & (times >= OFTEN) & (ratio >= SURE) & (F.length("unit") >= 2)).orderBy(F.desc("t"), "unit").limit(TOXIC_UNITS)
    toxic = [bytes(r["unit"]) for r in marked.select("unit").collect()]
    own = counts.filter((F.col("c") > 0) & ((F.col("t") == 0) | (times < 2)))
    clean = [bytes(r["unit"]) for r in own.orderBy(F.xxhash64("unit"), "unit").limit(CLEAN_UNITS).select("unit").collect()]
    if not toxic or not clean:
        return None
    more = altered(toxic)
    hard: list[bytes] = []
    model = fitted(toxic, more, clean)
    for _ in range(ROUNDS):

        def worst(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(model.margins(flat(batch.column("unit").to_pylist())))], ["unit", "margin"])

        over = own.select("unit").mapInArrow(worst, "unit binary, margin double").filter("margin > -1").orderBy(F.desc("margin"), "unit").limit(CLEAN_UNITS // 4)
        new = [u for r in over.collect() if (u := bytes(r["unit"])) not in set(hard)]
        if not new:
            break
        hard = new + hard
        model = fitted(toxic, more, [*hard, *sorted(set(clean) - set(hard))])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.highest(batch.column("text").to_pylist())), batch.column("toxic")], ["margin", "toxic"])

    seen = sample.mapInArrow(best, "margin double, toxic int").collect()  # two numbers a document of the sample
    # altered units stand for documents that the sample lacks, and weigh less
    points = [(m, t, 1.0) for m, t in seen if np.isfinite(m)] + [(m, 1, ALTERED) for m in model.margins(flat(more))]
    model.slope, model.offset = calibrated(*np.array(points).T)
    return model


def calibrated(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the documents' highest margins; targets are smoothed by one count."""
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (weight * (p - target)) + 1e-6 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def scored(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (double) and predicted (int: 1 if score >= threshold).

    Whole texts are scored by their highest unit.  Null, empty and letterless texts score 0, as all texts do without a model.
    Repeated rows are scored each for itself; a score at just the threshold is predicted 1; other columns stay (one
    of the name score or predicted is replaced).  An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        tidy()
        return pd.Series(held.value.scores(list(texts)) if held.value else np.zeros(len(texts)))

    return docs.withColumn("score", score(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op12(spark, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2 and scores all."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (unsigned_crc_fold(folds=FOLDS) == HELD_OUT).alias("held_out"))
    model = learn(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", "held_out", "score", "predicted")
