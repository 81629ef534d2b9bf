"""Language identification by rank-order profiles of character n-grams (out-of-place distance).

A profile is a language's most frequent n-grams in order.  A text is given the language whose profile is
nearest: over the text's own most frequent n-grams, the sum of the differences between an n-gram's rank in
the text and in the profile, with a fixed penalty where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, tidy, unsigned_crc_fold

PROFILE = 400
TEXT_GRAMS = 300

_LOWER = np.arange(0x250, dtype=np.uint32)


def _letters_table() -> np.ndarray:
    """Code points below U+0250: letters to lower case, all else to a blank."""
    out = np.full(0x250, 32, np.uint32)
    for i in range(0x250):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_FOLD = _letters_table()


def _folded(text: str) -> np.ndarray:
    """Code points in lower case; each run of other characters than letters is one blank, also at both ends."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(raw) and raw.max() >= 0x250:
        low = "".join(low if len(low := c.lower()) == 1 else c for c in (c if c.isalpha() else " " for c in text))
        code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    else:
        code = _FOLD[raw]
    blank = code == 32
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    code = code[keep]
    if len(code) and code[0] == 32:
        code = code[1:]
    if len(code) and code[-1] == 32:
        code = code[:-1]
    edge = np.array([32], np.uint32)
    return np.concatenate((edge, code, edge)).astype(np.int64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams of a text, packed into 63 bits, ascending, with their counts; none if it has no letter.

    Grams of blanks alone are left out; a gram of two or three characters may have a blank at its ends, which
    marks the start or end of a word.
    """
    code = _folded(text) if text else np.zeros(0, np.int64)
    if not len(code) or not (code != 32).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = code[code != 32]
    two = (code[:-1] << 21) | code[1:]
    three = (two[:-1] << 21) | code[2:]
    three = three[code[1:-1] != 32]
    values = np.sort(np.concatenate((one, two, three)))
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.diff(np.concatenate((first, [len(values)])))


def train(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """Profiles (lang, rank from 0, gram) from docs (text, lang), all rows with a non-null language.

    Every task adds up its own counts by language before the shuffle, so a language with most of the rows
    sends no more than another.  Ties go to the smaller gram; a language without letters has no profile.
    """
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged():
            for lang, parts in held.items():
                values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)
                yield lang, values, counts

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = grams(text)
                held.setdefault(lang, []).append(own)
                size += len(own[0])
            if size > 500_000:
                held = {lang: [(v, c)] for lang, v, c in merged()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > 250_000:
                    for lang, parts in held.items():
                        yield _counts(lang, *parts[0])
                    held, size = {}, 0
        for lang, values, counts in merged():
            yield _counts(lang, values, counts)
        held.clear()
        tidy()

    sums = (
        docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .mapInArrow(counted, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # a filter on the row number itself lets every task keep no more than ``size`` rows of a language before the shuffle
    top = sums.withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= size)
    return top.select("lang", (F.col("__nth") - 1).alias("rank"), "gram")


def _counts(lang: str, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "gram", "n"])


class Profiles:
    """The profiles as one table: the rank of each known gram in each language, the penalty where it has none."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.langs = sorted({r[0] for r in rows})
        self.known = np.unique(np.array([r[2] for r in rows], np.int64))
        self.penalty = size
        self.ranks = np.full((len(self.known) + 1, len(self.langs)), -1, np.int32)
        for lang, rank, gram in rows:
            self.ranks[np.searchsorted(self.known, gram), self.langs.index(lang)] = rank

    def predict(self, text: str | None, text_grams: int = TEXT_GRAMS) -> tuple[str, float]:
        values, counts = grams(text)
        if not len(values) or not self.langs:
            return "und", 0.0
        top = np.lexsort((values, -counts))[:text_grams]
        values = values[top]
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        ranks = self.ranks[np.where(self.known[at] == values, at, len(self.known))]
        away = np.where(ranks < 0, self.penalty, np.abs(ranks - np.arange(len(values))[:, None]))
        total = np.minimum(away, self.penalty).sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (self.penalty * len(values)))


def profiles(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Train and gather the profiles: ``size`` rows for each label of a language, however many documents there are."""
    rows = train(docs, size).collect()
    return Profiles([(r["lang"], r["rank"], r["gram"]) for r in rows], size)


def predictor(spark, model: Profiles):
    """A column function text -> struct<lang_pred,score>; `und` and 0 for null and for texts without a letter.

    The score is 1 less the distance as a share of the greatest one: 1 for a text that ranks its n-grams just as
    the profile, 0 for one that shares none with it.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = held.value
        tidy()
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def training_fold():
    """Rows that the contract lets a model learn from: crc32 of the id's text modulo 5 is not 0."""
    return unsigned_crc_fold() != 0


def identified(docs: DataFrame, learn=None) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text, lang); learn: which rows to learn from.

    Null languages are never learnt from.  Without any profile every text is `und`.
    """
    small_batches(docs.sparkSession)
    model = profiles(docs.filter(training_fold() if learn is None else learn))
    guess = predictor(docs.sparkSession, model)
    return docs.select("doc_id", guess(F.col("text").cast("string")).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = 0.02) -> DataFrame:
    """The rows of docs in a language: no `und`, and a score of at least ``least``.  All columns stay."""
    small_batches(docs.sparkSession)
    guess = predictor(docs.sparkSession, profiles(docs.filter(training_fold())))
    marked = docs.withColumn("__p", guess(F.col("text").cast("string")))
    return marked.filter((F.col("__p.lang_pred") != "und") & (F.col("__p.score") >= least)).drop("__p")


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    guess = predictor(spark, profiles(docs.filter(training_fold())))
    return docs.select(
        "doc_id", (unsigned_crc_fold() == 0).alias("held_out"), guess(F.col("text").cast("string")).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")
