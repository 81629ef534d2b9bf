"""Joins of texts with asked names by "contains" and "begins with", through indexes of the texts instead of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.operators.ranking import cumulated
from parcelworks.storage import broadcast_if_small, stored

#: Letters of an indexed gram; shorter names are looked up by grams as long as they are.
GRAM = 3
#: Places of a sorted list that are looked up together.
BLOCK = 64


def _grams(rows: DataFrame, text: str, n: int, *keep: str) -> DataFrame:
    """Every run of n letters of a text: keep, gram, at (from 1)."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    placed = rows.select(*keep, F.explode(starts).alias("at"))
    return placed.select(*keep, F.substring(F.col(text), F.col("at"), F.lit(n)).alias("gram"), "at")


def containing(texts: DataFrame, text: str, names: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of texts with every one of names that stands in their text, in column name; by: columns of both that must agree.

    An inverted index with positions: distinct texts give their runs of three letters, of which those count that some
    name has.  Each distinct name looks up the postings of its rarest run, moved by the run's place in the name, and the letters
    there must be the name's.  So a name meets the texts that hold its rarest run, not all of them.  Null and empty names stand in
    nothing, null texts hold nothing; repeated names count once, rows of texts each for itself.
    """
    keys = [f"__by{i}" for i in range(len(by))]
    as_keys = [F.col(b).alias(k) for b, k in zip(by, keys)]
    own = stored(texts.filter(F.col(text).isNotNull()).select(*as_keys, F.col(text).alias("__mtext")).distinct(), "texts")
    asked = stored(names.filter(F.length(name) > 0).select(*as_keys, F.col(name).alias("__mname")).distinct(), "names")
    sizes = [r[0] for r in asked.select(F.least(F.length("__mname"), F.lit(GRAM)).alias("n")).distinct().collect()]  # at most GRAM rows

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    sized = lambda n: asked.filter(F.least(F.length("__mname"), F.lit(GRAM)) == n)
    runs = stored(union([_grams(sized(n), "__mname", n, *keys, "__mname") for n in sizes or [GRAM]]), "asked-grams")
    wanted = stored(runs.select(*keys, "gram").distinct(), "wanted-grams")
    postings = union([_grams(own, "__mtext", n, *keys, "__mtext") for n in sizes or [GRAM]])
    on = [*keys, "gram"]
    counts = postings.join(broadcast_if_small(wanted, 64), on, "left_semi").groupBy(*on).agg(F.count("*").alias("df"))
    looked = runs.join(counts, on, "left").groupBy(*keys, "__mname").agg(
        F.min_by(F.struct("gram", "at"), F.struct("df", "at")).alias("r"), F.count_if(F.col("df").isNull()).alias("__missing")
    )
    rarest = stored(looked.filter("__missing = 0").select(*keys, "__mname", "r.gram", F.col("r.at").alias("__in")), "rarest-grams")
    begin = F.col("at") - F.col("__in") + 1
    met = postings.join(broadcast_if_small(rarest, 128), on).filter((begin >= 1) & (F.substring(F.col("__mtext"), begin, F.length("__mname")) == F.col("__mname")))
    pairs = met.select(*keys, "__mtext", "__mname").distinct()
    same = F.col(text) == F.col("__mtext")
    for b, k in zip(by, keys):
        same &= texts[b].eqNullSafe(F.col(k))
    return texts.join(pairs, same).withColumn(name, F.col("__mname")).drop(*keys, "__mtext", "__mname")


def beginning_with(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """The rows of texts with every one of names that their text begins with, in column name.

    A prefix index: the distinct texts in one sorted list, dealt out by ranges, each with its place.  A name is an interval of
    that list, from the first text that isn't below it to the last that is below all that follow its prefix; both ends are sorted
    in with the texts.  Intervals meet the list by blocks of places, so the work is that of sorting and of the matches, however many
    names share their first letters.  Null and empty names begin nothing; repeated names count once.
    """
    own = texts.filter(F.col(text).isNotNull()).select(F.col(text).alias("s")).distinct()
    asked = names.filter(F.length(name) > 0).select(F.col(name).alias("s")).distinct()
    bytes_ = F.col("s").cast("binary")
    row = lambda rows, key, kind: rows.select("s", key.alias("key"), F.lit(kind).alias("kind"), F.lit(int(kind == 1)).cast("bigint").alias("w"))
    # no text holds the byte FF: behind a name it comes after all that begins with the name
    every = row(asked, bytes_, 0).unionByName(row(own, bytes_, 1)).unionByName(row(asked, F.concat(bytes_, F.lit(bytearray(b"\xff"))), 2))
    listed = stored(cumulated(every, "w", "key", "kind"), "prefix-index")
    spans = listed.filter("kind <> 1").groupBy(F.col("s").alias("__mname")).agg(F.min("upto").alias("lo"), F.max("upto").alias("hi")).filter("hi > lo")
    block = lambda c: F.floor(c / BLOCK)
    spans = spans.withColumn("block", F.explode(F.sequence(block(F.col("lo") + 1), block(F.col("hi")))))
    known = listed.filter("kind = 1").select(F.col("s").alias("__mtext"), F.col("upto").alias("place"), block(F.col("upto")).alias("block"))
    pairs = known.join(spans, "block").filter((F.col("place") > F.col("lo")) & (F.col("place") <= F.col("hi"))).select("__mtext", "__mname")
    return texts.join(pairs, F.col(text) == F.col("__mtext")).withColumn(name, F.col("__mname")).drop("__mtext", "__mname")
