"""Importance resampling towards a target set: hashed n-gram gains summed by document, then a draw without replacement.

All of it is DataFrame work.  Every document's n-grams are exploded and hashed into a fixed number of buckets; the counts
of the buckets in the corpus and in the target give each bucket a gain; a document's weight is the sum of its features'
gains.  With noise that only its id decides, the highest scores are a draw in proportion to the weights.  Ranks come from
a range-partitioned sort: a row's rank is its place in its partition after the rows of all partitions before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BUCKETS = 10_000
LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024


def words(text):
    """The words of a text column with A-Z lower-cased; null has none."""
    text = text.cast("string")
    # lower() is faster and differs in letters beyond ASCII alone
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def ngrams(own, longest: int = LONGEST):
    """All runs of 1 to longest consecutive words, joined by one space, repeats kept."""

    def runs(n: int):
        starts = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " "))

    return F.concat(own, *map(runs, range(2, longest + 1))) if longest > 1 else own


def bucketed(frame: DataFrame, longest: int, buckets: int, *keys: str) -> DataFrame:
    """A row each feature: the keys and its bucket; a row with a null bucket for a text without any."""
    features = frame.select(*keys, F.explode_outer(ngrams(F.col("__words"), longest)).alias("feature"))
    return features.select(*keys, (F.crc32(F.col("feature").cast("binary")) % buckets).alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln of the target's smoothed share over the corpus's)."""
    spark = docs.sparkSession

    def counts(frame: DataFrame, name: str) -> DataFrame:
        own = frame.select(words(F.col("text")).alias("__words"))
        return bucketed(own, longest, buckets).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))

    # one row a bucket, whatever the corpus's size
    both = spark.range(buckets).toDF("bucket").join(counts(docs, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").na.fill(0)
    both = stored(both, "buckets")
    whole = both.agg(F.sum("s"), F.sum("t")).first()
    s, t = float(whole[0] or 0), float(whole[1] or 0)
    of = lambda name: F.col(name).cast("double") + 1
    gain = F.floor(F.lit(1000.0) * F.log(of("t") * (s + buckets) / (of("s") * (t + buckets))))
    return both.select("bucket", gain.cast("bigint").alias("gain"))


def noise(doc_id, seed: int = SEED):
    """The id's own Gumbel noise in thousandths; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked(frame: DataFrame, *order) -> DataFrame:
    """frame with rank (1, 2, 3...) by the order, which tells all rows apart, and no task sees more than its range of rows."""
    spark = frame.sparkSession
    placed = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    parts = placed.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # one row a partition
    before, offsets = 0, []
    for row in parts:
        offsets.append((row["__part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(offsets, "__part int, __before bigint")
    return placed.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """A row each row of docs (doc_id, text): doc_id, n_words, n_features, weight, score, rank, all long.

    rank counts the drawn rows, floor(percent * N / 100) of the N with at least min_words words, from the highest score; ties
    go to the smaller doc_id, a null one last.  All other rows have a null rank.  Null, empty and wordless texts have no
    feature and weight 0.  Repeated rows count and are drawn each for itself, alike ones in the order in which they were
    read; texts of any length are exploded as wholes.  Without target or documents, gains follow from the counts that are
    there; an empty table of documents gives no rows.  Other columns, whatever their names, are ignored.
    """
    table = gains(docs, target, longest, buckets)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words(F.col("text")).alias("__words"))
    rows = rows.withColumn("n_words", F.size("__words").cast("bigint"))
    weighed = (
        bucketed(rows, longest, buckets, "row", "doc_id", "n_words")
        .join(F.broadcast(table), "bucket", "left")  # `buckets` rows of 16 bytes
        .groupBy("row", "doc_id", "n_words")
        .agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    )
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    drawn = percent * scored.filter(F.col("n_words") >= min_words).count() // 100
    long_enough = (F.col("n_words") >= min_words).alias("long_enough")
    order = [F.desc(long_enough), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = ranked(scored, *order)
    rank = F.when((F.col("n_words") >= min_words) & (F.col("rank") <= drawn), F.col("rank"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op13(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (SELECT r, unnest(words) AS word FROM d),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS (
  SELECT word, xor(list_reduce(list_transform(range(1, 1 + octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i - 1 AS INT), 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM w UNION SELECT word FROM b), crc
), s AS (SELECT bucket, count(*) AS s FROM w JOIN v USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM w) AS ss, (SELECT count(*) FROM b) AS tt),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (ss + 10000) / (CAST(s + 1 AS DOUBLE) * (tt + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), n
), x AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN v USING (word) JOIN g USING (bucket) GROUP BY r),
y AS (
  SELECT r, doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN x USING (r)
), z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM z
"""
