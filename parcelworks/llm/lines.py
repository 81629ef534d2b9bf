"""Line dedup by site-relative frequency: lines on more than a share of a host's pages are boilerplate.

All of it is DataFrame work.  The lines of a page are counted once a page under (host, line), with partial sums
before the shuffle, so neither a host with most of the pages nor a line on all of them makes one task large.
Lines are compared by two 64-bit hashes.  A host's boilerplate lines are few by their definition: with at most
``ratio`` of a page's lines each, there are no more than (mean lines a page) / ratio of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

RATIO = 0.1
MIN_PAGES = 3


def _key(line):
    """What lines are compared by: two hashes of the line without blanks at its ends; null if nothing is left."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b")))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines array of keys): lines on at least min_pages of the host's pages and on over ``ratio`` of them."""
    rows = docs.select(F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")).filter("host IS NOT NULL")
    lines = rows.filter("text IS NOT NULL").select(
        "host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _key))).alias("line")
    )
    counts = lines.filter("line IS NOT NULL").groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    often = counts.join(totals, "host").filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def cleaned(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = True) -> DataFrame:
    """docs with __lines (lines of the text), __kept (those that stay) beside its own columns.

    Lines are cut at \\n; blank lines always stay.  With keep_whole, a page of which all non-blank lines are boilerplate
    stays as it is: it is a repeated page, which near-duplicate detection deals with; without, its blank lines are left.  Pages without a host keep all lines;
    null texts stay null; repeated rows are pages each; a line on just ratio of the pages stays.  The hosts' lines are broadcast if their counted size allows it, else joined by a
    shuffle on the host, in which Spark splits a hot host's pages.
    """
    lists = stored(boilerplate(docs, host, ratio, min_pages), "boilerplate")
    size = lists.agg(F.sum(F.size("lines") * 16 + 64)).first()[0] or 0
    lists = lists.select(F.col("host").alias("__host"), F.col("lines").alias("__boilerplate"))
    lists = broadcast_if_small(lists, 1 + size // max(1, lists.count()))
    joined = docs.join(lists, docs[host].cast("string") == lists["__host"], "left")
    split = F.split(F.col("text").cast("string"), "\n")
    stay = lambda line: F.coalesce(~F.array_contains(F.col("__boilerplate"), _key(line)), F.lit(True))
    kept = F.when(F.col("__boilerplate").isNull(), F.col("__lines")).otherwise(F.filter("__lines", stay))
    marked = joined.withColumn("__lines", split).withColumn("__some", kept)
    nothing = F.lit(keep_whole) & ~F.exists("__some", lambda line: F.btrim(line, F.lit(" \t\r")) != "")
    return marked.withColumn("__kept", F.when(nothing, F.col("__lines")).otherwise(F.col("__some"))).drop("__host", "__boilerplate", "__some")


def dedup_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows of docs with boilerplate lines gone from text, in the same columns; n_chars follows if docs has it."""
    out = cleaned(docs, host, ratio, min_pages).withColumn("text", F.array_join("__kept", "\n"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = F.size("__kept") < F.size("__lines")
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents by source: doc_id, n_lines, n_dropped, text without its boilerplate lines."""
    from .common import table

    out = cleaned(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__lines") - F.size("__kept"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.array_join("__kept", "\n").alias("text"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT r, source, trim(line, ' ' || chr(9) || chr(13)) AS line FROM (SELECT r, source, unnest(lines) AS line FROM d)
), b AS (
  SELECT source, line FROM (SELECT source, line, count(DISTINCT r) AS n FROM l WHERE line <> '' AND source IS NOT NULL GROUP BY source, line)
  JOIN (SELECT source, count(*) AS pages FROM d GROUP BY source) USING (source) WHERE n >= 3 AND n > 0.1 * pages
), e AS (
  SELECT r, i, lines[i] AS line, trim(lines[i], ' ' || chr(9) || chr(13)) AS bare, source FROM (SELECT r, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), k AS (
  SELECT r, i, e.line, bare, b.line IS NULL AS stays FROM e LEFT JOIN b ON e.source = b.source AND e.bare = b.line
), g AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (stays) AS n_kept, count(*) FILTER (stays AND bare <> '') AS n_text,
    string_agg(line, chr(10) ORDER BY i) AS whole, string_agg(line, chr(10) ORDER BY i) FILTER (stays) AS part
  FROM k GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(CASE WHEN coalesce(n_text, 0) = 0 THEN 0 ELSE n_lines - n_kept END AS BIGINT) AS n_dropped,
  CASE WHEN n_text = 0 THEN whole ELSE part END AS text
FROM d LEFT JOIN g USING (r)
"""
