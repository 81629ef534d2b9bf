"""Tables and label/value pairs of result pages, read with the pages' own markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions.text import found

#: Columns of a result table after its link cell (fixed order).
FIELDS = ("location", "document_code", "gf_number", "instrument_type", "document_no", "recorded_date", "instrument_date", "grantor", "grantee")


def plain(cell: Column) -> Column:
    """A cell's text: tags gone, common character references decoded, blanks made single."""
    out = F.regexp_replace(cell, r"(?s)<[^>]*>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def result_rows(pages: DataFrame, html: str = "html", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows of result tables: pages' other columns, ordinal, doc_no and the fields.

    A row counts if it has nine cells or more and its first cell links to a document number of capitals and digits.
    """
    rest = [c for c in pages.columns if c != html]
    rows = pages.select(*rest, F.posexplode(found(F.col(html), r"(?is)<tr\b[^>]*>(.*?)</tr>")).alias("ordinal", "row"))
    cells = rows.withColumn("cells", found(F.col("row"), r"(?is)<td\b[^>]*>(.*?)</td>"))
    used = cells.filter(F.size("cells") >= 9).withColumn("doc_no", plain(F.regexp_extract(F.get("cells", 0), r"(?is)<a\b[^>]*>(.*?)</a>", 1)))
    named = [F.coalesce(plain(F.get("cells", i)), F.lit("")).alias(f) for i, f in enumerate(fields, 1)]
    return used.filter(F.col("doc_no").rlike("^[A-Z0-9]+$")).select(*rest, F.col("ordinal").cast("bigint").alias("ordinal"), "doc_no", *named)


def label_values(html: Column) -> Column:
    """Map of two-cell rows, label without its colon to value; if there are none, of bold labels and the text after them."""
    row = r"(?is)<tr\b[^>]*>\s*<t[dh]\b[^>]*>((?:(?!</t[dh]>).)*)</t[dh]>\s*<td\b[^>]*>((?:(?!</td>).)*)</td>\s*</tr>"
    bold = r"(?is)<(?:b|strong)>([^<]*)</(?:b|strong)>\s*([^<]+)"

    def pairs(pattern: str) -> Column:
        both = F.arrays_zip(found(html, pattern, 1).alias("k"), found(html, pattern, 2).alias("v"))
        made = F.transform(both, lambda p: F.struct(F.rtrim(F.regexp_replace(plain(p["k"]), r":\s*$", "")).alias("k"), plain(p["v"]).alias("v")))
        return F.filter(made, lambda p: (p["k"] != "") & (p["v"] != ""))

    last = lambda a: F.map_from_entries(F.filter(a, lambda p, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda q: q["k"] == p["k"])))
    rows = pairs(row)
    return F.when(F.size(rows) > 0, last(rows)).otherwise(last(pairs(bold)))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(pages' other columns, href): the targets of a page's links, in page order; null pages have none."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.explode(found(F.col(html), r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']")).alias("href"))


def host_counts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages by host; addresses without one count under the empty text."""
    return pages.groupBy(F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"))


def form_defaults(html: Column) -> Column:
    """Map of a form's input names to their values."""
    inputs = found(html, r"(?is)(<input\b[^>]*>)")
    of = lambda x, a: F.regexp_extract(x, rf"(?is)\b{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    named = F.filter(F.transform(inputs, lambda x: F.struct(of(x, "name").alias("k"), of(x, "value").alias("v"))), lambda p: p["k"] != "")
    return F.map_from_entries(F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q["k"] == p["k"])))


def feed_entries(feed: DataFrame, xml: str = "xml", summary: int = 300, authors: int = 3) -> DataFrame:
    """Entries of Atom feeds: title, summary, url, authors, published."""
    bare = F.regexp_replace(F.regexp_replace(xml, r"<(/?)\w+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    each = feed.select(F.explode(F.regexp_extract_all(bare, F.lit(r"(?s)(<entry[\s>].*?</entry>)"), F.lit(1))).alias("x"))
    entry = F.from_xml("x", "title string, summary string, id string, published string, author array<struct<name:string>>")
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return each.select(entry.alias("e")).select(
        one(F.col("e.title")).alias("title"), F.substring(one(F.col("e.summary")), 1, summary).alias("summary"), F.trim("e.id").alias("url"),
        F.slice(F.transform("e.author", lambda a: F.trim(a["name"])), 1, authors).alias("authors"), F.substring("e.published", 1, 10).alias("published"),
    )
