"""Parcel search: conjunctions of optional predicates, with the first rows in listing order.

Parcels: pos, owner, upc, book, page, plat, cab_refs array<string>, trs, official (official owner), arc_trs,
subdivision; columns that a frame lacks count as empty.  An empty or null criterion is ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 50


def text(frame: DataFrame, name: str) -> Column:
    """The column in upper case, with the empty string for null or a missing column."""
    return F.coalesce(F.upper(F.col(name)), F.lit("")) if name in frame.columns else F.lit("")


def owner_matches(frame: DataFrame, owner: str, operator: str = "contains") -> Column:
    """contains: in owner and official owner written one after the other; begins, exact: either of the two."""
    query = owner.strip().upper()
    own, official = text(frame, "owner"), text(frame, "official")
    if operator == "exact":
        return (own == query) | (official == query)
    if operator == "begins":
        return own.startswith(query) | official.startswith(query)
    return F.concat(own, F.lit(" "), official).contains(query)


def parcel_predicate(frame: DataFrame, owner="", upc="", book="", page="", cabinet_ref="", trs="", subdivision="", operator="contains") -> Column:
    """The criteria as one condition.  upc, book and page are exact and case-sensitive, so they reach the scan."""
    given = []
    if (owner or "").strip():
        given.append(owner_matches(frame, owner, operator))
    given += [F.col(name) == value.strip() for name, value in (("upc", upc), ("book", book), ("page", page)) if (value or "").strip()]
    if (cabinet_ref or "").strip():
        ref = cabinet_ref.strip().upper()
        listed = F.array_contains("cab_refs", ref) if "cab_refs" in frame.columns else F.lit(False)
        given.append(F.coalesce(listed, F.lit(False)) | text(frame, "plat").contains(ref))
    if (trs or "").strip():
        query = trs.strip().upper()
        given.append(text(frame, "trs").contains(query) | text(frame, "arc_trs").contains(query))
    if (subdivision or "").strip():
        given.append(text(frame, "subdivision").contains(subdivision.strip().upper()))
    return reduce(lambda a, b: a & b, given, F.lit(True))


def first_rows(frame: DataFrame, limit: int, pos: str = "pos") -> DataFrame:
    """The first rows in listing order: a distributed top-N."""
    return frame.orderBy(pos).limit(limit)


def search_parcels(parcels: DataFrame, limit: int = LIMIT, **criteria) -> DataFrame:
    return first_rows(parcels.filter(parcel_predicate(parcels, **criteria)), limit)


def search_with_fallback(parcels: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Owner hits; only if there are none and the query is a number, parcels of that upc.  Under two characters: none."""
    query = (query or "").strip()
    if len(query) < 2:
        return parcels.limit(0)
    by_owner = parcels.filter(owner_matches(parcels, query)).withColumn("__way", F.lit(0))
    by_upc = parcels.filter(F.col("upc") == query if query.isdigit() else F.lit(False)).withColumn("__way", F.lit(1))
    found = by_owner.unionByName(by_upc).orderBy("__way", "pos").limit(limit)
    return found.withColumn("__best", F.min("__way").over(Window.partitionBy(F.lit(0)))).filter("__way = __best").drop("__way", "__best")


def county_search(counties: DataFrame, query: str | None) -> DataFrame:
    """Counties whose name or fips contains the query, or whose state is the query; all for an empty one."""
    query = (query or "").strip().upper()
    if not query:
        return counties
    return counties.filter(F.upper("name").contains(query) | (F.upper("state") == query) | F.col("fips").contains(query))


def page_of(frame: DataFrame, order: str, page: int, per_page: int) -> DataFrame:
    """One page of a listing."""
    return frame.orderBy(order).offset(max(0, page - 1) * per_page).limit(per_page)


#: Owners that are no persons, without blanks and marks.
NO_OWNER = (
    "ROAD", "STREET", "HIGHWAY", "HWY", "COUNTY", "STATE", "NEWMEXICO", "NMDOT", "PUEBLO", "BLM", "USFS", "FORESTSERVICE", "RIGHTOFWAY", "EASEMENT",
    "VACANT", "UNKNOWN", "NONE",
)


def is_person_name(name: Column) -> Column:
    """Owner names worth following: three characters or more, some of them letters, no lot label, no `UPC 12`, no public owner.

    A lot label is one word of four digits or more and letters after them.
    """
    bare = F.trim(name)
    letters, digits = F.regexp_replace(bare, "[^A-Za-z]", ""), F.regexp_replace(bare, "[^0-9]", "")
    label = (F.length(digits) >= 4) & (F.length(letters) > 0) & (bare == F.concat(digits, letters))
    upc = F.upper(F.substring(bare, 1, 3)).eqNullSafe("UPC") & F.trim(F.substring(bare, 4, 100)).rlike("^[0-9]")
    nothing = (F.length(digits) > 0) & (F.regexp_replace(bare, r"[\d\s-]", "") == "")
    return (F.length(bare) >= 3) & ~nothing & ~label & ~upc & ~F.upper(letters).isin(*NO_OWNER)


def _has_part(kind: Column, *parts: str) -> Column:
    """Whether one of the parts stands in a type's letters, whatever stands between these."""
    squeezed = F.regexp_replace(F.lower(kind), "[^a-z]", "")
    return F.greatest(*[F.contains(squeezed, F.lit(p)) for p in parts])


def is_deed_type(kind: Column) -> Column:
    """A deed, warranty, quitclaim, conveyance or grant."""
    return _has_part(kind, "deed", "warrant", "quitclaim", "convey", "grant")


def is_survey_type(kind: Column) -> Column:
    """A survey, plat (or replat), map, lot line or subdivision."""
    return _has_part(kind, "survey", "plat", "map", "lotline", "subdiv")
