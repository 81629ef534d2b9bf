"""Scores as sums of cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(parts: list[Column], low: int = 0, high: int = 100) -> Column:
    """The parts' sum within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), reduce(lambda a, b: a + b, parts)))


def last_name(name: Column) -> Column:
    """What stands before the first comma, in upper case."""
    return F.upper(F.trim(F.substring_index(F.coalesce(name, F.lit("")), ",", 1)))


def record_year(date: Column) -> Column:
    """The year of `2019-04-01` or of `04/01/2019`; null if there is none."""
    first = F.substring_index(date, "-", 1)
    text = F.when(date.contains("-"), first).otherwise(F.substring(date, -4, 4))
    return text.try_cast("int")


#: Words of instrument types.
DEED_KINDS = ("deed", "warranty", "quitclaim", "grant", "conveyance", "bargain")
PLAT_KINDS = ("plat", "survey", "partition", "subdivision")
LOW_KINDS = ("mortgage", "lien", "release", "assignment", "satisfaction", "ucc")


def search_relevance(row: dict[str, Column], client: dict[str, str]) -> tuple[Column, Column]:
    """Score from 0 to 100 of a deed search row for a client, and its tags.

    row: grantor, grantee, location, instrument_type, recorded_date; client: section, subdivision, name, adjoiner.
    """
    place = F.upper(F.coalesce(row["location"], F.lit("")))
    people = F.upper(F.concat_ws(" ", row["grantor"], row["grantee"]))
    kind = F.lower(F.coalesce(row["instrument_type"], F.lit("")))
    name, other = ((client.get(k) or "").split(",")[0].strip().upper() for k in ("name", "adjoiner"))
    section, subdivision = (client.get("section") or "").strip(), (client.get("subdivision") or "").strip().upper()
    year = record_year(row["recorded_date"])
    never = F.lit(False)
    words = F.split(kind, r"\s+")
    kinds = lambda names: F.array(*[F.lit(n) for n in names])
    deed, plat = F.arrays_overlap(words, kinds(DEED_KINDS)), F.arrays_overlap(words, kinds(PLAT_KINDS))
    rules = [
        (place.rlike(rf"(?i)SEC(?:TION)?\s*{section}(?!\d)") if section else never, 40, "trs_match"),
        ((place.contains(subdivision) | people.contains(subdivision)) if subdivision else never, 25, "same_subdivision"),
        (people.contains(name) if len(name) >= 2 else never, 30, "client_name"),
        (people.contains(other) if len(other) >= 3 else never, 20, "adjoiner"),
        (deed, 15, "deed"),
        (~deed & plat, 12, "plat"),
        (~deed & ~plat & F.arrays_overlap(words, kinds(LOW_KINDS)), -5, None),
        (year >= 2015, 5, None),
        ((year >= 2000) & (year < 2015), 3, None),
    ]
    hit = [(F.coalesce(c, F.lit(False)), n, tag) for c, n, tag in rules]
    tags = F.array_compact(F.array(*[F.when(c, F.lit(tag)) for c, _, tag in hit if tag]))
    return clamped([F.when(c, n).otherwise(0) for c, n, _ in hit]), tags


def deed_priority(kind: Column, grantee_hit: Column, grantor_hit: Column, year: Column) -> Column:
    """Best deed of a subject: by type, then which party matched, then how recent."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    base = (
        F.when(low.contains("warranty"), 50)
        .when(low.contains("deed") & ~low.contains("trust"), 40)
        .when(low.contains("quitclaim"), 30)
        .when(low.rlike("grant|convey|patent"), 25)
        .otherwise(5)
    )
    party = F.when(grantee_hit, 20).otherwise(0) + F.when(grantor_hit, 10).otherwise(0)
    return base + party + F.when(year >= 2020, 15).when(year >= 2010, 10).when(year >= 2000, 5).otherwise(0)


def deed_health(issues: Column, notary: Column, monuments: Column, calls: Column) -> tuple[Column, Column]:
    """Score and grade of a deed from its issues array<struct<severity>>: 15 off a critical one, 5 off a warning (`warn`)."""
    of = lambda kind: F.size(F.filter(issues, lambda i: i["severity"] == kind))
    score = clamped([F.lit(100), -15 * of("critical"), -5 * of("warn"), F.when(notary, 2).otherwise(0), F.when(monuments > 0, 3).otherwise(0), F.when(calls >= 4, 5).otherwise(0)])
    return score, F.when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor")


def age_years(date: Column, now: Column) -> Column:
    return F.datediff(now, date) / 365.25


def parsed_date(text: Column) -> Column:
    """A date in one of four formats; null if none fits.  Each format that doesn't fit costs an exception, so empty texts try none."""
    return F.when(F.trim(text) != "", F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in ("MM/dd/yyyy", "yyyy-MM-dd", "MM/dd/yy", "MMM d, yyyy")]))


def session_step(client: Column, adjoiners: Column) -> Column:
    """How far a session has come, from 1 to 6, from the client's subject and the adjoiners' array of subjects."""
    both = F.forall(adjoiners, lambda s: F.coalesce(s["deed_saved"], F.lit(False)) & F.coalesce(s["plat_saved"], F.lit(False)))
    described = F.coalesce(client["property_description"], client["desc_type"], F.lit("")) != ""
    return (
        F.when(client.isNull(), 1)
        .when(~F.coalesce(client["deed_saved"], F.lit(False)), 2)
        .when(~described, 3)
        .when(F.coalesce(F.size(adjoiners), F.lit(0)) == 0, 4)
        .when(~both, 5)
        .otherwise(6)
    )
