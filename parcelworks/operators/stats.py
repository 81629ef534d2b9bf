"""Session statistics, baselines, outlier flags, data quality and conflicts, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.operators.ranking import at_shares


def tier(value: Column, bounds: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first bound that the value reaches."""
    out = None
    for low, name in bounds:
        out = F.when(value >= low, name) if out is None else out.when(value >= low, name)
    return out.otherwise(rest)


COMPLETION = [(90, "complete"), (60, "mostly"), (25, "partial")]


def indexed_quartile(values: Column, share: float) -> Column:
    """The element int(n * share) of the sorted values, counted from 0: not an interpolated percentile."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) * share).cast("int"))


def indexed_quartiles(frame: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, q1, q3, low, high by indexed quartiles.  Null values count nothing; a null group is a group.

    A group of any size spreads over all tasks (ranking.at_shares).
    """
    return at_shares(frame, group, value, {"q1": 0.25, "q3": 0.75})


def monthly_counts(frame: DataFrame, date: str, months: int = 12) -> DataFrame:
    """Rows by month (`2024-05`), the latest ``months`` that have any, youngest first; rows without a date count nothing."""
    counts = frame.filter(F.col(date).isNotNull()).groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("month")).limit(months)


def baselines(frame: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean and sample deviation of a value by group and over all (`_global`); a single row has deviation 0."""
    out = frame.groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.grouping(group).alias("__all"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std")
    )
    return out.withColumn(group, F.when(F.col("__all") == 1, "_global").otherwise(F.col(group))).drop("__all")


def zscore_flags(frame: DataFrame, group: str, value: str, id_: str, least: int = 5) -> DataFrame:
    """id, group, level: error above 3 deviations, warn above 2, info below -2, against the group's baseline of ``least`` rows or more, else the global one."""
    base = baselines(frame, group, value)
    own = base.filter((F.col(group) != "_global") & (F.col("n") >= least)).select(F.col(group).alias("__g"), F.col("mean").alias("m1"), F.col("std").alias("s1"))
    all_ = base.filter(F.col(group) == "_global").select(F.col("mean").alias("m0"), F.col("std").alias("s0"))
    joined = frame.join(own, F.col(group) == F.col("__g"), "left").crossJoin(F.broadcast(all_))  # one row
    mean, std = F.coalesce("m1", "m0"), F.coalesce("s1", "s0")
    z = F.when(std > 0, (F.col(value) - mean) / std)
    level = F.when(z > 3, "error").when(z > 2, "warn").when(z < -2, "info")
    return joined.select(id_, group, level.alias("level")).filter("level IS NOT NULL")


def area_conflict(a: Column, b: Column, warn: float = 1.5, critical: float = 3.0) -> Column:
    """critical or warn if the larger of two sizes is over so many times the smaller; null if they agree or one is missing."""
    ratio = F.greatest(a, b) / F.least(a, b)
    return F.when((a > 0) & (b > 0), F.when(ratio > critical, "critical").when(ratio > warn, "warn"))


def index_health(parcels: DataFrame, now: Column) -> DataFrame:
    """One row: counts of parcels with each field, percentages, age of built_at in days and whether it is stale (over 30)."""
    has = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    names = [c for c in ("upc", "owner", "plat", "book", "page", "centroid", "polygon") if c in parcels.columns]
    out = parcels.agg(F.count("*").alias("total"), *[has(c).alias(f"with_{c}") for c in names], F.max("built_at").alias("built_at"))
    age = F.datediff(now, F.col("built_at"))
    share = {f"pct_{c}": F.when(F.col("total") > 0, F.round(100 * F.col(f"with_{c}") / F.col("total"), 1)).otherwise(0.0) for c in names}
    return out.withColumns(share | {"age_days": age, "stale": age > 30})


def session_metrics(sessions: DataFrame) -> DataFrame:
    """Counts of a session's subjects array<struct<name,type,deed_saved,plat_saved>>: by type, deeds, plats, both, and the share with both in per cent."""
    count = lambda f: F.size(F.filter(F.coalesce("subjects", F.array()), f))
    deed = lambda s: F.coalesce(s["deed_saved"], F.lit(False))
    plat = lambda s: F.coalesce(s["plat_saved"], F.lit(False))
    total = F.size(F.coalesce("subjects", F.array()))
    return sessions.withColumns({
        "subject_count": total,
        "client_count": count(lambda s: s["type"] == "client"),
        "adjoiner_count": count(lambda s: s["type"] == "adjoiner"),
        "deed_count": count(deed),
        "plat_count": count(plat),
        "both_count": count(lambda s: deed(s) & plat(s)),
    }).withColumn("completion_pct", F.when(total > 0, F.round(100.0 * F.col("both_count") / total, 1)).otherwise(0.0))


def completeness(sessions: DataFrame, missing: int = 20) -> DataFrame:
    """Share of saved deeds and plats, and the first ``missing`` names that lack one."""
    lacks = F.filter("subjects", lambda s: ~(F.coalesce(s["deed_saved"], F.lit(False)) & F.coalesce(s["plat_saved"], F.lit(False))))
    return session_metrics(sessions).withColumn("missing", F.slice(F.transform(lacks, lambda s: s["name"]), 1, missing))


#: Cabinets to look in where no job tells (fixed values).
CABINETS = ("C", "B", "A")


def likely_cabinets(history: DataFrame, cabinets: str, order: str, n: int = 3) -> DataFrame:
    """One row: likely_cabinets, the n letters that most jobs name, ties by who came first in ``order``; CABINETS if there is none.

    ``cabinets`` is an array of letters; a letter that stands twice in it counts twice.  Letters are counted where the rows are.
    """
    named = history.select(F.col(order).alias("__order"), F.posexplode(cabinets).alias("__at", "__letter")).filter("__letter IS NOT NULL")
    counts = named.groupBy("__letter").agg(F.count("*").alias("__n"), F.min(F.struct("__order", "__at")).alias("__first"))
    best = counts.orderBy(F.desc("__n"), "__first").limit(n)
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("k"), "__first", "__letter"))), lambda x: x["__letter"])
    return best.agg(listed.alias("l")).select(F.when(F.size("l") > 0, F.col("l")).otherwise(F.array(*map(F.lit, CABINETS))).alias("likely_cabinets"))


def predict_complexity(history: DataFrame, job_type: str, cabinets: str | None = None, order: str = "job") -> DataFrame:
    """One row about the adjoiners to expect: rows of the type if there are any, else all; class, confidence, indexed quartiles.

    With ``cabinets`` (a column of letters) also likely_cabinets, see there.  Without any row: 6 adjoiners, moderate, confidence none.
    """
    n = history.agg(F.count_if(F.col("job_type") == job_type).alias("typed"))
    used = history.crossJoin(F.broadcast(n)).filter((F.col("typed") == 0) | (F.col("job_type") == job_type))
    few = indexed_quartiles(used.withColumn("__one", F.lit(0)), "__one", "adjoiner_count")
    few = few.select(F.when(F.col("n") >= 4, F.col("q1")).otherwise(F.col("low")).alias("p25"), F.when(F.col("n") >= 4, F.col("q3")).otherwise(F.col("high")).alias("p75"))
    few = few.agg(F.max("p25").alias("p25"), F.max("p75").alias("p75"))  # a row of nulls where there are no jobs
    mean = F.coalesce(F.round(F.avg("adjoiner_count"), 1), F.lit(6.0)).alias("predicted")
    out = used.agg(F.count("*").alias("n"), mean).crossJoin(few)  # one row each
    if cabinets:
        out = out.crossJoin(likely_cabinets(used, cabinets, order))
    return out.withColumns({
        "complexity": F.when(F.col("predicted") <= 4, "simple").when(F.col("predicted") <= 10, "moderate").otherwise("complex"),
        "confidence": F.when(F.col("n") >= 20, "high").when(F.col("n") >= 5, "medium").when(F.col("n") > 0, "low").otherwise("none"),
    })


def user_stats(users: DataFrame, tiers: tuple[str, ...] = ("free", "pro", "team"), price: dict[str, int] | None = None) -> DataFrame:
    """tier, users (zero for tiers without any), active, revenue a month."""
    price = price or {"pro": 29, "team": 79}
    spark = users.sparkSession
    dim = spark.createDataFrame([(t, price.get(t, 0)) for t in tiers], "tier string, price int")
    counts = users.groupBy(F.coalesce("tier", F.lit("free")).alias("tier")).agg(F.count("*").alias("users"), F.count_if("active").alias("active"))
    out = F.broadcast(dim).join(counts, "tier", "left").na.fill(0, ["users", "active"])
    return out.select("tier", "users", "active", (F.col("users") * F.col("price")).alias("revenue"))
