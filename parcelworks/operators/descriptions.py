"""Most similar descriptions of many queries at once, by inverted lists of all five parts with bounds of what a pair can score."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.operators.similarity import WEIGHTS, legal_parts, legal_score
from parcelworks.storage import broadcast_if_small, stored

#: Bars of queries: the highest of these that its last hit reaches for certain.
LEVELS = tuple(5.0 * n for n in range(1, 21))
#: Scores are compared after they are rounded to one decimal.
ROUNDING = 0.05 + 1e-6

_PARTS = ("trs", "township", "tokens", "cabs", "names", "lots")
#: Parts that a query has or lacks: without them its score doesn't depend on a row's.
_LETTERS = {"trs": "t", "township": "t", "tokens": "w", "cabs": "c", "names": "n", "lots": "l"}
#: Every set of parts that a pair can share.
_SETS = [tuple(p for p in c if p) for c in product(("", "township", "trs"), *[("", p) for p in ("cabs", "names", "lots")])]


def _parts(frame: DataFrame, column: str, *keep: str) -> DataFrame:
    """keep, the parts as sorted arrays, and sid: a digest of all of them, so that descriptions alike in their parts are one."""
    text = frame.select(*keep, F.coalesce(F.col(column), F.lit("")).alias("__text"))
    made = legal_parts(text, "__text").drop("__text").withColumns({p: F.sort_array(p) for p in _PARTS})
    return made.withColumn("sid", F.sha2(F.to_json(F.struct(*_PARTS)), 256))


def _gains(weights: dict[str, float]) -> dict[str, float]:
    """What each part but the words adds to a score at most."""
    share = {p: 100.0 * w / sum(weights.values()) for p, w in weights.items()}
    return {"trs": share["trs"], "township": 0.3 * share["trs"], "cabs": share["cab"], "names": share["names"], "lots": share["lot_block"]}


def classes(bar: float, weights: dict[str, float]) -> list[tuple[tuple[str, ...], float]]:
    """(parts, need): what a pair that scores ``bar`` or more has in common, and the share of words it needs beside that.

    Every set of parts that a pair can share is looked at: it gives its gain, the rest must come from the words, so their share
    is at least need.  Sets for which that is over 1 can't reach the bar.  Sets that reach it alone have need 0 and stand for the
    sets that hold them too.
    """
    gain, text = _gains(weights), 100.0 * weights["text"] / sum(weights.values())
    found = []
    for shared in _SETS:
        lack = bar - sum(gain[p] for p in shared)
        if lack <= 0:
            found.append((shared, 0.0))
        elif lack <= text:
            found.append((shared, lack / text))
    holds = lambda big, small: all(p in big or (p == "township" and "trs" in big) for p in small)
    sure = [s for s, need in found if need == 0]
    return [(s, need) for s, need in found if not any(holds(s, o) and o != s for o in sure)]


def _extended(keys: Column, values: Column) -> Column:
    """Every key with every value behind it."""
    return F.flatten(F.transform(keys, lambda k: F.transform(values, lambda v: F.concat(k, F.lit("\x1f"), v))))


def _combined(kind: str, shared: tuple[str, ...]) -> Column:
    """Every combination of one value each of the shared parts, behind the mask, the kind of list and the set."""
    keys = F.array(F.concat_ws("\x1f", "mask", F.lit(f"{kind}{_SETS.index(shared)}")))
    for part in shared:
        keys = _extended(keys, F.col(part))
    return keys


def _reaching(need: float) -> Column:
    """The words of ranked, each with its reach: the share up to which a set of its size lists it, being need at least.

    Of two sets that share ``need`` of their words or more, one of the n - ceil(need * n) + 1 rarest of each is common.
    """
    n = F.size("ranked")
    words = F.transform("ranked", lambda word, at: F.struct(word.alias("word"), ((n - at) / n).alias("reach")))
    return F.filter(words, lambda x: x["reach"] >= need - 1e-9)


def _lists(rows: DataFrame, number: str, found: list[tuple[tuple[str, ...], float]], reach: bool) -> DataFrame:
    """(key, number, share): the entries of rows (mask, parts, ranked) in the lists of the sets found, each with the words it needs.

    With reach every set has both lists and share says how far an entry counts; without it share is the need itself.
    """
    entry = lambda key, share: F.struct(F.xxhash64(*key).alias("key"), share.cast("double").alias("share"))
    lists = []
    for shared, need in found:
        if need <= 0:
            lists.append(F.transform(_combined("sure", shared), lambda c: entry([c], F.lit(2.0 if reach else 0.0))))
        if need > 0 or reach:
            lists.append(_worded(_combined("words", shared), max(need, 0.0), reach, entry))
    every = F.array_distinct(F.concat(*lists)) if lists else F.array().cast("array<struct<key:bigint,share:double>>")
    return rows.select(number, F.explode(every).alias("e")).select("e.key", number, "e.share")


def _worded(keys: Column, need: float, reach: bool, entry) -> Column:
    words = _reaching(need)
    return F.flatten(F.transform(keys, lambda c: F.transform(words, lambda w: entry([c, w["word"]], w["reach"] if reach else F.lit(need)))))


def _bounds(rows: DataFrame, weights: dict[str, float], *keep: str) -> DataFrame:
    """keep, key, bound: lists whose rows all score bound or more with a query that is in them.

    A list is of a set of parts, with or without all words.  Of shared names one counts at least.
    """
    gain, text = _gains(weights), 100.0 * weights["text"] / sum(weights.values())
    none = F.lit(0.0)
    entry = lambda key, bound: F.struct(F.xxhash64(*key).alias("key"), F.hash(*key).alias("key2"), bound.alias("bound"))
    lists = []
    for shared in _SETS:
        bound = F.lit(sum(gain[p] for p in shared if p != "names")) + (gain["names"] / F.greatest(F.size("names"), F.lit(1)) if "names" in shared else none)
        words = F.when(F.size("tokens") > 0, F.array(F.concat_ws("\x1f", "tokens"))).otherwise(F.array().cast("array<string>"))
        if shared:
            lists.append(F.transform(_combined("parts", shared), lambda c: entry([c], bound)))
        lists.append(F.transform(_extended(_combined("alike", shared), words), lambda c: entry([c], bound + text)))
    return rows.select(*keep, F.explode(F.concat(*lists)).alias("e")).select(*keep, "e.*")


def _ranked(rows: DataFrame, df: DataFrame) -> DataFrame:
    """rows with ranked: their words from the rarest to the most frequent, ties by the word; unknown words are the rarest."""
    words = rows.select("sid", F.explode("tokens").alias("word")).join(df, "word", "left")
    order = words.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("r"))
    ranked = F.coalesce(F.transform("r", lambda x: x["word"]), F.array().cast("array<string>"))
    return rows.join(order, "sid", "left").withColumn("ranked", ranked).drop("r")


def _mask() -> Column:
    """The parts that a row has, a letter each."""
    return F.concat(*[F.when(F.size(p) > 0, letter).otherwise("") for p, letter in _LETTERS.items() if p != "township"])


def similar_descriptions_each(
    frame: DataFrame, queries: DataFrame, id_: str, query_id: str, column: str = "description", query: str = "query",
    least: float = 20.0, limit: int = 20, pos: str = "pos", weights: dict[str, float] | None = None,
) -> DataFrame:
    """(query_id, id_, the five parts, score, nth): for every query the first ``limit`` rows that score ``least`` or more.

    As similar_descriptions, for a frame of queries (query_id, query): best score first, then pos, then id_.  No pair is built
    that shares too little: see classes().  Work is in four steps, all joins by key:

    1. Descriptions with the same parts are one, with their first ``limit`` rows; no others can be among a query's first.  For queries
       that lack a part (their mask, at most 32) descriptions that differ in that part alone are one group too.
    2. Members are counted for every set of parts, with and without all words.  The highest of LEVELS at which a query's lists hold
       ``limit`` rows for certain is its bar.
    3. Groups are listed under what they share with a query, all values at once; a query meets those that can reach its bar.
    4. The first ``limit`` groups of a query by score and first row give its rows.

    Descriptions under ten characters are left out, null ones too; null queries have no parts and no hits.  least must be above
    ROUNDING: below it every pair qualifies.  Repeated rows and queries each count on their own.  A very long description is one row
    with many entries.  Columns beside those named are ignored.  Empty frames give no rows.
    """
    if least <= ROUNDING:
        raise ValueError(f"least must be above {ROUNDING}")
    w = WEIGHTS | (weights or {})
    long = frame.filter(F.length(F.trim(column)) >= 10)
    all_rows = stored(_parts(long.withColumns({"__id": F.col(id_), "__pos": F.col(pos)}), column, "__id", "__pos"), "described")
    asked_rows = stored(_parts(queries.withColumn("__asked", F.col(query_id)), query, "__asked"), "asked")
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.col("__pos"), F.col("__id")))
    members = stored(all_rows.select("sid", "__id", "__pos").withColumn("__n", place).filter(F.col("__n") <= limit).drop("__n"), "members")
    # one row of parts a digest: a group of copies comes together before the shuffle
    alike = lambda rows: rows.groupBy("sid").agg(*[F.first(p).alias(p) for p in _PARTS])
    rows = stored(alike(all_rows), "parts")
    df = stored(rows.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "words")
    counted = members.groupBy("sid").agg(F.count("*").alias("m"), F.min(F.struct("__pos", "__id")).alias("first"))
    rows = stored(_ranked(rows, df).join(counted, "sid"), "ranked")
    asked = _ranked(alike(asked_rows), df).withColumns({"mask": _mask(), "q": F.monotonically_increasing_id()})
    asked = stored(asked.filter("mask <> ''"), "asked-ranked")
    masks = [r.mask for r in asked.select("mask").distinct().collect()]  # at most 32

    masked = rows.withColumn("mask", F.explode(F.array(*map(F.lit, masks)).cast("array<string>")))
    empty = F.array().cast("array<string>")
    masked = masked.withColumns({p: F.when(F.contains("mask", F.lit(_LETTERS[p])), F.col(p)).otherwise(empty) for p in _PARTS})
    masked = masked.withColumn("ranked", F.when(F.size("tokens") > 0, F.col("ranked")).otherwise(empty))
    masked = masked.withColumn("gid", F.substring(F.unhex(F.sha2(F.to_json(F.struct("mask", *_PARTS)), 256)), 1, 16))
    belongs = stored(masked.select("gid", "sid"), "groups-of-parts")
    groups = masked.groupBy("gid").agg(*[F.first(p).alias(p) for p in (*_PARTS, "ranked", "mask")], F.sum("m").alias("m"), F.min("first").alias("first"))
    groups = stored(groups.withColumn("g", F.monotonically_increasing_id()), "groups")

    own = stored(_bounds(asked, w, "q"), "bounds")
    keys = ["key", "key2"]
    known = stored(own.select(*keys).distinct(), "bound-keys")
    counts = _bounds(groups, w, "m").join(broadcast_if_small(known, 32), keys, "left_semi").groupBy(*keys).agg(F.sum("m").alias("n")).filter(F.col("n") >= limit)
    sure = own.join(counts, keys).groupBy("q").agg(F.max("bound").alias("bound"))
    level = F.lit(float(least))
    for bar in LEVELS:
        if bar > least:
            level = F.when(F.col("bound") >= bar + 1e-6, F.lit(bar)).otherwise(level)
    asked = stored(asked.join(sure, "q", "left").withColumn("bar", level).drop("bound"), "bars")

    entries = asked.select(F.lit(0).cast("bigint").alias("key"), "q", F.lit(0.0).alias("need")).limit(0)
    for (bar,) in asked.select("bar").distinct().collect():  # at most one a level
        found = _lists(asked.filter(F.col("bar") == bar), "q", classes(bar - ROUNDING, w), False)
        entries = entries.unionByName(found.withColumnRenamed("share", "need"))
    wanted = stored(entries, "asked-lists")
    known = stored(wanted.select("key").distinct(), "asked-keys")
    gain, text = _gains(w), 100.0 * w["text"] / sum(w.values())
    needs = [(c, (least - ROUNDING - sum(gain[p] for p in c)) / text if text else float(least - ROUNDING > sum(gain[p] for p in c)) * 2) for c in _SETS]
    listed = _lists(groups, "g", [(c, need) for c, need in needs if need <= 1], True)
    listed = listed.join(broadcast_if_small(known, 32), "key", "left_semi")
    pairs = stored(listed.join(wanted, "key").filter(F.col("share") >= F.col("need") - 1e-9).select("q", "g").distinct(), "pairs")

    side = lambda frame, prefix, *more: frame.select(*more, *[F.col(p).alias(prefix + p) for p in _PARTS])
    met = pairs.join(side(groups, "a_", "g", "first"), "g").join(broadcast_if_small(side(asked, "b_", "q", "bar"), 512), "q")
    scored = met.select("q", "g", "first", "bar", *[F.round(v, 1).alias(k) for k, v in legal_score(weights=w).items()]).filter(F.col("score") >= F.col("bar"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first.__pos", "first.__id"))
    hits = stored(scored.withColumn("nth", nth).filter(F.col("nth") <= limit).drop("nth", "first", "bar"), "hits")
    met = stored(hits.select("g").distinct().join(groups.select("g", "gid"), "g"), "groups-met")
    place = F.row_number().over(Window.partitionBy("g").orderBy("__pos", "__id"))
    rows = belongs.join(broadcast_if_small(met, 48), "gid").join(members, "sid").select("g", "__id", "__pos").withColumn("n", place).filter(F.col("n") <= limit)
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "__pos", "__id"))
    hits = hits.join(rows, "g").withColumn("nth", nth).filter(F.col("nth") <= limit)
    out = asked_rows.select("__asked", "sid").join(asked.select("sid", "q"), "sid").join(hits, "q")
    return out.select(F.col("__asked").alias(query_id), F.col("__id").alias(id_), *legal_score(), "nth")
