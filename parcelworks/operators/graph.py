"""Property graph as two frames: nodes(id, type, name) and undirected edges(src, dst, relationship) with src < dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions import text as T
from parcelworks.storage import stored


def canonical_edges(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge a pair of nodes, whichever way it was given; the attributes of the last row stay.  Loops go."""
    rest = [c for c in rows.columns if c not in ("src", "dst", seq)]
    keyed = rows.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.struct(*rest).alias("__v"), seq)
    return keyed.groupBy("src", "dst").agg(F.max_by("__v", seq).alias("__v")).select("src", "dst", "__v.*")


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other) in both directions."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("id").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    return both_ways(edges.filter((F.col("src") == node) | (F.col("dst") == node))).filter(F.col("id") == node).select("other")


def bfs(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(id, hops, parent) of all nodes within ``depth`` hops of any of starts (id); of several parents the smallest stays.

    A round joins the frontier with the edges and leaves out what has been seen; its result is a stored table, so depth does
    not pile up lineage.  Repeated and null starts count once and not at all.
    """
    ways = both_ways(edges)
    kind = dict(ways.dtypes)["id"]
    first = starts.filter("id IS NOT NULL").select(F.col("id").cast(kind).alias("id")).distinct()
    seen = stored(first.select("id", F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("parent")), "nodes")
    front = seen.select("id")
    for hop in range(1, depth + 1):
        step = ways.join(front, "id").groupBy(F.col("other").alias("__id")).agg(F.min("id").alias("parent"))
        new = step.join(seen.select(F.col("id").alias("__id")), "__id", "left_anti")
        new = stored(new.select(F.col("__id").alias("id"), F.lit(hop).alias("hops"), "parent"), "nodes")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        front = new.select("id")
    return seen


def token_blocks(nodes: DataFrame, name: Column, low: int = 2, high: int = 500, letters: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (id) that share a word of ``letters`` letters or more with a block of low to high nodes."""
    words = nodes.select("id", F.explode(F.array_distinct(F.filter(F.split(F.lower(name), r"[^a-z0-9]+"), lambda w: F.length(w) >= letters))).alias("w"))
    sizes = words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n").between(low, high)).select("w")
    used = words.join(sizes, "w")
    a, b = used.alias("a"), used.alias("b")
    return a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def duplicates(nodes: DataFrame, threshold: float = 0.88, limit: int | None = None) -> DataFrame:
    """Likely duplicates (a, b, similarity) among nodes (id, name), by Jaro-Winkler within token blocks, likest first.

    All pairs are computed before any limit, so the result does not depend on an order of scanning.
    """
    pairs = token_blocks(nodes, F.col("name"))
    key = nodes.select("id", T.person_key(F.col("name")).alias("k"))
    met = pairs.join(key.select(F.col("id").alias("a"), F.col("k").alias("x")), "a").join(key.select(F.col("id").alias("b"), F.col("k").alias("y")), "b")
    out = met.withColumn("similarity", T.jaro_winkler_of("x", "y")).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")
    return out if limit is None else out.orderBy(F.desc("similarity"), "a", "b").limit(limit)


def keep_of_pair(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds keep: of a and b the node with more edges, a on a tie."""
    d = degrees(edges)
    met = pairs.join(d.select(F.col("id").alias("a"), F.col("degree").alias("__x")), "a", "left").join(d.select(F.col("id").alias("b"), F.col("degree").alias("__y")), "b", "left")
    x, y = F.coalesce("__x", F.lit(0)), F.coalesce("__y", F.lit(0))
    return met.withColumn("keep", F.when(x >= y, F.col("a")).otherwise(F.col("b"))).drop("__x", "__y")


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of every node in pairs (a, b): the smallest node that it is linked with, over any number of pairs.

    A round hands every node the least root around it, then the root of its root, so the rounds grow with the logarithm of the
    longest chain; each is a stored table and two joins on a node.  Pairs with a null, and of a node with itself, say nothing.
    """
    links = pairs.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    ways = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = stored(ways.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id")), "roots")
    while True:
        around = ways.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("__least"))
        least = stored(now.join(around, "id").select("id", "root", F.least("root", "__least").alias("__new")), "least-roots")
        over = least.select(F.col("id").alias("__new"), F.col("__new").alias("__over"))
        new = stored(least.join(over, "__new").select("id", F.col("__over").alias("root"), (F.col("__over") != F.col("root")).alias("__moved")), "roots")
        moved = not new.filter("__moved").isEmpty()
        now = new.select("id", "root")
        if not moved:
            return now


def contracted(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name and others, aliases) and edges (src, dst, relationship, seq and others) after all duplicates (a, b) are merged.

    Of nodes that pairs link, however far apart, the one with most edges stays, the smallest id on a tie; it gets the other names as
    aliases.  Edges are led to it; those of a node with itself go, and of edges alike in ends and relationship the last one stays.
    """
    groups = components(pairs).join(degrees(edges), "id", "left").na.fill(0, ["degree"])
    keep = groups.groupBy("root").agg(F.min_by("id", F.struct(-F.col("degree"), "id")).alias("__keep"))
    to = stored(groups.join(keep, "root").select("id", "__keep"), "merged")
    names = to.join(nodes.select("id", "name"), "id").filter("id <> __keep").groupBy(F.col("__keep").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("aliases"))  # of one group of duplicates
    none = F.array().cast("array<string>")
    left = nodes.join(to.filter("id <> __keep").select("id"), "id", "left_anti").join(names, "id", "left").withColumn("aliases", F.coalesce("aliases", none))
    led = edges
    for end in ("src", "dst"):
        led = led.join(to.select(F.col("id").alias(end), F.col("__keep").alias(f"__{end}")), end, "left").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
    rest = [c for c in edges.columns if c not in ("src", "dst", "relationship", "seq")]
    keyed = led.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "relationship", "seq", F.struct("seq", *rest).alias("__v"))
    merged = keyed.groupBy("src", "dst", "relationship").agg(F.max_by("__v", "seq").alias("__v")).select("src", "dst", "relationship", "__v.*")
    return left, merged.select(*edges.columns)
