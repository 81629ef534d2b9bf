"""Near-duplicate documents by bottom-k sketches, inverted lists, union-sketch estimates and exact Jaccard.

1. A document is its set of 5-word shingles under one 64-bit hash; the k smallest hashes are its sketch.
   Documents with equal sets form a class, of which one goes on.
2. Inverted lists of the retained values.  Two sets with Jaccard similarity s share about s * k of the values of
   their union's sketch, so both sketches hold at least ``overlap`` common ones; hence they share one of the
   k - overlap + 1 values that are rarest in the corpus, and only those get postings.
3. Lists of up to LIST documents give their pairs; the union's sketch estimates the similarity of a pair and
   drops those far below the threshold.  From longer lists every document is tied to the list's first one, with
   no estimate, so that no pair of a large group is written out.
4. Pairs and ties are joined to clusters.  A small cluster's full sets are all compared exactly.  In a large one
   every set is first compared with that of the cluster's centre, the document with most of the cluster's commonest
   values: those similar to it are one group and need no comparison among themselves.  Only the rest is compared, with one
   another and with the group, in blocks of bounded size, if their sizes allow the threshold.
5. Components of these links, carried over to the classes and to all documents.

Overlap and estimate lie five standard deviations below the threshold: a pair just at it is missed with a probability of about 1e-5 in
step 2 and of the same order in step 3, and less above it.  Sets of up to k shingles are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, small_batches, space_words, stored, tidy
from .graph import components

WIDTH = 5
#: The least similarity in per cent by default, and that of op10's contract.
PER_CENT = 80
CONTRACT_PER_CENT = 85
SKETCH = 64
#: Longest list whose pairs are written out; documents and shingles of a chunk of a large cluster.
LIST = 50
CHUNK_DOCS = 256
CHUNK_SHINGLES = 200_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_WORDS: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    held, hashed = _WORDS, xxhash.xxh3_64_intdigest
    if len(held) > 50_000:  # saves time only
        held.clear()
    out = []
    for w in words:
        h = held.get(w)
        if h is None:
            h = held[w] = hashed(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The document's set: hashes of its distinct shingles, ascending, as signed 64-bit numbers.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; with fewer than ``width`` words the whole sequence is one
    shingle; without words the set is empty.
    """
    words = space_words(text, lower=True)
    if not words:
        return np.zeros(0, np.int64)
    own = _word_hashes(words)
    mix = _MIX if width == len(_MIX) else (np.arange(1, width + 1).astype(np.uint64) * _MIX[0]) | np.uint64(1)
    n = min(width, len(own))
    size = len(own) - n + 1
    total = np.full(size, n, np.uint64)
    for i in range(n):
        total += own[i : i + size] * mix[i]
    total ^= total >> np.uint64(30)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(27)
    total *= np.uint64(0x94D049BB133111EB)
    total ^= total >> np.uint64(31)
    values = np.sort(total.view(np.int64))
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def sketches(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """doc_id, n (size of the set), key (digest of the set, null if empty), sketch (its k smallest hashes), a row each row of docs."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n bigint, key binary, sketch array<bigint>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        tidy()
        return pd.DataFrame({"n": [len(s) for s in sets], "key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "sketch": [s[:k] for s in sets]})

    return docs.select(F.col("doc_id").cast("bigint"), sketch(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")


def candidates(classes: DataFrame, k: int, overlap: int, estimate: float, longest: int, per_cent: int) -> DataFrame:
    """Stored pairs and ties (a, b) among classes (doc_id, n, sketch) that may be similar: see steps 2 and 3."""
    values = classes.select("doc_id", F.explode("sketch").alias("v"))
    shared = stored(values.groupBy("v").agg(F.count("*").alias("f")).filter("f > 1"), "shared-values")
    found = values.join(broadcast_if_small(shared, 16), "v").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("shared"))
    # values in no other sketch come first in the order of rarity and need no list
    size = F.size("sketch")
    prefix = size - F.ceil(size * overlap / k) + 1
    room = F.greatest(F.lit(0), prefix - (size - F.size("shared"))).cast("int")
    postings = classes.join(found, "doc_id").select("doc_id", "n", F.explode(F.slice("shared", F.lit(1), room)).alias("s")).select("doc_id", "n", "s.v")
    postings = stored(postings, "postings")
    long = stored(postings.groupBy("v").agg(F.count("*").alias("m"), F.min("doc_id").alias("first")).filter(F.col("m") > longest).select("v", "first"), "long-lists")
    few = broadcast_if_small(long, 16)
    ties = postings.join(few, "v").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    # without the long lists no group has more than ``longest`` rows
    short = postings.join(few, "v", "left_anti").groupBy("v").agg(F.collect_list(F.struct("doc_id", "n")).alias("own")).filter(F.size("own") > 1)
    one = short.select("own", F.explode("own").alias("a"))
    pairs = one.select("a", F.explode(F.filter("own", lambda b: (b["doc_id"] > F.col("a.doc_id")) & (100 * F.least(b["n"], F.col("a.n")) >= per_cent * F.greatest(b["n"], F.col("a.n"))))).alias("b"))
    pairs = pairs.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()
    own = classes.select("doc_id", "sketch")
    met = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y")), "b")
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, k)
    near = met.withColumn("u", union).filter(F.size(F.array_intersect(F.array_intersect("x", "y"), F.col("u"))) >= estimate * F.size("u"))
    found = stored(near.select("a", "b").unionByName(ties), "candidates")
    discard(shared, postings, long)
    return found


def _links(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """Links that span the groups of a block's documents.  Only documents of different sides are compared, if there are two."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    keep = counts[at] > 1
    number = np.cumsum(counts > 1) - 1
    row, column = row[keep], number[at[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)  # counts below 2 ** 24 are exact
    step = 4096
    for low in range(0, int((counts > 1).sum()), step):
        a, b = np.searchsorted(column, (low, low + step))
        part = np.zeros((n, step), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += part @ part.T
    both = sizes[:, None] + sizes[None, :]
    linked = (100 * common >= per_cent * (both - common)) & (common > 0)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(linked, 1))):
        p, q = root(int(x)), root(int(y))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(ids[x]), int(ids[y])))
    return out


def stars(docs: DataFrame, members: DataFrame, per_cent: int, k: int = SKETCH) -> DataFrame:
    """Stored links (a, b) of members (node, component, sketch) to their component's centre b, by their exact sets.

    A centre has more of its component's k commonest sketch values than any other member; of equals it is the smallest node.
    Every member's set is computed where its text is and compared with one set, so the work is linear in the members.
    """
    common = members.select("component", F.explode("sketch").alias("v")).groupBy("component", "v").agg(F.count("*").alias("f"))
    nth = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("f"), "v"))
    core = stored(common.withColumn("__nth", nth).filter(F.col("__nth") <= k).groupBy("component").agg(F.collect_list("v").alias("core")), "cores")
    shared = F.size(F.array_intersect("sketch", "core"))
    scored = members.join(broadcast_if_small(core, 8 * k + 16), "component").select("component", "node", shared.alias("s"))
    centres = stored(scored.groupBy("component").agg(F.max_by("node", F.struct("s", -F.col("node"))).alias("centre")), "centres")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text"))
    own = texts.join(broadcast_if_small(members.select("node", "component"), 16), "node")

    @F.pandas_udf("array<bigint>")
    def sets(texts: pd.Series) -> pd.Series:
        tidy()
        return pd.Series([shingles(t) for t in texts])

    @F.pandas_udf("boolean")
    def similar(texts: pd.Series, centre: pd.Series) -> pd.Series:
        out = []
        for t, other in zip(texts, centre):
            mine = shingles(t)
            both = len(np.intersect1d(mine, other, assume_unique=True))
            out.append(100 * both >= per_cent * (len(mine) + len(other) - both))
        tidy()
        return pd.Series(out)

    one = texts.join(broadcast_if_small(centres, 16), texts["node"] == F.col("centre")).dropDuplicates(["centre"])
    one = stored(one.select("component", "centre", sets("text").alias("set")), "centre-sets")
    size = one.agg(F.max(F.size("set"))).first()[0] or 0
    met = own.join(broadcast_if_small(one, 8 * size + 32), "component").filter(F.col("node") != F.col("centre"))
    return stored(met.filter(similar("text", "set")).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "star-links")


def links(docs: DataFrame, clusters: DataFrame, per_cent: int = PER_CENT, chunk_docs: int = CHUNK_DOCS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """Links (a, b) that span the groups of similar documents in each of clusters (node, component, n, sketch).

    A cluster too large for one block is cut by size: documents whose sizes differ by more than the threshold
    allows are at least two steps of log(size) apart, so a chunk meets those of its own and of the next step.  Its
    documents that are linked with its centre (see stars) have chunks of their own, which meet only chunks of others.
    """
    spark = docs.sparkSession
    step = max(float(-np.log(per_cent / 100)), 1e-9)
    tiers = clusters.withColumn("tier", F.floor(F.log("n") / step))
    whole = tiers.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    small = (F.col("docs") <= chunk_docs) & (F.col("total") <= chunk_shingles)
    tiers = stored(tiers.join(whole.select("component", small.alias("small")), "component"), "tiers")
    alone = tiers.filter("small").select("node", F.array(F.struct(F.col("component").alias("c"), F.lit("").alias("block"), F.lit(False).alias("side"))).alias("blocks"))
    near = stars(docs, tiers.filter("NOT small"), per_cent)
    group = near.select(F.col("a").alias("__in")).unionByName(near.select(F.col("b").alias("__in"))).distinct()
    large = tiers.filter("NOT small").drop("sketch").join(group, F.col("node") == F.col("__in"), "left").withColumn("grouped", F.col("__in").isNotNull()).drop("__in")
    count = lambda which: F.when(F.count_if(which) > 0, F.greatest(F.ceil(F.count_if(which) / chunk_docs), F.ceil(F.sum(F.when(which, F.col("n"))) / chunk_shingles))).otherwise(0).cast("int")
    chunks = large.groupBy("component", "tier").agg(count(~F.col("grouped")).alias("rest"), count(F.col("grouped")).alias("group"))
    chunks = stored(chunks, "chunks")
    beside = lambda d, *names: chunks.select("component", (F.col("tier") - d).alias("tier"), *[F.col(c).alias(n) for c, n in zip(("rest", "group"), names)])
    keys = ["component", "tier"]
    met = large.join(chunks.join(beside(1, "rest_up", "group_up"), keys, "left").join(beside(-1, "rest_down", "group_down"), keys, "left"), keys)
    met = met.na.fill(0, ["rest_up", "group_up", "rest_down", "group_down"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("grouped"), F.col("group")).otherwise(F.col("rest"))).cast("int")
    none = F.array().cast("array<struct<c:bigint,block:string,side:boolean>>")
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda side, *parts: F.struct(F.col("component").alias("c"), F.concat_ws(".", *[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("block"), side.alias("side"))
    own_, tier = F.col("own"), F.col("tier")
    no, yes = F.lit(False), F.lit(True)
    # d is bound by a function: a second parameter of the lambda would be given the element's place
    to_group = lambda name, d: F.transform(each(F.col(name)), lambda i: block(no, "g", tier, own_, tier + d, i))
    to_rest = lambda name, d: F.transform(each(F.col(name)), lambda i: block(yes, "g", tier + d, i, tier, own_))
    rest = F.concat(
        F.transform(each(F.col("rest")), lambda i: block(i < own_, "s", tier, F.least(i, own_), F.greatest(i, own_))),
        F.transform(each(F.col("rest_up")), lambda i: block(no, "n", tier, own_, i)),
        F.transform(each(F.col("rest_down")), lambda i: block(yes, "n", tier - 1, i, own_)),
        *[to_group(name, d) for name, d in (("group", 0), ("group_up", 1), ("group_down", -1))],
    )
    grouped_ = F.concat(*[to_rest(name, d) for name, d in (("rest", 0), ("rest_up", 1), ("rest_down", -1))])
    many = met.withColumn("own", own).select("node", F.when(F.col("grouped"), grouped_).otherwise(rest).alias("blocks")).filter(F.size("blocks") > 0)
    blocks = stored(alone.unionByName(many.select("node", F.coalesce("blocks", none).alias("blocks"))), "blocks").withColumnRenamed("node", "__node")

    small_batches(spark)

    @F.pandas_udf("array<bigint>")
    def sets(texts: pd.Series) -> pd.Series:
        tidy()
        return pd.Series([shingles(t) for t in texts])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(broadcast_if_small(blocks, 64), texts["doc_id"] == blocks["__node"])
    rows = met.select("doc_id", "blocks", sets("text").alias("s")).select("doc_id", "s", F.explode("blocks").alias("b")).select("doc_id", "s", "b.c", "b.block", "b.side")

    def compare(block: pa.Table) -> pa.Table:
        if block.num_rows < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        order = np.argsort(block.column("doc_id").to_numpy(), kind="stable")
        values = [block.column("s")[int(i)].values.to_numpy() for i in order]
        found = _links(block.column("doc_id").to_numpy()[order], block.column("side").to_numpy()[order], values, per_cent)
        tidy()
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.groupBy("c", "block").applyInArrow(compare, "a bigint, b bigint").unionByName(near)


def grouped(docs: DataFrame, per_cent: int = PER_CENT, k: int = SKETCH, longest: int = LIST, chunk_docs: int = CHUNK_DOCS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """A row each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links of at least per_cent, itself included; kept says
    doc_id = component_id.  Texts without words are linked with nothing.  Rows that share a doc_id are one document.
    Rows without a doc_id take no part: component_id is null and they are kept.
    """
    if not 0 < per_cent <= 100:
        raise ValueError("per_cent must be in (0, 100]")
    share = per_cent / 100
    deviation = 5 * (share * (1 - share) / k) ** 0.5
    overlap = max(1, int(k * (share - deviation)))
    rows = stored(sketches(docs, k), "sketches")
    keyed = rows.filter("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = stored(keyed.groupBy("key").agg(F.min("doc_id").alias("least")), "classes")
    # ties between rows that share a doc_id, and from every class to its first document
    first = keyed.join(classes, "key")
    own = stored(first.filter(F.col("doc_id") == F.col("least")).select("doc_id", "n", "sketch", "key").dropDuplicates(["key"]).drop("key"), "class-sketches")
    maybe = candidates(own, k, overlap, share - deviation, longest, per_cent)
    clusters = components(maybe)
    sized = clusters.join(own.dropDuplicates(["doc_id"]), clusters["node"] == F.col("doc_id")).select("node", "component", "n", "sketch")
    exact = stored(links(docs, sized, per_cent, chunk_docs, chunk_shingles), "exact-links")
    twice = keyed.select("doc_id", "key").join(classes, "key").filter(F.col("doc_id") != F.col("least"))
    several = twice.groupBy("doc_id").agg(F.count_distinct("least").alias("d"), F.min("least").alias("b")).filter("d > 1").select("doc_id", "b")
    bridges = twice.join(several, "doc_id").select(F.col("least").alias("a"), "b")
    found = stored(components(exact.unionByName(bridges)), "components")
    member = classes.join(found, classes["least"] == found["node"], "left").select("key", F.coalesce("component", "least").alias("component_id"))
    joined = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(member, "key", "left")
    return joined.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """The rows of docs but for near-duplicates of a document with a smaller doc_id; all columns stay.

    Rows without a doc_id come after all others, by a hash of their text.  Of rows alike in doc_id and text one stays; rows that
    share a doc_id but not the text stay or go together.  Texts without words are linked with nothing and stay.
    """
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__near_id", F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(text).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)))
    gone = stored(grouped(keyed.select(F.col("__near_id").alias("doc_id"), "text"), per_cent).filter("NOT kept").select(F.col("doc_id").alias("__near_id")).distinct(), "near-duplicates")
    left = keyed.join(broadcast_if_small(gone, 16), "__near_id", "left_anti").withColumn("__near_hash", F.xxhash64(text))
    twice = left.filter(text.rlike(r"[^\x20\x09-\x0D]")).groupBy("__near_id", "__near_hash").agg(F.count("*").alias("__near_n")).filter("__near_n > 1").drop("__near_n")
    twice = stored(twice, "repeated-rows")
    if twice.isEmpty():
        return left.select(*docs.columns)
    keys = broadcast_if_small(twice, 16)
    own = left.join(keys, ["__near_id", "__near_hash"], "left_semi").dropDuplicates(["__near_id", "__near_hash"])
    return left.join(keys, ["__near_id", "__near_hash"], "left_anti").unionByName(own).select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return grouped(table(spark, sf_dir, "documents"), CONTRACT_PER_CENT)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
), m AS (
  SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
