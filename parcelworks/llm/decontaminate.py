"""Benchmark decontamination over a stored positional inverted index.

The documents are indexed once, in shards of some hundred KB of text.  A shard is a row of the stored table: its
documents, its terms, and for every term the sorted positions at which it stands, as packed 32-bit numbers.
Positions run through the shard's documents with a gap between them that is wider than a window with its slack, so
neither a phrase nor a near match reaches over two documents.  Shards follow the input's partitions: building and
searching shuffle nothing, and neither a frequent term nor a hot source makes one task larger.

A search sends the benchmark's windows to the shards, in blocks of bounded size.  In each shard all windows whose
terms are there start from the lists of their rarest terms, shifted by the terms' offsets, and are intersected with the
shifted lists of their other terms, rarer ones first; for near matches the shifted lists may differ by the slack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_GROUP, alnum_words, broadcast_if_small, discard, shared_dir, small_batches, stored, tidy

WINDOW = 13
NEAR_SLACK = 3
SHARD_CHARS = 512 << 10
#: Characters of benchmark text searched in one pass over the index; a task holds about three times as many bytes.
BLOCK_CHARS = 8 << 20
#: Positions left free between the documents of a shard; a window plus twice the slack must be shorter.
GAP = 64
#: Places looked at together in a shard.
SLAB = 1 << 19

SHARDS = "shard string, doc_ids array<bigint>, starts array<int>, n_words array<int>, terms binary, ends binary, positions binary"
HITS = "shard string, at int, doc_id bigint, n_words bigint, starts array<int>, stops array<int>, items array<string>, near_items array<string>"


def _lists(values: np.ndarray | pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _shard(name: str, ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(counts[:-1] + GAP, out=starts[1:])
    terms: dict[bytes, int] = {}
    codes = np.fromiter((terms.setdefault(w, len(terms)) for words in texts for w in words), np.int64, int(counts.sum()))
    places = np.arange(len(codes)) + GAP * np.repeat(np.arange(len(texts)), counts)
    both = np.sort((codes << 32) | places)
    ends = np.cumsum(np.bincount(codes, minlength=len(terms)))
    whole = lambda x: _lists(x, np.array([0, len(x)], np.int32))
    blob = lambda x: pa.array([x], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name]), whole(pa.array(ids, pa.int64())), whole(starts.astype(np.int32)), whole(counts.astype(np.int32)),
            blob(b" ".join(terms)), blob(ends.astype("<i4").tobytes()), blob((both & 0xFFFFFFFF).astype("<i4").tobytes()),
        ],
        [c.split()[0] for c in SHARDS.split(", ")],
    )


def build_index(docs: DataFrame, path: str | None = None, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Store the positional index of docs (doc_id, text; other columns, whatever their names, are ignored) and return it.

    One row a shard of about shard_chars characters; a longer document has a shard of its own, as positions
    are 32 bits wide a document may have 2**31 words.  Null and empty texts are documents without words.
    Repeated rows are indexed as often as they occur; an empty table gives an empty index.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_dir(spark, "positional-index")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(alnum_words(text))
                size += len(text or "")
                if size >= shard_chars:
                    yield _shard(f"{part}-{made}", ids, texts)
                    made, ids, texts, size = made + 1, [], [], 0
                    tidy()
        if ids:
            yield _shard(f"{part}-{made}", ids, texts)
        del ids, texts
        tidy()

    made = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(shards, SHARDS)
    # rows are long, so the size of a row group is looked at after a few of them
    made.write.option("parquet.block.size", ROW_GROUP // 4).option("parquet.page.size.row.check.min", 4).parquet(path)
    return spark.read.schema(SHARDS).parquet(path)


class Windows:
    """A block of items as numbers of the block's terms, one after the other, with the places where windows start."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        terms: dict[bytes, int] = {}
        codes = [np.fromiter((terms.setdefault(w, len(terms)) for w in words), np.int32, len(words)) for _, words in items]
        self.codes = np.concatenate([*codes, np.zeros(0, np.int32)])
        self.terms = pa.array(list(terms), pa.binary())
        self.items = [item for item, _ in items]
        sizes = np.array([len(c) for c in codes], np.int64)
        first = np.cumsum(sizes) - sizes
        #: length of window -> (start in codes, item)
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(sizes, window)).tolist():
            own = np.flatnonzero(np.minimum(sizes, window) == n)
            many = sizes[own] - n + 1
            item = np.repeat(own, many)
            at = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + first[item]
            self.groups[n] = at.astype(np.int32), item.astype(np.int32)


def blocks(items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Iterator[Windows]:
    """The items (item_id, text) as blocks of about block_chars characters; the driver holds one at a time."""
    held, size = [], 0
    for item_id, text in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = alnum_words(text)
        if words and item_id is not None:
            held.append((item_id, words))
            size += len(text)
        if size >= block_chars:
            yield Windows(held, window)
            held, size = [], 0
    if held:
        yield Windows(held, window)


def _slabs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring windows with about SLAB places together."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB, side="right")))
        yield at, stop
        at = stop


def _search(terms: pa.Array, ends: np.ndarray, both: np.ndarray, windows: Windows, slack: int):
    """Exact and near places of the windows in a shard: (starts, length, items, exact).

    both: the postings of all terms, as (term's row << 32 | position) in ascending order, so that one binary search
    finds whether a term's list has a position, or one within the slack.
    """
    row = pc.index_in(windows.terms, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate(([0], ends[:-1])).astype(np.int64)
    count = np.where(row >= 0, (ends - first)[row] if len(ends) else 0, 0)
    absent = np.concatenate(([0], np.cumsum(count[windows.codes] == 0)))
    for n, (at, item) in windows.groups.items():
        there = np.flatnonzero(absent[at + n] == absent[at])
        if not len(there):
            continue
        rows = row[windows.codes[at[there][:, None] + np.arange(n)]]
        order = np.argsort((ends - first)[rows], axis=1, kind="stable")
        sizes = (ends - first)[rows[np.arange(len(rows)), order[:, 0]]]
        for low, high in _slabs(sizes * (2 * slack + 1)):
            w = np.repeat(np.arange(low, high), sizes[low:high])
            rarest = rows[w, order[w, 0]]
            nth = np.arange(len(w)) - np.repeat(np.cumsum(sizes[low:high]) - sizes[low:high], sizes[low:high])
            start = (both[first[rarest] + nth] & 0xFFFFFFFF) - order[w, 0]
            own, places = w, start
            for k in range(1, n):
                j = order[own, k]
                own, places = _kept(both, rows[own, j], places + j, 0, own, places)
                if not len(own):
                    break
            if len(own):
                yield places, n, item[there[own]], True
            if slack:
                near = np.unique(((w << 34)[:, None] | ((start + 64)[:, None] + np.arange(-slack, slack + 1))).ravel())
                own, places = near >> 34, (near & ((1 << 34) - 1)) - 64
                for k in range(1, n):
                    j = order[own, k]
                    own, places = _kept(both, rows[own, j], places + j, slack, own, places)
                    if not len(own):
                        break
                else:
                    yield places, n, item[there[own]], False


def _kept(both: np.ndarray, term: np.ndarray, at: np.ndarray, slack: int, own: np.ndarray, places: np.ndarray):
    """Those of own and places for which the term's list has a position within slack of at."""
    found = np.searchsorted(both, (term << 32) | np.maximum(at - slack, 0))
    ok = (found < len(both)) & (both[np.minimum(found, len(both) - 1)] <= (term << 32) + (at + slack))
    return own[ok], places[ok]


def _hits(batches: Iterator[pa.RecordBatch], windows: Windows, slack: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            shard = {name: batch.column(j)[k] for j, name in enumerate(batch.schema.names)}
            starts = shard["starts"].values.to_numpy().astype(np.int64)
            n_words = shard["n_words"].values.to_numpy().astype(np.int64)
            if not len(starts):
                continue
            total = int(starts[-1] + n_words[-1]) + 1
            edges, exact_items, near_items = np.zeros(total + 1, np.int64), {}, {}
            ends = np.frombuffer(shard["ends"].as_py(), "<i4").astype(np.int64)
            positions = np.frombuffer(shard["positions"].as_py(), "<i4").astype(np.int64)
            both = (np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) << 32) | positions
            terms = pa.array(shard["terms"].as_py().split(), pa.binary())
            for places, n, items, exact in _search(terms, ends, both, windows, slack):
                if exact:
                    np.add.at(edges, places, 1)
                    np.add.at(edges, places + n, -1)
                own = exact_items if exact else near_items
                # a near match may start up to slack before its document's first word
                docs = np.searchsorted(starts - GAP // 2, places, side="right") - 1
                for pair in np.unique((docs << 32) | items).tolist():
                    own.setdefault(pair >> 32, set()).add(windows.items[pair & 0xFFFFFFFF])
            hit = np.diff(np.concatenate(([0], (np.cumsum(edges) > 0).astype(np.int8), [0])))
            run_starts, run_stops = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
            at = np.searchsorted(starts, run_starts, side="right") - 1
            stops = np.zeros(len(starts) + 1, np.int32)
            np.cumsum(np.bincount(at, minlength=len(starts)), out=stops[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard["shard"].as_py()] * len(starts)),
                    pa.array(np.arange(len(starts), dtype=np.int32)),
                    shard["doc_ids"].values,
                    pa.array(n_words),
                    _lists((run_starts - starts[at]).astype(np.int32), stops),
                    _lists((run_stops - starts[at]).astype(np.int32), stops),
                    pa.array([sorted(exact_items.get(d, ())) for d in range(len(starts))], pa.list_(pa.string())),
                    pa.array([sorted(near_items.get(d, ())) for d in range(len(starts))], pa.list_(pa.string())),
                ],
                ["shard", "at", "doc_id", "n_words", "starts", "stops", "items", "near_items"],
            )
            tidy()


def find(index: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = NEAR_SLACK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Search the index for the windows of items; one row an indexed document.

    Columns: shard, at (the document's place in its shard), doc_id, n_words, starts and stops (word spans that exact
    windows cover, disjoint and ascending), items (ids with an exact window), near_items (ids with a window
    whose every word stands in the document at most ``slack`` words off its place, counted from a common start; exact ones are among them).
    An item of fewer than ``window`` words is one window; items without words or id are never found, repeated items count once.
    With several blocks of items each takes a pass over the index, and the rows of a document are merged by a shuffle on (shard, at).
    """
    if window + 2 * slack >= GAP:
        raise ValueError(f"window + 2 * slack must be below {GAP}")
    spark = index.sparkSession
    small_batches(spark)
    found = None
    for n, block in enumerate(blocks(items, window, block_chars)):
        held = spark.sparkContext.broadcast(block)
        hits = index.mapInArrow(lambda batches, held=held: _hits(batches, held.value, slack), HITS)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = index.mapInArrow(lambda batches: _hits(batches, Windows([], window), 0), HITS)
    elif n:
        found = found.groupBy("shard", "at").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("starts")).alias("starts"),
            F.flatten(F.collect_list("stops")).alias("stops"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"),
        )
    return found


def covered():
    """Words covered by the spans (starts, stops), which may overlap after a merge."""
    spans = F.array_sort(F.arrays_zip("starts", "stops"))
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["stops"] - F.greatest(s["starts"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], s["stops"]).alias("upto"),
        ),
    )
    return done["n"].cast("bigint")


def decontaminate(index: DataFrame, items: DataFrame, per_cent: int = 5, window: int = WINDOW, slack: int = NEAR_SLACK) -> DataFrame:
    """Per indexed document: doc_id, n_words, n_hit, items, near_items, contaminated (n_hit > 0 and at least per_cent of the words)."""
    return find(index, items, window, slack).select(
        "doc_id", "n_words", covered().alias("n_hit"), "items", "near_items"
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= per_cent * F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated; all columns stay.

    Contamination is a matter of the text alone, so rows are told by a 64-bit hash of it: rows without a doc_id and rows that
    share one are judged each by its own text.
    """
    own = F.xxhash64(F.col("text").cast("string"))
    index = build_index(docs.select(own.alias("doc_id"), "text"))
    bad = stored(decontaminate(index, items).filter("contaminated").select(F.col("doc_id").alias("__contaminated")).distinct(), "contaminated")
    discard(index)
    bad = broadcast_if_small(bad, 16)
    return docs.join(bad, own == bad["__contaminated"], "left_anti")


def digest(items):
    """SHA-256 in lower-case hex of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256)


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and of near items (exact ones are among them) n_near, near_sha256."""
    from .common import table

    index = build_index(table(spark, sf_dir, "documents"))
    return decontaminate(index, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        digest(F.col("items")).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("bigint").alias("n_near"),
        digest(F.col("near_items")).alias("near_sha256"),
    )


def reference_hits(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, str, bool]:
    """What op1 returns for a text, by plain search; for tests."""
    words, hit, found = alnum_words(text), set(), set()
    for item, other in items:
        own = alnum_words(other)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            part = own[i : i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(item)
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), g AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), p AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)
), m AS (
  SELECT p.r, p.s, p.n, g.item FROM p JOIN g ON p.n = g.n AND p.gram = g.gram
), h AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM m) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r
), dw AS (
  SELECT r, s, w[s] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d)
), gw AS (
  SELECT item, n, gram, k, string_split(gram, ' ')[k + 1] AS word FROM (SELECT item, n, gram, unnest(range(0, n)) AS k FROM g)
), f AS (
  SELECT word, count(*) AS f FROM dw GROUP BY word
), rare AS (
  SELECT item, n, gram, arg_min(k, f * 100 + k) AS k, arg_min(word, f * 100 + k) AS word
  FROM (SELECT *, coalesce(f, 0) AS f0 FROM gw LEFT JOIN f USING (word)) GROUP BY item, n, gram HAVING min(f0) > 0
), c AS (
  SELECT DISTINCT r, item, gram, n, s - k + e AS a FROM rare JOIN dw USING (word), (SELECT unnest(range(-3, 4)) AS e)
), ck AS (
  SELECT r, item, gram, n, a, k, string_split(gram, ' ')[k + 1] AS word FROM (SELECT *, unnest(range(0, n)) AS k FROM c)
), nm AS (
  SELECT r, item FROM (
    SELECT ck.r, item, gram, n, a, count(DISTINCT k) AS ok FROM ck JOIN dw ON dw.r = ck.r AND dw.word = ck.word AND dw.s BETWEEN a + k - 3 AND a + k + 3
    GROUP BY ck.r, item, gram, n, a
  ) WHERE ok = n GROUP BY r, item
), nt AS (
  SELECT r, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near FROM nm GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN nt USING (r)
"""
