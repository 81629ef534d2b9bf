"""Language-model scores by a probabilistic suffix tree, beside an add-half unigram model of words.

The tree predicts the next byte of the lower-cased text from the longest retained suffix of the bytes before it.
A context is kept if it occurs at least LEAST times in the training texts and its next-byte distribution diverges
from that of its own suffix by a likelihood-ratio test; with it stay its suffixes.  LEAST is a small absolute count, so
the tree grows with the corpus.  Distributions are smoothed towards the next shorter suffix (Witten-Bell), down to
add-half over 256 symbols.

Nothing of this is gathered: contexts, distributions and the test are joins over tables.  Documents come in blocks of
neighbouring rows of their files; a block's distinct words and positions (context and byte) look their counts and
probabilities up in a join and come back to the block's documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, small_batches, space_words, stored, tidy, unsigned_crc_fold

DEPTH = 5
#: Longest context for which a position fits into 64 bits.
MAX_DEPTH = 7
LEAST = 16
#: Threshold of 2 * n * KL, beyond which a context differs from its suffix.
DIVERGENCE = 50.0
BLOCK_CHARS = 32 << 20
#: Rows whose characters are added up together when blocks are cut.
CHUNK_ROWS = 256
#: Bytes that UTF-8 never uses: the end of a text and what stands before it.
END, START = 0xFE, 0xFF

_WORDS, _GRAMS = 0, 1


def word_keys(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words `[^\\x20\\x09-\\x0D]+`."""
    return np.array(list(map(xxhash.xxh3_64_intdigest, space_words(text, lower=True))), np.uint64).view(np.int64)


def positions(text: str | None, depth: int = DEPTH) -> np.ndarray:
    """For every byte of the lower-cased text and its end: the depth bytes before it and itself, packed."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    code = np.frombuffer(bytes([START]) * depth + raw + bytes([END]), np.uint8).astype(np.uint64)
    n = len(raw) + 1
    out = np.zeros(n, np.uint64)
    for i in range(depth + 1):
        out = (out << np.uint64(8)) | code[i : i + n]
    return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and where their runs start and end."""
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[at], np.append(at, len(values))


def located(docs: DataFrame, block_chars: int = BLOCK_CHARS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """docs with __block: neighbouring rows of a file with about block_chars characters together, cut by running length.

    A frame that is not a plain read of files is written to the shared folder first, for its rows to have places.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema
    except Exception as error:  # noqa: BLE001  Spark says only by its error class that there is no such column
        if "UNRESOLVED_COLUMN" not in str(error) and "_metadata" not in str(error):
            raise
        docs = stored(docs, "documents")
    placed = docs.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.floor(F.col("_metadata.row_index") / chunk_rows).alias("__chunk"))
    sizes = placed.groupBy("__file", "__chunk").agg(F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) + 1).alias("n"))
    running = F.sum("n").over(Window.partitionBy("__file").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    block = F.xxhash64("__file", F.floor(F.coalesce(running, F.lit(0)) / block_chars))
    cut = stored(sizes.select("__file", "__chunk", block.alias("__block")), "blocks")
    return placed.join(broadcast_if_small(cut, 24), ["__file", "__chunk"]).drop("__file", "__chunk")


def counted(docs: DataFrame, learn: Column, depth: int = DEPTH) -> DataFrame:
    """(kind, block, key, n): distinct words and packed positions of each block's part in a task, with their counts in training rows.

    ``learn`` tells the training rows.  What only other rows have comes with n = 0.  Key 0 of kind _GRAMS + 1 counts
    training documents.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, block, keys, n):
            size = len(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, kind, np.int8)), pa.array(np.full(size, block, np.int64)), pa.array(keys), pa.array(n.astype(np.int64))],
                ["kind", "block", "key", "n"],
            )

        def merged(held):
            values, weights = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(values, kind="stable")
            values, starts = _runs(values[order])
            return values, np.add.reduceat(weights[order], starts[:-1]) if len(values) else weights

        held = {_WORDS: [], _GRAMS: []}

        def add(kind, keys, learnt):
            """Keys of some texts: those learnt from count, the others are there with 0."""
            values, starts = _runs(np.sort(keys))
            held[kind].append((values, np.diff(starts) if learnt else np.zeros(len(values), np.int64)))
            if sum(len(h[0]) for h in held[kind]) > 1_000_000:
                held[kind] = [merged(held[kind])]

        def done(block):
            for kind, own in held.items():
                if own:
                    keys, n = merged(own)
                    for low in range(0, len(keys), 100_000):
                        yield out(kind, block, keys[low : low + 100_000], n[low : low + 100_000])
                held[kind] = []
            tidy()

        block, seen = None, 0
        for batch in batches:
            texts, learns, blocks = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(texts):
                stop = at
                while stop < len(texts) and blocks[stop] == blocks[at]:
                    stop += 1
                if blocks[at] != block:
                    if block is not None:
                        yield from done(block)
                    block = blocks[at]
                for learnt in (True, False):
                    own = [t for t, x in zip(texts[at:stop], learns[at:stop]) if x == learnt]
                    if own:
                        seen += len(own) * learnt
                        add(_WORDS, np.concatenate([word_keys(t) for t in own]), learnt)
                        add(_GRAMS, np.concatenate([positions(t, depth) for t in own]).view(np.int64), learnt)
                at = stop
        if block is not None:
            yield from done(block)
        yield out(_GRAMS + 1, 0, np.zeros(1, np.int64), np.array([seen]))

    return docs.select(F.col("text").cast("string"), learn.alias("__learn"), "__block").mapInArrow(count, "kind tinyint, block bigint, key bigint, n bigint")


def _context(key: str, d) -> Column:
    """The last d bytes before a packed position's own byte.  d: a number or a column of numbers up to MAX_DEPTH."""
    bits = F.col(d) * 8 if isinstance(d, str) else F.lit(8 * d)
    return F.shiftrightunsigned(key, 8).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int")) - 1)


def _suffix(k: str = "k", context: str = "context") -> Column:
    """The context without its first byte."""
    return F.col(context).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (8 * (F.col(k) - 1)).cast("int")) - 1)


def grow(grams: DataFrame, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE) -> tuple[DataFrame, DataFrame, float, list[DataFrame]]:
    """The tree of packed positions (key, n): kept states (k, context, step), their entries (k, context, symbol, p), p of a byte never seen, and all stored tables.

    k is a context's length; p an entry's smoothed probability; step the factor with which a state passes what it has
    not seen on to its suffix (1 at the root).  Tables all; n = 0 counts nothing.
    """
    levels = F.array(*[F.struct(F.lit(d).alias("k"), _context("key", d).alias("context")) for d in range(depth + 1)])
    rows = grams.filter("n > 0").select(F.explode(levels).alias("c"), F.col("key").bitwiseAND(255).alias("symbol"), "n")
    rows = stored(rows.groupBy("c.k", "c.context", "symbol").agg(F.sum("n").alias("n")), "contexts")
    often = rows.groupBy("k", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter((F.col("k") == 0) | (F.col("total") >= least))
    entries = stored(rows.join(often, ["k", "context"]), "entries")
    total = entries.filter("k = 0").agg(F.max("total")).first()[0] or 0
    unseen = 0.5 / (total + 128.0)
    at = lambda d: entries.filter(F.col("k") == d)
    levels = [stored(at(0).select("k", "context", "symbol", ((F.col("n") + 0.5) / (total + 128.0)).alias("p")), "level")]
    done, kept = [levels[0]], [None]
    for d in range(1, depth + 1):
        above = done[-1].select(F.col("context").alias("__c"), F.col("symbol").alias("__s"), F.col("p").alias("__p"))
        met = at(d).withColumn("__u", _suffix()).join(above, (F.col("__u") == F.col("__c")) & (F.col("symbol") == F.col("__s")))
        whole = F.col("total") + F.col("kinds")
        own = met.select("k", "context", "symbol", (F.col("n") / whole + F.col("kinds") / whole * F.col("__p")).alias("p"), (2 * F.col("n") * F.log(F.col("n") / F.col("total") / F.col("__p"))).alias("g"))
        own = stored(own, "level")
        levels.append(own)
        kept.append(own.groupBy("context").agg(F.sum("g").alias("g")).filter(F.col("g") > divergence).select("context"))
        done.append(own.drop("g"))
    states = [None] * (depth + 1)
    for d in range(depth, 0, -1):  # suffixes of kept contexts stay
        below = states[d + 1].select(_suffix().alias("context")) if d < depth else None
        own = kept[d] if below is None else kept[d].unionByName(below).distinct()
        states[d] = stored(own.select(F.lit(d).alias("k"), "context"), "kept")
    root = grams.sparkSession.createDataFrame([(0, 0)], "k int, context bigint")
    keep = root
    for own in states[1:]:
        keep = keep.unionByName(own)
    step = F.when(F.col("k") == 0, 1.0).otherwise(F.col("kinds") / (F.col("total") + F.col("kinds")))
    found = stored(keep.join(often, ["k", "context"], "left").select("k", "context", F.coalesce(step, F.lit(1.0)).alias("step")), "states")
    table = done[0]
    for own in done[1:]:
        table = table.unionByName(own)
    discard(rows, entries, *states[1:])
    return found, table, unseen, [found, *levels]


def probabilities(grams: DataFrame, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE) -> tuple[DataFrame, list[DataFrame]]:
    """(key, value): log10 probability of every position's byte, from the longest kept suffix of the bytes before it; and the tables it is read from."""
    states, entries, unseen, made = grow(grams, depth, least, divergence)
    each = grams.select("key", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("k"))
    each = each.select("key", "k", _context("key", "k").alias("context"), F.col("key").bitwiseAND(255).alias("symbol"))
    known = each.join(broadcast_if_small(states, 24), ["k", "context"]).join(entries, ["k", "context", "symbol"], "left")
    # of the kept suffixes, the longest that has seen the byte gives p; the longer ones pass it on by their steps
    lists = known.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "step", "p")), asc=False).alias("own"))
    found = F.aggregate(
        "own",
        F.struct(F.lit(1.0).alias("steps"), F.lit(None).cast("double").alias("p")),
        lambda a, x: F.struct(F.when(a["p"].isNull() & x["p"].isNull(), a["steps"] * x["step"]).otherwise(a["steps"]).alias("steps"), F.coalesce(a["p"], x["p"]).alias("p")),
    )
    return lists.select("key", found.alias("f")).select("key", F.log10(F.col("f.steps") * F.coalesce("f.p", F.lit(unseen))).alias("value")), made


def scored(docs: DataFrame, learn: Column, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, block_chars: int = BLOCK_CHARS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A row each row of docs (doc_id, text): doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` is a condition on docs that tells the training rows.  Tokens are the lower-cased words and one end.
    Null and empty texts are their end alone.  Without training rows every token is unknown and every byte has the
    same probability.  Repeated rows count as often as they occur; other columns, whatever their names, are ignored.
    depth is 1 to MAX_DEPTH.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 1 to {MAX_DEPTH}")
    spark = docs.sparkSession
    small_batches(spark)
    # only what is needed goes on: other columns may have clashing names
    docs = located(docs, block_chars, chunk_rows).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), "__block")
    counts = stored(counted(docs, F.col("learn"), depth), "counts")
    ends = counts.filter(F.col("kind") == _GRAMS + 1).agg(F.sum("n")).first()[0] or 0
    sums = stored(counts.filter(F.col("kind") <= _GRAMS).groupBy("kind", "key").agg(F.sum("n").alias("n")), "sums")
    words = sums.filter(F.col("kind") == _WORDS)
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    logs, made = probabilities(sums.filter(F.col("kind") == _GRAMS).select("key", "n"), depth, least, divergence)
    values = words.select("kind", "key", F.col("n").cast("double").alias("value")).unionByName(logs.select(F.lit(_GRAMS).cast("tinyint").alias("kind"), "key", "value"))
    values = stored(values, "values")
    discard(*made, sums)
    looked = counts.filter(F.col("kind") <= _GRAMS).select("kind", "block", "key").join(values, ["kind", "key"])

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        kind, keys, value = (own.column(c).to_numpy() for c in ("kind", "key", "value"))
        of = {}
        for k in (_WORDS, _GRAMS):
            mine, at = np.unique(keys[kind == k], return_index=True)  # a block that several tasks counted has keys twice
            of[k] = mine, value[kind == k][at]
        (word, c), (gram, log) = of[_WORDS], of[_GRAMS]
        word_log, n = np.log10(c + 0.5), texts.num_rows
        column = texts.column("text")
        n_tokens, n_known = np.ones(n, np.int64), np.full(n, int(ends > 0))
        base, total = np.full(n, np.log10(ends + 0.5)), np.zeros(n)
        for low in range(0, n, 256):
            held = column.slice(low, 256).to_pylist()
            for part, kind_of, keys_of in ((held, _WORDS, word_keys), (held, _GRAMS, lambda t: positions(t, depth).view(np.int64))):
                each = [keys_of(t) for t in part]
                doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
                all_ = np.concatenate(each) if each else np.zeros(0, np.int64)
                order = np.argsort(all_)  # in order the lookups stay near each other
                found, doc = np.searchsorted(of[kind_of][0], all_[order]), doc[order]
                size, stop = len(each), low + len(each)
                if kind_of == _WORDS:
                    n_tokens[low:stop] += np.bincount(doc, minlength=size)
                    n_known[low:stop] += np.bincount(doc[c[found] > 0], minlength=size)
                    base[low:stop] += np.bincount(doc, word_log[found], size)
                else:
                    total[low:stop] = np.bincount(doc, log[found], size)
        tidy()
        return pa.table({"doc_id": texts.column("doc_id"), "learnt": texts.column("learn"), "n_tokens": n_tokens, "n_known": n_known, "logs": base, "score": total})

    schema = "doc_id bigint, learnt boolean, n_tokens bigint, n_known bigint, logs double, score double"
    found = docs.groupBy("__block").cogroup(looked.groupBy("block")).applyInArrow(lambda a, b: score(a, b), schema)
    share = float(np.log10(tokens + 0.5 * (kinds + 1)))
    return found.select(
        "doc_id", "learnt", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * share).alias("base_score"), "score",
    )


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = scored(table(spark, sf_dir, "documents"), unsigned_crc_fold() != 1)
    return out.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
