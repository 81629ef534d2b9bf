"""Hard negatives by exact inner products, with most pairs left out by bounds in rotated coordinates.

Vectors become integers.  Their second moments, summed over all rows, give an orthogonal rotation (principal components)
that gathers as much of every vector as can be in its leading coordinates.  A pair's partial product over these, plus or
minus the product of what is left of both norms and a slack for rounding, bounds its whole product.  A pair whose bound
can't reach what it must is left out; what survives all coordinates is verified by integer products, which alone are returned.

Rows and anchors are packed into blocks of a bounded number of vectors.  Every block of rows meets every block of anchors
(a stated query set against all rows), dealt by the numbers of the blocks; a task keeps its best rows for the anchors of
the last few blocks, which raises the bounds as it goes, and hands on no more than these.  So a vector that a third of all
rows share, or a label that most rows carry, makes no task larger and no more rows to hand on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, small_batches, stored, tidy

POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256.0

#: Vectors of a block of rows, of a block of anchors, and anchors looked at together.
ROW_BLOCK, ANCHOR_BLOCK, SLICE = 4096, 1024, 64
#: Blocks of anchors whose best rows a task holds at once.
HELD = 64
#: Blocks of rows that a cell of the dealt-out grid gets if anchors are too many to be broadcast.
CELL = 64
#: Tasks for each of the cluster's cores, at most.
TASKS = 4
#: Components are held within this, so that a hundred times a product of 512 components fits a long.
LARGEST = float(1 << 23)
#: Shares of the coordinates after which bounds are tried.
STAGES = (0.25, 0.5, 0.75, 1.0)

BLOCK = "block bigint, ids binary, labels binary, vectors binary, dims int"


def prepared(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, v array<int>): the rows that take part, their components floor(scale * x)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    first = own.select("vec_id", "label", v.alias("v")).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m"))
    return first.select("vec_id", "m.label", "m.v")


def packed(rows: DataFrame, size: int, *more: tuple[str, str]) -> DataFrame:
    """rows (vec_id, label, v) as blocks of at most size vectors; more: further columns (name, kind) of lists of numbers."""
    fields = BLOCK + "".join(f", {name} binary" for name, _ in more)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            vectors = table.column("v").to_pylist()
            dims = max(map(len, vectors))
            grid = np.zeros((len(vectors), dims), np.int32)
            for row, v in zip(grid, vectors):
                row[: len(v)] = v
            ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
            extra = [np.array(table.column(name).to_pylist(), np.int64).tobytes() for name, _ in more]
            values = [int(ids.min()), ids.tobytes(), labels.tobytes(), grid.tobytes(), dims, *extra]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * len(more)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], ["block", "ids", "labels", "vectors", "dims", *[m[0] for m in more]])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                rest = table.slice(size)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.select("vec_id", "label", "v", *[F.col(name).cast(kind) for name, kind in more]).mapInArrow(pack, fields)


def opened(ids: bytes, labels: bytes, vectors: bytes, dims: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, labels and integer vectors, these filled up with zeros to the table's width."""
    out = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
    grid = np.zeros((len(out[0]), width), np.int64)
    grid[:, :dims] = np.frombuffer(vectors, np.int32).reshape(len(out[0]), dims)
    return *out, grid


def rotation(blocks: DataFrame) -> tuple[int, np.ndarray]:
    """(width, orthogonal matrix): eigenvectors of the second moments of all rows, by falling eigenvalue, as columns.

    A task sends one row a matrix cell; the matrix is as large as the square of the vectors' width, whatever the rows.
    """
    width = blocks.agg(F.max("dims")).first()[0] or 0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for b in batch.to_pylist():
                x = opened(b["ids"], b["labels"], b["vectors"], b["dims"], width)[2].astype(float)
                total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

    sums = blocks.mapInArrow(moments, "i bigint, j bigint, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    matrix = np.zeros((width, width))
    for i, j, x in sums:
        matrix[i, j] = matrix[j, i] = x
    values, vectors = np.linalg.eigh(matrix)
    return width, np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")])


def met(row_blocks: DataFrame, anchor_blocks: DataFrame) -> DataFrame:
    """Every block of rows beside every block of anchors (columns a_...): an equi-join on the anchor block's number.

    Anchors are broadcast if their counted bytes are few; else both are dealt to a grid's cells, each with CELL blocks of rows.
    """
    spark = row_blocks.sparkSession
    n, size = anchor_blocks.agg(F.count("*"), F.sum(F.expr("length(vectors)"))).first()
    numbered = anchor_blocks.select([F.col(c).alias(f"a_{c}") for c in anchor_blocks.columns])
    ids = [r[0] for r in anchor_blocks.select("block").orderBy("block").collect()]  # one number for 1,024 anchors
    numbers = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "a_block bigint, to bigint")
    numbered = numbered.join(F.broadcast(numbers), "a_block")
    spread = row_blocks.withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    if (size or 0) <= BROADCAST_BYTES:
        return spread.join(F.broadcast(numbered), "to")
    cells = max(1, row_blocks.count() // CELL)
    numbered = numbered.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return spread.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")).join(numbered, ["to", "cell"])


class Side:
    """A block's vectors, rotated, with the norms of what is left after each stage."""

    def __init__(self, ids, labels, grid, turn):
        self.ids, self.labels, self.grid = ids, labels, grid
        self.turned = grid.astype(float) @ turn
        width = grid.shape[1]
        self.cuts = sorted({max(1, round(width * s)) for s in STAGES}) if width else []
        squares = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1] if width else np.zeros((len(ids), 0))
        self.rest = [np.sqrt(squares[:, c]) if c < width else np.zeros(len(ids)) for c in self.cuts]
        self.norm = np.sqrt((grid.astype(float) ** 2).sum(axis=1))


def bounded(anchors: Side, rows: Side, part: np.ndarray, wanted, seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, row place, integer product) of all pairs that the bounds leave.

    part: places of the anchors to look at.  wanted(low, high, anchor places) says by bounds which pairs may matter, as a mask of the
    pairs; seeds(estimates) gives, by the last partial products, pairs to verify first so that wanted() gets stricter.
    """
    partial = np.zeros((len(part), len(rows.ids)))
    # rounding of the rotation and of the sums: far above width * 2 ** -53 of the norms' product, far below 1 for unit vectors
    slack = 1e-9 * anchors.norm[part][:, None] * rows.norm[None, :] + 1e-6
    alive, done = None, 0
    for k, cut in enumerate(anchors.cuts):
        partial += anchors.turned[part, done:cut] @ rows.turned[:, done:cut].T
        done = cut
        left = anchors.rest[k][part][:, None] * rows.rest[k][None, :] + slack
        if k == 0 or cut == anchors.cuts[-1]:
            seeds(partial)
        alive = wanted(partial - left, partial + left)
        if not alive.any():
            break
        if alive.mean() < 0.05 and cut < anchors.cuts[-1]:
            a, r = np.nonzero(alive)  # few enough to go on pair by pair
            rest = np.einsum("ij,ij->i", anchors.turned[part[a], cut:], rows.turned[r, cut:])
            whole = np.full(partial.shape, -np.inf)
            whole[a, r] = partial[a, r] + rest
            alive &= wanted(whole - slack, np.where(alive, whole + slack, -np.inf))
            break
    if alive is None:  # no coordinates: all products are 0
        alive = wanted(partial, partial)
    a, r = np.nonzero(alive)
    return part[a], r, products(anchors, rows, part[a], r)


def products(anchors: Side, rows: Side, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs, some at a time."""
    out = np.empty(len(a), np.int64)
    for s in range(0, len(a), 1 << 16):
        out[s : s + (1 << 16)] = np.einsum("ij,ij->i", anchors.grid[a[s : s + (1 << 16)]], rows.grid[r[s : s + (1 << 16)]])
    return out


class Best:
    """For each of some lists the first `size` of (score, id): higher scores come first, ties by smaller id."""

    def __init__(self, lists: int, size: int):
        self.scores = np.full((lists, size), np.iinfo(np.int64).min)
        self.ids = np.full((lists, size), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in candidates of list `at`; one that is there already counts once."""
        size = self.scores.shape[1]
        last = self.scores[at, -1]
        better = (scores > last) | ((scores == last) & (ids < self.ids[at, -1]))
        at, scores, ids = at[better], scores[better], ids[better]
        if not len(at):
            return
        lists = np.unique(at)
        at = np.concatenate([at, np.repeat(lists, size)])
        scores = np.concatenate([scores, self.scores[lists].ravel()])
        ids = np.concatenate([ids, self.ids[lists].ravel()])
        order = np.lexsort((ids, ~scores, at))  # ~ turns the order round and can't overflow
        at, scores, ids = at[order], scores[order], ids[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] == np.iinfo(np.int64).max)
        at, scores, ids = at[fresh], scores[fresh], ids[fresh]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        place = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        keep = place < size
        self.scores[at[keep], place[keep]], self.ids[at[keep], place[keep]] = scores[keep], ids[keep]


def _top(estimates: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's n largest numbers, -inf left out."""
    n = min(n, estimates.shape[1])
    if not n:
        return np.empty(0, int), np.empty(0, int)
    r = np.argpartition(-estimates, n - 1, axis=1)[:, :n]
    a = np.repeat(np.arange(len(estimates)), n)
    r = r.ravel()
    real = estimates[a, r] > -np.inf
    return a[real], r[real]


def best_positives(anchors: Side, rows: Side, best: Best) -> int:
    """Takes the block's rows into each anchor's first rows of its own label; how many pairs were verified."""
    verified = 0
    for label in np.intersect1d(anchors.labels, rows.labels):
        own = np.flatnonzero(rows.labels == label)
        some = Side.__new__(Side)
        some.ids, some.grid, some.turned, some.norm = rows.ids[own], rows.grid[own], rows.turned[own], rows.norm[own]
        some.cuts, some.rest = rows.cuts, [x[own] for x in rows.rest]
        of = np.flatnonzero(anchors.labels == label)
        for s in range(0, len(of), SLICE):
            part = of[s : s + SLICE]
            other = anchors.ids[part][:, None] != some.ids[None, :]

            def wanted(low, high):
                last = best.scores[part, -1][:, None]
                reach = np.floor(high)
                return other & ((reach > last) | ((reach >= last) & (some.ids[None, :] < best.ids[part, -1][:, None])))

            def seeds(estimates):
                a, r = _top(np.where(other, estimates, -np.inf), best.scores.shape[1] + 1)
                best.add(part[a], products(anchors, some, part[a], r), some.ids[r])

            a, r, scores = bounded(anchors, some, part, wanted, seeds)
            verified += len(a)
            best.add(a, scores, some.ids[r])
    return verified


def best_negatives(anchors: Side, rows: Side, low: np.ndarray, high: np.ndarray, best: Best) -> int:
    """Takes the block's rows of other labels into the lists of the anchors' bands; list i * bands + j is band j of anchor i.

    low, high: the smallest and largest score of each band (anchors x bands); an empty band has low above high.
    """
    verified, bands = 0, low.shape[1]
    for s in range(0, len(anchors.ids), SLICE):
        part = np.arange(s, min(s + SLICE, len(anchors.ids)))
        other = anchors.labels[part][:, None] != rows.labels[None, :]
        lists = part[:, None] * bands + np.arange(bands)

        def wanted(least, most):
            last, ids = best.scores[lists, -1], best.ids[lists, -1]
            need = np.maximum(low[part], last)
            mask = other & (most >= need.min(axis=1)[:, None]) & (least <= high[part].max(axis=1)[:, None])
            a, r = np.nonzero(mask)
            reach, floor = np.floor(most[a, r]), np.ceil(least[a, r])
            some = np.zeros(len(a), bool)
            for j in range(bands):
                better = (reach > last[a, j]) | ((reach >= last[a, j]) & (rows.ids[r] < ids[a, j]))
                some |= better & (reach >= low[part[a], j]) & (floor <= high[part[a], j])
            mask[a, r] = some
            return mask

        def take(a, r, scores):
            for j in range(bands):
                inside = (scores >= low[a, j]) & (scores <= high[a, j])
                best.add(a[inside] * bands + j, scores[inside], rows.ids[r[inside]])

        def seeds(estimates):
            for j in range(bands):
                fits = other & (estimates <= high[part, j][:, None]) & (estimates >= low[part, j][:, None])
                a, r = _top(np.where(fits, estimates, -np.inf), best.scores.shape[1] + 1)
                take(part[a], r, products(anchors, rows, part[a], r))

        a, r, scores = bounded(anchors, rows, part, wanted, seeds)
        verified += len(a)
        take(a, r, scores)
    return verified


def _scan(pairs: DataFrame, width: int, turn: np.ndarray, lists: int, size: int, search, fields: str, emit) -> DataFrame:
    """Goes through a task's pairs of blocks; search(anchors, rows, pair, best) fills best, emit(anchors, pair, best) gives its rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        last = None
        for batch in batches:
            for at in range(batch.num_rows):
                pair = batch.slice(at, 1).to_pylist()[0]
                if last is None or last[0] != pair["block"]:
                    tidy()
                    last = pair["block"], Side(*opened(pair["ids"], pair["labels"], pair["vectors"], pair["dims"], width), turn)
                if pair["a_block"] not in held:
                    if len(held) >= HELD:
                        yield from (emit(*own) for own in held.values())
                        held.clear()
                    side = Side(*opened(pair["a_ids"], pair["a_labels"], pair["a_vectors"], pair["a_dims"], width), turn)
                    held[pair["a_block"]] = side, {k: v for k, v in pair.items() if k == "a_scores"}, Best(len(side.ids) * lists, size)
                search(held[pair["a_block"]][0], last[1], *held[pair["a_block"]][1:])
        yield from (emit(*own) for own in held.values())

    return pairs.mapInArrow(scan, fields)


def mined(
    rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor's positives' hard negatives.

    rows: vec_id, label, embedding (array of numbers).  Anchors are the rows whose vec_id is divisible by `every`.  A row without an id, label or vector,
    or with a null or non-finite component, takes no part.  Of rows that share an id the first by label, then by vector,
    takes part.  Shorter vectors are filled up with zeros, an empty one is all zeros; components beyond 2 ** 23 in size
    are held there.  Ties of scores go to the smaller id.  A positive whose band holds no row has no row here; with a positive score of 0
    negatives must score 0, and below 0 there are none.  An empty table, or one without anchors, gives no rows; other
    columns, whatever their names, are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    own = stored(prepared(rows, scale), "vectors")
    blocks = stored(packed(own.coalesce(1 + own.count() // ROW_BLOCK), ROW_BLOCK), "row-blocks")
    fields = "anchor_id bigint, positive_id bigint, positive_score bigint"
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    width, turn = rotation(blocks)
    anchors = own.filter(F.col("vec_id") % every == 0)
    n_anchors = anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], out)
    anchor_blocks = stored(packed(anchors.coalesce(1 + n_anchors // ANCHOR_BLOCK), ANCHOR_BLOCK), "anchor-blocks")
    # a file may hold many blocks; a task hands on each anchor's best rows once, so there are no more tasks than are needed
    dealt = blocks.repartition(min(blocks.count(), TASKS * spark.sparkContext.defaultParallelism))

    def emit_positives(side: Side, _, best: Best) -> pa.RecordBatch:
        real = best.ids != np.iinfo(np.int64).max
        a = np.repeat(np.arange(len(side.ids)), real.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(side.ids[a]), pa.array(best.ids[real]), pa.array(best.scores[real])], ["anchor_id", "positive_id", "positive_score"])

    found = _scan(met(dealt, anchor_blocks), width, turn, 1, positives, lambda side, block, _, best: best_positives(side, block, best), fields, emit_positives)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = stored(found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives), "positives")

    # an anchor's positive scores, by rank; ranks that it lacks get an empty band
    none = -1
    lists = first.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "positive_score"))).alias("m"))
    scores = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(none).cast("bigint")))
    asked = anchors.join(lists.select(F.col("anchor_id").alias("vec_id"), scores.alias("scores")), "vec_id")
    asked_blocks = stored(packed(asked.coalesce(1 + n_anchors // ANCHOR_BLOCK), ANCHOR_BLOCK, ("scores", "array<bigint>")), "asked-blocks")
    if not asked_blocks.count():
        return spark.createDataFrame([], out)

    def edges(pair: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        score = np.frombuffer(pair["a_scores"], np.int64).reshape(n, positives)
        least, most = -((-low * score) // 100), (high * score) // 100
        return np.where(score < 0, 1, least), np.where(score < 0, 0, most)

    def search(side: Side, block: Side, pair: dict, best: Best) -> None:
        best_negatives(side, block, *edges(pair, len(side.ids)), best)

    def emit_negatives(side: Side, _, best: Best) -> pa.RecordBatch:
        real = best.ids != np.iinfo(np.int64).max
        which = np.repeat(np.arange(len(real)), real.sum(axis=1))
        columns = [side.ids[which // positives], which % positives + 1, best.ids[real], best.scores[real]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "n", "negative_id", "negative_score"])

    hard = _scan(met(dealt, asked_blocks), width, turn, positives, negatives, search, "anchor_id bigint, n bigint, negative_id bigint, negative_score bigint", emit_negatives)
    order = Window.partitionBy("anchor_id", "n").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    joined = first.join(hard, ["anchor_id", "n"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(spark, sf_dir: str) -> DataFrame:
    """Anchors are the rows with vec_id divisible by 50; where vec_id is divisible by 7, label becomes (label + 1) % 10 first."""
    from .common import table

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.select("vec_id", label.alias("label"), "embedding"))


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM e a, e r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), q AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id,
  positive_score, score AS negative_score
FROM q JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
