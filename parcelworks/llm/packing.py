"""Best-fit packing of tokenised documents into sequences, by bin completion with branch and bound.

Only the lengths matter for packing, and there are at most ``capacity`` of them: the driver gets the number of
pieces of each length, however many documents there are, and plans fillings with the number of times each is
used.  A piece then finds its place by its rank among the pieces of its length, which needs the counts of each
(task, length) and no sort or shuffle of texts.

The plan: the largest piece left is completed by a filling of the space beside it; fillings are enumerated from
large pieces to small, and dominated ones are left out: a filling is dominated if its pieces can be packed into the
pieces of another one, taken as bins, for then the other one can take its place in any plan.  The first descent starts from the
best-fit-decreasing plan as incumbent; the search then goes back over the last choices, cut by a bound on total
waste, until a plan meets the lower bound or its nodes are spent.  This takes a filling as often as it goes; where that is not good
enough, a linear programme over the same fillings says how often to take each.  The budgets of nodes and pivots bound the
planner's time alone: every piece gets a place, and how far a plan is from its lower bound is in the README.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, stored, tidy
from .tokens import encoder, tokenizer_path

CAPACITY = 1024
END_ID = 2
#: Nodes of one enumeration of fillings, fillings tried at a step, and nodes of the whole search after its first descent.
FILLING_NODES = 300
BRANCHES = 4
SEARCH_NODES = 200_000
#: Pivots of the linear programme, tried where bin completion is over its bound by more than one sequence in SLACK_SHARE.
PIVOTS, SLACK_SHARE = 1500, 200

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The documents' token pieces: doc_id, piece, start, length, ids_crc32, part (task), rank (in part and length).

    A document is its ids and end_id; null is the empty text, which has end_id alone.  Documents longer than the
    capacity are cut into pieces of that length, the first of which may be shorter.  Repeated rows are repeated, ties of
    length go by place, a special token's string in a text is that token, and other columns are ignored.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder, ranks = TaskContext.get().partitionId(), encoder(path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = coder.ids(text) + end
                n = len(ids) >> 2
                bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(pairwise(bounds)):
                    rows.append((doc_id, k, a, b - a, crc32(ids[4 * a : 4 * b]), part, int(ranks[b - a])))
                    ranks[b - a] += 1
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PIECES.split(", ")])
        coder.forget()
        tidy()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class Counts:
    """How many pieces of each length are left, with the lengths present in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: v for k, v in counts.items() if v}
        self.present = sorted(self.left)

    def take(self, filling: tuple[int, ...], times: int) -> None:
        for x in filling:
            self.left[x] = self.left.get(x, 0) - times
            if not self.left[x]:
                self.present.pop(bisect_right(self.present, x) - 1)
            elif self.left[x] == -times:
                raise AssertionError(x)

    def give(self, filling: tuple[int, ...], times: int) -> None:
        for x in filling:
            if not self.left.get(x):
                self.present.insert(bisect_right(self.present, x), x)
            self.left[x] = self.left.get(x, 0) + times

    def times(self, filling: tuple[int, ...]) -> int:
        return min(self.left[x] // filling.count(x) for x in set(filling))


def dominates(better: tuple[int, ...], worse: tuple[int, ...]) -> bool:
    """Whether the pieces of ``worse`` can be packed into those of ``better`` as bins.  Both run from large to small."""
    if sum(worse) > sum(better) or (worse and (not better or worse[0] > better[0])):
        return False
    room = list(better)

    def put(i: int) -> bool:
        if i == len(worse):
            return True
        tried = set()
        for k, space in enumerate(room):
            if space >= worse[i] and space not in tried:
                tried.add(space)
                room[k] -= worse[i]
                if put(i + 1):
                    return True
                room[k] += worse[i]
        return False

    return put(0)


def fillings(counts: Counts, space: int, branches: int = BRANCHES, nodes: int = FILLING_NODES) -> tuple[list[tuple[int, ...]], int]:
    """Up to ``branches`` undominated fillings of the space, least waste first, larger pieces first among equals; nodes used.

    Walks the lengths from large to small.  A filling into which another left piece fits is dominated by the one with that
    piece, so only full ones are looked at; of these each is kept that no other one kept dominates.
    """
    present, left = counts.present, counts.left
    kept: list[tuple[int, tuple[int, ...]]] = []
    used: dict[int, int] = {}
    chosen: list[int] = []
    budget = nodes

    def walk(space: int, top: int) -> bool:
        """top: lengths before this place may be used.  True if the search can end."""
        nonlocal budget
        at = min(top, bisect_right(present, space))
        maximal = True
        while at > 0:
            x = present[at - 1]
            if used.get(x, 0) < left[x]:
                maximal = False
                if len(kept) >= branches and budget <= 0:
                    return True
                budget -= 1
                used[x] = used.get(x, 0) + 1
                chosen.append(x)
                done = walk(space - x, at)
                chosen.pop()
                used[x] -= 1
                if done:
                    return True
                if budget <= 0 and kept:
                    return True
            at -= 1
        if maximal:
            small = next((p for p in present if used.get(p, 0) < left[p]), None)
            if (small is None or small > space) and not any(dominates(f, tuple(chosen)) for _, f in kept):
                own = tuple(chosen)
                kept[:] = [k for k in kept if not dominates(own, k[1])]
                kept.append((space, own))
                kept.sort(key=lambda k: k[0])
                del kept[branches:]
                return len(kept) == branches and kept[-1][0] == 0
        return False

    walk(space, len(present))
    return [f for _, f in kept], nodes - budget


def lower_bound(left: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: total length, or pieces over half of the capacity with what can't stand beside them."""
    total = sum(k * v for k, v in left.items())
    best = -(-total // capacity)
    for least in sorted({k for k in left if k <= capacity // 2 and left[k]} | {0}):
        large = sum(v for k, v in left.items() if k > capacity - least)
        half = [(k, v) for k, v in left.items() if capacity // 2 < k <= capacity - least]
        small = sum(k * v for k, v in left.items() if least <= k <= capacity // 2)
        room = sum(v * (capacity - k) for k, v in half)
        best = max(best, large + sum(v for _, v in half) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences filled one kind at a time: always the largest piece left that fits."""
    state, plan = Counts(counts), []
    while state.present:
        filling, space, used = [], capacity, {}
        at = len(state.present)
        while at > 0:
            at = min(at, bisect_right(state.present, space))
            if not at:
                break
            x = state.present[at - 1]
            n = min(space // x, state.left[x] - used.get(x, 0))
            filling += [x] * n
            space -= n * x
            at -= 1
        times = state.times(tuple(filling))
        state.take(tuple(filling), times)
        plan.append((tuple(filling), times))
    return plan


def filled_best(worth: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """(worth, copies of each length) of the filling that is worth most, by dynamic programming over the space."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for space in range(1, capacity + 1):
        best[space] = best[space - 1]
        n = upto[space]
        if n:
            own = best[space - lengths[:n]] + worth[:n]
            k = int(own.argmax())
            if own[k] > best[space] + 1e-12:
                best[space], choice[space] = own[k], k
    copies, space = np.zeros(len(lengths)), capacity
    while space > 0:
        if choice[space] < 0:
            space -= 1
        else:
            copies[choice[space]] += 1
            space -= int(lengths[choice[space]])
    return float(best[capacity]), copies


def relaxed(counts: dict[int, int], capacity: int, pivots: int) -> tuple[list[tuple[tuple[int, ...], float]], int, int]:
    """(fillings with how often each is used in fractions, lower bound on sequences, pivots used) of the plan's linear programme.

    The simplex method over fillings that are made as they are needed: the lengths' prices under the present plan give the filling
    worth most, which comes in.  Prices divided by that worth bound every plan from below, so the bound holds wherever the pivots end.
    """
    lengths = np.array(sorted(k for k, v in counts.items() if v))
    need = np.array([counts[k] for k in lengths], float)
    own = np.minimum(capacity // lengths, need)
    columns, inverse, used = np.diag(own).astype(float), np.diag(1 / own), need / own
    bound = 0.0
    for done in range(pivots):
        prices = inverse.sum(axis=0)
        worth, copies = filled_best(np.maximum(prices, 0), lengths, capacity)
        bound = max(bound, float(np.maximum(prices, 0) @ need) / max(worth, 1.0))
        if worth <= 1 + 1e-9:
            break
        along = inverse @ copies
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(along > 1e-9, used / along, np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        columns[:, r] = copies
        used = used - ratio[r] * along
        used[r] = ratio[r]
        inverse[r] /= along[r]
        others = np.arange(len(lengths)) != r
        inverse[others] -= np.outer(along[others], inverse[r])
    plan_ = [(tuple(int(x) for k in np.flatnonzero(columns[::-1, j]) for x in [lengths[::-1][k]] * int(columns[::-1, j][k])), float(used[j])) for j in range(len(lengths)) if used[j] > 1e-9]
    return plan_, math.ceil(bound - 1e-6), done + 1


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES, pivots: int = PIVOTS) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with the number of sequences of each, for the counts of pieces by length.

    Bin completion takes a filling as often as it goes.  Where its plan is over the lower bound by more than one in SLACK_SHARE, plans are
    tried in which fillings are used fewer times: as often, in whole numbers, as the linear programme over all fillings uses them; what
    is left is planned again in the same way, and by bin completion once nothing more comes of that.  The better plan counts.
    """
    found = completed(counts, capacity, nodes)
    total, bound = sum(n for _, n in found), lower_bound(counts, capacity)
    if total - bound <= total // SLACK_SHARE:
        return found
    left, used = dict(counts), []
    while pivots > 0 and any(left.values()):
        fractions, least, spent = relaxed(left, capacity, pivots)
        pivots -= spent
        if len(used) == 0 and total <= max(bound, least):
            return found
        state = Counts(left)
        before = len(used)
        # whole numbers first; then the largest parts are rounded up, as far as there are pieces, by a tenth of the fillings at once
        for up, group in ((False, fractions), (True, sorted(fractions, key=lambda f: -(f[1] % 1))[: 1 + len(fractions) // 10])):
            for filling, share in group:
                there = all(state.left.get(x, 0) >= filling.count(x) for x in set(filling))
                times = min(state.times(filling), 1 if up else int(share + 1e-9)) if there else 0
                if times:
                    state.take(filling, times)
                    used.append((filling, times))
        left = dict(state.left)
        if len(used) == before:
            break
    used += completed(left, capacity, nodes)
    merged: dict[tuple[int, ...], int] = {}
    for filling, times in used:
        merged[filling] = merged.get(filling, 0) + times
    return list(merged.items()) if sum(merged.values()) < total else found


def completed(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> list[tuple[tuple[int, ...], int]]:
    """A plan by bin completion and branch and bound, each filling taken as often as it goes."""
    total = sum(k * v for k, v in counts.items())
    bound = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    best = sum(n for _, n in incumbent)
    state, path, used, waste = Counts(counts), [], 0, 0
    #: of each step: the fillings not tried yet, and what was taken
    open_: list[list[tuple[int, ...]]] = []
    forward = True
    descended = False
    while best > bound and (nodes > 0 or not descended):
        if forward:
            if not state.present:
                if used < best:
                    best, incumbent = used, list(path)
                forward, descended = False, True
                continue
            first = state.present[-1]
            state.take((first,), 1)
            found, spent = fillings(state, capacity - first)
            found = [(first, *f) for f in found]
            nodes -= spent if descended else 0
            state.give((first,), 1)
            open_.append(found[::-1])
        else:
            if not path:
                break
            filling, times = path.pop()
            state.give(filling, times)
            used -= times
            waste -= times * (capacity - sum(filling))
        forward = False
        while open_ and open_[-1]:
            filling = open_[-1].pop()
            times = state.times(filling)
            more = times * (capacity - sum(filling))
            # a plan with fewer sequences than the incumbent has at most this waste
            if waste + more <= (best - 1) * capacity - total:
                state.take(filling, times)
                path.append((filling, times))
                used, waste, forward = used + times, waste + more, True
                break
        if not forward:
            descended = True
            open_.pop()
            if not open_:
                break
    return incumbent


def slots(fillings_used: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset): where the pieces of that length go, by rank."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for filling, times in fillings_used:
        offset = 0
        for x in filling:
            found.setdefault(x, []).append((ranks.get(x, 0), sequence, offset))
            ranks[x] = ranks.get(x, 0) + times
            offset += x
        sequence += times
    return {x: np.array(rows, np.int64) for x, rows in found.items()}


def packed(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """A row a piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    No piece is lost or cut again; sequences are filled from offset 0 without gaps.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity, end_id, path), "pieces")
    by_part = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    held = spark.sparkContext.broadcast(slots(plan(counts, capacity), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select(
        F.col("part").alias("__part"), F.col("length").alias("__length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")
    )
    base = broadcast_if_small(stored(base, "piece-ranks"), 24)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(rank), 2), np.int64)
        for x in np.unique(length):
            own, rows = length == x, held.value[int(x)]
            at = np.searchsorted(rows[:, 0], rank[own], side="right") - 1
            out[own, 0] = rows[at, 1] + rank[own] - rows[at, 0]
            out[own, 1] = rows[at, 2]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    ranked = cut.join(base, (F.col("part") == F.col("__part")) & (F.col("length") == F.col("__length")))
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", place("length", F.col("rank") + F.col("__before")).alias("p")
    ).select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return packed(table(spark, sf_dir, "documents"))
