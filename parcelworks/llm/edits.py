"""Edit-aware token counts: stored segment trees of pre-token counts per document, re-encoded only where edits touch.

A document's leaves are its pre-tokens with their lengths and token counts; inner nodes hold the sums.  build() encodes every
document once and stores its leaves and root beside the document's key.  A batch of edits joins the touched documents' texts
with their stored trees.  An edit replaces a span of characters: only the leaves it touches, with boundary context on both
sides, are cut and encoded anew.  Pre-tokens of the new text are compared with the old ones and the work stops where both are
in step again; then the leaves are spliced and the sums above them updated.  The batch's result is a table of the touched
documents' new texts and trees, which the next batch starts from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, stored, tidy
from .tokens import Encoder, encoder, tokenizer_path

#: Leaves held by a block of the tree; edits change whole blocks' sums, never the whole document.
BLOCK = 64


def packed(parts: list[str], counts: list[int]) -> bytes:
    """The leaves' lengths and token counts: a byte each, those of 255 and more behind them in four."""
    values = np.array([*map(len, parts), *counts], np.int64)
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<u4").tobytes() + np.array([len(parts)], "<u4").tobytes()


def unpacked(leaves: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(leaves[-4:], "<u4")[0])
    values = np.frombuffer(leaves, np.uint8, 2 * n).astype(np.int64)
    values[values == 255] = np.frombuffer(leaves[2 * n : -4], "<u4")
    return values[:n], values[n:]


class TokenTree:
    """Pre-token leaves in blocks of about BLOCK, under a segment tree over the blocks' sums of characters and tokens."""

    def __init__(self, text: str, coder: Encoder, leaves: bytes | None = None):
        """The tree of a text: of its stored leaves if given, without encoding anything, else encoded anew."""
        self.coder, self.encoded = coder, 0
        if leaves is None:
            parts = coder.pretokens(text)
            counts = self._count(parts)
        else:
            lengths, counts = unpacked(leaves)
            ends = np.cumsum(lengths).tolist()
            parts = [text[a:b] for a, b in zip([0, *ends], ends)]
            counts = counts.tolist()
        self.blocks = [(parts[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(parts), BLOCK)] or [([], [])]
        self._build()

    def _count(self, parts: list[str]) -> list[int]:
        self.encoded += len(parts)
        return self.coder.counts(parts)

    def _build(self) -> None:
        width = 1
        while width < len(self.blocks):
            width *= 2
        self.width = width
        self.sums = np.zeros((2 * width, 2), np.int64)
        for i, block in enumerate(self.blocks):
            self.sums[width + i] = self._sum(block)
        for i in range(width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @staticmethod
    def _sum(block) -> tuple[int, int]:
        return sum(map(len, block[0])), sum(block[1])

    def _changed(self, i: int) -> None:
        at = self.width + i
        self.sums[at] = self._sum(self.blocks[i])
        at //= 2
        while at:
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]
            at //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def length(self) -> int:
        return int(self.sums[1, 0])

    def find(self, char: int) -> tuple[int, int, int]:
        """The block and leaf that hold a character, and the leaf's first character; at the end, one past the last leaf."""
        at, before = 1, 0
        while at < self.width:
            at *= 2
            if char - before >= self.sums[at, 0] and self.sums[at + 1, 0]:
                before += int(self.sums[at, 0])
                at += 1
        block = at - self.width
        leaf = 0
        parts = self.blocks[block][0]
        while leaf < len(parts) and char >= before + len(parts[leaf]):
            before += len(parts[leaf])
            leaf += 1
        return block, leaf, before

    def _back(self, block: int, leaf: int) -> tuple[int, int] | None:
        if leaf:
            return block, leaf - 1
        while block:
            block -= 1
            if self.blocks[block][0]:
                return block, len(self.blocks[block][0]) - 1
        return None

    def _leaf(self, block: int, leaf: int) -> tuple[int, int] | None:
        """The place itself if a leaf is there, else the next leaf; None at the end."""
        while block < len(self.blocks):
            if leaf < len(self.blocks[block][0]):
                return block, leaf
            block, leaf = block + 1, 0
        return None

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in the place of characters [start, stop)."""
        start, stop = max(0, min(start, self.length)), max(0, min(stop, self.length))
        stop = max(start, stop)
        block, leaf, first = self.find(start)
        # context before: a pre-token's end depends on the next characters, so go back over two leaves and all blanks
        steps = 0
        while (before := self._back(block, leaf)) is not None:
            block, leaf = before
            part = self.blocks[block][0][leaf]
            first -= len(part)
            steps += not part.isspace()
            if steps >= 2:
                break
        head = []
        place, char = self._leaf(block, leaf), first
        old, cut = [], first
        # old leaves up to the end of the edit
        while place is not None and char < stop:
            old.append(place)
            char += len(self.blocks[place[0]][0][place[1]])
            place = self._leaf(place[0], place[1] + 1)
        text = "".join(self.blocks[b][0][i] for b, i in old)
        # the leaves between the context's start and the edit may end before it
        while place is not None and char < start:
            old.append(place)
            text += self.blocks[place[0]][0][place[1]]
            char += len(self.blocks[place[0]][0][place[1]])
            place = self._leaf(place[0], place[1] + 1)
        text = text[: start - cut] + new + text[stop - cut :]
        safe = len(text)
        ahead = 8
        while True:
            # context behind: take in more leaves until a pre-token of the new text ends where an old one does
            more = []
            while place is not None and len(more) < ahead:
                more.append(place)
                place = self._leaf(place[0], place[1] + 1)
            ends, size = {len(text): 0}, len(text)
            for n, (b, i) in enumerate(more, 1):
                text += self.blocks[b][0][i]
                ends[len(text)] = n
            parts = self.coder.pretokens(text)
            if place is None and not more:
                head, used = parts, 0
                break
            found, at = None, 0
            for n, part in enumerate(parts):
                at += len(part)
                # in step: the boundary is old, lies behind the edit, and enough text follows to have decided it
                if at >= safe and at in ends and not part.isspace() and len(text) - at >= 4 and not text[at : at + 4].isspace():
                    found = n + 1, ends[at]
                    break
            if found:
                head, used = parts[: found[0]], found[1]
                break
            if place is None:
                head, used = parts, len(more)
                break
            old += more
            safe = max(safe, size)
            ahead *= 2
        self._splice(old + more[:used], block, leaf, head, self._count(head))

    def _splice(self, old: list[tuple[int, int]], block: int, leaf: int, parts: list[str], counts: list[int]) -> None:
        if old:
            block, leaf = old[0]
        touched: dict[int, list[int]] = {}
        for b, i in old:
            touched.setdefault(b, []).append(i)
        for b, own in touched.items():
            p, c = self.blocks[b]
            self.blocks[b] = (p[: own[0]] + p[own[-1] + 1 :], c[: own[0]] + c[own[-1] + 1 :])
        p, c = self.blocks[block]
        self.blocks[block] = (p[:leaf] + parts + p[leaf:], c[:leaf] + counts + c[leaf:])
        if len(self.blocks[block][0]) > 4 * BLOCK:  # too long a block is cut: the tree is laid out anew, nothing is encoded
            p, c = self.blocks[block]
            self.blocks[block : block + 1] = [(p[i : i + BLOCK], c[i : i + BLOCK]) for i in range(0, len(p), BLOCK)]
            self._build()
        else:
            for b in {*touched, block}:
                self._changed(b)

    def leaves(self) -> bytes:
        return packed([p for parts, _ in self.blocks for p in parts], [n for _, counts in self.blocks for n in counts])

    def text(self) -> str:
        return "".join(p for parts, _ in self.blocks for p in parts)


#: Personal data and secrets that the scrub replaces: mail addresses, IPv4 addresses, long digit runs, long hex runs.
SCRUB = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{24,}\b|\b\d{12,}\b", re.ASCII)


#: Telephone numbers, which a second scrub replaces.
PHONES = re.compile(r"(?<!\w)\+?\d[\d ().-]{6,}\d(?!\w)", re.ASCII)
#: The two batches of op8: what is replaced, and by what.
BATCHES = ((SCRUB, "[gone]"), (PHONES, "[phone]"))

KEY = ["k1", "k2"]
TREES = "k1 bigint, k2 bigint, doc_id bigint, n_chars bigint, n_tokens bigint, n_pretokens bigint, leaves binary"
STATE = "n_chars bigint, n_tokens bigint, n_pretokens bigint, leaves binary, text string, n_edits bigint, n_reencoded bigint"


def apply_edits(tree: TokenTree, edits: list[tuple[int, int, str]]) -> None:
    """Edits are given in the characters of the text before all of them and don't overlap; later ones go first."""
    for start, stop, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        tree.replace(start, stop, new)


def keyed(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, text: the key is a hash of id and text, so rows alike in both share their tree.  Null is the empty text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"), "doc_id", "text")


def build(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The stored trees (TREES) of rows as keyed() gives them, a row each row; every text is encoded once, where it lies."""
    small_batches(rows.sparkSession)
    path = path or tokenizer_path()

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                parts = coder.pretokens(text) if text else []
                counts = coder.counts(parts)
                out.append((len(text), sum(counts), len(parts), packed(parts, counts)))
            chars, tokens, sizes, leaves = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*KEY, "doc_id")), *(pa.array(c, pa.int64()) for c in (chars, tokens, sizes)), pa.array(leaves, pa.binary())],
                [c.split()[0] for c in TREES.split(", ")],
            )
            tidy()
        coder.forget()
        tidy()

    return stored(rows.mapInArrow(trees, TREES), "trees")


def found_edits(rows: DataFrame, pattern: re.Pattern, replacement: str) -> DataFrame:
    """Edits (k1, k2, start, stop, replacement) that put the replacement for each match of the pattern in rows' texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, texts = (batch.column(c).to_pylist() for c in (*KEY, "text"))
            out = [(a, b, m.start(), m.end()) for a, b, text in zip(k1, k2, texts) for m in pattern.finditer(text)]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*KEY, "start", "stop"])
        tidy()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(find, "k1 bigint, k2 bigint, start bigint, stop bigint").withColumn("replacement", F.lit(replacement))


def given_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits by document (doc_id, start, stop, replacement) as edits by key; rows without an id, start or stop are ignored."""
    own = edits.filter("doc_id IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("__id"), F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"), F.col("replacement").cast("string").alias("replacement")
    )
    keys = rows.select(*KEY, "doc_id").distinct()
    return keys.join(own, keys["doc_id"] == own["__id"]).select(*KEY, "start", "stop", "replacement")


def apply_batch(rows: DataFrame, trees: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """The stored states (k1, k2 and STATE) of the documents that edits touch, from their texts (rows) and trees.

    Only touched documents take part: their keys are broadcast if they are few, else joined by a shuffle.  Texts and trees that
    occur repeatedly under a key are equal, so one of each is taken.
    """
    small_batches(rows.sparkSession)
    path = path or tokenizer_path()

    @F.pandas_udf(STATE)
    def run(texts: pd.Series, leaves: pd.Series, edits: pd.Series) -> pd.DataFrame:
        coder, out = encoder(path), []
        for text, own, batch in zip(texts, leaves, edits):
            tree = TokenTree(text, coder, own)
            apply_edits(tree, [(e["start"], e["stop"], e["replacement"] or "") for e in batch])
            now = tree.leaves()
            out.append((tree.length, tree.tokens, len(unpacked(now)[0]), now, tree.text(), len(batch), tree.encoded))
        tidy()
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    lists = edits.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop", "replacement")).alias("edits"))
    keys = broadcast_if_small(stored(edits.select(*KEY).distinct(), "edited"), 16)
    touched = lambda frame, column: frame.select(*KEY, column).join(keys, KEY, "left_semi").dropDuplicates(KEY)
    met = touched(rows, "text").join(touched(trees, "leaves"), KEY).join(lists, KEY)
    return stored(met.select(*KEY, run("text", "leaves", "edits").alias("s")).select(*KEY, "s.*"), "edited-trees")


def counted(docs: DataFrame, *batches, path: str | None = None) -> DataFrame:
    """A row each row of docs (doc_id, text): doc_id, n_chars, n_tokens, n_pretokens, then of the text after all batches
    n_chars_after, n_tokens_after, n_pretokens_after, and of each batch, numbered from 1, n_edits_1, n_reencoded_1 and so on.

    A batch is a pair of pattern and replacement, or a table (doc_id, start, stop, replacement) of spans of characters of the
    whole text as the batch finds it, which don't overlap; null replacements delete, spans are cut to the text, edits of
    unknown documents are ignored.  n_reencoded are the pre-tokens that a batch encoded: the rest of a document comes from its
    stored tree.  Null and empty texts have no tokens; repeated rows are counted each for itself; other columns are ignored.
    To counts, a special token's string is ordinary text.  The edits of one document in a batch must fit one task's memory.
    """
    rows = keyed(docs)
    trees = build(rows, path)
    out = trees.select(*KEY, "doc_id", "n_chars", "n_tokens", "n_pretokens", *[F.col(c).alias(f"{c}_after") for c in ("n_chars", "n_tokens", "n_pretokens")])
    texts, leaves, last = rows.select(*KEY, "text"), trees.select(*KEY, "leaves"), None
    for n, batch in enumerate(batches, 1):
        if isinstance(batch, DataFrame):
            edits = given_edits(rows, batch)
        else:
            edits = found_edits(rows, *batch)
            if last is not None:  # what a batch has changed is searched in its new text
                edits = edits.join(broadcast_if_small(last.select(*KEY), 16), KEY, "left_anti").unionByName(found_edits(last, *batch))
        edits = stored(edits, "edits")
        if last is not None:
            old = broadcast_if_small(last.select(*KEY), 16)
            keys = broadcast_if_small(stored(edits.select(*KEY).distinct(), "edited"), 16)
            current = lambda frame, column: frame.join(keys, KEY, "left_semi").join(old, KEY, "left_anti").unionByName(last.select(*KEY, column))
            state = apply_batch(current(texts, "text"), current(leaves, "leaves"), edits, path)
            last = stored(last.join(state, KEY, "left_anti").unionByName(state), "edited-trees") if n < len(batches) else state
        else:
            last = state = apply_batch(texts, leaves, edits, path)
        new = state.select(*KEY, *[F.col(c).alias(f"__{c}") for c in ("n_chars", "n_tokens", "n_pretokens", "n_edits", "n_reencoded")])
        out = out.join(broadcast_if_small(new, 56), KEY, "left")
        for c in ("n_chars", "n_tokens", "n_pretokens"):
            out = out.withColumn(f"{c}_after", F.coalesce(f"__{c}", f"{c}_after"))
        out = out.withColumns({f"{c}_{n}": F.coalesce(f"__{c}", F.lit(0).cast("bigint")) for c in ("n_edits", "n_reencoded")}).drop(*[c for c in new.columns if c not in KEY])
    return out.drop(*KEY)


def op8(spark, sf_dir: str) -> DataFrame:
    """All documents under two batches of edits: a scrub of mail addresses, IP addresses and long secrets, then of telephone numbers."""
    from .common import table

    return counted(table(spark, sf_dir, "documents"), *BATCHES)
