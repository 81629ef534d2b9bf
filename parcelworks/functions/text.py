"""Text functions as columns: tokens, references, names and cleaning of survey and deed texts."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Words without weight in legal descriptions.
STOP_WORDS = (
    "the of and to a in for by at on an is or be as from with that said all being more less particularly described follows "
    "located situated lying county state new mexico thence along feet foot point beginning commencing boundary line also known "
    "record recorded filed per set found running true then accordance according northerly southerly easterly westerly"
).split()


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a pattern's group; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def top_concepts(rows: DataFrame, text: str, n: int = 12, without: tuple[str, ...] = ()) -> DataFrame:
    """(w, n): the most frequent words of four letters or more in lower case, but for those in ``without``; ties by word."""
    words = rows.select(F.explode(found(F.lower(text), "([a-z]{4,})")).alias("w"))
    words = words.filter(~F.col("w").isin(*without)) if without else words
    return words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(n)


def phrase(*texts: str) -> str:
    """A pattern for any of the phrases, the longer ones first, with any white space between their words."""
    escaped = sorted((re.escape(t).replace(r"\ ", r"\s+") for t in texts), key=len, reverse=True)
    return f"(?:{'|'.join(escaped)})"


def legal_tokens(text: Column) -> Column:
    """Distinct words of three letters or more in lower case, without stop words."""
    return F.array_except(F.array_distinct(found(F.lower(text), "([a-z]{3,})")), F.array(*[F.lit(w) for w in STOP_WORDS]))


def _coordinate(letter: str, directions: str, edge: str = "") -> str:
    """A township or range as surveys write it: its letter, a number and a direction."""
    return rf"{edge}{letter}\.?\s*\d+\s*[{directions}]{edge}"


def _reference(section: str, edge: str = "", between: str = r"[,.\s]*") -> str:
    """A township, a range and, if it is there, a section."""
    return rf"(?i){_coordinate('T', 'NS', edge)}{between}{_coordinate('R', 'EW', edge)}(?:[,\s]*{section}\.?\s*\d+{edge})?"


#: References as descriptions are compared by, and the stricter ones of boundary texts, in which only `Sec` marks a section.
TRS, TRS_STRICT = _reference(r"s(?:ec(?:tion)?)?"), _reference(r"sec(?:tion)?", r"\b", r"[,\s]*")


def _trs(text: Column, pattern: str, sep: str, mark: str) -> Column:
    """The references' numbers and directions, read from each short match in turn."""

    def name(match: Column) -> Column:
        numbers, directions = F.regexp_extract_all(match, F.lit(r"(\d+)"), F.lit(1)), F.regexp_extract_all(F.upper(match), F.lit(r"\d\s*([NSEW])"), F.lit(1))
        place = lambda i: F.concat(F.lit("TR"[i]), numbers[i], directions[i])
        section = F.get(numbers, 2)
        return F.concat(place(0), F.lit(sep), place(1), F.when(section.isNotNull(), F.concat(F.lit(mark), section)).otherwise(""))

    return F.array_distinct(F.transform(found(text, pattern, 0), name))


def trs_fingerprints(text: Column) -> Column:
    """`T26N-R13E` or `T26N-R13E-S12`, in order of first occurrence."""
    return _trs(text, TRS, "-", "-S")


def trs_refs(text: Column) -> Column:
    """`T26N R13E` or `T26N R13E S12`, by the stricter pattern."""
    return _trs(text, TRS_STRICT, " ", " S")


def trs_of(township: Column, township_direction: Column, range_: Column, range_direction: Column, section: Column) -> Column:
    """`T26N R13E SEC 12` of a record's parts; null without township or range, no section if it is empty or 0."""
    given = lambda x: F.nullif(F.trim(x.cast("string")), F.lit(""))
    place = lambda letter, n, direction: F.concat(F.lit(letter), given(n), F.coalesce(F.upper(given(direction)), F.lit("")))
    sec = F.nullif(given(section), F.lit("0"))
    both = F.concat(place("T", township, township_direction), F.lit(" "), place("R", range_, range_direction))
    return F.concat(both, F.coalesce(F.concat(F.lit(" SEC "), sec), F.lit("")))


def _tight(text: Column) -> Column:
    """Upper case, dashes alike and without blanks round them."""
    return F.regexp_replace(F.upper(text), r"\s*[-–]\s*", "-")


def cabinet_refs(text: Column) -> Column:
    """`C-191A` of `CAB. C-191A` and `CABINET C - 191a`, as a set."""
    return F.array_distinct(found(_tight(text), r"\bCAB(?:INET)?\.? *([A-F]-\d+[A-Z]?)\b"))


def plat_cabinet_refs(plat: Column) -> Column:
    """References of a plat field: those after CAB first, then short forms like `C-191-A NAME` and `C-84`.

    The short form is a word of its own: cabinet letter, number and perhaps one letter.
    """
    long = found(_tight(plat), r"\bCAB\.? *([A-F]-\d+[A-Z]?)\b")
    words = F.filter(F.split(F.upper(F.coalesce(plat, F.lit(""))), r"[\s,;.]+"), lambda w: w.rlike(r"^\W*[A-F]-\d{1,4}(?:-[A-Z])?$"))
    parts = F.transform(words, lambda w: F.split(F.ltrim(w, F.lit("()[]/&#:'\"")), "-"))
    short = F.transform(parts, lambda p: F.concat(p[0], F.lit("-"), p[1], F.coalesce(F.get(p, 2), F.lit(""))))
    return F.array_distinct(F.concat(long, short))


def legal_names(text: Column) -> Column:
    """Name words of `LAST, FIRST` and `lands of NAME`, in lower case, as a set."""
    word = r"[A-Z][A-Za-z'-]+"
    pairs = F.flatten(F.transform(found(text, rf"\b{word}\s*,\s*{word}", 0), lambda pair: F.transform(F.split(pair, ","), lambda w: F.trim(w))))
    owners = found(text, rf"(?i)\b{phrase('land of', 'lands of', 'land of the', 'lands of the')}\s+({word})")
    return F.array_distinct(F.transform(F.concat(pairs, owners), F.lower))


def lot_block_tract(text: Column) -> Column:
    """`lot-3`, `block-7`, `tract-2A`, as a set.  A block counts where it follows a lot's number."""
    every = F.filter(F.split(F.upper(F.coalesce(text, F.lit(""))), r"[\s,.;:()]+"), lambda w: w != "")

    def keys(words: Column) -> Column:
        number = lambda i: F.nullif(F.regexp_extract(F.coalesce(F.get(words, i), F.lit("")), r"^\d+\w?", 0), F.lit(""))
        is_ = lambda i, word: (i >= 0) & (F.coalesce(F.get(words, F.greatest(i, F.lit(0))), F.lit("")) == word)
        key = lambda word, rule: F.array_compact(F.transform(words, lambda w, i: F.when(rule(i), F.concat(F.lit(f"{word}-"), number(i + 1)))))
        lots, tracts = key("lot", lambda i: is_(i, "LOT")), key("tract", lambda i: is_(i, "TRACT"))
        blocks = key("block", lambda i: is_(i, "BLOCK") & is_(i - 2, "LOT"))
        return F.array_distinct(F.concat(lots, blocks, tracts))

    return let(every, keys)


def book_page(location: Column) -> tuple[Column, Column]:
    """Book and page of `M568-482`; null if the text does not start so."""
    pattern = r"^[A-Za-z]?(\d+)-(\d+)"
    part = lambda g: F.nullif(F.regexp_extract(F.trim(location), pattern, g), F.lit(""))
    return part(1), part(2)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def plain_words(text: Column) -> Column:
    """The text's words in lower case, a blank before, between and behind them; what is no letter or digit parts words.  Null has none."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def mentions(text: Column, *phrases: str, plain: bool = False) -> Column:
    """Whether one of the phrases stands in the text, word by word; one that ends in `-` is the beginning of a word.

    plain: the text is one of plain_words already, which saves parting it again for each question.
    """

    def any_of(words: Column) -> Column:
        hits = [F.contains(words, F.lit(f" {p[:-1]}" if p.endswith("-") else f" {p} ")) for p in phrases]
        return reduce(or_, hits)

    return any_of(text) if plain else let(plain_words(text), any_of)


#: Kinds of monuments, each with what it is called.
MONUMENTS = {
    "iron pin": ("iron pin", "iron rod", "iron pipe"),
    "rebar": ("rebar",),
    "pipe": ("pipe",),
    "rock": tuple(f"{what} {shape}" for what in ("rock", "stone") for shape in ("mound", "monument", "cairn", "marker")),
    "concrete": ("concrete monument", "concrete post", "concrete marker"),
    "fence": ("fence",),
    "cap": ("cap",),
    "nail": ("nail",),
}


def monuments(text: Column, plain: bool = False) -> Column:
    return F.array_compact(F.array(*[F.when(mentions(text, *names, plain=plain), F.lit(kind)) for kind, names in MONUMENTS.items()]))


#: Ways to hold title, each with what a deed says of it (`-`: the beginning of a word).
VESTING = {
    "Joint Tenants": ("joint tenan-",),
    "Tenants in Common": ("tenant in common", "tenants in common"),
    "Community Property": ("community property",),
    "Husband & Wife": ("husband and wife", "husband wife"),
    "Trustee": ("trustee-",),
    "LLC / Corp": ("llc", "l l c", "inc", "corp", "corporation", "company"),
    "Estate / Heirs": ("estate of", "heir of", "heirs of", "personal representative"),
}


def vesting(text: Column, plain: bool = False) -> Column:
    """The ways to hold title that a text names, in the order of VESTING; punctuation and `&` only part words.  Null names none."""
    return F.array_compact(F.array(*[F.when(mentions(text, *names, plain=plain), F.lit(way)) for way, names in VESTING.items()]))


def refers_to_survey(text: Column, plain: bool = False) -> Column:
    """Whether a text leans on an earlier survey or a recorded plat: `plat of`, `surveyed by`, `recorded in`."""
    what, where = ("survey", "surveyed", "plat", "subdivision", "filed", "recorded"), ("by", "of", "in", "under", "at")
    return mentions(text, *[f"{a} {b}" for a in what for b in where], plain=plain)


def has_beginning(text: Column, plain: bool = False) -> Column:
    """Whether a text names the point at which its boundary begins; also in short, with or without full stops."""
    return mentions(text, "point of beginning", "point of commencement", "pob", "p o b", plain=plain)


def _led_by(text: Column, *leads: str) -> Column:
    """The words of a text that follow one of the leading words."""
    after = lambda words: F.transform(words, lambda w, i: F.when((i > 0) & F.get(words, F.greatest(i - 1, F.lit(0))).isin(*leads), w))
    return F.array_compact(let(F.split(F.trim(plain_words(text)), " "), after))


def description_type(text: Column, n_calls: Column) -> Column:
    """metes_and_bounds, lot_block (a lot, block or unit with a number), tract (with a letter or number), trs_only or unknown: the first that holds."""
    numbered = F.exists(_led_by(text, "lot", "block", "unit"), lambda w: F.substring(w, 1, 1).between("0", "9"))
    return (
        F.when(n_calls > 0, "metes_and_bounds")
        .when(numbered, "lot_block")
        .when(F.size(_led_by(text, "tract")) > 0, "tract")
        .when(F.size(trs_refs(text)) > 0, "trs_only")
        .otherwise("unknown")
    )


def owner_cleaned(owner: Column) -> Column:
    """Owner without what joins it to a name that isn't there: `&`, AND and OR at its end, up to three of them, with the commas around."""
    is_joint, is_comma = (lambda w: F.upper(w).isin("&", "AND", "OR")), (lambda w: w == ",")

    def cut(pieces: Column) -> Column:
        # the last piece that is neither, and how many joining words follow it
        real = F.array_max(F.transform(pieces, lambda w, i: F.when(~is_joint(w) & ~is_comma(w), i + 1).otherwise(0)))
        joints = F.size(F.filter(F.slice(pieces, real + 1, F.greatest(F.size(pieces) - real, F.lit(0))), is_joint))
        return F.slice(pieces, F.lit(1), F.when(joints > 3, F.size(pieces) - 3).otherwise(real))

    pieces = F.filter(F.split(F.replace(F.trim(owner), F.lit(","), F.lit(" , ")), r"\s+"), lambda w: w != "")
    kept = let(pieces, lambda p: F.when(F.size(p) > 0, cut(p)).otherwise(p))
    return F.replace(F.array_join(kept, " "), F.lit(" , "), F.lit(", "))


#: Endings of owners' names that a comparison passes over.
OWNER_ENDINGS = ("JR", "SR", "II", "III", "IV", "EST", "ESTATE", "TRUST", "LLC", "INC", "ETAL", "ET AL")


def owner_key(owner: Column) -> Column:
    """Owner for comparison: upper case, punctuation to blanks, one ending dropped, but not the whole name."""
    def bare(words: Column) -> Column:
        n = F.size(words)
        last = lambda k: F.array_join(F.slice(words, F.greatest(n - k + 1, F.lit(1)), k), " ")
        drop = F.when((n > 2) & last(2).isin(*[e for e in OWNER_ENDINGS if " " in e]), 2).when((n > 1) & last(1).isin(*OWNER_ENDINGS), 1).otherwise(0)
        return F.array_join(F.slice(words, F.lit(1), F.greatest(n - drop, F.lit(0))), " ")

    return let(F.filter(F.split(F.translate(F.upper(owner), ",.'\"-", "     "), r"\s+"), lambda w: w != ""), bare)


def person_key(name: Column) -> Column:
    """`LAST, FIRST` becomes `first last`; other names their words in order of the alphabet; lower case."""
    low = F.lower(F.trim(name))
    parts = F.split(low, r"\s*,\s*")
    flipped = F.trim(F.concat_ws(" ", F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1)))
    words = F.filter(F.split(F.regexp_replace(low, r"[^a-z0-9 ]", " "), r"\s+"), lambda w: w != "")
    return F.when(low.contains(","), flipped).otherwise(F.concat_ws(" ", F.array_sort(words)))


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Textbook Jaro-Winkler with a prefix of at most four and no floor for the prefix bonus."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs)) / 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * scale * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def cleaned_for_embedding(text: Column, limit: int = 2048) -> Column:
    """One line of printable text, cut to ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E -￿]", " "), r"\s+", " ")), 1, limit)


def safe_filename(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " "))


def deed_filename_parts(name: Column) -> dict[str, Column]:
    """doc number, grantor and grantee of `123-45 A to B`, else what stands before and after ` to `."""
    stem = F.regexp_replace(name, r"(?i)\.pdf$", "")
    full = r"^(\d+-\d+)\s+(.+?)\s+to\s+(.+)$"
    hit = stem.rlike(full)
    sides = F.split(stem, " to ", 2)
    return {
        "doc_no": F.when(hit, F.regexp_extract(stem, full, 1)),
        "grantor": F.when(hit, F.regexp_extract(stem, full, 2)).when(F.size(sides) == 2, F.element_at(sides, 1)),
        "grantee": F.when(hit, F.regexp_extract(stem, full, 3)).when(F.size(sides) == 2, F.element_at(sides, 2)),
    }


