"""Deed and plat texts: OCR correction, adjoiner names, isolation of the legal description, cabinet file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.functions.text import found, let
from parcelworks.operators.matching import containing
from parcelworks.storage import broadcast_if_small, stored, tasks_for

#: Misread words and what they stand for.
MISREAD = {
    "thance": "thence", "thense": "thence", "th ence": "thence", "thenee": "thence", "thanee": "thence", "theuce": "thence", "thcnce": "thence",
    "begining": "beginning", "beginng": "beginning", "begimning": "beginning", "begmning": "beginning", "heginning": "beginning",
    "begiiming": "beginning", "begiruming": "beginning",
    "comrnencing": "commencing", "commensing": "commencing",
    "teet": "feet", "fect": "feet", "fcet": "feet", "feot": "feet", "feat": "feet", "feei": "feet", "ieet": "feet", "foet": "feet",
    "rchar": "rebar", "rcbar": "rebar", "re bar": "rebar", "rehbar": "rebar",
    "iroh": "iron", "lron": "iron", "ircn": "iron",
    "hounding": "bounding", "boundcd": "bounded", "hounded": "bounded", "haaring": "bearing", "hcaring": "bearing",
    "distanec": "distance", "distanee": "distance", "distancc": "distance",
    "corvey": "survey", "survcy": "survey", "survcey": "survey",
    "plattcd": "platted", "seetion": "section", "sectiou": "section", "towuship": "township", "townsbip": "township",
    "grautor": "grantor", "grantec": "grantee", "grantcc": "grantee", "conveyancc": "conveyance", "conveyauce": "conveyance",
    "easemeut": "easement", "cabiuet": "cabinet", "cabinct": "cabinet", "accquia": "acequia", "acequla": "acequia",
    "ol": "of", "ot": "of", "arid": "and", "aud": "and", "tbe": "the", "tiie": "the", "poinl": "point", "poiut": "point",
}
#: How a scan shows the signs of degrees, minutes and seconds, and the letter S.
DEGREE, MINUTE, SECOND, LETTER_S = "°oO*@^~", "'′`", "\"″`", "$5"
#: Units of length, as written and as misread.
FEET = ("feet", "foot", "ft", "teet", "fect", "fcet")


def _pieces(text: Column) -> Column:
    """The text cut at every edge between word and other characters; joined, the pieces are the text."""
    return F.split(text, r"\b")


def _numbers_read(text: Column) -> Column:
    """l and I between digits are 1 and O is 0; an l that leads a length is 1."""
    pieces = _pieces(text)
    unit = rf"(?i)^\s*(?:{'|'.join(FEET)}|')"

    def read(piece: Column, i: Column) -> Column:
        inner = F.when(piece.rlike("^[0-9][0-9lIO]*[0-9]$"), F.translate(piece, "lIO", "110")).otherwise(piece)
        # the rest of a decimal and the unit stand in the next pieces
        after = F.array_join(F.slice(pieces, i + 2, 5), "")
        decimal = F.regexp_replace(after, r"^\.[0-9]+", "")
        return F.when(piece.rlike("^[lL][0-9]+$") & decimal.rlike(unit), F.concat(F.lit("1"), F.substring(piece, 2, 100))).otherwise(inner)

    return F.array_join(F.transform(pieces, read), "")


def _bearings_read(text: Column) -> Column:
    """Bearings of one to three numbers in the form `N 10°20'30" E`, whatever signs the scan shows between the numbers."""
    out = F.regexp_replace(text, rf"(?<!\w)[{LETTER_S}]\s+(?=\d{{1,3}}\s*[°\d])", "S ") if LETTER_S else text
    signs = (DEGREE, MINUTE, SECOND)
    for n in (3, 2, 1):
        numbers = [r"(\d{1,3})", r"(\d{1,2})", r"(\d{1,2})"][:n]
        between = [rf"[{sign}\s-]\s*" for sign in signs[: n - 1]]
        body = "".join(x for pair in zip(numbers, [*between, ""]) for x in pair)
        shown = "".join(f"${k + 2}{mark}" for k, mark in enumerate("°'\""[:n]))
        out = F.regexp_replace(out, rf"(?i)\b([NS])\s*{body}[{signs[n - 1]}\s-]*([EW])(?!\w)", f"$1 {shown} ${n + 2}")
    return out


def _words_read(text: Column) -> Column:
    """Misread words put right; a capital at their start stays, the rest is written small."""
    words = F.create_map(*[F.lit(x) for wrong, right in MISREAD.items() if " " not in wrong for x in (wrong, right)])
    out = text
    for wrong, right in MISREAD.items():  # those of two words can't be looked up word by word
        if " " in wrong:
            out = F.regexp_replace(F.regexp_replace(out, rf"\b{wrong.capitalize()}\b", right.capitalize()), rf"(?i)\b{wrong}\b", right)

    def read(piece: Column) -> Column:
        right = words[F.lower(piece)]
        return F.coalesce(F.when(F.substring(piece, 1, 1).rlike("[A-Z]"), F.initcap(right)).otherwise(right), piece)

    return F.array_join(F.transform(_pieces(out), read), "")


def ocr_corrected(text: Column) -> Column:
    """OCR text with blanks, lengths, digits, bearings, units and known words put right, in this order.

    Texts under five characters stay as they are.
    """
    out = F.regexp_replace(text, " +", " ")
    units = "|".join(FEET[:3])
    out = F.regexp_replace(out, rf"(?i)(?<=\d) (?=\d+\.\d+\s*(?:{units})\b)", "")  # a length torn at a blank
    out = _bearings_read(_numbers_read(out))
    out = F.regexp_replace(out, r"(?i)\bft\b\.?", "feet")
    return F.when(F.length(F.trim(text)) < 5, text).otherwise(_words_read(out))


def correction_count(before: Column, after: Column) -> Column:
    """Characters that differ place by place, and the difference in length."""
    a, b = F.split(before, ""), F.split(after, "")
    n = F.least(F.length(before), F.length(after))
    differ = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.get(a, i - 1) != F.get(b, i - 1))))
    return differ + F.abs(F.length(before) - F.length(after))


#: A neighbour's name comes after one of: something held or a line, with `of`; `bounded` or a side, with `by`; a side alone; a verb; a
#: common corner.  FILLERS may stand before it, one of STOPS or a mark behind it.
HELD = ("land", "lands", "property", "estate", "heirs", "line", "boundary", "fence", "corner")
FILLERS = ("the", "of", "by", "or", "heirs", "land", "lands", "property", "estate")
STOPS = ("on", "bounded", "thence", "and", "to")
#: What must stand behind a name that follows `along` alone.
HOLDINGS = ("property", "tract", "land", "parcel", "line", "fence")

#: A name with one of these in it is no person's.
NO_NAME = (
    "the said above herein grantor grantee county state new mexico united states government public road street acequia ditch right way river "
    "creek arroyo unknown parties record described following certain north south east west northerly southerly easterly westerly northeast "
    "northwest southeast southwest tract parcel lot block section survey plat beginning thence along point corner line boundary thereof therein "
    "portion remainder being lying taos santa bernalillo subdivision addition unit phase"
).split()


def title_case(text: Column) -> Column:
    """A capital after anything that is no letter, so also after an apostrophe or a dash."""
    pieces = found(text, r"([A-Za-z]+|[^A-Za-z]+)")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def _parties(text: Column) -> Column:
    """What stands where a neighbour's name would, in the order of the text: one walk over its words and marks.

    The walk remembers the word before, what it is doing (0 reads on, 1 has met a relation and passes over fillers, 2 collects a
    name), whether `along` began it, the name so far and the names found.
    """
    tokens = found(text, r"([A-Za-z][A-Za-z.'-]*|[,;\n]|[0-9]+)")
    none = F.array().cast("array<string>")
    state = lambda last, doing, along, name, names: F.struct(last.alias("last"), doing.alias("doing"), along.alias("along"), name.alias("name"), names.alias("names"))
    side = lambda w: F.substring(w, 1, 4).isin("nort", "sout", "east", "west")

    def step(s: Column, token: Column) -> Column:
        w, last = F.lower(token), s["last"]
        relation = ((w == "of") & last.isin(*HELD)) | ((w == "by") & ((last == "bounded") | side(last))) | side(w)
        relation |= w.isin("adjoin", "adjoins", "formerly") | ((w == "to") & (last == "common")) | ((w == "with") & (last == "corner"))
        stop = w.isin(*STOPS, ",", ";", "\n") | F.substring(w, 1, 1).between("0", "9")
        return let(F.struct(w.alias("w"), relation.alias("relation"), stop.alias("stop")), lambda seen: moved(s, token, seen["w"], seen["relation"], seen["stop"]))

    def moved(s: Column, token: Column, w: Column, relation: Column, stop: Column) -> Column:
        collecting, begin = s["doing"] == 2, relation | (w == "along")
        done = collecting & F.when(s["along"], w.isin(*HOLDINGS)).otherwise(stop | relation)
        doing = F.when(begin, 1).when(stop | done | (s["doing"] == 0), 0).when((s["doing"] == 1) & w.isin(*FILLERS), 1).otherwise(2)
        name = F.when(collecting, F.concat_ws(" ", s["name"], token)).otherwise(token)
        return state(w, doing, F.when(begin, w == "along").otherwise(s["along"]), name, F.when(done, F.array_append(s["names"], s["name"])).otherwise(s["names"]))

    begin = state(F.lit(""), F.lit(0), F.lit(False), F.lit(""), none)
    return F.aggregate(F.concat(tokens, F.array(F.lit(";"))), begin, step, lambda s: s["names"])


def adjoiner_names(text: Column) -> Column:
    """Distinct names of neighbours in a description, in the order of the text.

    A name has 3 to 51 characters, and none of NO_NAME in it.
    """
    names = F.transform(_parties(text), lambda n: title_case(F.rtrim(n, F.lit(".' -"))))
    noise = F.array(*[F.lit(w) for w in NO_NAME])
    good = F.filter(names, lambda n: F.length(n).between(3, 51) & ~F.exists(noise, lambda w: F.contains(F.lower(n), w)))
    return F.array_distinct(good)


#: Phrases at which a description starts, kind by kind, and the letters that one must have to count.
STARTS = (
    ("legal description", "property description", "description of property", "description of the property"),
    ("described as follows", "more particularly described as"),
    ("to wit",),
)
LEAST_LETTERS, SHORT_TEXT, LEAST_PARAGRAPH, NO_TEXT = 30, 2000, 100, 20
#: A line that begins so ends a description under a heading; any of ENDS one that starts at a corner.
NEXT_PARTS = (
    "in witness", "witness whereof", "excepting", "subject to", "together with", "this conveyance", "grantor reserves", "county of", "state of", "notary", "acknowledgment",
)
CORNERS = ("beginning at ", "commencing at ")
ENDS = (" containing", " subject to", " together with", " except ", " reserving ", " said land ", " in witness ")
LAND_WORDS = ("beginning", "thence", "lot", "block", "tract", "section", "township")


def _place(low: Column, phrases: tuple[str, ...], begin: Column | None = None) -> Column:
    """Where the first of the phrases starts, from begin on; null without one."""
    places = [F.nullif(F.position(F.lit(p), low, F.lit(1) if begin is None else begin), F.lit(0)) for p in phrases]
    return F.least(*places) if len(places) > 1 else places[0]


def legal_description(text: Column) -> Column:
    """The legal description of a deed: after a heading, else from BEGINNING or COMMENCING on, else the whole of a short text.

    A longer text without either gives its first paragraph that looks like a description, else its first 2000 characters.  Blanks
    count as one, and none at the ends of lines; texts of almost nothing stay as they are.
    """
    tidy = F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+", " "), r" ?\n ?", "\n"), F.lit(" \n"))

    def isolated(t: Column) -> Column:
        bare, low, lines = t["bare"], t["low"], t["lines"]
        upto = lambda start, end: F.trim(F.substring(bare, start, F.coalesce(end, F.length(bare) + 1) - start), F.lit(" :\n"))

        def headed(phrases: tuple[str, ...]) -> Column:
            length = lambda at: F.greatest(*[F.when(F.substring(low, at, F.lit(len(p))) == p, len(p)).otherwise(0) for p in (*phrases, "")])
            start = let(_place(low, phrases), lambda at: at + length(at))
            part = let(start, lambda s: upto(s, _place(lines, tuple(f"\n{p}" for p in NEXT_PARTS), s)))
            return let(part, lambda x: F.when(F.length(x) > LEAST_LETTERS, x))

        body = let(_place(low, CORNERS), lambda at: upto(at, _place(low, ENDS, at)))
        paragraphs = F.transform(F.split(bare, "\n\n"), lambda p: F.trim(p))
        land = F.filter(paragraphs, lambda p: (F.length(p) > LEAST_PARAGRAPH) & F.greatest(*[F.contains(F.lower(p), F.lit(w)) for w in LAND_WORDS]))
        chosen = F.coalesce(*map(headed, STARTS), body, F.when(F.length(bare) < SHORT_TEXT, bare), F.get(land, 0), F.trim(F.substring(bare, 1, SHORT_TEXT)))
        return F.when(F.length(bare) < NO_TEXT, text).otherwise(chosen)

    # a phrase may be broken over lines
    return let(tidy, lambda bare: let(F.struct(bare.alias("bare"), F.lower(F.translate(bare, "\n", " ")).alias("low"), F.lower(bare).alias("lines")), isolated))


def file_stem(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\.[^.]*$", ""))


def display_name(name: Column) -> Column:
    """The owner in `195554.001   Adela Rael.PDF`; the whole stem if nothing is left."""
    stem = file_stem(name)
    bare = F.trim(F.regexp_replace(stem, r"^\d+(?:\.\d+)?\s+", ""))
    return F.when(bare != "", bare).otherwise(stem)


def doc_number(name: Column) -> Column:
    return F.regexp_extract(file_stem(name), r"^(\d+)", 1)


#: Letters with marks and the bare ones they count as (fixed values).
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñç"
BARE = "aaaaaaeeeeiiiiooooouuuunc"


def normal_name(name: Column) -> Column:
    """Lower case, no accents, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), MARKED, BARE), r"\s+", " "))


#: Name parts that are no names.
PARTICLES = ("de", "la", "los", "las", "del", "da", "di")


def name_variants(person: Column) -> Column:
    """Ways in which a file may write a person: as given, without comma, turned round, and single words of some length."""
    norm = normal_name(person)
    flat = F.trim(F.regexp_replace(F.replace(norm, F.lit(","), F.lit(" ")), r"\s+", " "))
    halves = F.transform(F.split(norm, ",", 2), lambda h: F.trim(h))
    words = F.filter(F.split(flat, " "), lambda w: w != "")
    comma = norm.contains(",")
    turned = F.when(comma, F.concat_ws(" ", F.get(halves, 1), F.get(halves, 0))).otherwise(
        F.when(F.size(words) >= 2, F.concat_ws(" ", F.slice(words, F.lit(2), F.size(words)), F.slice(words, 1, 1)))
    )
    singles = F.filter(words, lambda w: (F.length(w) >= F.when(comma, 4).otherwise(3)) & ~w.isin(*PARTICLES))
    parts = F.when(comma, halves).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(norm, flat, turned), parts, singles)
    return F.array_distinct(F.filter(every, lambda v: v.isNotNull() & (F.length(v) >= 3)))


def token_overlap(words: Column, name: Column) -> Column:
    """Share in per cent of the words that stand in a file name, half for those inside another word."""
    own = F.split(name, r"[\s,._-]+")
    whole = F.size(F.filter(words, lambda w: F.array_contains(own, w)))
    part = F.size(F.filter(words, lambda w: ~F.array_contains(own, w) & F.contains(name, w)))
    return F.when(F.size(words) > 0, F.least(F.lit(100), F.floor((whole + part * 0.5) / F.size(words) * 100))).otherwise(0).cast("int")


def plat_name_tokens(plat: Column) -> Column:
    """The name of a plat field after its cabinet reference, then its last name and its longer words."""
    name = F.trim(F.regexp_replace(plat, r"(?i)^(.*?)(?:CAB(?:INET)?\.?\s*)?[A-F]\s*-\s*\d{1,4}(?:-[A-Z])?\s*", "$1"))
    last = F.trim(F.substring_index(name, ",", 1))
    noise = ("AND", "THE", "DEL", "LOS", "LAS", "DES", "EST", "CORP", "LLC")
    words = F.filter(F.split(name, r"[\s,;&]+"), lambda w: (F.length(w) >= 4) & ~F.upper(w).isin(*noise))
    last_ = F.when(F.length(last) >= 3, F.array(last)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(name) >= 3, F.array_distinct(F.concat(F.array(name), last_, words))).otherwise(F.array().cast("array<string>"))


def cabinet_files(listing: DataFrame) -> DataFrame:
    """Index rows of a listing (cabinet, file, path): PDF files with display name, normalised name and document number."""
    pdf = listing.filter(F.lower("file").endswith(".pdf"))
    return pdf.select("cabinet", "file", "path", display_name(F.col("file")).alias("display"), normal_name(display_name(F.col("file"))).alias("name_norm"), normal_name(F.col("file")).alias("file_norm"), doc_number(F.col("file")).alias("doc_number"))


def page_keys(cabinet: Column, file: Column) -> Column:
    """What may stand as a page behind the cabinet's name in a file's name, lower case: every piece from there to where a word ends.

    The name must not follow a letter; one hyphen or blank may stand between.
    """
    name, low = F.lower(cabinet), F.lower(file)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: (F.substring(low, i, F.length(name)) == name) & ~F.when(i > 1, F.substring(low, i - 1, F.lit(1))).otherwise("").rlike("[a-z]"))
    behind = F.transform(places, lambda i: F.substring(low, i + F.length(name), F.length(low)))
    rests = F.concat(behind, F.transform(F.filter(behind, lambda r: r.rlike("^[- ]")), lambda r: F.substring(r, F.lit(2), F.length(r))))
    ends = lambda r: F.filter(F.sequence(F.lit(1), F.length(r)), lambda j: ~F.substring(r, j + 1, F.lit(1)).rlike("[a-z0-9]"))
    pieces = F.transform(F.filter(rests, lambda r: r != ""), lambda r: F.transform(ends(r), lambda j: F.substring(r, F.lit(1), j)))
    return F.when(F.length(name) > 0, F.array_distinct(F.flatten(pieces))).otherwise(F.array().cast("array<string>"))


#: Files and requests of one key that meet at once, about.
BLOCK_ROWS = 2000
#: Pairs of a file and a request that count as one row where tasks are dealt out: they are made and passed on, not held.
PAIRS_A_ROW = 16


def search_cabinet(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Files for requests (request, cabinet, doc, grantor, grantee): by document number, else by name, else by page reference.

    Adds strategy, weight and nth, the place within the request, best first.  A request with a hit by number gets no others; a file
    that has a variant of a name in it is no page hit.  Requests without a cabinet find nothing.  Rows of one request and cabinet count
    as one request with all their numbers, pages and names.

    What is found may grow with files times requests, so a pair is made last and never shuffled.  The variants are looked up in
    an index of the cabinet's names, and each file gets those that stand in it.  A file then has keys (number, variant or page), and each
    variant goes with the better ones of the same file, each page with all of them: a request that has one of those gets the file by a better
    key, and so every pair comes from one key alone.  Requests that ask alike are one row till the end.  Keys with many files or requests are
    dealt out in blocks.
    """
    spark, none = files.sparkSession, F.array().cast("array<string>")
    own = stored(files.withColumn("__row", F.monotonically_increasing_id()), "files")
    people = F.array_compact(F.array("grantor", "grantee"))
    asked = requests.select(
        "request", "cabinet", F.lower(F.trim(F.coalesce("doc", F.lit("")))).alias("__doc"), F.flatten(F.transform(people, name_variants)).alias("__variants"),
        F.filter(F.flatten(F.transform(people, lambda p: F.split(normal_name(p), r"[\s,]+"))), lambda w: (F.length(w) >= 3) & ~w.isin(*PARTICLES)).alias("__words"),
    ).filter("cabinet IS NOT NULL")
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    asked = stored(asked.groupBy("request", "cabinet").agg(F.collect_list("__doc").alias("__docs"), every("__variants"), every("__words")), "cabinet-requests")
    numbers = asked.select("request", "cabinet", F.explode("__docs").alias("__doc")).select("request", "cabinet", F.regexp_replace("__doc", "[^0-9]", "").alias("doc_number")).filter("doc_number <> ''")
    served = numbers.join(own.select("cabinet", "doc_number"), ["cabinet", "doc_number"], "left_semi").select("request").distinct()
    rest = stored(asked.join(served, "request", "left_anti"), "cabinet-rest")

    names = F.when(F.contains("file_norm", "name_norm"), F.array("file_norm")).otherwise(F.array("file_norm", "name_norm"))
    variants = rest.select("cabinet", F.explode("__variants").alias("__variant")).distinct()
    met = containing(own.select("cabinet", "__row", F.explode(names).alias("__form")), "__form", variants, "__variant", by=("cabinet",))
    held = met.groupBy("__row").agg(F.collect_set("__variant").alias("__held"))
    known = own.join(held, "__row", "left").withColumn("__held", F.coalesce("__held", none)).withColumn("__pages", page_keys(F.col("cabinet"), F.col("file")))
    known = stored(known, "cabinet-files")

    def keyed(kind: int, value: Column, barred: Column) -> Column:
        return F.struct(F.lit(kind).alias("__kind"), value.alias("__key"), barred.alias("__barred"))

    better = lambda v: F.filter("__held", lambda h: (F.length(h) > F.length(v)) | ((F.length(h) == F.length(v)) & (h < v)))
    keys = F.concat(F.array(keyed(0, F.col("doc_number"), none)), F.transform("__held", lambda v: keyed(1, v, better(v))), F.transform("__pages", lambda p: keyed(2, p, F.col("__held"))))
    listed = known.select(*files.columns, "__row", F.inline(keys)).filter("cabinet IS NOT NULL AND __key <> ''")
    wanted = numbers.select("request", "cabinet", F.lit(0).alias("__kind"), F.col("doc_number").alias("__key"), none.alias("__variants"), none.alias("__words"))
    wanted = wanted.unionByName(rest.select("request", "cabinet", F.lit(1).alias("__kind"), F.explode("__variants").alias("__key"), "__variants", "__words"))
    wanted = wanted.unionByName(rest.select("request", "cabinet", F.lit(2).alias("__kind"), F.explode("__docs").alias("__key"), "__variants", none.alias("__words")).filter("__key <> ''"))

    key = ["cabinet", "__kind", "__key"]
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    sizes = wanted.groupBy(*key).agg(F.count("*").alias("__r"))
    sizes = stored(known.select("cabinet", "__row", F.inline(keys)).groupBy(*key).agg(F.count("*").alias("__f")).join(sizes, key), "cabinet-keys")
    pairs = sizes.agg(F.coalesce(F.sum(F.col("__f") * F.col("__r")), F.lit(0))).first()[0]
    sizes = broadcast_if_small(sizes.select(*key, blocks("__f").alias("__fs"), blocks("__r").alias("__rs")), 64)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    listed = listed.join(sizes, key).withColumn("__a", dealt("__row", "__fs")).withColumn("__b", spread("__rs")).drop("__fs", "__rs")
    alike = wanted.join(sizes, key).withColumn("__b", dealt("request", "__rs")).groupBy(*key, "__variants", "__words", "__b", "__fs").agg(F.collect_list("request").alias("__requests"))
    alike = alike.withColumn("__a", spread("__fs")).drop("__fs")

    on, tasks = [*key, "__a", "__b"], tasks_for(spark, pairs // PAIRS_A_ROW)
    found = listed.repartition(tasks, *on).join(alike.repartition(tasks, *on).hint("merge"), on).filter(~F.arrays_overlap("__barred", "__variants"))
    kind = F.col("__kind")
    weight = F.when(kind == 0, 1000).when(kind == 1, F.length("__key") + token_overlap(F.col("__words"), F.col("name_norm"))).otherwise(0).cast("int")
    found = found.withColumn("weight", weight).withColumn("strategy", F.when(kind == 0, "doc_number").when(kind == 1, "name_match").otherwise("page_ref")).withColumn("request", F.explode("__requests"))
    nth = F.row_number().over(Window.partitionBy("request").orderBy(kind, F.desc("weight"), "file", "__row"))
    return found.select("request", *files.columns, "strategy", "weight", nth.alias("nth"))
