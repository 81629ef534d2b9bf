"""Research steps over many jobs at once: deed cross-references, discovery by strategies, enriched order, statistics, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.functions import text as T
from parcelworks.functions.scores import search_relevance
from parcelworks.operators.matching import beginning_with, containing
from parcelworks.operators.search import is_deed_type, is_survey_type, text
from parcelworks.storage import stored, tasks_for

#: Points and the most rows of each rule of the cross-reference, and its whole length.
MAP_PICK, NAME_HITS, PAGE_HITS, CABINET_HITS, CROSS_LIMIT = (100, 1), (10, 10), (50, 5), (30, 5), 30


def last_name(person: Column) -> Column:
    """The upper-case name before a comma, else the first word."""
    name = F.upper(F.trim(F.coalesce(person, F.lit(""))))
    return F.trim(F.when(name.contains(","), F.substring_index(name, ",", 1)).otherwise(F.substring_index(name, " ", 1)))


def _first(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first rows by pos for each of the keys."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return rows.withColumn("__nth", nth).filter(F.col("__nth") <= limit).drop("__nth")


def cross_reference(deeds: DataFrame, parcels: DataFrame, limit: int = CROSS_LIMIT) -> DataFrame:
    """(deed, upc, score, reasons, nth): the parcels a deed may speak of, best first, at most ``limit`` a deed.

    deeds: deed, grantor, grantee, location, map_upc, body; parcels: pos, upc, owner, book, page, cab_refs.  Four rules
    add up: the parcel picked on the map; owners that contain the grantor's or the grantee's last name of three letters or more;
    the book and page of the location; every cabinet reference in the deed's fields.  A rule gives its first parcels in listing
    order, and of one parcel as often as it hits.  Parcels without a upc are left out.  The deeds' distinct last names are looked up
    in an index of the owners' letters; the other rules are equi-joins.  Nulls hit nothing.
    """
    known = parcels.filter("upc IS NOT NULL AND upc <> ''").select("pos", "upc", text(parcels, "owner").alias("__owner"), "book", "page", "cab_refs")
    hit = lambda rows, rule, reason, n: rows.select("deed", "upc", F.lit(rule[0]).alias("score"), F.lit(reason).alias("reason"), F.lit(n).alias("__rule"), "pos")
    picked = _first(deeds.select("deed", F.col("map_upc").alias("__upc")).join(known, F.col("__upc") == F.col("upc")), ["deed"], MAP_PICK[1])
    found = [hit(picked, MAP_PICK, "map pick", 0)]
    for n, side in enumerate(("grantor", "grantee"), 1):
        asked = deeds.select("deed", last_name(F.col(side)).alias("__name")).filter(F.length("__name") >= 3)
        names = asked.select("__name").distinct()
        met = _first(containing(known, "__owner", names, "__name"), ["__name"], NAME_HITS[1])
        found.append(hit(asked.join(met, "__name"), NAME_HITS, f"{side} name", n))
    book, page = T.book_page(F.col("location"))
    asked = deeds.select("deed", book.alias("book"), page.alias("page")).filter("book IS NOT NULL")
    places = _first(asked.select("book", "page").distinct().join(known, ["book", "page"]), ["book", "page"], PAGE_HITS[1])
    found.append(hit(asked.join(places, ["book", "page"]), PAGE_HITS, "book-page", 3))
    every = F.array_distinct(F.concat(*[T.plat_cabinet_refs(F.col(c)) for c in ("grantor", "grantee", "location", "body")]))
    asked = deeds.select("deed", F.explode(every).alias("__ref"))
    listed = known.withColumn("__ref", F.explode("cab_refs")).join(asked.select("__ref").distinct(), "__ref")
    found.append(hit(asked.join(_first(listed, ["__ref"], CABINET_HITS[1]), "__ref"), CABINET_HITS, "cabinet", 4))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    sums = hits.groupBy("deed", "upc").agg(
        F.sum("score").alias("score"), F.sort_array(F.collect_list(F.struct("__rule", "pos", "reason"))).alias("__own"), F.min(F.struct("__rule", "pos")).alias("__first")
    )
    nth = F.row_number().over(Window.partitionBy("deed").orderBy(F.desc("score"), "__first", "upc"))
    best = sums.withColumn("nth", nth).filter(F.col("nth") <= limit)
    return best.select("deed", "upc", "score", F.array_join(F.transform("__own", lambda x: x["reason"]), " + ").alias("reasons"), "nth")


def enriched_search(rows: DataFrame, client: dict[str, str], by: str = "relevance") -> DataFrame:
    """Search rows with relevance and tags for a client, ordered by relevance, date (as text, latest first) or type.

    rows: pos and the columns of search_relevance.  Types come as deed, plat, survey, other, by their first word.
    """
    score, tags = search_relevance({c: F.col(c) for c in ("grantor", "grantee", "location", "instrument_type", "recorded_date")}, client)
    out = rows.withColumn("relevance", score).withColumn("tags", tags)
    word = F.lower(F.substring_index(F.trim(F.coalesce("instrument_type", F.lit(""))), " ", 1))
    rank = F.when(word.contains("deed"), 0).when(word.contains("plat"), 1).when(word.contains("survey"), 2).otherwise(3)
    order = {"relevance": [F.desc("relevance")], "date": [F.coalesce("recorded_date", F.lit("")).desc()], "type": [rank]}[by]
    return out.orderBy(*order, "pos")


def global_stats(sessions: DataFrame) -> DataFrame:
    """One row over session metrics (adjoiner_count, deed_count, plat_count, completion_pct, file_date): counts, sums, means, median, range.

    An even number of rows has its median rounded to one decimal, as the means are.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c.split('_')[0]}s")
    out = sessions.agg(
        F.count("*").alias("n"), total("adjoiner_count"), total("deed_count"), total("plat_count"), F.round(F.avg("adjoiner_count"), 1).alias("avg_adjoiners"),
        F.median("adjoiner_count").alias("__median"), F.max("adjoiner_count").alias("max_adjoiners"), F.round(F.avg("completion_pct"), 1).alias("avg_completion"),
        F.min("file_date").alias("first_date"), F.max("file_date").alias("last_date"),
    )
    median = F.when(F.col("n") % 2 == 1, F.col("__median")).otherwise(F.round("__median", 1))
    return out.withColumn("median_adjoiners", median).drop("__median")


def incomplete(sessions: DataFrame, below: float = 50.0) -> DataFrame:
    """Sessions with adjoiners of which fewer than ``below`` per cent are complete."""
    return sessions.filter((F.col("completion_pct") < below) & (F.col("adjoiner_count") > 0))


def newer_files(files: DataFrame, built: DataFrame) -> DataFrame:
    """files (path, modified) that are younger than the index (one row: built_at); all of them if there is none."""
    one = built.agg(F.max("built_at").alias("__built"))
    return files.crossJoin(F.broadcast(one)).filter(F.col("__built").isNull() | (F.col("modified") > F.col("__built"))).drop("__built")  # one row


def stale_cabinets(folders: DataFrame, index: DataFrame) -> DataFrame:
    """Cabinets of folders (cabinet, modified) whose index (cabinet, indexed_at) is missing or of another time; those get rebuilt."""
    own = index.groupBy("cabinet").agg(F.max("indexed_at").alias("__at"))
    return folders.join(own, "cabinet", "left").filter(~F.col("modified").eqNullSafe(F.col("__at"))).select("cabinet", "modified")


def recent_jobs(folders: DataFrame, limit: int = 10) -> DataFrame:
    """The youngest job folders (path, name, modified): job number and client of `1234 NAME`, type BDY where the name says none."""
    parts = F.regexp_extract("name", r"^(\d+)\s*-?\s*(.*)$", 1), F.regexp_extract("name", r"^(\d+)\s*-?\s*(.*)$", 2)
    kind = F.upper(F.regexp_extract("name", r"\b([A-Z]{3})$", 1))
    rows = folders.filter(parts[0] != "").select("path", parts[0].cast("int").alias("job_number"), F.trim(parts[1]).alias("client_name"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("BDY")).alias("job_type"), "modified")
    return rows.orderBy(F.desc("modified"), "path").limit(limit)


def first_archive(candidates: DataFrame) -> DataFrame:
    """Of each archive's candidate files (archive, rank, path, found) the first that is there."""
    return candidates.filter("found").groupBy("archive").agg(F.min_by("path", "rank").alias("path"))


def book_page_cabinets(deeds: DataFrame, parcels: DataFrame) -> DataFrame:
    """(deed, letter): the cabinets of the parcels that a deed's book and page name; deeds: deed, location.

    A page's parcels come down to their set of letters before deeds meet it, so a deed is joined with one row a page.
    """
    book, page = T.book_page(F.col("location"))
    asked = deeds.select("deed", book.alias("book"), page.alias("page")).filter("book IS NOT NULL")
    refs = parcels.select("book", "page", F.explode("cab_refs").alias("__ref"))
    letters = refs.select("book", "page", F.upper(F.substring("__ref", 1, 1)).alias("letter")).filter("letter <> ''").distinct()
    pages = letters.groupBy("book", "page").agg(F.collect_set("letter").alias("letters"))
    return asked.join(pages, ["book", "page"]).select("deed", F.explode("letters").alias("letter")).distinct()


def discovered(sources: list[tuple[DataFrame, int | None]], per: str = "job", name: str = "name", few: int = 10) -> DataFrame:
    """Names found for each job, first wins by lower case: an ordered union of sources (job, name, pos), each with its cap.

    The last source is asked only for jobs that have fewer than ``few`` names by then.  Adds prio, the source's number.
    """
    tagged = None
    for n, (rows, cap) in enumerate(sources[:-1]):
        own = rows if cap is None else _first(rows, [per], cap)
        own = own.select(per, name, "pos", F.lit(n).alias("prio"))
        tagged = own if tagged is None else tagged.unionByName(own)
    key = F.lower(F.trim(name))

    def first_wins(rows: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(per, "__key").orderBy("prio", "pos"))
        return rows.filter(F.trim(name) != "").withColumn("__key", key).withColumn("__nth", nth).filter("__nth = 1").drop("__nth", "__key")

    offline = first_wins(tagged)
    enough = offline.groupBy(per).agg(F.count("*").alias("__n")).filter(F.col("__n") >= few).select(per)
    rows, cap = sources[-1]
    last = (rows if cap is None else _first(rows, [per], cap)).join(enough, per, "left_anti")
    return first_wins(tagged.unionByName(last.select(per, name, "pos", F.lit(len(sources) - 1).alias("prio"))))


def plats_of_client(plats: DataFrame, clients: DataFrame, limit: int = 15) -> DataFrame:
    """(client, upc, pos, picked): parcels whose owner contains the client's last name of two letters or more, the map's pick first.

    plats: pos, upc, owner; clients: client, name, map_upc.  The picked parcel stands once, at the head.
    """
    owners = plats.select("pos", "upc", text(plats, "owner").alias("__owner"))
    asked = clients.select("client", last_name(F.col("name")).alias("__name"), "map_upc")
    names = asked.filter(F.length("__name") >= 2)
    distinct = names.select("__name").distinct()
    by_name = names.join(_first(containing(owners, "__owner", distinct, "__name"), ["__name"], limit), "__name")
    by_name = by_name.filter(F.col("map_upc").isNull() | (F.col("upc") != F.col("map_upc"))).select("client", "upc", "pos", F.lit(False).alias("picked"))
    picked = _first(asked.join(owners, asked["map_upc"] == owners["upc"]), ["client"], 1).select("client", "upc", "pos", F.lit(True).alias("picked"))
    return picked.unionByName(by_name)


def bulk_deed_match(subjects: DataFrame, deeds: DataFrame) -> DataFrame:
    """(subject, doc_no, way): the best deed for each adjoiner without one.

    subjects: subject, name, deed_saved; deeds: doc_no, grantor, grantee, instrument_type, recorded_date.  Names `UPC …` are
    passed over.  Parties that begin with the whole name come before those that begin with the last name; deed types and empty
    types count alone; then deed_priority decides, then the smaller date text and document number.  Deeds are reduced to the best
    of each party and last name before subjects meet them; whole names are looked up in a prefix index of the parties.
    """
    from parcelworks.functions.scores import deed_priority, record_year

    pending = subjects.filter(~F.coalesce("deed_saved", F.lit(False)) & ~F.upper(F.trim("name")).startswith("UPC "))
    pending = pending.select("subject", F.upper(F.trim("name")).alias("__full"), last_name(F.col("name")).alias("__last")).filter("__last <> ''")
    kind = F.trim(F.coalesce("instrument_type", F.lit("")))
    usable = deeds.filter((kind == "") | is_deed_type(kind))
    party = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    sides = usable.select("*", F.explode(F.array(F.struct(F.lit("grantee").alias("s"), party(F.col("grantee")).alias("p")), F.struct(F.lit("grantor").alias("s"), party(F.col("grantor")).alias("p")))).alias("__side"))
    score = deed_priority(F.col("instrument_type"), F.col("__side.s") == "grantee", F.col("__side.s") == "grantor", record_year(F.col("recorded_date")))
    order = F.struct((-score).alias("s"), F.coalesce("recorded_date", F.lit("")).alias("d"), F.coalesce("doc_no", F.lit("")).alias("n"))
    # the best deed of each party, then of each last name: what subjects meet no longer grows with a name's deeds
    parties = sides.select(F.col("__side.p").alias("__party"), last_name(F.col("__side.p")).alias("__key"), order.alias("__order"), "doc_no")
    parties = stored(parties.groupBy("__party", "__key").agg(F.min("__order").alias("__order"), F.min_by("doc_no", "__order").alias("doc_no")), "parties")
    by_last = parties.groupBy(F.col("__key").alias("__last")).agg(F.min_by("doc_no", "__order").alias("__last_doc"))
    # a party that begins with a whole name counts if its own last name is the name's
    whole = beginning_with(parties, "__party", pending.select("__full").distinct(), "__full")
    by_full = whole.groupBy("__full", F.col("__key").alias("__last")).agg(F.min_by("doc_no", "__order").alias("__full_doc"), F.lit(True).alias("__has_full"))
    rows = pending.join(by_last, "__last").join(by_full, ["__full", "__last"], "left")
    full = F.col("__has_full").isNotNull()
    return rows.select("subject", F.when(full, F.col("__full_doc")).otherwise(F.col("__last_doc")).alias("doc_no"), F.when(full, "full name").otherwise("last name").alias("way"))


def trs_consistency(jobs: DataFrame) -> DataFrame:
    """Jobs (job, client_trs, adjoiner_trs, arrays) whose client has one place and shares none with its adjoiners: a warning."""
    apart = (F.size("client_trs") == 1) & (F.size("adjoiner_trs") > 0) & ~F.arrays_overlap("client_trs", "adjoiner_trs")
    return jobs.filter(apart).select("job", F.lit("warn").alias("severity"), F.get("client_trs", 0).alias("client"), F.array_join("adjoiner_trs", ", ").alias("adjoiners"))


def iqr_outliers(frame: DataFrame, group: str, value: str, id_: str, factor: float = 1.5) -> DataFrame:
    """(id, group, value): rows beyond ``factor`` times the distance of the indexed quartiles from them; groups of four rows at least."""
    from parcelworks.operators.stats import indexed_quartiles

    q = indexed_quartiles(frame, group, value).filter("n >= 4").select(F.col(group).alias("__g"), "q1", "q3")
    wide = factor * (F.col("q3") - F.col("q1"))
    met = frame.join(q, F.col(group).eqNullSafe(F.col("__g")))
    return met.filter((F.col(value) < F.col("q1") - wide) | (F.col(value) > F.col("q3") + wide)).select(id_, group, value)


#: How sure a way of finding a plat is.
PLAT_CONFIDENCE = {"exact_ref": 97, "deed_ref": 92, "page_ref": 90, "parcel_ref": 82, "client_name": 65, "adjoiner_name": 55, "prev_owner": 35, "broad": 25}


def plat_confidence(strategy: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PLAT_CONFIDENCE.items() for x in pair]), strategy), F.lit(20))


def goal_reached(years: Column, goal: Column) -> Column:
    """Whether a chain's earliest year is at the goal or before it; null without years."""
    return F.array_min(years) <= goal


def top_classes(names: Column, probabilities: Column, n: int = 3) -> Column:
    """The n likeliest classes as array<struct<p,name>>, likeliest first; of equals the later name."""
    return F.slice(F.sort_array(F.zip_with(probabilities, names, lambda p, c: F.struct(p.alias("p"), c.alias("name"))), asc=False), 1, n)


def grid_step(width: Column, lines: int = 10) -> Column:
    """The step of a map's grid: 1, 2, 5 or 10 times a power of ten, the first that needs at most ``lines`` steps."""
    raw = width / lines
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = F.round(raw / power, 9)
    return F.when(width > 0, power * F.when(part <= 1, 1).when(part <= 2, 2).when(part <= 5, 5).otherwise(10))


def fill_class(upc: Column, owner: Column, highlighted: Column, board: Column) -> Column:
    """highlight, board (an owner on the board) or none."""
    return F.when(F.array_contains(highlighted, upc), "highlight").when(F.array_contains(board, F.upper(owner)), "board").otherwise("none")


def address(parts: dict[str, Column]) -> Column:
    """A record's address: address1, else number and street, else all parts but the zip code, else `No address`.

    parts: address1, number, street, city, state, zip.
    """
    given = {k: F.nullif(F.trim(c.cast("string")), F.lit("")) for k, c in parts.items()}
    joined = lambda *names: F.nullif(F.concat_ws(" ", *[given[n] for n in names]), F.lit(""))
    street = F.when(given["number"].isNotNull() & given["street"].isNotNull(), joined("number", "street"))
    return F.coalesce(given["address1"], street, joined("number", "street", "city", "state"), F.lit("No address"))


#: The fields of a deed's record that say the same, first the one that counts.
ALIASES = {
    "doc_no": ("doc_no", "Document Number", "Doc No"),
    "grantor": ("Grantor", "Grantors", "From"),
    "grantee": ("Grantee", "Grantees", "To"),
    "recorded": ("Recorded Date", "Record Date"),
    "dated": ("Instrument Date", "Document Date"),
    "kind": ("Instrument Type", "Document Type", "Type"),
    "price": ("Consideration", "Amount", "Sale Price"),
}
LEGAL_FIELDS = ("Other_Legal", "Subdivision_Legal", "Legal Description", "Legal", "Description")


def deed_summary(fields: Column) -> dict[str, Column]:
    """A deed's record (map<string,string>) in one form: the first given value of each kind, distinct parties and dates, legal text.

    Prices of nothing are dropped; legal texts are joined in the order of LEGAL_FIELDS.
    """
    given = lambda name: F.nullif(F.trim(F.try_element_at(fields, F.lit(name))), F.lit(""))
    first = {k: F.coalesce(*map(given, names)) for k, names in ALIASES.items()}
    nothing = F.regexp_replace(first["price"], r"[$,\s]", "").rlike(r"^0*(?:\.0*)?$")
    party = lambda label, names: [F.when(given(n).isNotNull(), F.struct(F.lit(label).alias("label"), given(n).alias("value"))) for n in names]
    parties = F.array_distinct(F.array_compact(F.array(*party("grantor", ALIASES["grantor"]), *party("grantee", ALIASES["grantee"]))))
    dates = F.array_distinct(F.array_compact(F.array(*map(given, (*ALIASES["recorded"], *ALIASES["dated"])))))
    legal = F.array_distinct(F.array_compact(F.array(*map(given, LEGAL_FIELDS))))
    return first | {"price": F.when(~nothing, first["price"]), "parties": parties, "dates": dates, "legal": F.array_join(legal, "; ")}


def trs_parameters(trs: Column) -> Column:
    """`T=26N&R=13E&S=12` of a reference, encoded for an address; the empty text if it is none."""
    part = lambda p: F.upper(F.regexp_extract(trs, p, 1))
    t, r, s = part(r"(?i)T\.?\s*(\d+\s*[NS])"), part(r"(?i)R\.?\s*(\d+\s*[EW])"), part(r"(?i)\bS(?:EC)?\.?\s*(\d+)\b")
    pair = lambda k, v: F.when(v != "", F.concat(F.lit(f"{k}="), F.url_encode(F.regexp_replace(v, r"\s", ""))))
    return F.when((t != "") & (r != ""), F.concat_ws("&", pair("T", t), pair("R", r), pair("S", s))).otherwise("")


#: Tiers from the least to the most.
TIERS = ("free", "pro", "team")


def tier_rank(tier: Column) -> Column:
    """A tier's place, unknown and null ones as free."""
    return F.coalesce(F.try_element_at(F.create_map(*[x for i, t in enumerate(TIERS) for x in (F.lit(t), F.lit(i))]), F.lower(tier)), F.lit(0))


def event_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events (id, reference_id, email, customer_id) with the user they are about: by id, else by e-mail, else by customer.

    users: user_id, email, customer_id.  Of several users with an address or a customer the smallest id counts.
    """
    by = lambda key, name: users.filter(F.col(key).isNotNull()).groupBy(F.lower(key).alias(f"__{name}")).agg(F.min("user_id").alias(f"__by_{name}"))
    ids = users.select(F.col("user_id").alias("__by_id")).distinct()
    out = events.join(ids, F.col("reference_id") == F.col("__by_id"), "left")
    out = out.join(by("email", "email"), F.lower("email") == F.col("__email"), "left").join(by("customer_id", "customer"), F.lower("customer_id") == F.col("__customer"), "left")
    return out.select("id", F.coalesce("__by_id", "__by_email", "__by_customer").alias("user_id"))


def not_expired(rows: DataFrame, now: Column, hours: int) -> DataFrame:
    """Rows made (created) within so many hours before now: invitations 72, tokens 720, resets 1."""
    return rows.filter(F.col("created") >= now - F.make_interval(hours=F.lit(hours)))


#: Seats of a team.
SEATS = 5


def team_members(events: DataFrame) -> DataFrame:
    """(team, user, role) after a log of events (team, user, seq, action): create, invite, accept, remove, leave.

    The latest event of a user in a team counts; an owner can't leave or be removed; of accepted members only the first SEATS by
    the time of their acceptance, the owner among them, have a seat.
    """
    owner = events.filter("action = 'create'").groupBy("team").agg(F.min_by("user", "seq").alias("__owner"), F.min("seq").alias("__at"))
    rest = events.join(owner, "team").filter((F.col("user") != F.col("__owner")) & (F.col("action") != "create"))
    invited = rest.filter("action = 'invite'").groupBy("team", "user").agg(F.min("seq").alias("__invited"))
    last = rest.groupBy("team", "user").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq")).join(invited, ["team", "user"])
    members = last.filter("action = 'accept' AND seq > __invited").select("team", "user", "seq", F.lit("member").alias("role"))
    every = owner.select("team", F.col("__owner").alias("user"), F.col("__at").alias("seq"), F.lit("owner").alias("role")).unionByName(members)
    nth = F.row_number().over(Window.partitionBy("team").orderBy(F.when(F.col("role") == "owner", 0).otherwise(1), "seq", "user"))
    return every.withColumn("__nth", nth).filter(F.col("__nth") <= SEATS).select("team", "user", "role")


def seats(members: DataFrame) -> DataFrame:
    """(team, taken, free)."""
    return members.groupBy("team").agg(F.count("*").alias("taken")).withColumn("free", F.greatest(F.lit(0), F.lit(SEATS) - F.col("taken")))


def instrument_classes(rows: DataFrame) -> DataFrame:
    """Counts of search rows by class of instrument: deed, survey or other."""
    kind = F.coalesce("instrument_type", F.lit(""))
    return rows.groupBy(F.when(is_deed_type(kind), "deed").when(is_survey_type(kind), "survey").otherwise("other").alias("class")).agg(F.count("*").alias("n"))


def session_graph(sessions: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name) and edges (src, dst, relationship, seq) of sessions (job_number, client_name, subjects).

    Persons are their names' keys.  A client is `client_of` the job, an adjoiner is `adjoiner_in` it and `adjoins` the client.
    Alike edges are of one job, so they are dealt by jobs to ``tasks`` tasks; by default the sessions are counted for their number.
    """
    tasks = tasks or tasks_for(sessions.sparkSession, 4 * sessions.count())
    job = F.concat(F.lit("job:"), F.col("job_number"))
    person = lambda name: F.concat(F.lit("person:"), T.person_key(name))
    clients = sessions.filter(F.trim("client_name") != "").select("job_number", job.alias("job"), person(F.col("client_name")).alias("person"), F.col("client_name").alias("name"))
    adjoiners = sessions.select("job_number", job.alias("job"), F.explode("subjects").alias("s")).filter("s.type = 'adjoiner' AND trim(s.name) <> ''")
    adjoiners = adjoiners.select("job_number", "job", person(F.col("s.name")).alias("person"), F.col("s.name").alias("name"))
    people = clients.unionByName(adjoiners).groupBy(F.col("person").alias("id")).agg(F.lit("person").alias("type"), F.min_by("name", F.struct("job_number", "name")).alias("name"))
    jobs = sessions.select(job.alias("id"), F.lit("job").alias("type"), F.col("job_number").cast("string").alias("name")).repartition(tasks, "name").distinct()
    edge = lambda rows, a, b, kind: rows.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("relationship"), F.col("job_number").alias("seq"))
    both = clients.select("job", F.col("person").alias("__client")).join(adjoiners, "job")
    edges = edge(clients, "person", "job", "client_of").unionByName(edge(adjoiners, "person", "job", "adjoiner_in")).unionByName(edge(both, "__client", "person", "adjoins"))
    return people.unionByName(jobs), edges.filter("src <> dst").repartition(tasks, "seq").distinct()


def search_persons(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Persons whose name contains the query: the first ``limit`` in the order of ids, then by how many edges they have."""
    found = nodes.filter((F.col("type") == "person") & F.upper("name").contains((query or "").strip().upper())).orderBy("id").limit(limit)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return found.join(ends, "id", "left").na.fill(0, ["degree"]).orderBy(F.desc("degree"), "id")


def find_nodes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id): for each of names (name) the person with just its key, else the first id that contains its last word.

    The names' distinct last words are looked up in an index of the ids' letters.
    """
    key = T.person_key(F.col("name"))
    asked = names.select("name", F.concat(F.lit("person:"), key).alias("__id"), F.lower(F.trim(last_name(F.col("name")))).alias("__last")).distinct()
    ids = nodes.filter("type = 'person'").select("id")
    same = asked.join(ids, asked["__id"] == ids["id"]).select("name", "id", F.lit(0).alias("__way"))
    words = asked.select("__last").filter(F.length("__last") >= 2).distinct()
    near = containing(ids, "id", words, "__last").groupBy("__last").agg(F.min("id").alias("id"))
    both = same.unionByName(asked.join(near, "__last").select("name", "id", F.lit(1).alias("__way")))
    return both.groupBy("name").agg(F.min_by("id", F.struct("__way", "id")).alias("id"))


def jobs_of(edges: DataFrame, persons: DataFrame) -> DataFrame:
    """(id, job, relationship) of persons (id): the jobs they are in."""
    own = edges.filter(F.col("relationship").isin("client_of", "adjoiner_in"))
    return own.join(persons.select("id"), own["src"] == persons["id"]).select("id", F.col("dst").alias("job"), "relationship")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes by type and edges by relationship."""
    by = lambda frame, column, what: frame.groupBy(F.col(column).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return by(nodes, "type", "node").unionByName(by(edges, "relationship", "edge"))
