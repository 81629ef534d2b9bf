"""Queries of the research operators, and of extractors and neighbour joins, over rows made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelworks.functions import deeds as D
from parcelworks.functions import geometry as G
from parcelworks.functions import scores
from parcelworks.functions import text as T
from parcelworks.operators import adjacency, conflicts, matching, research, spatial, stats
from parcelworks.plans.registry import PARCELS, parcels_like, query, table
from parcelworks.storage import tasks_for

_OWNED = f"(SELECT pos, upc, book, page, cab, 'OWN' || (pos % 60) || 'X' AS owner FROM {PARCELS})"


def _owned(spark, sf_dir):
    return parcels_like(spark, sf_dir).withColumn("owner", F.concat(F.lit("OWN"), F.col("pos") % 60, F.lit("X")))


@query(
    "cross_reference",
    f"""WITH p AS {_OWNED}, d AS (SELECT s_suppkey AS deed, 'OWN' || (s_suppkey % 50) AS g, 'OWN' || (s_suppkey % 7) AS h, CAST(s_nationkey AS VARCHAR) AS book, CAST(s_suppkey % 97 AS VARCHAR) AS page, lpad(CAST(s_suppkey AS VARCHAR), 13, '0') AS pick FROM supplier),
n AS (SELECT name, pos, upc FROM (SELECT name, p.pos, p.upc, row_number() OVER (PARTITION BY name ORDER BY pos) AS r FROM (SELECT g AS name FROM d UNION SELECT h FROM d) JOIN p ON contains(p.owner, name)) WHERE r <= 10),
b AS (SELECT book, page, pos, upc FROM (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY pos) AS r FROM p) WHERE r <= 5),
c AS (SELECT cab, pos, upc FROM (SELECT *, row_number() OVER (PARTITION BY cab ORDER BY pos) AS r FROM p WHERE cab = 'B-3') WHERE r <= 5),
x AS (SELECT deed, upc, 100 AS score, 'map pick' AS reason, 0 AS rule, pos FROM d JOIN p ON pick = upc UNION ALL SELECT deed, upc, 10, 'grantor name', 1, pos FROM d JOIN n ON g = name
UNION ALL SELECT deed, upc, 10, 'grantee name', 2, pos FROM d JOIN n ON h = name UNION ALL SELECT deed, upc, 50, 'book-page', 3, pos FROM d JOIN b USING (book, page) UNION ALL SELECT deed, upc, 30, 'cabinet', 4, pos FROM d, c),
s AS (SELECT deed, upc, sum(score) AS score, string_agg(reason, ' + ' ORDER BY rule, pos, reason) AS reasons, min(CAST(rule AS BIGINT) * 1000000000 + pos) AS first FROM x GROUP BY deed, upc)
SELECT deed, upc, CAST(score AS BIGINT) AS score, reasons, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY deed ORDER BY score DESC, first, upc) AS nth FROM s) WHERE nth <= 30""",
)
def cross_reference(spark, sf_dir):
    k = F.col("s_suppkey")
    deeds = table(spark, sf_dir, "supplier").select(
        k.alias("deed"), F.concat(F.lit("Own"), k % 50, F.lit(", A")).alias("grantor"), F.concat(F.lit("own"), k % 7, F.lit(" B")).alias("grantee"),
        F.concat(F.lit("M"), F.col("s_nationkey"), F.lit("-"), k % 97).alias("location"), F.lpad(k.cast("string"), 13, "0").alias("map_upc"), F.lit("see CAB B-3").alias("body"),
    )
    return research.cross_reference(deeds, _owned(spark, sf_dir))


@query(
    "enriched_search",
    """SELECT s_suppkey, CASE WHEN s_nationkey = 7 THEN 40 ELSE 0 END + CASE WHEN s_suppkey % 2 = 0 THEN 15 ELSE 12 END + 5 AS relevance FROM supplier ORDER BY relevance DESC, s_suppkey LIMIT 30""",
)
def enriched_search(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        k, k.alias("pos"), F.lit("A").alias("grantor"), F.lit("B").alias("grantee"), F.concat(F.lit("Section "), F.col("s_nationkey")).alias("location"),
        F.when(k % 2 == 0, "Warranty Deed").otherwise("Survey").alias("instrument_type"), F.lit("01/02/2020").alias("recorded_date"),
    )
    return research.enriched_search(rows, {"section": "7"}).limit(30).select("s_suppkey", "relevance")


_SESSIONS = """(SELECT o_custkey AS job, CAST(count(*) AS INTEGER) AS adjoiner_count, CAST(count(*) FILTER (o_orderstatus = 'O') AS INTEGER) AS deed_count, CAST(count(*) FILTER (o_totalprice > 200000) AS INTEGER) AS plat_count,
  round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS completion_pct, strftime(max(o_orderdate), '%Y-%m-%d') AS file_date FROM orders GROUP BY 1)"""


def _sessions(spark, sf_dir):
    n = lambda c: F.count_if(c).cast("int")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job")).agg(
        F.count("*").cast("int").alias("adjoiner_count"), n(F.col("o_orderstatus") == "O").alias("deed_count"), n(F.col("o_totalprice") > 200_000).alias("plat_count"),
        F.round(100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 1).alias("completion_pct"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("file_date"),
    )


@query(
    "global_stats",
    f"""SELECT count(*) AS n, CAST(sum(adjoiner_count) AS BIGINT) AS total_adjoiners, CAST(sum(deed_count) AS BIGINT) AS total_deeds, CAST(sum(plat_count) AS BIGINT) AS total_plats, round(avg(adjoiner_count), 1) AS avg_adjoiners, max(adjoiner_count) AS max_adjoiners,
round(avg(completion_pct), 1) AS avg_completion, min(file_date) AS first_date, max(file_date) AS last_date, CASE WHEN count(*) % 2 = 1 THEN median(adjoiner_count) ELSE round(median(adjoiner_count), 1) END AS median_adjoiners FROM {_SESSIONS}""",
)
def global_stats(spark, sf_dir):
    return research.global_stats(_sessions(spark, sf_dir))


@query("incomplete", f"SELECT job, completion_pct FROM {_SESSIONS} WHERE completion_pct < 50 AND adjoiner_count > 0")
def incomplete(spark, sf_dir):
    return research.incomplete(_sessions(spark, sf_dir)).select("job", "completion_pct")


@query(
    "iqr_outliers",
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1 HAVING count(*) >= 4), q AS (SELECT event_type, v[CAST(floor(len(v) * 0.25) AS INTEGER) + 1] AS a, v[CAST(floor(len(v) * 0.75) AS INTEGER) + 1] AS b FROM s)
SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
)
def iqr_outliers(spark, sf_dir):
    return research.iqr_outliers(table(spark, sf_dir, "events"), "event_type", "value", "event_id")


@query("predicted_complexity", f"""WITH s AS (SELECT adjoiner_count AS a FROM {_SESSIONS}), l AS (SELECT list_sort(list(a)) AS v FROM s)
SELECT count(*) AS n, round(avg(a), 1) AS predicted, CASE WHEN round(avg(a), 1) <= 4 THEN 'simple' WHEN round(avg(a), 1) <= 10 THEN 'moderate' ELSE 'complex' END AS complexity, 'high' AS confidence,
(SELECT v[CAST(floor(len(v) * 0.25) AS INTEGER) + 1] FROM l) AS p25, (SELECT v[CAST(floor(len(v) * 0.75) AS INTEGER) + 1] FROM l) AS p75 FROM s""")
def predicted_complexity(spark, sf_dir):
    history = _sessions(spark, sf_dir).withColumn("job_type", F.lit("BDY"))
    return stats.predict_complexity(history, "BDY").select("n", "predicted", "complexity", "confidence", "p25", "p75")


@query(
    "predicted_cabinets",
    """WITH h AS (SELECT o_orderkey AS job, o_custkey % 13 AS a, unnest([chr(CAST(65 + o_custkey % 6 AS INTEGER)), chr(CAST(65 + o_orderkey % 4 AS INTEGER))]) AS letter, unnest([0, 1]) AS i FROM orders WHERE o_orderstatus = 'P'),
l AS (SELECT letter, count(*) AS n, min(job * 2 + i) AS first FROM h GROUP BY letter ORDER BY n DESC, first LIMIT 3), v AS (SELECT list_sort(list(a)) AS v FROM h WHERE i = 0)
SELECT (SELECT string_agg(letter, ',' ORDER BY n DESC, first) FROM l) AS cabinets, len(v) AS n, v[CAST(floor(len(v) * 0.25) AS INTEGER) + 1] AS p25, v[CAST(floor(len(v) * 0.75) AS INTEGER) + 1] AS p75 FROM v""",
)
def predicted_cabinets(spark, sf_dir):
    letter = lambda c, n: F.chr(F.lit(65) + F.col(c) % n)
    o = table(spark, sf_dir, "orders")
    history = o.select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("job_type"), (F.col("o_custkey") % 13).alias("adjoiner_count"), F.array(letter("o_custkey", 6), letter("o_orderkey", 4)).alias("cabinets"))
    return stats.predict_complexity(history, "P", "cabinets").select(F.array_join("likely_cabinets", ",").alias("cabinets"), "n", "p25", "p75")


@query(
    "book_page_cabinets",
    f"""SELECT DISTINCT l_orderkey AS deed, substr(cab, 1, 1) AS letter FROM lineitem JOIN {PARCELS} ON book = CAST(l_suppkey % 25 AS VARCHAR) AND page = CAST(l_partkey % 97 AS VARCHAR)""",
)
def book_page_cabinets(spark, sf_dir):
    deeds = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deed"), F.concat(F.lit("M"), F.col("l_suppkey") % 25, F.lit("-"), F.col("l_partkey") % 97).alias("location"))
    return research.book_page_cabinets(deeds, parcels_like(spark, sf_dir))


@query("newer_files", "SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 450000 AND o_orderpriority = '1-URGENT' AND year(o_orderdate) < 1997)")
def newer_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    built = o.filter("o_orderstatus = 'F' AND o_totalprice > 450000 AND o_orderpriority = '1-URGENT' AND year(o_orderdate) < 1997").select(F.col("o_orderdate").alias("built_at"))
    return research.newer_files(o.withColumn("modified", F.col("o_orderdate")), built).select("o_orderkey")


@query(
    "stale_cabinets",
    """SELECT 'c' || o_custkey AS cabinet, CAST(max(o_orderdate) AS TIMESTAMP) AS modified FROM orders GROUP BY o_custkey HAVING max(o_orderdate) IS DISTINCT FROM max(o_orderdate) FILTER (o_orderstatus = 'O')""",
)
def stale_cabinets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cabinet", F.concat(F.lit("c"), F.col("o_custkey")))
    folders = o.groupBy("cabinet").agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("modified"))
    return research.stale_cabinets(folders, o.filter("o_orderstatus = 'O'").select("cabinet", F.col("o_orderdate").cast("timestamp").alias("indexed_at")))


@query(
    "discovered_names",
    """WITH a AS (SELECT o_custkey AS job, o_orderpriority AS name, o_orderkey AS pos, 0 AS prio FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS job, lower(o_orderpriority) || CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '' END AS name, o_orderkey AS pos, 1 AS prio FROM orders WHERE o_orderstatus = 'O'),
c AS (SELECT o_custkey AS job, 'online ' || (o_orderkey % 3) AS name, o_orderkey AS pos, 2 AS prio FROM orders), ab AS (SELECT job, name, pos, prio FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) AS r FROM a) WHERE r <= 3 UNION ALL SELECT job, name, pos, prio FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) AS r FROM b) WHERE r <= 12),
n AS (SELECT job FROM ab GROUP BY job HAVING count(DISTINCT lower(trim(name))) >= 4), u AS (FROM ab UNION ALL SELECT job, name, pos, prio FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) AS r FROM c) WHERE r <= 2 AND job NOT IN (SELECT job FROM n))
SELECT job, name, pos, CAST(prio AS INTEGER) AS prio FROM (SELECT *, row_number() OVER (PARTITION BY job, lower(trim(name)) ORDER BY prio, pos) AS r FROM u) WHERE r = 1""",
)
def discovered_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("pos"), "o_orderpriority", "o_orderstatus")
    one = o.filter("o_orderstatus = 'F'").withColumn("name", F.col("o_orderpriority"))
    two = o.filter("o_orderstatus = 'O'").withColumn("name", F.concat(F.lower("o_orderpriority"), F.when(F.col("pos") % 2 == 0, "x").otherwise("")))
    online = o.withColumn("name", F.concat(F.lit("online "), F.col("pos") % 3))
    return research.discovered([(one, 3), (two, 12), (online, 2)], few=4).select("job", "name", "pos", "prio")


@query(
    "plats_of_client",
    f"""WITH p AS {_OWNED}, c AS (SELECT s_suppkey AS client, 'OWN' || (s_suppkey % 50) AS name, lpad(CAST(s_suppkey AS VARCHAR), 13, '0') AS pick FROM supplier),
n AS (SELECT name, pos, upc FROM (SELECT name, p.pos, p.upc, row_number() OVER (PARTITION BY name ORDER BY pos) AS r FROM (SELECT DISTINCT name FROM c) JOIN p ON contains(p.owner, name)) WHERE r <= 15)
SELECT client, upc, pos, true AS picked FROM c JOIN p ON pick = upc UNION ALL SELECT client, upc, pos, false FROM c JOIN n USING (name) WHERE upc <> pick""",
)
def plats_of_client(spark, sf_dir):
    k = F.col("s_suppkey")
    clients = table(spark, sf_dir, "supplier").select(k.alias("client"), F.concat(F.lit("Own"), k % 50, F.lit(", A")).alias("name"), F.lpad(k.cast("string"), 13, "0").alias("map_upc"))
    return research.plats_of_client(_owned(spark, sf_dir), clients)


@query(
    "bulk_deed_match",
    """WITH s AS (SELECT c_custkey AS subject, 'N' || (c_custkey % 40) AS last, 'N' || (c_custkey % 40) || ', F' || (c_custkey % 3) AS full_name FROM customer WHERE c_custkey % 5 <> 0), d AS (SELECT o_orderkey, 'D' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS doc_no, 'N' || (o_orderkey % 40) AS last, 'N' || (o_orderkey % 40) || ', F' || (o_custkey % 3) || ' X' AS party, CASE o_orderstatus WHEN 'O' THEN 'Warranty Deed' ELSE '' END AS kind,
CASE WHEN year(o_orderdate) + 20 >= 2020 THEN 15 WHEN year(o_orderdate) + 20 >= 2010 THEN 10 ELSE 5 END AS y, '01/02/' || (year(o_orderdate) + 20) AS dated FROM orders WHERE o_orderstatus <> 'P'),
m AS (SELECT subject, doc_no, CASE WHEN starts_with(party, full_name) THEN 0 ELSE 1 END AS way, CASE WHEN kind = '' THEN 5 ELSE 50 END + 20 + y AS score, dated FROM s JOIN d USING (last))
SELECT subject, doc_no, CASE WHEN way = 0 THEN 'full name' ELSE 'last name' END AS way FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY way, score DESC, dated, doc_no) AS r FROM m) WHERE r = 1""",
)
def bulk_deed_match(spark, sf_dir):
    k, o = F.col("c_custkey"), table(spark, sf_dir, "orders")
    subjects = table(spark, sf_dir, "customer").select(k.alias("subject"), F.concat(F.lit("n"), k % 40, F.lit(", f"), k % 3).alias("name"), (k % 5 == 0).alias("deed_saved"))
    n = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "O", "Warranty Deed").when(F.col("o_orderstatus") == "P", "Lien").otherwise("")
    deeds = o.select(
        F.concat(F.lit("D"), F.lpad(n.cast("string"), 9, "0")).alias("doc_no"), F.lit("Z").alias("grantor"), F.concat(F.lit("N"), n % 40, F.lit(", F"), F.col("o_custkey") % 3, F.lit(" X")).alias("grantee"),
        kind.alias("instrument_type"), F.concat(F.lit("01/02/"), F.year("o_orderdate") + 20).alias("recorded_date"),
    )
    return research.bulk_deed_match(subjects, deeds)


@query(
    "trs_consistency",
    """SELECT c_custkey AS job, 'warn' AS severity, 'T' || (c_custkey % 9) || 'N R1E' AS client, 'T' || (c_nationkey % 9) || 'N R1E' AS adjoiners FROM customer WHERE c_custkey % 9 <> c_nationkey % 9""",
)
def trs_consistency(spark, sf_dir):
    place = lambda c: T.trs_refs(F.concat(F.lit("in T"), F.col(c) % 9, F.lit("N, R1E")))
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), place("c_custkey").alias("client_trs"), place("c_nationkey").alias("adjoiner_trs"))
    return research.trs_consistency(jobs)


@query(
    "event_users",
    """WITH u AS (SELECT c_custkey AS user_id, 'mail' || (c_custkey % 700) AS email, 'cus' || (c_custkey % 900) AS cus FROM customer), m AS (SELECT email, min(user_id) AS i FROM u GROUP BY 1), k AS (SELECT cus, min(user_id) AS i FROM u GROUP BY 1)
SELECT o_orderkey AS id, coalesce(u.user_id, m.i, k.i) AS user_id FROM orders LEFT JOIN u ON o_orderkey % 3 = 0 AND u.user_id = o_orderkey LEFT JOIN m ON m.email = 'mail' || o_custkey LEFT JOIN k ON k.cus = 'cus' || o_custkey""",
)
def event_users(spark, sf_dir):
    k = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select(k.alias("user_id"), F.concat(F.lit("Mail"), k % 700).alias("email"), F.concat(F.lit("cus"), k % 900).alias("customer_id"))
    n = F.col("o_orderkey")
    events = table(spark, sf_dir, "orders").select(n.alias("id"), F.when(n % 3 == 0, n).alias("reference_id"), F.concat(F.lit("mail"), F.col("o_custkey")).alias("email"), F.concat(F.lit("cus"), F.col("o_custkey")).alias("customer_id"))
    return research.event_users(events, users)


@query(
    "team_members",
    """WITH e AS (SELECT user_id % 40 AS team, user_id AS usr, event_id AS seq, CASE WHEN user_id < 40 THEN 'create' ELSE ['invite', 'accept', 'remove', 'accept'][event_id % 4 + 1] END AS action FROM events), o AS (SELECT team, min(usr) AS own FROM e WHERE action = 'create' GROUP BY team),
i AS (SELECT team, usr, min(seq) AS inv FROM e WHERE action = 'invite' GROUP BY 1, 2), l AS (SELECT team, usr, arg_max(action, seq) AS action, max(seq) AS seq FROM e JOIN o USING (team) WHERE action <> 'create' GROUP BY 1, 2),
m AS (SELECT team, usr, seq, 'member' AS role FROM l JOIN i USING (team, usr) WHERE action = 'accept' AND seq > inv UNION ALL SELECT team, own, -1, 'owner' FROM o)
SELECT team, usr AS "user", role FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY seq, usr) AS r FROM m) WHERE r <= 5""",
)
def team_members(spark, sf_dir):
    u, n = F.col("user_id"), F.col("event_id")
    action = F.when(u < 40, "create").otherwise(F.element_at(F.array(*map(F.lit, ("invite", "accept", "remove", "accept"))), (n % 4 + 1).cast("int")))
    return research.team_members(table(spark, sf_dir, "events").select((u % 40).alias("team"), u.alias("user"), n.alias("seq"), action.alias("action")))


_LINKS = "(SELECT DISTINCT 'person:s' || l_suppkey AS p, 'job:' || l_orderkey AS j FROM lineitem)"


def _graph(spark, sf_dir):
    """The graph of lineitem as sessions; its rows, counted by its files' footers, say to how many tasks they are dealt."""
    lines = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(spark, lines.count())
    subject = F.struct(F.concat(F.lit("S"), F.col("l_suppkey")).alias("name"), F.lit("adjoiner").alias("type"))
    jobs = lines.repartition(tasks, "l_orderkey").groupBy(F.col("l_orderkey").alias("job_number")).agg(F.lit("Zoe").alias("client_name"), F.collect_list(subject).alias("subjects"))
    return research.session_graph(jobs, tasks)


@query(
    "session_graph",
    f"""WITH l AS {_LINKS} SELECT 'node' AS what, 'person' AS kind, count(DISTINCT p) + 1 AS n FROM l UNION ALL SELECT 'node', 'job', count(DISTINCT j) FROM l UNION ALL SELECT 'edge', 'client_of', count(DISTINCT j) FROM l
UNION ALL SELECT 'edge', 'adjoiner_in', count(*) FROM l UNION ALL SELECT 'edge', 'adjoins', count(*) FROM l""",
)
def session_graph(spark, sf_dir):
    return research.graph_counts(*_graph(spark, sf_dir))


@query("search_persons", f"WITH l AS {_LINKS}, f AS (SELECT DISTINCT p FROM l WHERE contains(p, 's1') ORDER BY p LIMIT 20) SELECT p AS id, 2 * count(*) AS degree FROM f JOIN l USING (p) GROUP BY p")
def search_persons(spark, sf_dir):
    return research.search_persons(*_graph(spark, sf_dir), "s1").select("id", "degree")


@query("find_nodes", f"WITH l AS {_LINKS} SELECT 'S' || k AS name, 'person:s' || k AS id FROM (SELECT DISTINCT s_suppkey AS k FROM supplier) WHERE 'person:s' || k IN (SELECT p FROM l)")
def find_nodes(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("name"))
    return research.find_nodes(nodes, names)


@query(
    "key_neighbours",
    """WITH k AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 13, '0') AS upc FROM customer) SELECT a.upc AS query, b.upc FROM k a JOIN k b ON substr(a.upc, 1, 10) = substr(b.upc, 1, 10) AND abs(a.c_custkey - b.c_custkey) <= 8 AND a.upc <> b.upc
WHERE a.c_custkey % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.upc ORDER BY b.c_custkey) <= 12""",
)
def key_neighbours(spark, sf_dir):
    parcels = parcels_like(spark, sf_dir)
    return adjacency.key_neighbours_each(parcels, parcels.filter("pos % 50 = 0").select("upc")).select("query", "upc")


@query(
    "adjacent_pairs",
    """WITH p AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 13, '0') AS upc, c_custkey % 40 AS x, c_custkey // 40 AS y FROM customer)
SELECT least(a.upc, b.upc) AS a, greatest(a.upc, b.upc) AS b FROM p a JOIN p b ON a.upc < b.upc AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1""",
)
def adjacent_pairs(spark, sf_dir):
    return adjacency.adjacent_pairs(_squares(spark, sf_dir)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _squares(spark, sf_dir):
    """Squares of 0.001 degrees, side by side."""
    k = F.col("c_custkey")
    x, y = (k % 40) * 0.001 - 105.0, F.floor(k / 40) * 0.001 + 36.0
    corner = lambda dx, dy: F.struct((x + dx).alias("lng"), (y + dy).alias("lat"))
    ring = F.array(corner(0.0, 0.0), corner(0.001, 0.0), corner(0.001, 0.001), corner(0.0, 0.001), corner(0.0, 0.0))
    return table(spark, sf_dir, "customer").select(k.alias("pos"), F.lpad(k.cast("string"), 13, "0").alias("upc"), ring.alias("polygon"), corner(0.0005, 0.0005).alias("centroid"))


@query("find_adjacent", """WITH p AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 13, '0') AS upc, c_custkey % 40 AS x, c_custkey // 40 AS y FROM customer) SELECT b.upc, 'edge' AS kind FROM p a JOIN p b ON a.upc <> b.upc AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE a.upc = '0000000000085'""")
def find_adjacent(spark, sf_dir):
    return adjacency.find_adjacent(_squares(spark, sf_dir), "0000000000085").select("upc", F.col("_adjacency_type").alias("kind"))


@query(
    "parcel_conflicts",
    """SELECT c_custkey AS pos, unnest(list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'missing_enrichment' END, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 = 0 THEN 'owner_mismatch' END, CASE WHEN c_custkey % 4 <> 0 AND c_nationkey % 5 = 0 THEN 'trs_mismatch' END], lambda x: x IS NOT NULL)) AS type FROM customer""",
)
def parcel_conflicts(spark, sf_dir):
    k = F.col("c_custkey")
    arcgis = F.struct(F.when(k % 3 == 0, "ZED").otherwise("RAEL ADELA TRUST").alias("owner_official"), F.lit(None).cast("double").alias("land_area"), F.when(F.col("c_nationkey") % 5 == 0, "T9N R1E").otherwise("T1N R1E S4").alias("trs"))
    rows = _squares(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("pos") == k).select(
        "pos", "upc", F.lit("Rael, Adela").alias("owner"), "polygon", F.lit("T1N R1E SEC 4").alias("trs"), F.when(k % 4 != 0, arcgis).alias("arcgis"),
    )
    return conflicts.conflicts(rows).select("pos", "type")


_TITLES = """WITH RECURSIVE d AS (
SELECT 'D' || c_custkey || s AS doc, 'GRANTEE 00' || lpad(CAST(c_custkey // 3 AS VARCHAR), 6, '0') AS g, 'GRANTEE 00' || lpad(CAST(c_custkey // 3 + 5 AS VARCHAR), 6, '0') AS f,
s = 'b' AND c_custkey % 4 = 0 AS other, CASE s WHEN 'a' THEN 1990 + c_custkey % 10 ELSE 1980 + c_custkey % 17 END AS y, c_nationkey = 3 AS plat FROM customer, (VALUES ('a'), ('b')) v(s)),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY other, y, doc) AS n FROM d),
r AS (SELECT g AS start, 1 AS hop, doc, f, plat FROM b WHERE n = 1 AND CAST(substr(g, 11) AS INTEGER) % 50 = 0
UNION ALL SELECT start, hop + 1, b.doc, b.f, b.plat FROM r JOIN b ON b.g = r.f AND b.n = 1 WHERE NOT r.plat AND hop < 5)
SELECT start, CAST(hop AS INTEGER) AS hop, doc AS doc_no FROM r"""


@query("chain_of_title", _TITLES)
def chain_of_title(spark, sf_dir):
    """Six candidate deeds a name, some of another type, of different dates; all names share their first ten letters."""
    k, s = F.col("c_custkey"), F.col("s")
    name = lambda c: F.concat(F.lit("Grantee 00"), F.lpad(c.cast("string"), 6, "0"))
    rows = table(spark, sf_dir, "customer").withColumn("s", F.explode(F.array(F.lit("a"), F.lit("b"))))
    deeds = rows.select(
        F.concat(F.lit("D"), k, s).alias("doc_no"), name(F.floor(k / 3) + 5).alias("grantor"), F.concat(name(F.floor(k / 3)), F.when(k % 2 == 0, " AND WIFE").otherwise("")).alias("grantee"),
        F.when(F.col("c_nationkey") == 3, "Plat 4").otherwise("M1").alias("location"), F.when((s == "b") & (k % 4 == 0), "LIEN").otherwise("WARRANTY DEED").alias("instrument_type"),
        F.when(s == "a", 1990 + k % 10).otherwise(1980 + k % 17).cast("string").alias("recorded_date"),
    )
    starts = table(spark, sf_dir, "customer").select(F.floor(k / 3).alias("n")).filter("n % 50 = 0").select(name(F.col("n")).alias("start"))
    return conflicts.chain_of_title(deeds, starts, 5).select(F.upper("start").alias("start"), "hop", "doc_no")


@query("deed_grades", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'warn' ELSE 'none' END AS self, c_custkey % 4 = 0 AS easement FROM customer")
def deed_grades(spark, sf_dir):
    k = F.col("c_custkey")
    fields = F.create_map(F.lit("Grantor"), F.lit("RAEL, ADELA"), F.lit("Grantee"), F.when(k % 3 == 0, "Rael, Adela").otherwise("Garcia, Juan"))
    body = F.when(k % 4 == 0, "with an easement of way").otherwise("all of lot 3")
    deeds = table(spark, sf_dir, "customer").select("c_custkey", fields.alias("fields"), body.alias("body"))
    out = conflicts.deed_issues(deeds, F.lit("2024-01-01").cast("date"))
    has = lambda title: F.exists("issues", lambda i: i["title"] == title)
    return out.select("c_custkey", F.when(has("self-conveyance"), "warn").otherwise("none").alias("self"), has("easements").alias("easement"))


_HOLDERS = ("a joint tenancy", "Rael Land L.L.C.", "Vigil & Luna, husband & wife", "the Estate of Medina, trustees", "tenants in common", "community properties")


@query(
    "deed_vesting",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Joint Tenants' WHEN 1 THEN 'LLC / Corp' WHEN 2 THEN 'Husband & Wife' WHEN 3 THEN 'Trustee;Estate / Heirs' WHEN 4 THEN 'Tenants in Common' ELSE '' END || CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 6 NOT IN (1, 3) THEN CASE WHEN c_custkey % 6 = 5 THEN '' ELSE ';' END || 'LLC / Corp' ELSE '' END AS vesting,
c_nationkey % 5 < 3 AS survey FROM customer""",
)
def deed_vesting(spark, sf_dir):
    k = F.col("c_custkey")
    held = F.element_at(F.array(*map(F.lit, _HOLDERS)), (k % 6 + 1).cast("int"))
    fields = F.create_map(F.lit("Grantor"), F.when((F.col("c_mktsegment") == "BUILDING") & (k % 6 != 3), "Mesa Company").otherwise("Accompany, Ann"), F.lit("Grantee"), held)
    said = F.element_at(F.array(*map(F.lit, ("as surveyed by Luna", "plat, of record", "filed at noon", "a survey byline", "recorded"))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    out = conflicts.deed_issues(table(spark, sf_dir, "customer").select("c_custkey", fields.alias("fields"), said.alias("body")), F.lit("2024-01-01").cast("date"))
    return out.select("c_custkey", F.array_join("vesting", ";").alias("vesting"), F.exists("issues", lambda i: i["title"] == "earlier survey").alias("survey"))


@query("ocr_lines", "SELECT p_partkey, 'thence N ' || (p_partkey % 80 + 10) || '°15''30\" E ' || p_size || ' feet to the point' AS line FROM part")
def ocr_lines(spark, sf_dir):
    made = F.concat(F.lit("thance N "), F.col("p_partkey") % 80 + 10, F.lit("o 15' 30\"E  "), F.col("p_size"), F.lit(" ft. to tbe poiut"))
    return table(spark, sf_dir, "part").select("p_partkey", D.ocr_corrected(made).alias("line"))


@query("adjoiners_named", "SELECT p_partkey, ['Vigil' || chr(CAST(97 + p_size % 26 AS INTEGER)), 'Medina'] AS names FROM part")
def adjoiners_named(spark, sf_dir):
    made = F.concat(F.lit("bounded by lands of VIGIL"), F.chr(F.lit(97) + F.col("p_size") % 26), F.lit(" thence along to the estate of Medina, deceased"))
    return table(spark, sf_dir, "part").select("p_partkey", D.adjoiner_names(made).alias("names"))


@query("legal_blocks", "SELECT p_partkey, 'Tract ' || p_size || ' of the grant of ' || p_name || ' in the county' AS block FROM part")
def legal_blocks(spark, sf_dir):
    made = F.concat(F.lit("WARRANTY DEED\nLEGAL DESCRIPTION: Tract "), F.col("p_size"), F.lit(" of the grant of "), F.col("p_name"), F.lit(" in the county\nSUBJECT TO taxes"))
    return table(spark, sf_dir, "part").select("p_partkey", D.legal_description(made).alias("block"))


_CABINETS = """WITH f AS (SELECT 'f' || p_partkey AS path, p_size, p_partkey % 100 AS n, p_name AS name, 'q' || chr(CAST(97 + p_partkey % 7 AS INTEGER)) AS page, lower((p_partkey % 100) || '.001 ' || p_name || ' c' || p_size) AS form FROM part),
r AS (SELECT p_partkey AS request, p_size, p_partkey % 150 AS way, p_partkey % 100 AS n, string_split(p_name, ' ') AS w, 'q' || chr(CAST(97 + p_partkey % 5 AS INTEGER)) AS page FROM part WHERE p_partkey % 50 = 0),
v AS (SELECT request, p_size, w, unnest([w[2] || ' ' || w[1], w[1] || ' ' || w[2], w[1], w[2]]) AS v FROM r WHERE way = 50),
m AS (SELECT request, path, max(len(v)) + floor((CASE WHEN list_contains(string_split(name, ' '), w[1]) THEN 1 WHEN contains(form, w[1]) THEN 0.5 ELSE 0 END + CASE WHEN w[1] = w[2] THEN 0 WHEN list_contains(string_split(name, ' '), w[2]) THEN 1 WHEN contains(form, w[2]) THEN 0.5 ELSE 0 END) / len(list_distinct(w)) * 100) AS weight
FROM v JOIN f USING (p_size) WHERE contains(form, v) GROUP BY request, path, name, form, w),
x AS (SELECT request, path, 'doc_number' AS strategy, 1000 AS weight FROM r JOIN f USING (p_size) WHERE way = 0 AND r.n = f.n
UNION ALL SELECT request, path, 'name_match', CAST(weight AS INTEGER) FROM m UNION ALL SELECT request, path, 'page_ref', 0 FROM r JOIN f USING (p_size) WHERE way = 100 AND r.page = f.page)
SELECT request, path, strategy, CAST(weight AS INTEGER) AS weight FROM x"""


@query("cabinet_search", _CABINETS)
def cabinet_search(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    cabinet = F.concat(F.lit("C"), F.col("p_size")).alias("cabinet")
    file = F.concat(k % 100, F.lit(".001 "), F.col("p_name"), F.lit(" "), cabinet, F.lit("-Q"), F.chr(F.lit(97) + k % 7), F.lit(".PDF"))
    files = D.cabinet_files(part.select(cabinet, file.alias("file"), F.concat(F.lit("f"), k).alias("path")))
    words, way = F.split("p_name", " "), k % 150
    asked = part.filter("p_partkey % 50 = 0").select(
        k.alias("request"), cabinet, F.when(way == 0, (k % 100).cast("string")).when(way == 100, F.concat(F.lit("q"), F.chr(F.lit(65) + k % 5))).alias("doc"),
        F.when(way == 50, F.concat(F.upper(words[1]), F.lit(", "), F.upper(words[0]))).alias("grantor"), F.lit(None).cast("string").alias("grantee"),
    )
    return D.search_cabinet(files, asked).select("request", "path", "strategy", "weight")


@query(
    "substring_join",
    """WITH n AS (SELECT DISTINCT substr(p_name, 1 + CAST(p_partkey // 50 % 4 AS INTEGER), 2 + CAST(p_partkey // 50 % 5 AS INTEGER)) AS name FROM part WHERE p_partkey % 50 = 0)
SELECT p_partkey, name FROM part JOIN n ON contains(p_name, name) WHERE name <> ''""",
)
def substring_join(spark, sf_dir):
    part, step = table(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / 50)
    names = part.filter("p_partkey % 50 = 0").select(F.substring("p_name", 1 + step % 4, 2 + step % 5).alias("name"))
    return matching.containing(part, "p_name", names, "name").select("p_partkey", "name")


@query(
    "prefix_join",
    """WITH n AS (SELECT DISTINCT substr(c_name, 1, 14 + CAST(c_custkey // 50 % 5 AS INTEGER)) AS name FROM customer WHERE c_custkey % 50 = 0)
SELECT c_custkey, name FROM customer JOIN n ON starts_with(c_name, name)""",
)
def prefix_join(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    names = rows.filter("c_custkey % 50 = 0").select(F.substring("c_name", F.lit(1), 14 + F.floor(F.col("c_custkey") / 50) % 5).alias("name"))
    return matching.beginning_with(rows, "c_name", names, "name").select("c_custkey", "name")


def _square(x, y, w):
    """A square ring with its lower left corner at x, y."""
    corner = lambda dx, dy: F.struct((x + dx * w).cast("double").alias("lng"), (y + dy * w).cast("double").alias("lat"))
    return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))


# squares of 4 on a grid; every fiftieth asks: as it is, moved by half its side, a quarter of it inside, all around it
_ASKED = """WITH p AS (SELECT c_custkey AS pos, c_custkey % 40 * 4 AS x, c_custkey // 40 * 4 AS y FROM customer),
q AS (SELECT pos AS query, CASE pos % 200 WHEN 0 THEN x WHEN 50 THEN x + 2 WHEN 100 THEN x + 1 ELSE x - 1 END AS x, CASE pos % 200 WHEN 0 THEN y WHEN 50 THEN y + 2 WHEN 100 THEN y + 1 ELSE y - 1 END AS y,
CASE pos % 200 WHEN 0 THEN 4 WHEN 50 THEN 4 WHEN 100 THEN 1 ELSE 6 END AS w FROM p WHERE pos % 50 = 0),
m AS (SELECT query, pos, p.x >= q.x + w OR q.x >= p.x + 4 OR p.y >= q.y + w OR q.y >= p.y + 4 AS touch, p.x = q.x AND p.y = q.y AND w = 4 AS same, q.x <= p.x AND q.y <= p.y AND p.x + 4 <= q.x + w AND p.y + 4 <= q.y + w AS inside,
p.x <= q.x AND p.y <= q.y AND q.x + w <= p.x + 4 AND q.y + w <= p.y + 4 AS around FROM q JOIN p ON p.x <= q.x + w AND q.x <= p.x + 4 AND p.y <= q.y + w AND q.y <= p.y + 4)"""


def _asked_squares(spark, sf_dir):
    k, c = F.col("c_custkey"), F.col
    parcels = table(spark, sf_dir, "customer").select(k.alias("pos"), (k % 40 * 4).alias("x"), (F.floor(k / 40) * 4).alias("y"))
    way = c("pos") % 200
    moved = F.when(way == 0, 0).when(way == 50, 2).when(way == 100, 1).otherwise(-1)
    asked = parcels.filter("pos % 50 = 0").select(c("pos").alias("query"), _square(c("x") + moved, c("y") + moved, F.when(way.isin(0, 50), 4).when(way == 100, 1).otherwise(6)).alias("polygon"))
    return parcels.select("pos", c("pos").alias("upc"), _square(c("x"), c("y"), F.lit(4)).alias("polygon"), F.repeat(F.lit("tract "), 50).alias("legal")), asked


@query(
    "polygon_relations",
    _ASKED + " SELECT query, pos, CASE WHEN touch THEN 'touches' WHEN same THEN 'equal' WHEN inside THEN 'contains' WHEN around THEN 'within' ELSE 'overlaps' END AS relation FROM m",
)
def polygon_relations(spark, sf_dir):
    parcels, asked = _asked_squares(spark, sf_dir)
    found = spatial.relations(asked.select(F.col("query").alias("id"), "polygon"), parcels.select(F.col("pos").alias("id"), "polygon"))
    return found.select(F.col("a").alias("query"), F.col("b").alias("pos"), "relation")


@query(
    "spatial_adjoiners",
    _ASKED + """ SELECT query, pos, CASE WHEN touch THEN 'touches' ELSE 'intersects' END AS spatial_rel, CAST(200 AS INTEGER) AS letters
FROM (SELECT *, bool_or(touch) OVER (PARTITION BY query) AS any_touch FROM m) WHERE touch OR NOT any_touch QUALIFY row_number() OVER (PARTITION BY query ORDER BY pos) <= 100""",
)
def spatial_adjoiners(spark, sf_dir):
    parcels, asked = _asked_squares(spark, sf_dir)
    return spatial.spatial_adjoiners(asked, parcels).select("query", "pos", "spatial_rel", F.length("legal").alias("letters"))


@query(
    "point_sections",
    """WITH s AS (SELECT n_nationkey AS id, n_nationkey % 5 * 4 AS x, n_nationkey // 5 * 4 AS y FROM nation)
SELECT l_orderkey * 10 + l_linenumber AS point, 'T' || arg_min(y, id) || 'N R' || arg_min(x, id) || 'E S' || min(id) AS trs FROM lineitem JOIN s ON l_partkey % 21 + 1 BETWEEN x AND x + 4 AND l_suppkey % 23 + 0.5 BETWEEN y AND y + 4 GROUP BY 1""",
)
def point_sections(spark, sf_dir):
    n, c = F.col("n_nationkey"), F.col
    x, y = n % 5 * 4, F.floor(n / 5) * 4
    sections = table(spark, sf_dir, "nation").select(n.alias("id"), _square(x, y, F.lit(4)).alias("polygon"), y.alias("twp"), F.lit("N").alias("twp_dir"), x.alias("rng"), F.lit("E").alias("rng_dir"), n.alias("sec"))
    points = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("point"), (c("l_partkey") % 21 + 1).alias("x"), (c("l_suppkey") % 23 + 0.5).alias("y"))
    return spatial.sections_of(points.distinct(), sections)


@query(
    "addresses",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_custkey || ' MAIN' WHEN 2 THEN 'MAIN TAOS' ELSE 'No address' END AS address, CASE WHEN c_custkey % 2 = 0 THEN 'T2N R' || c_nationkey || 'E SEC 4' END AS trs FROM customer",
)
def addresses(spark, sf_dir):
    k = F.col("c_custkey")
    parts = {
        "address1": F.when(k % 4 == 0, F.col("c_name")), "number": F.when(k % 4 == 1, k), "street": F.when((k % 4).isin(1, 2), "MAIN"), "city": F.when(k % 4 == 2, " TAOS "),
        "state": F.lit(""), "zip": F.lit("87571"),
    }
    trs = T.trs_of(F.when(k % 2 == 0, F.lit(2)), F.lit("n"), F.col("c_nationkey"), F.lit("E"), F.lit("4"))
    return table(spark, sf_dir, "customer").select("c_custkey", research.address(parts).alias("address"), trs.alias("trs"))


@query(
    "deed_summaries",
    "SELECT c_custkey, c_name AS grantor, CASE WHEN c_custkey % 2 = 0 THEN '$' || c_custkey || '1' END AS price, 2 AS parties, 1 AS dates, 'lot 3; all of it' AS legal FROM customer",
)
def deed_summaries(spark, sf_dir):
    k = F.col("c_custkey")
    fields = F.create_map(
        F.lit("Grantors"), F.col("c_name"), F.lit("From"), F.col("c_name"), F.lit("To"), F.lit("X"), F.lit("Amount"), F.when(k % 2 == 0, F.concat(F.lit("$"), k, F.lit("1"))).otherwise("$0.00"),
        F.lit("Record Date"), F.lit("01/02/2001"), F.lit("Instrument Date"), F.lit("01/02/2001"), F.lit("Other_Legal"), F.lit("lot 3"), F.lit("Legal"), F.lit("all of it"), F.lit("Description"), F.lit(" "),
    )
    s = research.deed_summary(fields)
    return table(spark, sf_dir, "customer").select("c_custkey", s["grantor"].alias("grantor"), s["price"].alias("price"), F.size(s["parties"]).alias("parties"), F.size(s["dates"]).alias("dates"), s["legal"].alias("legal"))


@query(
    "small_lookups",
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 97 WHEN 1 THEN 65 ELSE 20 END AS confidence, CASE p_size % 2 WHEN 0 THEN 1 ELSE 0 END AS rank, 1990 - p_size <= 1960 AS reached, CASE WHEN p_size = 7 THEN 'highlight' WHEN p_brand = 'Brand#2' THEN 'board' ELSE 'none' END AS fill FROM part",
)
def small_lookups(spark, sf_dir):
    size = F.col("p_size")
    strategy = F.when(size % 3 == 0, "exact_ref").when(size % 3 == 1, "client_name").otherwise("other")
    years = F.array((F.lit(1990) - size).cast("int"), F.lit(1995))
    fill = research.fill_class(size.cast("string"), F.col("p_brand"), F.array(F.lit("7")), F.array(F.lit("BRAND#2")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", research.plat_confidence(strategy).alias("confidence"), research.tier_rank(F.when(size % 2 == 0, "Pro")).alias("rank"), research.goal_reached(years, F.lit(1960)).alias("reached"), fill.alias("fill"),
    )


@query("jobs_of_persons", f"WITH l AS {_LINKS} SELECT p AS id, j AS job, 'adjoiner_in' AS relationship FROM l WHERE p IN ('person:s1', 'person:s2')")
def jobs_of_persons(spark, sf_dir):
    _, edges = _graph(spark, sf_dir)
    return research.jobs_of(edges, spark.createDataFrame([("person:s1",), ("person:s2",)], "id string"))


@query(
    "lengths_in_feet",
    "SELECT p_partkey, round(p_size * CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 66 WHEN 2 THEN 16.5 ELSE 1 END, 6) AS feet FROM part",
)
def lengths_in_feet(spark, sf_dir):
    size = F.col("p_size")
    unit = F.when(size % 4 == 0, "Yards").when(size % 4 == 1, "chains").when(size % 4 == 2, "rods").otherwise("ft.")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(G.to_feet(size.cast("double"), unit), 6).alias("feet"))


@query(
    "distances",
    """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS a, CAST(embedding[2] AS DOUBLE) * 10 AS b, CAST(embedding[3] AS DOUBLE) * 10 AS c, CAST(embedding[4] AS DOUBLE) * 10 AS d FROM embeddings)
SELECT vec_id, round(2 * 3958.8 * asin(sqrt(least(1, pow(sin((radians(c) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)))), 3) AS miles FROM p""",
)
def distances(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double") * 10
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(G.haversine_miles(e(0), e(1), e(2), e(3)), 3).alias("miles"))


@query(
    "session_steps",
    """SELECT l_orderkey AS job, CASE WHEN count(*) FILTER (l_linenumber = 1 AND l_returnflag = 'R') = 0 THEN 2 WHEN l_orderkey % 3 = 0 THEN 3 WHEN count(*) FILTER (l_linenumber > 1) = 0 THEN 4
WHEN bool_and(l_linestatus = 'O') FILTER (l_linenumber > 1) THEN 6 ELSE 5 END AS step FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY l_orderkey""",
)
def session_steps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    job = F.col("l_orderkey")
    deed = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    client = F.max(F.when(F.col("l_linenumber") == 1, F.struct(deed.alias("deed_saved"), F.when(job % 3 != 0, "lot").alias("property_description"), F.lit("").alias("desc_type"))))
    open_ = F.col("l_linestatus") == "O"
    others = F.collect_list(F.when(F.col("l_linenumber") > 1, F.struct(open_.alias("deed_saved"), open_.alias("plat_saved"))))
    jobs = rows.groupBy(job.alias("job")).agg(F.bool_or(deed).alias("deed"), client.alias("client"), others.alias("adjoiners")).filter("client IS NOT NULL")
    client = F.struct(F.col("deed").alias("deed_saved"), F.col("client.property_description").alias("property_description"), F.lit("").alias("desc_type"))
    return jobs.select("job", scores.session_step(client, F.col("adjoiners")).alias("step"))


@query(
    "session_flags",
    """WITH s AS (SELECT l_orderkey AS job, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS done FROM lineitem GROUP BY 1), t AS (SELECT job, n, round(100.0 * done / n, 1) AS share, CASE WHEN job % 2 = 0 THEN 'BDY' ELSE 'SDV' END AS kind FROM s),
b AS (SELECT kind, count(*) AS c, round(avg(n), 2) AS m, round(coalesce(stddev_samp(n), 0), 2) AS d FROM t GROUP BY 1), z AS (SELECT job, n, share, c, CASE WHEN d > 0 THEN (n - m) / d ELSE 0 END AS z FROM t JOIN b USING (kind))
SELECT job AS job_number, 'adjoiners' AS category, CASE WHEN z < -2 THEN 'info' WHEN z > 3 THEN 'error' ELSE 'warning' END AS severity FROM z WHERE c >= 5 AND (z < -2 OR z > 2) UNION ALL SELECT job, 'documents', CASE WHEN share < 50 THEN 'error' ELSE 'warning' END FROM z WHERE share < 80""",
)
def session_flags(spark, sf_dir):
    open_ = F.col("l_linestatus") == "O"
    subject = F.struct(F.col("l_linenumber").cast("string").alias("name"), F.lit("adjoiner").alias("type"), open_.alias("deed_saved"), open_.alias("plat_saved"))
    sessions = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_number")).agg(F.collect_list(subject).alias("subjects"))
    sessions = sessions.withColumn("job_type", F.when(F.col("job_number") % 2 == 0, "BDY").otherwise("SDV"))
    base = stats.baselines(stats.session_metrics(sessions), "job_type", "adjoiner_count")
    return conflicts.session_flags(sessions, base).select("job_number", "category", "severity")


@query(
    "similar_descriptions",
    """SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 THEN 40.0 ELSE 0.0 END + CASE WHEN p_size = 7 THEN 20.0 ELSE 0.0 END + 25.0 * 1 / 4, 1) AS score FROM part WHERE p_size % 5 = 0 OR p_size = 7 ORDER BY score DESC, p_partkey LIMIT 25""",
)
def similar_descriptions(spark, sf_dir):
    from parcelworks.operators.similarity import similar_descriptions as similar

    size = F.col("p_size")
    text = F.concat(F.lit("zzz in "), F.when(size % 5 == 0, "T5N R6E").otherwise("T8N R9E"), F.lit(" plat "), F.when(size == 7, "CAB C-7").otherwise("CAB C-8"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("pos"), text.alias("description"))
    return similar(rows, "xxx at T5N R6E of CAB C-7", limit=25).select("p_partkey", "score")


_DESCRIBED = """(SELECT k, s, t, 'plat of ' || p_name || CASE WHEN k % 3 > 0 THEN ', T' || t || 'N R13E' || CASE WHEN s > 0 THEN ' Sec ' || s ELSE '' END ELSE '' END || CASE WHEN k % 11 < 2 THEN ' CAB C-' || p_size ELSE '' END
|| CASE WHEN k % 4 = 0 THEN ' LOT ' || p_size % 6 || ';' ELSE '' END || CASE WHEN k % 5 < 2 THEN ' lands of ' || split_part(p_name, ' ', 1) ELSE '' END AS d, k % 3 > 0 AS has_t, CASE WHEN k % 11 < 2 THEN p_size END AS cab,
CASE WHEN k % 4 = 0 THEN p_size % 6 END AS lot, CASE WHEN k % 5 < 2 THEN lower(split_part(p_name, ' ', 1)) END AS name FROM (SELECT *, p_partkey AS k, p_partkey % 7 AS s, 20 + p_size % 5 AS t FROM part))"""


@query(
    "similar_descriptions_each",
    f"""WITH p AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(d), '[a-z]{{3,}}')), lambda x: NOT list_contains([%STOP%], x)) AS w FROM {_DESCRIBED}),
x AS (SELECT q.k AS query_id, p.k AS p_partkey, CASE WHEN p.has_t AND q.has_t AND p.t = q.t THEN CASE WHEN p.s = q.s THEN 100.0 ELSE 30.0 END ELSE 0.0 END AS a,
100.0 * len(list_intersect(p.w, q.w)) / len(list_distinct(list_concat(p.w, q.w))) AS b, CASE WHEN p.cab = q.cab THEN 100.0 ELSE 0.0 END AS c, CASE WHEN p.name = q.name THEN 100.0 ELSE 0.0 END AS e, CASE WHEN p.lot = q.lot THEN 100.0 ELSE 0.0 END AS f
FROM p, p AS q WHERE q.k % 50 = 0), s AS (SELECT query_id, p_partkey, round((a * 40 + b * 25 + c * 20 + e * 10 + f * 5) / 100, 1) AS score FROM x)
SELECT query_id, p_partkey, score, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS nth FROM s WHERE score >= 20) WHERE nth <= 20""".replace(
        "%STOP%", ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    ),
)
def similar_descriptions_each(spark, sf_dir):
    from parcelworks.operators.descriptions import similar_descriptions_each as similar

    k, size, s, none = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 7, F.lit("")
    text = F.concat(
        F.lit("plat of "), F.col("p_name"), F.when(k % 3 > 0, F.concat(F.lit(", T"), 20 + size % 5, F.lit("N R13E"), F.when(s > 0, F.concat(F.lit(" Sec "), s)).otherwise(none))).otherwise(none),
        F.when(k % 11 < 2, F.concat(F.lit(" CAB C-"), size)).otherwise(none), F.when(k % 4 == 0, F.concat(F.lit(" LOT "), size % 6, F.lit(";"))).otherwise(none),
        F.when(k % 5 < 2, F.concat(F.lit(" lands of "), F.split("p_name", " ")[0])).otherwise(none),
    )
    rows = table(spark, sf_dir, "part").select(k, k.alias("pos"), text.alias("description"))
    queries = rows.filter("p_partkey % 50 = 0").select(k.alias("query_id"), F.col("description").alias("query"))
    return similar(rows, queries, "p_partkey", "query_id").select("query_id", "p_partkey", "score", "nth")


_MERGED = """WITH RECURSIVE p AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 4 <> 3 AND s_suppkey + 1 < (SELECT count(*) FROM supplier)),
w AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS id, a AS o FROM w UNION SELECT r.id, w.b FROM r JOIN w ON w.a = r.o),
c AS (SELECT id, min(o) AS root FROM r GROUP BY id),
e AS (SELECT DISTINCT l_suppkey AS s, 1000000 + l_partkey % 50 AS d FROM lineitem WHERE l_quantity > 40),
g AS (SELECT id, count(*) AS n FROM (SELECT s AS id FROM e UNION ALL SELECT d FROM e) GROUP BY id),
k AS (SELECT root, arg_min(id, (-coalesce(n, 0), id)) AS keep FROM c LEFT JOIN g USING (id) GROUP BY root), t AS (SELECT id, keep FROM c JOIN k USING (root))"""


def _supplier_graph(spark, sf_dir):
    from parcelworks.operators.graph import contracted

    k, supplier = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    n = supplier.count()
    pairs = supplier.filter((k % 4 != 3) & (k + 1 < n)).select(k.alias("a"), (k + 1).alias("b"))
    edges = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_suppkey").alias("src"), (1_000_000 + F.col("l_partkey") % 50).alias("dst")).distinct()
    edges = edges.withColumns({"relationship": F.lit("sells"), "seq": F.col("src")})
    return contracted(supplier.select(k.alias("id"), F.col("s_name").alias("name")), edges, pairs)


@query("merged_nodes", _MERGED + " SELECT s_suppkey AS id, s_name AS name, CAST((SELECT count(*) FROM t WHERE keep = s_suppkey AND t.id <> keep) AS INTEGER) AS aliases FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM t WHERE id <> keep)")
def merged_nodes(spark, sf_dir):
    return _supplier_graph(spark, sf_dir)[0].select("id", "name", F.size("aliases").alias("aliases"))


@query("merged_edges", _MERGED + " SELECT coalesce(keep, s) AS src, d AS dst, max(s) AS seq FROM e LEFT JOIN t ON t.id = e.s GROUP BY 1, 2")
def merged_edges(spark, sf_dir):
    return _supplier_graph(spark, sf_dir)[1].select("src", "dst", "seq")
