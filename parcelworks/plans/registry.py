"""Named queries over the test tables, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""

    def put(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return put


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "parcel_search",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(upper(c_name), '77') ORDER BY c_custkey LIMIT 50",
)
def parcel_search(spark, sf_dir):
    from parcelworks.operators.search import search_parcels

    c = table(spark, sf_dir, "customer")
    found = search_parcels(c.withColumns({"pos": F.col("c_custkey"), "owner": F.col("c_name")}), owner="77")
    return found.select("c_custkey", "c_name", "c_mktsegment")


def parcels_like(spark, sf_dir: str):
    """customer as parcels: pos, owner, upc, book, page, plat, cab_refs, official, source."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("pos"),
        F.col("c_name").alias("owner"),
        F.lpad(F.col("c_custkey").cast("string"), 13, "0").alias("upc"),
        F.col("c_nationkey").cast("string").alias("book"),
        (F.col("c_custkey") % 97).cast("string").alias("page"),
        F.concat(F.lit("CAB "), F.substring("c_mktsegment", 1, 1), F.lit("-"), F.col("c_nationkey").cast("string")).alias("plat"),
        F.array(F.concat(F.substring("c_mktsegment", 1, 1), F.lit("-"), F.col("c_nationkey").cast("string"))).alias("cab_refs"),
        F.col("c_mktsegment").alias("official"),
        F.when(F.col("c_custkey") % 2 == 0, "a.kml").otherwise("b.kmz").alias("source"),
    )


PARCELS = """(SELECT c_custkey AS pos, c_name AS owner, lpad(CAST(c_custkey AS VARCHAR), 13, '0') AS upc, CAST(c_nationkey AS VARCHAR) AS book,
  CAST(c_custkey % 97 AS VARCHAR) AS page, 'CAB ' || substr(c_mktsegment, 1, 1) || '-' || c_nationkey AS plat,
  substr(c_mktsegment, 1, 1) || '-' || c_nationkey AS cab, c_mktsegment AS official FROM customer)"""


@query(
    "search_combined",
    f"SELECT pos, owner, upc FROM {PARCELS} WHERE contains(upper(owner) || ' ' || upper(official), 'B') AND book = '7' AND contains(upper(plat), 'B-7') ORDER BY pos LIMIT 50",
)
def search_combined(spark, sf_dir):
    from parcelworks.operators.search import search_parcels

    return search_parcels(parcels_like(spark, sf_dir), owner="b", book="7", cabinet_ref="B-7").select("pos", "owner", "upc")


@query("search_prefix_exact", "SELECT p_partkey, p_name FROM part WHERE starts_with(upper(p_name), 'RED') OR upper(p_name) = 'BLUE WIDGET'")
def search_prefix_exact(spark, sf_dir):
    from parcelworks.operators.search import owner_matches

    part = table(spark, sf_dir, "part").withColumn("owner", F.col("p_name"))
    return part.filter(owner_matches(part, "red", "begins") | owner_matches(part, "Blue Widget", "exact")).select("p_partkey", "p_name")


@query("search_fallback", f"SELECT pos, owner, upc FROM {PARCELS} WHERE upc = '0000000000077'")
def search_fallback(spark, sf_dir):
    from parcelworks.operators.search import search_with_fallback

    parcels = parcels_like(spark, sf_dir).withColumn("owner", F.translate("owner", "0123456789#", "")).drop("official")
    found = search_with_fallback(parcels, "0000000000077")
    return found.join(parcels_like(spark, sf_dir).select("pos", F.col("owner").alias("full")), "pos").select("pos", F.col("full").alias("owner"), "upc")


@query("page_listing", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'e') ORDER BY p_partkey LIMIT 25 OFFSET 50")
def page_listing(spark, sf_dir):
    from parcelworks.operators.search import page_of

    return page_of(table(spark, sf_dir, "part").filter(F.col("p_name").contains("e")), "p_partkey", 3, 25).select("p_partkey", "p_name")


@query(
    "dedup_best",
    """SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source DESC, n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1""",
)
def dedup_best(spark, sf_dir):
    from parcelworks.operators.ordering import best_per_key

    return best_per_key(table(spark, sf_dir, "documents"), "text", F.desc("source"), F.desc("n_chars"), F.col("doc_id")).select("doc_id", "source", "n_chars")


@query(
    "merge_index",
    f"""WITH p AS (SELECT pos, CASE WHEN pos % 10 = 3 THEN '' ELSE CAST(pos // 3 AS VARCHAR) END AS upc, CASE WHEN pos % 5 = 0 THEN '' ELSE plat END AS plat,
  CASE WHEN pos % 4 = 0 THEN 'x.kmz/doc.kml' ELSE 'x.kml' END AS source FROM {PARCELS}),
k AS (SELECT *, row_number() OVER (PARTITION BY upc ORDER BY CASE WHEN contains(source, '.kmz') THEN 0 ELSE 1 END, length(plat) DESC, pos) AS r FROM p WHERE upc <> '')
SELECT pos, upc, plat, source FROM k WHERE r = 1 UNION ALL SELECT pos, upc, plat, source FROM p WHERE upc = ''""",
)
def merge_index(spark, sf_dir):
    from parcelworks.operators.ordering import merge_index as merge

    pos = F.col("pos")
    rows = parcels_like(spark, sf_dir).select(
        "pos",
        F.when(pos % 10 == 3, "").otherwise(F.floor(pos / 3).cast("string")).alias("upc"),
        F.when(pos % 5 == 0, "").otherwise(F.col("plat")).alias("plat"),
        F.when(pos % 4 == 0, "x.kmz/doc.kml").otherwise("x.kml").alias("source"),
    )
    return merge(rows).select("pos", "upc", "plat", "source")


@query(
    "prioritised_union",
    """WITH a AS (SELECT c_custkey AS pos, c_nationkey AS k, 0 AS prio FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 12),
b AS (SELECT s_suppkey AS pos, s_nationkey AS k, 1 AS prio FROM supplier ORDER BY s_suppkey LIMIT 12), c AS (SELECT c_custkey AS pos, c_nationkey AS k, 2 AS prio FROM customer ORDER BY c_custkey LIMIT 40)
SELECT pos, CAST(k AS INTEGER) AS k, CAST(prio AS INTEGER) AS prio FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY prio, pos) AS r FROM (FROM a UNION ALL FROM b UNION ALL FROM c)) WHERE r = 1 ORDER BY prio, pos LIMIT 15""",
)
def prioritised_union(spark, sf_dir):
    from parcelworks.operators.ordering import prioritised_union as union

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("k"), "c_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_nationkey").alias("k"))
    return union([(c.filter("c_acctbal < 0").drop("c_acctbal"), 12), (s, 12), (c.drop("c_acctbal"), 40)], F.col("k").cast("string"), 15).select("pos", "k", "prio")


@query(
    "score_union",
    """WITH h AS (SELECT CAST(o_custkey AS VARCHAR) AS upc, 100 AS score, 'large' AS reason, o_orderkey * 4 AS seq FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 50, 'urgent', o_orderkey * 4 + 1 FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 10, 'open', o_orderkey * 4 + 2 FROM orders WHERE o_orderstatus = 'O')
SELECT upc, sum(score) AS score, string_agg(reason, ' + ' ORDER BY seq) AS reasons FROM h GROUP BY upc ORDER BY score DESC, min(seq) LIMIT 30""",
)
def score_union(spark, sf_dir):
    from parcelworks.operators.ordering import score_union as union

    o = table(spark, sf_dir, "orders")
    rule = lambda where, score, reason, n: o.filter(where).select(F.col("o_custkey").cast("string").alias("upc"), F.lit(score).alias("score"), F.lit(reason).alias("reason"), (F.col("o_orderkey") * 4 + n).alias("seq"))
    hits = rule("o_totalprice > 400000", 100, "large", 0).unionByName(rule("o_orderpriority = '1-URGENT'", 50, "urgent", 1)).unionByName(rule("o_orderstatus = 'O'", 10, "open", 2))
    return union(hits)


@query(
    "merge_upsert",
    """SELECT coalesce(n.k, o.k) AS k, coalesce(n.name, o.name) AS name, coalesce(n.seg, o.seg) AS seg FROM
(SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 2 = 0) o FULL JOIN
(SELECT c_custkey AS k, upper(c_name) AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'NEW' END AS seg FROM customer WHERE c_custkey % 3 = 0) n ON o.k = n.k""",
)
def merge_upsert(spark, sf_dir):
    from parcelworks.operators.ordering import upsert

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    new = c.filter("k % 3 = 0").select("k", F.upper("name").alias("name"), F.when(F.col("k") % 5 != 0, "NEW").alias("seg"))
    return upsert(c.filter("k % 2 = 0"), new, "k")


@query(
    "history_latest",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM
(SELECT *, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY ts DESC, event_id DESC) AS q FROM events) WHERE q = 1) WHERE r <= 3""",
)
def history_latest(spark, sf_dir):
    from parcelworks.operators.ordering import search_history

    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("query"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return search_history(e, 3).select("user_id", F.col("id").alias("event_id"))


@query("range_join_grid", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND abs(a.embedding[1] - b.embedding[1]) < 0.01 AND abs(a.embedding[2] - b.embedding[2]) < 0.01")
def range_join_grid(spark, sf_dir):
    from parcelworks.operators.adjacency import near_points

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return near_points(e, 0.01)


@query(
    "box_overlap_grid",
    """WITH b AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS y0, CAST(embedding[1] AS DOUBLE) + 0.02 AS x1, CAST(embedding[2] AS DOUBLE) + 0.01 AS y1 FROM embeddings)
SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.id < b.id AND a.x0 - 0.002 <= b.x1 + 0.002 AND b.x0 - 0.002 <= a.x1 + 0.002 AND a.y0 - 0.002 <= b.y1 + 0.002 AND b.y0 - 0.002 <= a.y1 + 0.002""",
)
def box_overlap_grid(spark, sf_dir):
    from parcelworks.operators.adjacency import box_pairs

    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    boxes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x0"), y.alias("y0"), (x + 0.02).alias("x1"), (y + 0.01).alias("y1"))
    return box_pairs(boxes, 0.004, 0.03)


@query("band_join", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) <= 1.0")
def band_join(spark, sf_dir):
    from parcelworks.operators.adjacency import band_pairs

    return band_pairs(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", 1.0, "c_custkey")


@query("key_proximity", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND b.c_custkey - a.c_custkey <= 8")
def key_proximity(spark, sf_dir):
    from parcelworks.operators.adjacency import band_pairs

    return band_pairs(table(spark, sf_dir, "customer").withColumn("v", F.col("c_custkey")), "c_nationkey", "v", 8, "c_custkey")


@query(
    "grouping_baseline",
    """SELECT coalesce(o_orderpriority, '_global') AS o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS std FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""",
)
def grouping_baseline(spark, sf_dir):
    from parcelworks.operators.stats import baselines

    return baselines(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice").select("o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(
    "zscore_flags",
    """WITH b AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type)
SELECT event_id, event_type, level FROM (SELECT event_id, e.event_type, CASE WHEN (value - m) / s > 3 THEN 'error' WHEN (value - m) / s > 2 THEN 'warn' WHEN (value - m) / s < -2 THEN 'info' END AS level FROM events e JOIN b USING (event_type)) WHERE level IS NOT NULL""",
)
def zscore_flags(spark, sf_dir):
    from parcelworks.operators.stats import zscore_flags as flags

    return flags(table(spark, sf_dir, "events"), "event_type", "value", "event_id")


@query(
    "quartiles_indexed",
    """SELECT lang, count(*) AS n, list_sort(list(n_chars))[CAST(floor(count(*) * 0.25) AS INTEGER) + 1] AS q1, list_sort(list(n_chars))[CAST(floor(count(*) * 0.75) AS INTEGER) + 1] AS q3, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY lang""",
)
def quartiles_indexed(spark, sf_dir):
    from parcelworks.operators.stats import indexed_quartiles

    return indexed_quartiles(table(spark, sf_dir, "documents"), "lang", "n_chars")


@query("tiers", "SELECT CASE WHEN o_totalprice >= 450000 THEN 'complete' WHEN o_totalprice >= 300000 THEN 'mostly' WHEN o_totalprice >= 125000 THEN 'partial' ELSE 'low' END AS tier, count(*) AS n FROM orders GROUP BY 1")
def tiers(spark, sf_dir):
    from parcelworks.operators.stats import tier

    bounds = [(450_000, "complete"), (300_000, "mostly"), (125_000, "partial")]
    return table(spark, sf_dir, "orders").groupBy(tier(F.col("o_totalprice"), bounds, "low").alias("tier")).agg(F.count("*").alias("n"))


@query("monthly_activity", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def monthly_activity(spark, sf_dir):
    from parcelworks.operators.stats import monthly_counts

    return monthly_counts(table(spark, sf_dir, "orders"), "o_orderdate")


@query(
    "conflict_flags",
    """SELECT severity, count(*) AS n FROM (SELECT CASE WHEN greatest(a, b) / least(a, b) > 3 THEN 'critical' WHEN greatest(a, b) / least(a, b) > 1.5 THEN 'warn' END AS severity
FROM (SELECT l_extendedprice / l_quantity AS a, p_retailprice AS b FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE severity IS NOT NULL GROUP BY 1""",
)
def conflict_flags(spark, sf_dir):
    from parcelworks.operators.stats import area_conflict

    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    met = l.join(p, l["l_partkey"] == p["p_partkey"]).select(area_conflict(F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice")).alias("severity"))
    return met.filter("severity IS NOT NULL").groupBy("severity").agg(F.count("*").alias("n"))


@query(
    "completeness",
    """SELECT l_orderkey AS job, count(*) AS subject_count, count(*) FILTER (l_returnflag = 'R') AS deed_count, count(*) FILTER (l_linestatus = 'O') AS plat_count, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS both_count FROM lineitem GROUP BY 1""",
)
def completeness(spark, sf_dir):
    from parcelworks.operators.stats import session_metrics

    subject = F.struct(F.col("l_linenumber").cast("string").alias("name"), F.lit("adjoiner").alias("type"), (F.col("l_returnflag") == "R").alias("deed_saved"), (F.col("l_linestatus") == "O").alias("plat_saved"))
    sessions = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.collect_list(subject).alias("subjects"))
    return session_metrics(sessions).select("job", *[F.col(c).cast("bigint").alias(c) for c in ("subject_count", "deed_count", "plat_count", "both_count")])


@query(
    "index_health",
    """SELECT count(*) AS total, count(*) FILTER (p_name <> '') AS with_owner, count(*) FILTER (p_size > 10) AS with_plat, CAST(round(100.0 * count(*) FILTER (p_size > 10) / count(*), 1) AS DOUBLE) AS pct_plat FROM part""",
)
def index_health(spark, sf_dir):
    from parcelworks.operators.stats import index_health as health

    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("owner"), F.when(F.col("p_size") > 10, "x").alias("plat"), F.lit("2024-01-01").cast("date").alias("built_at"))
    return health(parts, F.lit("2024-02-15").cast("date")).select("total", "with_owner", "with_plat", "pct_plat")


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))"


@query(
    "top_tokens",
    "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 12",
)
def top_tokens(spark, sf_dir):
    from parcelworks.functions.text import top_concepts

    return top_concepts(table(spark, sf_dir, "documents"), "text")


@query(
    "token_jaccard",
    """WITH q AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')), lambda x: NOT list_contains([%STOP%], x)) AS t FROM benchmark WHERE item_id % 50 = 0),
d AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')), lambda x: NOT list_contains([%STOP%], x)) AS t FROM documents)
SELECT doc_id, item_id, round(len(list_intersect(d.t, q.t)) / len(list_distinct(list_concat(d.t, q.t))), 6) AS jaccard FROM d, q WHERE len(list_intersect(d.t, q.t)) > 0""",
)
def token_jaccard(spark, sf_dir):
    from parcelworks.functions.text import legal_tokens
    from parcelworks.operators.similarity import token_overlap

    tokens = legal_tokens(F.col("text")).alias("tokens")
    queries = table(spark, sf_dir, "benchmark").filter("item_id % 50 = 0").select("item_id", tokens)
    out = token_overlap(table(spark, sf_dir, "documents").select("doc_id", tokens), queries, "doc_id", "item_id")
    return out.select("doc_id", "item_id", F.round(F.col("common") / F.col("whole"), 6).alias("jaccard"))


@query(
    "vector_topk",
    """SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id) AS nth
FROM embeddings, (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0)) WHERE nth <= 3""",
)
def vector_topk(spark, sf_dir):
    from parcelworks.operators.similarity import vector_topk_each

    e = table(spark, sf_dir, "embeddings")
    return vector_topk_each(e, e.filter("vec_id % 50 = 0"), 3).select("query_id", "vec_id")


_QUERY_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')), lambda x: NOT list_contains([%STOP%], x))"


@query(
    "token_jaccard_all",
    f"""WITH q AS (SELECT item_id, {_QUERY_TOKENS} AS t FROM benchmark WHERE item_id % 50 = 0), d AS (SELECT doc_id, {_QUERY_TOKENS} AS t FROM documents)
SELECT doc_id, item_id, CAST(len(list_intersect(d.t, q.t)) AS BIGINT) AS common, CAST(len(list_distinct(list_concat(d.t, q.t))) AS BIGINT) AS whole FROM d, q WHERE len(list_intersect(d.t, q.t)) > 0""",
)
def token_jaccard_all(spark, sf_dir):
    from parcelworks.functions.text import legal_tokens
    from parcelworks.operators.similarity import token_overlap

    tokens = legal_tokens(F.col("text")).alias("tokens")
    queries = table(spark, sf_dir, "benchmark").filter("item_id % 50 = 0").select("item_id", tokens)
    out = token_overlap(table(spark, sf_dir, "documents").select("doc_id", tokens), queries, "doc_id", "item_id")
    return out.select("doc_id", "item_id", F.col("common").cast("bigint").alias("common"), F.col("whole").cast("bigint").alias("whole"))


@query(
    "vector_topk_all",
    """SELECT query_id, vec_id, CAST(nth AS INTEGER) AS nth FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id) AS nth
FROM embeddings, (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0)) WHERE nth <= 10""",
)
def vector_topk_all(spark, sf_dir):
    from parcelworks.operators.similarity import vector_topk_each

    e = table(spark, sf_dir, "embeddings")
    return vector_topk_each(e, e.filter("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "nth")


@query(
    "entity_resolution",
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT DISTINCT name, unnest(string_split(lower(name), ' ')) AS w FROM n), b AS (SELECT w FROM w WHERE length(w) >= 3 GROUP BY w HAVING count(*) BETWEEN 2 AND 500),
k AS (SELECT name, array_to_string(list_sort(string_split(lower(name), ' ')), ' ') AS k FROM n)
SELECT DISTINCT x.name AS a, y.name AS b FROM w x JOIN b USING (w) JOIN w y USING (w) JOIN k p ON p.name = x.name JOIN k q ON q.name = y.name WHERE x.name < y.name AND jaro_winkler_similarity(p.k, q.k) >= 0.88""",
)
def entity_resolution(spark, sf_dir):
    from parcelworks.operators.graph import duplicates

    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct()
    return duplicates(names).select("a", "b")


@query(
    "score_relevance",
    """WITH r AS (SELECT o_orderkey, c_nationkey AS n, c_mktsegment AS seg, c_custkey AS k, o_orderstatus AS st, year(o_orderdate) + 20 AS y FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, least(100, greatest(0, CASE WHEN n = 7 THEN 40 ELSE 0 END + CASE WHEN seg = 'BUILDING' THEN 25 ELSE 0 END + CASE WHEN contains(CAST(k AS VARCHAR), '77') THEN 30 ELSE 0 END
+ CASE WHEN contains(CAST(k AS VARCHAR), '123') THEN 20 ELSE 0 END + CASE st WHEN 'O' THEN 15 WHEN 'F' THEN 12 ELSE -5 END + CASE WHEN y >= 2015 THEN 5 WHEN y >= 2000 THEN 3 ELSE 0 END)) AS score FROM r""",
)
def score_relevance(spark, sf_dir):
    from parcelworks.functions.scores import search_relevance

    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"])
    made = {
        "grantor": F.concat(F.lit("X"), F.col("c_custkey")), "grantee": F.lit("NOBODY"),
        "location": F.concat(F.lit("SEC "), F.col("c_nationkey"), F.lit(" IN "), F.col("c_mktsegment")),
        "instrument_type": F.when(F.col("o_orderstatus") == "O", "Warranty Deed").when(F.col("o_orderstatus") == "F", "Plat").otherwise("Lien"),
        "recorded_date": F.concat(F.lit("01/02/"), F.year("o_orderdate") + 20),
    }
    client = {"section": "7", "subdivision": "Building", "name": "77, A", "adjoiner": "123"}
    return rows.select("o_orderkey", search_relevance(made, client)[0].alias("score"))


@query(
    "graph_degree",
    """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem)
SELECT id, count(*) AS degree FROM (SELECT s AS id FROM e UNION ALL SELECT p FROM e) GROUP BY id ORDER BY degree DESC, id LIMIT 15""",
)
def graph_degree(spark, sf_dir):
    from parcelworks.operators.graph import degrees

    return degrees(_graph(spark, sf_dir)).orderBy(F.desc("degree"), "id").limit(15)


def _graph(spark, sf_dir):
    from parcelworks.operators.graph import canonical_edges

    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.lit("supplies").alias("relationship"), F.col("l_orderkey").alias("seq")
    )
    return canonical_edges(rows)


_REACHED = """WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem), b AS (SELECT s AS x, p AS y FROM e UNION ALL SELECT p, s FROM e),
r AS (SELECT (SELECT min(s) FROM e) AS id, 0 AS hops UNION SELECT y, hops + 1 FROM r JOIN b ON x = id WHERE hops < 3), f AS (SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY id)"""


@query(
    "graph_bfs",
    _REACHED + " SELECT f.id, f.hops, min(o.id) AS parent FROM f LEFT JOIN b ON b.y = f.id LEFT JOIN f o ON o.id = b.x AND o.hops = f.hops - 1 GROUP BY f.id, f.hops",
)
def graph_bfs(spark, sf_dir):
    from parcelworks.operators.graph import bfs

    edges = _graph(spark, sf_dir)
    return bfs(edges, edges.select(F.min("dst").alias("id")), 3)  # suppliers are the larger ends


@query("graph_bfs_all", _REACHED + " SELECT id, hops FROM f")
def graph_bfs_all(spark, sf_dir):
    return graph_bfs(spark, sf_dir).select("id", "hops")


@query(
    "limiter",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, ts, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT key, id, ts, r, true AS allowed, CAST(0 AS INTEGER) AS retry_after, list_value(sec) AS held FROM e WHERE r = 1
UNION ALL SELECT key, id, ts, r, len(h) < 5, CASE WHEN len(h) < 5 THEN 0 ELSE greatest(1, CAST(floor(86400.0 - (sec - h[1])) AS INTEGER) + 1) END, CASE WHEN len(h) < 5 THEN list_append(h, sec) ELSE h END
FROM (SELECT e.*, list_filter(s.held, lambda x: e.sec - x <= 86400.0) AS h FROM s JOIN e ON e.key = s.key AND e.r = s.r + 1))
SELECT key, id, ts, allowed, retry_after FROM s""",
)
def limiter(spark, sf_dir):
    from parcelworks.streaming.limiter import limited

    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts")
    return limited(e, 5, 86_400.0)


@query(
    "monthly_quota",
    """SELECT event_id, user_id, nth, nth <= 10 AS within FROM (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS INTEGER) AS nth FROM events)""",
)
def monthly_quota(spark, sf_dir):
    from parcelworks.streaming.limiter import monthly_quota as quota

    return quota(table(spark, sf_dir, "events")).select("event_id", "user_id", "nth", "within")


@query("html_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf_dir):
    from parcelworks.sources.html import links

    return links(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("host_counts", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark, sf_dir):
    from parcelworks.sources.html import host_counts as counts

    return counts(table(spark, sf_dir, "pages"))


@query(
    "trs_extract",
    "SELECT l_orderkey, l_linenumber, ['T' || CAST(l_quantity AS INTEGER) || 'N-R' || l_linenumber || 'E-S' || (l_partkey % 36 + 1)] AS trs FROM lineitem",
)
def trs_extract(spark, sf_dir):
    from parcelworks.functions.text import trs_fingerprints

    made = F.concat(F.lit("tract in T"), F.col("l_quantity").cast("int"), F.lit("N R. "), F.col("l_linenumber"), F.lit("E, Sec. "), F.col("l_partkey") % 36 + 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", trs_fingerprints(made).alias("trs"))


@query(
    "traverse_closure",
    """SELECT o_orderkey AS job, n AS calls, CAST(round(length, 2) AS DOUBLE) AS length, CASE WHEN e <= 0.5 THEN 'ok' WHEN e <= 1 THEN 'info' WHEN e <= 5 THEN 'warn' ELSE 'critical' END AS closure FROM (SELECT *, sqrt(x * x + y * y) AS e FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, sum(l_quantity + 0.3) AS length,
sum((l_quantity + 0.3) * sin(radians((l_partkey * 37 + l_linenumber * 90) % 360))) AS x, sum((l_quantity + 0.3) * cos(radians((l_partkey * 37 + l_linenumber * 90) % 360))) AS y FROM lineitem GROUP BY 1))""",
)
def traverse_closure(spark, sf_dir):
    from parcelworks.functions import geometry as G

    azimuth = ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 90) % 360).cast("double")
    call = F.struct("l_linenumber", azimuth.alias("azimuth_deg"), (F.col("l_quantity") + 0.3).alias("distance"))
    jobs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.sort_array(F.collect_list(call)).alias("calls"))
    judged = jobs.withColumn("error", G.closing_error(F.col("calls")))
    return judged.select("job", F.size("calls").cast("bigint").alias("calls"), F.round(G.perimeter(F.col("calls")), 2).alias("length"), G.closure_class(F.col("error")).alias("closure"))


@query(
    "shoelace",
    """WITH p AS (SELECT vec_id, list_transform(range(1, 33), lambda i: {'x': CAST(embedding[2 * i - 1] AS DOUBLE), 'y': CAST(embedding[2 * i] AS DOUBLE)}) AS pts FROM embeddings)
SELECT vec_id, CAST(round(abs(list_sum(list_transform(range(1, 33), lambda i: pts[i].x * pts[i % 32 + 1].y - pts[i % 32 + 1].x * pts[i].y))) / 2, 6) AS DOUBLE) AS area FROM p""",
)
def shoelace(spark, sf_dir):
    from parcelworks.functions import geometry as G

    e = F.col("embedding")
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get(e, 2 * i).cast("double").alias("x"), F.get(e, 2 * i + 1).cast("double").alias("y")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(G.shoelace(pts), 6).alias("area"))


@query(
    "age_bucket",
    "SELECT CASE WHEN d / 365.25 > 31 THEN 'warn' WHEN d / 365.25 > 29 THEN 'info' ELSE 'ok' END AS level, count(*) AS n FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '2026-01-01') AS d FROM orders) GROUP BY 1",
)
def age_bucket(spark, sf_dir):
    from parcelworks.functions.scores import age_years

    age = age_years(F.to_date("o_orderdate"), F.lit("2026-01-01").cast("date"))
    level = F.when(age > 31, "warn").when(age > 29, "info").otherwise("ok")
    return table(spark, sf_dir, "orders").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query(
    "band_limit",
    "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 50",
)
def band_limit(spark, sf_dir):
    from parcelworks.operators.ordering import first_per_key

    return first_per_key(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 50).select("o_orderkey", "o_orderpriority")


def _fill_stop_words():
    from parcelworks.functions.text import STOP_WORDS

    for name in ("token_jaccard", "token_jaccard_all"):
        ORACLE_SQL[name] = ORACLE_SQL[name].replace("%STOP%", ", ".join(f"'{w}'" for w in STOP_WORDS))


_fill_stop_words()
