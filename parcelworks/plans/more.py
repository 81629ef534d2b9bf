"""Further queries: text and geometry functions over texts made from columns, enrichment, history and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelworks.functions import deeds as D
from parcelworks.functions import geometry as G
from parcelworks.functions import scores as S
from parcelworks.functions import text as T
from parcelworks.plans.registry import query, table


@query("book_page_parse", "SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS book, CAST(l_partkey AS VARCHAR) AS page FROM lineitem")
def book_page_parse(spark, sf_dir):
    book, page = T.book_page(F.concat(F.lit(" M"), F.col("l_suppkey"), F.lit("-"), F.col("l_partkey"), F.lit(" x")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", book.alias("book"), page.alias("page"))


@query(
    "cabinet_refs",
    "SELECT p_partkey, ['ABCDEF'[p_size % 6 + 1] || '-' || p_partkey || 'A', 'B-' || p_size] AS refs FROM part WHERE NOT ('ABCDEF'[p_size % 6 + 1] = 'B' AND p_partkey || 'A' = CAST(p_size AS VARCHAR))",
)
def cabinet_refs(spark, sf_dir):
    letter = F.substring(F.lit("ABCDEF"), F.col("p_size") % 6 + 1, F.lit(1))
    made = F.concat(F.lit("see CAB. "), F.lower(letter), F.lit(" - "), F.col("p_partkey"), F.lit("a and cabinet B-"), F.col("p_size"), F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", T.cabinet_refs(made).alias("refs"))


@query("lot_block_tract", "SELECT p_partkey, ['lot-' || p_size, 'block-' || p_partkey, 'tract-' || p_size || 'B'] AS refs FROM part")
def lot_block_tract(spark, sf_dir):
    made = F.concat(F.lit("Lot "), F.col("p_size"), F.lit(", Block "), F.col("p_partkey"), F.lit(" of Tract "), F.col("p_size"), F.lit("b"))
    return table(spark, sf_dir, "part").select("p_partkey", T.lot_block_tract(made).alias("refs"))


@query(
    "description_types",
    "SELECT CASE p_size % 4 WHEN 0 THEN 'lot_block' WHEN 1 THEN 'tract' WHEN 2 THEN 'trs_only' ELSE 'unknown' END AS kind, count(*) AS n FROM part GROUP BY 1",
)
def description_types(spark, sf_dir):
    k = F.col("p_size") % 4
    made = F.when(k == 0, "lot 3 of it").when(k == 1, "the tract A").when(k == 2, "in T5N R6E").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").groupBy(T.description_type(made, F.lit(0)).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "owner_names",
    "SELECT c_custkey, upper(split_part(c_name, '#', 1)) || ' ' || CAST(c_custkey AS VARCHAR) AS owner, upper(split_part(c_name, '#', 1)) || ' ' || CAST(c_custkey AS VARCHAR) || ' AND' AS raw FROM customer",
)
def owner_names(spark, sf_dir):
    raw = F.concat(F.upper(F.substring_index("c_name", "#", 1)), F.lit(" "), F.col("c_custkey"), F.lit(" AND"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.owner_key(T.owner_cleaned(F.concat(raw, F.lit(" &")))).alias("owner"), raw.alias("raw"))


@query("cabinet_display", "SELECT p_partkey, p_name AS display, CAST(p_partkey AS VARCHAR) AS doc_number FROM part")
def cabinet_display(spark, sf_dir):
    file = F.concat(F.col("p_partkey"), F.lit(".001   "), F.col("p_name"), F.lit(".PDF"))
    return table(spark, sf_dir, "part").select("p_partkey", D.display_name(file).alias("display"), D.doc_number(file).alias("doc_number"))


@query(
    "best_deed",
    """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 50 WHEN 'F' THEN 40 ELSE 5 END
+ CASE WHEN o_totalprice > 200000 THEN 20 ELSE 0 END + CASE WHEN year(o_orderdate) >= 1997 THEN 5 ELSE 0 END DESC, o_orderkey) AS r FROM (SELECT *, year(o_orderdate) AS y FROM orders)) WHERE r = 1""",
)
def best_deed(spark, sf_dir):
    from parcelworks.operators.ordering import best_per_key

    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "Warranty Deed").when(F.col("o_orderstatus") == "F", "Deed").otherwise("Lien")
    year = F.when(F.year("o_orderdate") >= 1997, 2001).otherwise(1990)
    score = S.deed_priority(kind, F.col("o_totalprice") > 200_000, F.lit(False), year)
    return best_per_key(o.withColumn("s", score), "o_custkey", F.desc("s"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query(
    "enrichment",
    """SELECT c_custkey, o_orderkey AS last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def enrichment(spark, sf_dir):
    from parcelworks.sources.kml import enrich

    index = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("upc"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("upc"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("k"))
    return enrich(index, rows).select("c_custkey", F.col("arcgis.k").alias("last_order"))


@query(
    "centroids",
    "SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + CAST(embedding[3] AS DOUBLE) + CAST(embedding[5] AS DOUBLE)) / 3, 5) AS lng FROM embeddings",
)
def centroids(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double").cast("string")
    made = F.concat_ws(" ", *[F.concat(e(i), F.lit(","), e(i + 1), F.lit(",0")) for i in (0, 2, 4)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(G.centroid(G.points_of(made))["lng"], 5).alias("lng"))


@query(
    "points_in_box",
    "SELECT vec_id FROM embeddings WHERE embedding[1] > -0.05 AND embedding[1] < 0.07 AND embedding[2] > -0.1 AND embedding[2] < 0.02",
)
def points_in_box(spark, sf_dir):
    ring = G.points_of(F.lit("-0.05,-0.1 0.07,-0.1 0.07,0.02 -0.05,0.02 -0.05,-0.1"))
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, sf_dir, "embeddings").filter(G.in_ring(x, y, ring)).select("vec_id")


@query(
    "call_parse",
    "SELECT l_orderkey, l_linenumber, CAST((l_partkey % 89) AS DOUBLE) AS azimuth, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) * 3 AS distance FROM lineitem",
)
def call_parse(spark, sf_dir):
    made = F.concat(F.lit("thence N "), F.col("l_partkey") % 89, F.lit("°00'00\" E, "), F.col("l_quantity").cast("int"), F.lit(" yards to a pin"))
    return table(spark, sf_dir, "lineitem").withColumn("c", F.get(G.parse_calls(made), 0)).select("l_orderkey", "l_linenumber", F.col("c.azimuth_deg").alias("azimuth"), F.col("c.distance").alias("distance"))


@query(
    "call_parse_all",
    "SELECT l_orderkey, l_linenumber, CAST(180 + (l_partkey % 89) AS DOUBLE) AS azimuth, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS distance FROM lineitem",
)
def call_parse_all(spark, sf_dir):
    made = F.concat(F.lit("a stone; thence S "), F.col("l_partkey") % 89, F.lit("°00'00\" W, "), F.col("l_quantity").cast("int"), F.lit(" feet along the fence"))
    rows = table(spark, sf_dir, "lineitem").withColumn("c", F.get(G.parse_calls(made), 0))
    return rows.select("l_orderkey", "l_linenumber", F.col("c.azimuth_deg").alias("azimuth"), F.col("c.distance").alias("distance"))


@query(
    "subscription_tiers",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'free' WHEN event_id % 3 = 0 THEN 'pro' END AS t FROM events)
SELECT CAST(user_id AS VARCHAR) AS "user", coalesce(arg_max(t, event_id) FILTER (t IS NOT NULL), 'free') AS tier FROM e GROUP BY 1""",
)
def subscription_tiers(spark, sf_dir):
    from parcelworks.streaming.limiter import subscription_tiers as tiers

    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user"), n.alias("at"), n.alias("id"),
        F.when(n % 7 == 0, "customer.subscription.deleted").when(n % 3 == 0, "checkout.session.completed").otherwise("invoice.payment_failed").alias("type"),
        F.lit(None).cast("string").alias("status"), F.lit("pro").alias("tier"),
    )
    return tiers(rows)


@query(
    "lockouts",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS "user", event_id AS id, CAST(ts AS TIMESTAMP) AS ts, event_id % 9 = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT "user", id, r, false AS blocked, CASE WHEN ok THEN 0 ELSE 1 END AS n, CAST(NULL AS TIMESTAMP) AS until FROM e WHERE r = 1
UNION ALL SELECT "user", id, r, blocked, CASE WHEN blocked THEN n ELSE m END, CASE WHEN blocked THEN until WHEN m >= 5 THEN ts + INTERVAL 15 MINUTE END
FROM (SELECT e."user", e.id, e.r, e.ts, s.n, s.until, s.until IS NOT NULL AND e.ts < s.until AS blocked, CASE WHEN e.ok THEN 0 ELSE s.n + 1 END AS m FROM s JOIN e ON e."user" = s."user" AND e.r = s.r + 1))
SELECT "user", id, blocked FROM s""",
)
def lockouts(spark, sf_dir):
    from parcelworks.streaming.limiter import lockouts as run

    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 9 == 0).alias("ok"))
    return run(rows).select("user", "id", "blocked")


@query(
    "user_tiers",
    """SELECT t.tier, coalesce(n, 0) AS users, coalesce(a, 0) AS active, coalesce(n, 0) * price AS revenue FROM (VALUES ('free', 0), ('pro', 29), ('team', 79)) t(tier, price) LEFT JOIN
(SELECT CASE WHEN c_nationkey < 5 THEN 'pro' ELSE 'free' END AS tier, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS a FROM customer GROUP BY 1) USING (tier)""",
)
def user_tiers(spark, sf_dir):
    from parcelworks.operators.stats import user_stats

    users = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") < 5, "pro").otherwise("free").alias("tier"), (F.col("c_acctbal") > 0).alias("active"))
    return user_stats(users)


@query(
    "not_cached_yet",
    "SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)) WHERE r <= 5",
)
def not_cached_yet(spark, sf_dir):
    from parcelworks.sinks import missing_only

    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return missing_only(table(spark, sf_dir, "part"), done, "p_partkey", "p_brand", 5).select("p_partkey", "p_brand")


@query(
    "edge_merge",
    """SELECT src, dst, arg_max(w, seq) AS w FROM (SELECT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst, l_linenumber AS w, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_suppkey <> l_partkey) GROUP BY 1, 2""",
)
def edge_merge(spark, sf_dir):
    from parcelworks.operators.graph import canonical_edges

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("w"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return canonical_edges(rows)


@query(
    "novelty",
    """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS t FROM benchmark WHERE item_id % 50 = 0),
d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents)
SELECT item_id, count(*) AS docs, count(*) FILTER (h > 0) AS similar, round(avg(h), 6) AS mean_hits FROM (SELECT item_id, len(list_intersect(w, t)) AS h FROM d, q) GROUP BY item_id""",
)
def novelty(spark, sf_dir):
    from parcelworks.operators.similarity import novelty as verdicts

    words = lambda c: F.array_distinct(T.found(F.lower(c), "([a-z]{4,})")).alias("tokens")
    items = table(spark, sf_dir, "benchmark").filter("item_id % 50 = 0").select("item_id", words(F.col("text")))
    out = verdicts(table(spark, sf_dir, "documents").select("doc_id", words(F.col("text"))), items, "doc_id", "item_id")
    return out.select("item_id", "docs", "similar", F.round("mean_hits", 6).alias("mean_hits"))


@query(
    "novelty_all",
    """WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS t FROM benchmark WHERE item_id % 50 = 0)
SELECT doc_id, item_id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')), t)) AS BIGINT) AS hits FROM documents, q""",
)
def novelty_all(spark, sf_dir):
    words = lambda c: F.array_distinct(T.found(F.lower(c), "([a-z]{4,})"))
    items = table(spark, sf_dir, "benchmark").filter("item_id % 50 = 0").select("item_id", words(F.col("text")).alias("q"))
    docs = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    pairs = docs.crossJoin(F.broadcast(items))  # every pair is a row of the result
    return pairs.select("doc_id", "item_id", F.size(F.array_intersect("w", "q")).cast("bigint").alias("hits"))


@query(
    "vector_index_topk",
    """SELECT query_id, vec_id, CAST(nth AS INTEGER) AS nth FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id) AS nth
FROM embeddings, (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0)) WHERE nth <= 5""",
)
def vector_index_topk(spark, sf_dir):
    from parcelworks.operators.vectors import nearest, vector_index

    e = table(spark, sf_dir, "embeddings")
    return nearest(vector_index(e), e.filter("vec_id % 50 = 0"), 5).select("query_id", "vec_id", "nth")


@query(
    "text_neighbours",
    """WITH w AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents)),
v AS (SELECT doc_id, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM w GROUP BY 1, 2 HAVING s <> 0), z AS (SELECT doc_id, sum(s * s) AS n FROM v GROUP BY 1),
d AS (SELECT q.doc_id AS query_id, v.doc_id, sum(q.s * v.s) AS dot FROM v AS q JOIN v USING (i) WHERE q.doc_id % 50 = 0 GROUP BY 1, 2),
a AS (SELECT x.doc_id AS query_id, y.doc_id, coalesce(dot, 0) / (sqrt(x.n) * sqrt(y.n)) AS c FROM z AS x CROSS JOIN z AS y LEFT JOIN d ON d.query_id = x.doc_id AND d.doc_id = y.doc_id WHERE x.doc_id % 50 = 0)
SELECT query_id, doc_id, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS nth FROM a) WHERE nth <= 5""",
)
def text_neighbours(spark, sf_dir):
    from parcelworks.operators.vectors import hashed_vectors, nearest, vector_index
    from parcelworks.storage import stored

    d = stored(hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text"), "hashed")
    return nearest(vector_index(d, "doc_id", dim=64), d.filter("doc_id % 50 = 0"), 5, "doc_id").select("query_id", "doc_id", "nth")
