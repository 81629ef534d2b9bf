from pyspark.sql import functions as F

from parcelworks.functions import text as T
from parcelworks.operators import adjacency
from parcelworks.operators import research as R


def test_cross_reference_edges(spark):
    parcels = spark.createDataFrame([(1, "u1", "RAEL ADELA", "568", "482", ["C-1"]), (2, "u2", "GARCIA", "1", "2", ["C-1"]), (3, None, "RAEL", "568", "482", []), (4, "", "RAEL", None, None, None)], "pos int, upc string, owner string, book string, page string, cab_refs array<string>")
    deeds = spark.createDataFrame([(1, "Rael, Adela", "Rael, B", "M568-482", "u1", "CAB C-1"), (2, None, "Al, X", None, None, None)], "deed int, grantor string, grantee string, location string, map_upc string, body string")
    got = {(r.deed, r.upc): (r.score, r.reasons, r.nth) for r in R.cross_reference(deeds, parcels).collect()}
    assert got == {(1, "u1"): (200, "map pick + grantor name + grantee name + book-page + cabinet", 1), (1, "u2"): (30, "cabinet", 2)}
    assert R.cross_reference(deeds.limit(0), parcels).count() == 0 and R.cross_reference(deeds, parcels.limit(0)).count() == 0


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [value(R.grid_step(F.lit(w))) for w in (100.0, 30.0, 0.7, 0.0)] == [10.0, 5.0, 0.1, None]
    top = R.top_classes(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, (0.1, 0.4, 0.2, 0.3))))
    assert [x["name"] for x in value(top)] == ["b", "d", "c"]
    assert value(R.trs_parameters(F.lit("T26N R13E SEC 12"))) == "T=26N&R=13E&S=12" and value(R.trs_parameters(F.lit("none"))) == ""
    assert value(T.trs_of(F.lit(None).cast("string"), F.lit("N"), F.lit("1"), F.lit("E"), F.lit("2"))) is None
    assert value(R.last_name(F.lit("  de Vargas, Ana "))) == "DE VARGAS" and value(R.last_name(F.lit(None).cast("string"))) == ""
    assert value(R.tier_rank(F.lit("gold"))) == 0 and value(R.tier_rank(F.lit("TEAM"))) == 2


def test_jobs_archives_and_expiry(spark):
    folders = spark.createDataFrame([("/a", "1234 RAEL ADELA SDV", 3.0), ("/b", "12 - GARCIA", 5.0), ("/c", "notes", 9.0)], "path string, name string, modified double")
    assert [(r.job_number, r.job_type) for r in R.recent_jobs(folders).collect()] == [(12, "BDY"), (1234, "SDV")]
    files = spark.createDataFrame([("x", 0, "/x.json", False), ("x", 1, "/x2.json", True), ("y", 0, "/y", False)], "archive string, rank int, path string, found boolean")
    assert [tuple(r) for r in R.first_archive(files).collect()] == [("x", "/x2.json")]
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS created UNION ALL SELECT timestamp'2024-01-03 12:00:00'")
    assert R.not_expired(rows, F.lit("2024-01-04 00:00:00").cast("timestamp"), 72).count() == 2
    assert R.not_expired(rows, F.lit("2024-01-04 00:00:00").cast("timestamp"), 24).count() == 1


def test_teams(spark):
    log = [("t", "o", 1, "create"), ("t", "a", 2, "invite"), ("t", "a", 3, "accept"), ("t", "b", 4, "accept"), ("t", "o", 5, "leave"), ("t", "c", 6, "invite"), ("t", "c", 7, "accept"), ("t", "c", 8, "leave")]
    members = R.team_members(spark.createDataFrame(log, "team string, user string, seq int, action string"))
    assert sorted((r.user, r.role) for r in members.collect()) == [("a", "member"), ("o", "owner")]
    assert [tuple(r) for r in R.seats(members).collect()] == [("t", 2, 3)]


def test_key_neighbours_agree(spark):
    parcels = spark.createDataFrame([(i, f"{i:013d}") for i in range(0, 60, 3)] + [(99, "12"), (100, None)], "pos int, upc string")
    asked = [f"{i:013d}" for i in (0, 30, 57)]
    got = {(r.query, r.upc) for r in adjacency.key_neighbours_each(parcels, spark.createDataFrame([(u,) for u in asked], "upc string")).collect()}
    assert got == {(u, r.upc) for u in asked for r in adjacency.key_neighbours(parcels, u).collect()}


def test_likely_cabinets_and_prediction_without_jobs(spark):
    from parcelworks.operators import stats

    rows = [(3, "BDY", 4, ["B", "A"]), (1, "BDY", 6, ["A", None]), (2, "BDY", 8, ["D", "C", "C"]), (4, "BDY", 9, None), (5, "BDY", 2, []), (6, "ALTA", 40, ["F", "F", "F"])]
    history = spark.createDataFrame(rows, "job long, job_type string, adjoiner_count int, cabinets array<string>")
    row = stats.predict_complexity(history, "BDY", "cabinets").first()
    assert (row.likely_cabinets, row.n, row.predicted, row.confidence) == (["A", "C", "D"], 5, 5.8, "medium")
    assert stats.predict_complexity(history, "none", "cabinets").first().likely_cabinets == ["F", "A", "C"]
    assert stats.predict_complexity(history.filter("job = 5"), "BDY", "cabinets").first().likely_cabinets == ["C", "B", "A"]
    none = stats.predict_complexity(history.limit(0), "BDY", "cabinets").first()
    assert (none.n, none.predicted, none.complexity, none.confidence, none.p25, none.likely_cabinets) == (0, 6.0, "moderate", "none", None, ["C", "B", "A"])


def test_vesting_and_survey_references(spark):
    texts = ["John and Mary, husband and wife, as JOINT TENANTS", "husband & wife; heirs of Luna", "Acme, Inc.", "incorporated companyman", None, "", "tenant in common, as trustee"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in frame.select(T.vesting(F.col("t")).alias("v")).collect()]
    assert got == [["Joint Tenants", "Husband & Wife"], ["Husband & Wife", "Estate / Heirs"], ["LLC / Corp"], [], [], [], ["Tenants in Common", "Trustee"]]
    refers = spark.createDataFrame([("the plat of Mesa",), ("Recorded  in Book 3",), ("platform of wood",), (None,)], "t string")
    assert [r.v for r in refers.select(T.refers_to_survey(F.col("t")).alias("v")).collect()] == [True, True, False, False]


def test_a_page_meets_a_deed_once(spark):
    parcels = spark.createDataFrame([("1", "2", ["a-1", "B-2"]), ("1", "2", None), ("1", "3", [""])] + [("1", "2", ["A-9"])] * 500, "book string, page string, cab_refs array<string>")
    deeds = spark.createDataFrame([(7, "M1-2"), (7, "M1-2"), (8, "1-3"), (9, None)], "deed int, location string")
    found = R.book_page_cabinets(deeds, parcels)
    assert sorted(map(tuple, found.collect())) == [(7, "A"), (7, "B")]
    assert "collect_set" in found._jdf.queryExecution().optimizedPlan().toString()


def test_session_graph_deals_edges_by_jobs(spark):
    from parcelworks.storage import TASK_ROWS, tasks_for

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark, 10) == least and tasks_for(spark, 100 * TASK_ROWS + 1) == 101
    rows = [(j, "Zoe", [("S1", "adjoiner"), ("S1", "adjoiner"), (f"S{j}", "adjoiner")]) for j in (1, 1, 2)]
    nodes, edges = R.session_graph(spark.createDataFrame(rows, "job_number int, client_name string, subjects array<struct<name:string,type:string>>"), 7)
    assert edges.rdd.getNumPartitions() == 7
    assert sorted((r.kind, r.n) for r in R.graph_counts(nodes, edges).collect()) == [("adjoiner_in", 3), ("adjoins", 3), ("client_of", 2), ("job", 2), ("person", 3)]
