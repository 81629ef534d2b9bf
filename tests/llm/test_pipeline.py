import corpus_pipeline
from parcelworks.llm import decontaminate, language, lines
from parcelworks.llm.common import stored, table

from .test_lines import brute as brute_lines
from .test_near_duplicates import brute as brute_groups
from .test_packing import check_packing

SF = "/root/testdata/sf0.001"


def test_each_stage_against_plain_rules(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        found[name] = docs.collect()
        if name != "pack":
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in rows} for name, rows in found.items()}

    model = language.profiles(table(spark, SF, "documents").filter(language.training_fold()))
    guess = {i: model.predict(r.text) for i, r in before.items()}
    assert ids["language"] == {i for i, (lang, score) in guess.items() if lang != "und" and score >= 0.02}

    want = brute_lines([(r.doc_id, r.text, r.source) for r in found["language"]], lines.RATIO, lines.MIN_PAGES)
    assert sorted((r.doc_id, r.text) for r in found["line_dedup"]) == sorted(want)

    groups = brute_groups([(r.doc_id, r.text) for r in found["line_dedup"]], 80)
    assert ids["near_duplicates"] == {i for i, _, _, kept in groups if kept}

    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {r.doc_id for r in found["near_duplicates"] if decontaminate.reference_hits(r.text, items)[3]}
    assert ids["decontaminate"] == ids["near_duplicates"] - bad and bad

    check_packing(found["pack"], {r.doc_id: r.text for r in found["decontaminate"]})


def test_clean_documents_pass_the_language_stage(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels").filter("quality = 1").select("doc_id")
    good = docs.join(labels, "doc_id")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).select("doc_id").collect()}
    assert {r.doc_id for r in good.collect()} <= kept


def edge_rows():
    prose = "the quick brown fox jumps over the lazy dog and then it runs into the forest where it sleeps until the morning comes again"
    rows = [(i, f"{prose} number {i} {'word ' * (i % 5)}{i * 37} ends here.\nshared line\n{prose[i:]} {i}", "en", "s", 100) for i in range(12)]
    rows += [(20, None, "en", "s", None), (21, "", None, None, 0), (22, " \n ", "en", "s", 3), (None, prose, "en", None, 9), (None, prose, "en", None, 9), (3, rows[3][1], "en", "s", 100)]
    rows += [(30, "longtext " * 60_000 + prose, "en", "s", 1), (31, "12 %% 34", "en", "s", 8)]
    return rows


def test_edge_cases_of_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([("b", "nothing that stands in them at all really not one"), (None, "x"), ("e", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = {"lines": "1", "key": "2", "component": "3", "__id": "4", "contaminated": "5", "kept": "6"}
    docs = spark.createDataFrame(edge_rows(), schema).withColumns({k: lang_lit(v) for k, v in clash.items()}).repartition(3)
    docs = stored(docs.drop("__id"), "edge")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0, name
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        if name != "pack":
            assert docs.columns == columns and set(clash) - {"__id"} <= set(columns)
            last = docs.collect()
    ids = [r.doc_id for r in last]
    assert len([i for i in ids if i == 3]) == 1 and 30 in ids and not {20, 21, 22, 31} & set(ids)
    check_packing(docs.filter("doc_id IS NOT NULL").collect(), {r.doc_id: r.text for r in last if r.doc_id is not None})


def lang_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_stages_keep_null_and_empty_texts(spark, tmp_path):
    spark.createDataFrame([("b", "one two")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, None, None, None, None), (3, "one two", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {name: stage(spark, docs, str(tmp_path)).collect() for name, stage in corpus_pipeline.STAGES}
    assert len(found["line_dedup"]) == 4 and len(found["near_duplicates"]) == 4
    assert sorted(r.doc_id or 0 for r in found["decontaminate"]) == [0, 1, 2] and len(found["pack"]) == 4


def test_stages_read_a_path_that_only_spark_opens(spark, tmp_path):
    spark.conf.set("spark.hadoop.fs.viewfs.mounttable.edge.link./in", f"file://{SF}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.edge.link./in", f"file://{SF}")
    docs = table(spark, "viewfs://edge/in", "documents")
    assert corpus_pipeline.drop_contaminated(spark, docs, "viewfs://edge/in").count() < docs.count()
