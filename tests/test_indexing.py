import glob
import os
from datetime import datetime

from parcelworks.streaming import indexing as I

DAY = [datetime(2024, 1, d) for d in range(1, 9)]


def listing(spark, path, rows):
    spark.createDataFrame(rows, I.LISTING).coalesce(1).write.mode("append").parquet(path)


def files_of(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_only_newer_cabinets_are_rebuilt(spark, tmp_path):
    source, index, state = (f"file://{tmp_path}/{x}" for x in ("in", "index", "state"))
    stream = lambda: spark.readStream.schema(I.LISTING).parquet(source)
    go = lambda: I.follow(stream(), I.rebuild_stale(index), state).awaitTermination(180)
    listing(spark, source, [("A", DAY[0], "1 Rael.PDF", "/a1"), ("A", DAY[0], "note.txt", "/a2"), ("B", DAY[0], "2 Vigil.pdf", "/b1")])
    assert go()
    rows = lambda: sorted((r.cabinet, r.display, r.path, r.doc_number) for r in spark.read.parquet(index).collect())
    assert rows() == [("A", "Rael", "/a1", "1"), ("B", "Vigil", "/b1", "2")]
    before = files_of(f"{tmp_path}/index")
    listing(spark, source, [("A", DAY[2], "1 Rael.PDF", "/a1"), ("A", DAY[2], "3 Vigil.PDF", "/a3"), ("A", DAY[1], "9 Old.PDF", "/a9"), ("B", DAY[0], "7 Same.PDF", "/b7")])
    assert go()
    assert rows() == [("A", "Rael", "/a1", "1"), ("A", "Vigil", "/a3", "3"), ("B", "Vigil", "/b1", "2")]
    same = {f: t for f, t in before.items() if "cabinet=B" in f}
    assert same and all(files_of(f"{tmp_path}/index").get(f) == t for f, t in same.items())  # B wasn't written again
    # replayed batches, an older one last, change nothing
    run, found = I.rebuild_stale(index), rows()
    for _ in range(2):
        run(spark.read.schema(I.LISTING).parquet(source), 7)
        run(spark.createDataFrame([("A", DAY[0], "5 X.PDF", "/x")], I.LISTING), 8)
    assert rows() == found
    run(spark.createDataFrame([], I.LISTING), 9)
    assert rows() == found


def test_merging_by_key_survives_a_replay(spark, tmp_path):
    table = f"file://{tmp_path}/table"
    kind = "upc string, owner string, seq int, bucket string"
    run = I.merge_by_key(table, "upc", "seq", 4)
    first = spark.createDataFrame([(str(i), "old", 1, "x") for i in range(40)] + [(None, "y", 1, "x"), ("3", "newer", 5, "x")], kind)
    second = spark.createDataFrame([("1", "new", 2, "x"), ("3", "late", 3, "x"), ("99", "added", 1, "x")], kind)
    for batch in (first, second, second, first):
        run(batch, 0)
    got = {r.upc: r.owner for r in spark.read.parquet(table).collect()}
    assert got == {str(i): "old" for i in range(40)} | {"1": "new", "3": "newer", "99": "added"}
    before = files_of(f"{tmp_path}/table")
    run(spark.createDataFrame([("1", "newest", 9, "x")], kind), 1)
    after = files_of(f"{tmp_path}/table")
    assert len({os.path.dirname(f) for f in before.keys() ^ after.keys()}) == 1  # one bucket of four


def test_the_log_takes_every_row_once(spark, tmp_path):
    kind = "user string, ts timestamp, note string"
    source, log, state = (f"file://{tmp_path}/{x}" for x in ("in", "log", "state"))
    go = lambda: I.append_log(spark.readStream.schema(kind).json(source), log, state).awaitTermination(180)
    for n in range(2):
        spark.createDataFrame([(f"u{n}", DAY[n], "a"), (f"v{n}", None, "b")], kind).coalesce(1).write.mode("append").json(source)
        assert go() and go()
    assert sorted((r.user, str(r.day)) for r in spark.read.parquet(log).collect()) == [("u0", "2024-01-01"), ("u1", "2024-01-02"), ("v0", "none"), ("v1", "none")]
