from pyspark.sql import functions as F

from quarry.sources.storage import VersionedTable
from quarry.streaming import changes as C

ROW = "struct<k:bigint, v:string>"
LOG = f"seq bigint, gtid string, db string, tbl string, op string, before {ROW}, after {ROW}"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_runs_of_one_table_are_grouped(spark):
    rows = [(1, "a:1", "app", "t", "insert", None, (1, "x")), (2, "a:1", "app", "u", "insert", None, (1, "x")), (3, "a:1", "app", "u", "insert", None, (2, "y")), (4, "a:2", "app", "u", "insert", None, (3, "z"))]
    got = sorted((r["gtid"], r["island"], r["tbl"], r["n"]) for r in C.grouped(log(spark, rows)).collect())
    assert got == [("a:1", 1, "t", 1), ("a:1", 2, "u", 2), ("a:2", 1, "u", 1)]


def test_capture_and_apply_are_inverse(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k bigint, v string")
    after = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "k bigint, v string")
    found = C.capture(before, after, ["k"])
    assert sorted((r["op"], r["k"]) for r in found.collect()) == [("delete", 3), ("insert", 4), ("update", 2)]
    changes = found.select(F.col("k").alias("seq"), F.lit("g").alias("gtid"), "op", "before", "after")
    got = C.apply(before, changes, ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, after.collect()))


def test_executed_transactions_are_skipped(spark):
    rows = [(1, "a:1", "app", "t", "insert", None, (1, "x")), (2, "a:2", "app", "t", "insert", None, (2, "y")), (2, "a:2", "app", "t", "insert", None, (2, "y"))]
    done = spark.createDataFrame([("a:1",)], "gtid string")
    assert [r["seq"] for r in C.deduplicated(log(spark, rows), done).collect()] == [2]
    assert C.after(log(spark, rows), 1).count() == 2


def test_stream_equals_batch_and_resumes(spark, place):
    path, rows = f"{place}/log", [(i, f"a:{i}", "app", "t", "insert", None, (i, "x")) for i in range(6)] + [(6, "a:6", "app", "t", "delete", (1, "x"), None), (7, "a:7", "app", "t", "update", (2, "x"), (9, "moved"))]
    t = VersionedTable.create(spark, f"{place}/t", spark.createDataFrame([], "k bigint, v string"))
    C.write_log(log(spark, rows[:5]), path)
    follow = lambda: C.start_applying(spark, path, log(spark, []).schema, t, ["k"], f"{place}/progress", compact_after=2).awaitTermination()
    follow()
    follow()
    C.write_log(log(spark, rows[5:]), path)
    follow()
    want = C.apply(spark.createDataFrame([], "k bigint, v string"), log(spark, rows), ["k"])
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, want.collect())) and t.meta()["batch"] == 1
    assert C.log_files(spark, path).count() >= 2


def test_lag_is_never_negative(spark):
    rows = spark.createDataFrame([("a", "2030-01-01 00:00:00", False), ("b", "2020-01-01 00:00:00", True), ("c", "2029-12-31 23:59:50", False)], "s string, t string, idle boolean")
    got = C.lag_seconds(rows.withColumn("last_event", F.col("t").cast("timestamp")), F.lit("2030-01-01 00:00:00").cast("timestamp"))
    assert {r["s"]: r["seconds_behind"] for r in got.collect()} == {"a": 0, "b": 0, "c": 10}


def test_a_transaction_that_comes_again_is_not_applied_again(spark, place):
    path = f"{place}/log"
    t = VersionedTable.create(spark, f"{place}/t", spark.createDataFrame([], "k bigint, v string"))
    first = [(1, "a:1", "app", "t", "insert", None, (1, "x")), (2, "a:2", "app", "t", "insert", None, (2, "x"))]
    follow = lambda: C.start_applying(spark, path, log(spark, []).schema, t, ["k"], f"{place}/progress", compact_after=2).awaitTermination()
    C.write_log(log(spark, first), path)
    follow()
    C.write_log(log(spark, [(3, "a:3", "app", "t", "update", (1, "x"), (1, "later")), (4, "a:3", "app", "t", "delete", (2, "x"), None)]), path)
    follow()
    again = [*first, (4, "a:3", "app", "t", "delete", (2, "x"), None), (5, "a:3", "app", "t", "insert", None, (9, "rest"))]
    for _ in range(3):
        C.write_log(log(spark, again), path)
        follow()
        t.drop_unpublished()
        assert {r["k"]: r["v"] for r in t.read().collect()} == {1: "later", 9: "rest"}


def test_events_of_a_log(spark):
    rows = [(1, "a:1", "app", "t", "insert", None), (2, "a:1", "app", "u", "insert", None), (3, "a:1", "app", "u", "insert", None), (4, "a:2", "app", "", "ddl", "CREATE TABLE x (a INT)"), (5, "a:3", "app", "u", "delete", None)]
    got = C.events(spark.createDataFrame(rows, "seq bigint, gtid string, db string, tbl string, op string, statement string")).orderBy("seq", "place").collect()
    assert [(r["gtid"], r["event"], r["n"]) for r in got] == [
        ("a:1", "GTID", 0), ("a:1", "BEGIN", 0), ("a:1", "ROWS", 1), ("a:1", "ROWS", 2), ("a:1", "XID", 0), ("a:2", "GTID", 0), ("a:2", "QUERY", 0),
        ("a:3", "GTID", 0), ("a:3", "BEGIN", 0), ("a:3", "ROWS", 1), ("a:3", "XID", 0),
    ]
    assert got[6]["text"] == "CREATE TABLE x (a INT)"
    assert C.events(spark.createDataFrame([], "seq bigint, gtid string, db string, tbl string, op string, statement string")).count() == 0
