"""Replicas under control, and row images that lack columns."""

import pytest
from pyspark.sql import functions as F

from quarry.sources.storage import VersionedTable
from quarry.streaming import changes as C
from quarry.streaming.changes import Filters
from quarry.streaming.replica import Replica, ReplicaError

ROW = "seq long, gtid string, db string, tbl string, op string, before struct<k:long,v:string>, after struct<k:long,v:string>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_control(spark, tmp_path):
    log, other = f"file://{tmp_path}/log", f"file://{tmp_path}/other"
    first = spark.createDataFrame([(1, "a", "d", "t", "insert", None, (1, "x")), (2, "b", "d", "u", "insert", None, (2, "y"))], ROW)
    C.write_log(first, log)
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", spark.createDataFrame([], "k long, v string"))
    own = Replica(spark, f"file://{tmp_path}/r", t, first.schema, ["k"])
    with pytest.raises(ReplicaError):
        own.start()
    with pytest.raises(ReplicaError):
        own.change_source(log, auto_position=False)
    own.change_source(log, filters=Filters(do_table=("d.t",)))
    own.start()
    own.wait()
    assert rows(t.read()) == [(1, "x")] and own.status().first()["seconds_behind"] == 0
    # a copy of the log with one more transaction: what was executed is not applied again
    t.commit(t.read().withColumn("v", F.lit("kept")), t.version())
    more = spark.createDataFrame([(3, "c", "d", "t", "insert", None, (3, "z"))], ROW)
    C.write_log(first.unionByName(more), other)
    own.change_source(other)
    own.start()
    own.wait()
    assert rows(t.read()) == [(1, "kept"), (3, "z")]  # what the filter left out was executed
    own.reset(everything=True)
    assert own.options() == {} and t.meta()["batch"] == -1
    assert rows(C.log_status(spark, other).select("executed", "last_seq")) == [(3, 3)]


def test_partial_images(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "k long, v string, n int")
    schema = "seq long, op string, before struct<k:long>, after struct<k:long,v:string,n:int>, present array<string>"
    change = lambda *r: spark.createDataFrame(list(r), schema)
    got = C.apply_partial(
        base,
        change(
            (1, "update", (1,), (1, None, 9), ["n"]), (2, "update", (1,), (1, None, None), ["v"]), (3, "delete", (2,), None, []), (4, "update", (2,), (2, "no", 0), ["v", "n"]),
            (5, "delete", (3,), None, []), (6, "insert", None, (3, "new", None), []), (7, "update", (3,), (3, "", 5), ["k", "n"]), (8, "update", (7,), (7, "no", 0), ["v"]),
        ),
        ["k"],
    )
    assert rows(got.na.fill("null", ["v"])) == [(1, "null", 9), (3, "new", 5)]
    assert rows(C.apply_partial(base, change(), ["k"])) == rows(base)
    with pytest.raises(Exception, match="move its key"):
        C.apply_partial(base, change((1, "update", (1,), (5, "x", 1), ["k", "v"])), ["k"]).collect()
