import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.operators.constraints import ConstraintError
from quarry.operators.dml import auto_increment, delete_keyless
from quarry.operators.transactions import ReadOnlyError, Session
from quarry.sources.storage import CommitConflict, TwoPhase, VersionedTable


def kv(spark, rows):
    return spark.createDataFrame(rows, "id bigint, name string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_second_writer_conflicts(spark, place):
    t = VersionedTable.create(spark, f"{place}/t", kv(spark, [(1, "a")]))
    v = t.version()
    t.commit(kv(spark, [(2, "b")]), v)
    with pytest.raises(CommitConflict):
        t.commit(kv(spark, [(3, "c")]), v)
    assert ids(t.read()) == [2] and ids(t.read(0)) == [1]
    assert len(t.unpublished()) == 1
    t.drop_unpublished()
    assert t.unpublished() == [] and ids(t.read()) == [2]


def test_savepoints(spark, place):
    t = VersionedTable.create(spark, f"{place}/t", kv(spark, []))
    s = Session(t, ["id"])
    s.insert(kv(spark, [(1, "a")]))
    s.savepoint("a")
    s.insert(kv(spark, [(2, "b")]))
    s.savepoint("b")
    s.insert(kv(spark, [(3, "c")]))
    s.rollback_to("a")
    s.savepoint("a")
    s.insert(kv(spark, [(4, "d")]))
    s.savepoint("c")
    s.release("a")
    assert set(s.marks) == set()
    s.commit()
    assert ids(t.read()) == [1, 4]


def test_isolation_and_lost_update(spark, place):
    t = VersionedTable.create(spark, f"{place}/t", kv(spark, [(1, "a"), (2, "b")]))
    one, two, three = Session(t, ["id"]), Session(t, ["id"]), Session(t, ["id"], "read committed")
    one.update(F.col("id") == 1, {"name": F.lit("x")})
    one.commit()
    assert {r["name"] for r in two.read().collect()} == {"a", "b"}
    assert {r["name"] for r in three.read().collect()} == {"x", "b"}
    two.update(F.col("id") == 1, {"name": F.lit("y")})
    with pytest.raises(ConstraintError, match="row changed"):
        two.commit()
    two.rollback()
    two.update(F.col("id") == 2, {"id": F.lit(9)})
    assert two.count() == 2
    two.commit()
    assert ids(t.read()) == [1, 9]


def test_read_only_and_duplicate(spark, place):
    t = VersionedTable.create(spark, f"{place}/t", kv(spark, [(1, "a")]))
    with pytest.raises(ReadOnlyError):
        Session(t, ["id"], read_only=True).delete(F.lit(True))
    with pytest.raises(ConstraintError, match="duplicate"):
        Session(t, ["id"]).insert(kv(spark, [(1, "z")]))


def test_two_phase_recovery(spark, place):
    a = VersionedTable.create(spark, f"{place}/a", kv(spark, [(1, "a")]))
    b = VersionedTable.create(spark, f"{place}/b", kv(spark, [(1, "b")]))
    tx = TwoPhase(spark, f"{place}/meta")
    tx.prepare("lost", {"a": (a, kv(spark, [(5, "x")])), "b": (b, kv(spark, [(5, "x")]))})
    assert tx.recover(spark) == {"lost": False} and ids(a.read()) == [1] and a.unpublished() == []
    tx.prepare("kept", {"a": (a, kv(spark, [(6, "x")])), "b": (b, kv(spark, [(7, "x")]))})
    tx.decide("kept")
    assert tx.recover(spark) == {"kept": True} and ids(a.read()) == [6] and ids(b.read()) == [7]
    assert tx.recover(spark) == {}


def test_two_phase_holds_what_it_prepared(spark, place):
    """Another writer can't move a prepared table, and a table that has moved aborts all."""
    a, b = (VersionedTable.create(spark, f"{place}/{n}", kv(spark, [(1, n)])) for n in "ab")
    tx = TwoPhase(spark, f"{place}/meta")
    tx.prepare("one", {"a": (a, kv(spark, [(5, "x")])), "b": (b, kv(spark, [(5, "x")]))})
    with pytest.raises(CommitConflict, match="not decided"):
        a.commit(kv(spark, [(9, "z")]), 0)
    with pytest.raises(CommitConflict):
        tx.prepare("two", {"b": (b, kv(spark, [(6, "y")])), "a": (a, kv(spark, [(6, "y")]))})
    assert ids(a.read()) == [1] and a.version() == 0
    assert tx.decide("one") and ids(a.read()) == ids(b.read()) == [5]
    assert not tx.decide("two") and tx.recover(spark) == {"one": True}
    with pytest.raises(CommitConflict):
        a.commit(kv(spark, [(9, "z")]), 0)
    assert a.commit(kv(spark, [(9, "z")]), 1) == 2 and ids(a.read()) == [9]
    tx.prepare("three", {"a": (a, kv(spark, [(7, "y")]))})
    assert tx.recover(spark) == {"three": False} and not tx.decide("three") and ids(a.read()) == [9] and a.unpublished() == []
    assert a.commit(kv(spark, [(8, "z")]), 2) == 4 and ids(a.read(2)) == [9] and a.versions() == [0, 1, 2, 4]


def test_of_many_writers_one_commits(spark, place):
    from concurrent.futures import ThreadPoolExecutor

    t = VersionedTable.create(spark, f"{place}/t", kv(spark, [(0, "a")]))
    folders = [t.stage(kv(spark, [(i, "w")])) for i in range(1, 9)]

    def write(folder):
        try:
            return VersionedTable(spark, t.path).publish(folder, 0)
        except CommitConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert [x for x in pool.map(write, folders) if x is not None] == [1]
    files = t.files
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda i: files.create(f"{place}/once", str(i)), range(40))) == 1
    assert files.names(place) == ["once", "t"]


def test_names_are_taken_once_without_links(spark, place, monkeypatch):
    """The way of file systems that rename without overwriting."""
    t = VersionedTable.create(spark, f"{place}/t", kv(spark, []))
    at = lambda n: t.files._at(f"{place}/{n}")[0]
    for n in "ab":
        t.files._write(t.files._at(f"{place}/x")[1].create(at(n), False), n)
    t.files._rename(at("a"), at("c"))
    with pytest.raises(Exception, match="FileAlreadyExists"):
        t.files._rename(at("b"), at("c"))
    assert t.files.read(f"{place}/c") == "a"


def test_two_sessions_insert_one_key(spark, place):
    t = VersionedTable.create(spark, f"{place}/t", kv(spark, [(1, "a")]))
    one, two = Session(t, ["id"]), Session(t, ["id"])
    one.insert(kv(spark, [(7, "one")]))
    two.insert(kv(spark, [(7, "two"), (8, "own")]))
    one.commit()
    with pytest.raises(ConstraintError, match="row changed"):
        two.commit()
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (7, "one")]
    for rows in ([(9, "x"), (9, "y")], [(None, "x")]):
        with pytest.raises(ConstraintError, match="primary key"):
            Session(t, ["id"]).insert(kv(spark, rows))


def test_sessions_keep_constraints(spark, place):
    e = Engine(spark, place)
    e.create_table("parent", {"id": "BIGINT"}, ["id"], rows=spark.createDataFrame([(1,), (2,)], "id bigint"))
    e.create_table("acc", {"id": "BIGINT", "email": "TEXT", "age": "INT", "p": "BIGINT"}, ["id"], [["email"]], ["age >= 0"])
    e.add_foreign_key("acc", ["p"], "parent", ["id"])
    acc = lambda *rows: spark.createDataFrame(list(rows), "id bigint, email string, age int, p bigint")
    s = e.begin("acc")
    s.insert(acc((1, "a", 1, 1), (2, None, None, None), (3, None, 3, 2)))
    for bad in ((4, "a", 1, 1), (4, "z", -1, 1)):
        with pytest.raises(ConstraintError):
            s.insert(acc(bad))
    with pytest.raises(ConstraintError, match="check"):
        s.update(F.col("id") == 1, {"age": F.lit(-5)})
    with pytest.raises(ConstraintError, match="unique"):
        s.update(F.col("id") == 3, {"email": F.lit("a")})
    s.update(F.col("id") == 3, {"email": F.lit("c")})
    one, two = e.begin("acc"), e.begin("acc")
    s.commit()
    one.insert(acc((10, "new", 1, 1)))
    two.insert(acc((11, "new", 1, 1)))
    one.commit()
    with pytest.raises(ConstraintError, match="unique"):
        two.commit()
    three = e.begin("acc")
    three.insert(acc((20, "orphan", 1, 99)))
    with pytest.raises(ConstraintError, match="foreign key"):
        three.commit()
    assert ids(e.table("acc").read()) == [1, 2, 3, 10]
    four = e.begin("acc")
    four.replace(acc((30, "a", 5, None), (10, "ten", 1, 1)))
    four.insert_ignore(acc((3, "q", 1, 1), (31, "c", 1, 1), (32, "fresh", 1, 1)))
    four.upsert(acc((32, None, 9, None), (33, None, 1, None)), {"age": F.col("old.age") + F.col("new.age")})
    four.commit()
    assert sorted(map(tuple, e.table("acc").read().select("id", "email", "age").collect())) == [(2, None, None), (3, "c", 3), (10, "ten", 1), (30, "a", 5), (32, "fresh", 10), (33, None, 1)]


def test_ranged_tables_keep_all_ranges(spark, place):
    from quarry.plans.ranges import RangedTable
    from quarry.plans.router import KeyRange, RouteError, compare

    rows = kv(spark, [(i, str(i)) for i in range(1, 11)])
    t = RangedTable.create(spark, f"{place}/t", rows, "id", [KeyRange("g0", None, 5), KeyRange("g1", 5, 100)])
    t.table.drop_unpublished()
    t.table.backup(f"{place}/b")
    back = VersionedTable.restore(spark, f"{place}/b", f"{place}/r")
    assert ids(t.table.read()) == ids(back.read()) == ids(RangedTable(back, "id").read()) == list(range(1, 11))
    s = t.begin(["id"])
    s.insert(kv(spark, [(20, "new"), (0, "new")]))
    s.update(F.col("id") == 3, {"id": F.lit(33)})
    s.delete(F.col("id") == 6)
    with pytest.raises(RouteError, match="no range"):
        s.insert(kv(spark, [(500, "far")]))
    s.commit()
    want = [0, 1, 2, 4, 5, 7, 8, 9, 10, 20, 33]
    assert ids(t.read()) == want and ids(t.read(compare("id", "<", 5))) == [0, 1, 2, 4]
    t.split(8, "g2")
    assert ids(t.read()) == want and len(t.parts()) == 3 and not any(r.copying for r, _ in t.parts())
    t.table.drop_unpublished()
    assert ids(t.read()) == want
    own = t.table.meta()
    held = [p | {"copying": p["group"] == "g2"} for p in own["ranges"]]
    t.table.publish(own["folder"], t.table.version(), ranges=held)
    s = t.begin(["id"])
    s.insert(kv(spark, [(-1, "ok")]))
    with pytest.raises(RouteError, match="splitting"):
        s.insert(kv(spark, [(50, "held")]))
    t.table.commit(t.read(), t.table.version())
    assert ids(t.read()) == want and len(t.parts()) == 3
    done = t.split_over(1, lambda n: f"s{n}")
    assert done and ids(t.read()) == want and len(t.parts()) > 6


def test_sessions_on_several_tables_commit_together(spark, place):
    from quarry.operators.transactions import commit_together

    a, b = (VersionedTable.create(spark, f"{place}/{n}", kv(spark, [(1, n)])) for n in "ab")
    one, two = Session(a, ["id"]), Session(b, ["id"])
    one.insert(kv(spark, [(2, "x")]))
    two.insert(kv(spark, [(2, "y")]))
    commit_together(f"{place}/meta", "t1", [one, two])
    assert ids(a.read()) == ids(b.read()) == [1, 2]
    one, two, other = Session(a, ["id"]), Session(b, ["id"]), Session(b, ["id"])
    one.insert(kv(spark, [(3, "x")]))
    two.insert(kv(spark, [(3, "y")]))
    other.insert(kv(spark, [(3, "first")]))
    other.commit()
    with pytest.raises(ConstraintError):
        commit_together(f"{place}/meta", "t2", [one, two])
    assert ids(a.read()) == [1, 2] and ids(b.read()) == [1, 2, 3]


def test_engine_constraints_sql_and_alter(spark, place):
    e = Engine(spark, place)
    e.create_table("Accounts", {"id": "BIGINT", "email": "VARCHAR(255)", "age": "INT"}, ["id"], [["email"]], ["age >= 0"])
    rows = spark.createDataFrame([(1, "a@b.c", 3), (2, None, None), (3, None, 4)], "id bigint, email string, age int")
    e.write("accounts", rows)
    assert e.sql("SELECT count(*) AS n FROM accounts WHERE id > :low", low=1).first()["n"] == 2
    for bad in ([(1, "x", -1)], [(1, "x", 1), (2, "x", 2)], [(1, "x", 1), (1, "y", 1)]):
        with pytest.raises(ConstraintError):
            e.write("accounts", spark.createDataFrame(bad, "id bigint, email string, age int"))
    assert e.tables() == ["accounts"] and e.information_schema().count() == 3
    e.rename_table("accounts", "people")
    assert e.tables() == ["people"] and e.table("People").read().count() == 3
    e.save_definition("trigger", "T1", {"body": "x"})
    assert e.definitions("trigger") == {"t1": {"body": "x"}}


def test_keyless_delete_takes_one_of_equal_rows(spark):
    base = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "name string")
    left = delete_keyless(base, spark.createDataFrame([("a",), (None,)], "name string"))
    assert sorted(str(r["name"]) for r in left.collect()) == ["None", "a", "b"]


def test_auto_increment_continues_from_explicit_values(spark):
    rows = spark.createDataFrame([(1, None), (2, 50), (3, None), (4, 10), (5, None), (6, 5000), (7, None)], "at int, id bigint")
    got = {r["at"]: r["id"] for r in auto_increment(rows, "id", 7, "at").collect()}
    assert got == {1: 7, 2: 50, 3: 51, 4: 10, 5: 52, 6: 5000, 7: 5001}


def test_commits_write_edits_alone_until_compacted(spark, place):
    t = VersionedTable.create(spark, f"{place}/t", kv(spark, [(i, "a") for i in range(5)]))
    for k in range(3):
        s = Session(t, ["id"])
        s.delete(F.col("id") == k)
        s.insert(kv(spark, [(10 + k, "new")]))
        s.commit()
    s = Session(t, ["id"])
    s.insert(kv(spark, [(0, "again")]))
    s.commit()
    m = t.meta()
    assert len(m["edits"]) == 4 and m["folder"] == t.meta(0)["folder"] and ids(t.read()) == [0, 3, 4, 10, 11, 12]
    t.backup(f"{place}/b")
    assert ids(VersionedTable.restore(spark, f"{place}/b", f"{place}/r").read()) == [0, 3, 4, 10, 11, 12]
    t.compact()
    assert t.meta()["edits"] == [] and ids(t.read()) == [0, 3, 4, 10, 11, 12] and ids(t.read(1)) == [1, 2, 3, 4, 10]


def test_ranges_are_folders(spark, place):
    from quarry.plans.ranges import RangedTable
    from quarry.plans.router import KeyRange, between, compare

    t = RangedTable.create(spark, f"{place}/t", kv(spark, [(i, str(i)) for i in range(1, 9)]), "id", [KeyRange("g0", None, 5), KeyRange("g1", 5, None)])
    assert len(t.read(compare("id", "=", 2)).inputFiles()) < len(t.read().inputFiles())
    assert t.read(between("id", 5, 3)).columns == ["id", "name"] and t.read(between("id", 5, 3)).count() == 0
    t.split(2, "g2")
    assert [(r.group, r.start, r.end) for r, _ in t.parts()] == [("g0", None, 3), ("g2", 3, 5), ("g1", 5, None)]
    t.split(None, "g3")
    assert ids(t.read()) == list(range(1, 9)) and len(t.parts()) == 4


def test_indexes_keys_and_statistics(spark, place):
    e = Engine(spark, place)
    e.create_table("p", {"id": "BIGINT"}, ["id"], rows=spark.createDataFrame([(1,), (2,)], "id bigint"))
    rows = spark.createDataFrame([(1, 1, "aab"), (2, 2, "aac"), (3, None, None), (4, None, None)], "id bigint, p bigint, s string")
    e.create_table("c", {"id": "BIGINT", "p": "BIGINT", "s": "TEXT"}, ["id"], rows=rows)
    with pytest.raises(ConstraintError):
        e.create_index("c", "short", ["s"], unique=True, prefixes={"s": 2})
    e.create_index("c", "whole", ["s"], unique=True)
    e.create_index("c", "any", ["p"])
    assert e.indexes("c") == [("PRIMARY", ["id"]), ("any", ["p"]), ("whole", ["s"])]
    e.drop_index("c", "ANY")
    e.add_foreign_key("c", ["p"], "p", ["id"])
    e.check_foreign_keys("c")
    with pytest.raises(ConstraintError):
        e.add_foreign_key("p", ["id"], "c", ["p"]) if e.write("p", spark.createDataFrame([(1,), (9,)], "id bigint")) else None
    with pytest.raises(ConstraintError):
        e.check_foreign_keys("c")
    assert e.analyze("c", ["p"])["null_rows"] == 2 and e.statistics("c", ["p"])["n_rows"] == 4
    e.set_attributes("c", comment="notes")
    assert e.table("c").meta()["comment"] == "notes" and e.table("c").read().count() == 4
    e.drop_statistics("c")
    assert e.statistics("c", ["p"]) is None
