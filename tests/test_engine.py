import pytest

from quarry.engine import Engine
from quarry.operators import fulltext
from quarry.operators.constraints import ConstraintError
from quarry.plans.statements import Statement, StatementError, cut, parse


def rows(e, text):
    return sorted(map(tuple, e.sql(text).collect()), key=str)


def test_parts_of_statements():
    assert parse("INSERT INTO `app`.`T` (a, `b`) VALUES (1, 'x, (y'), (2, \"it''s\");") == Statement("insert", "T", ("a", "b"), "SELECT * FROM VALUES (1, 'x, (y'), (2, \"it''s\")")
    assert parse("insert t select * from u where v in (select 1)").source == "select * from u where v in (select 1)"
    up = parse("insert into t values (1, 2) on duplicate key update n = n + values(n), s = concat('a = b, c', s)")
    assert up.kind == "upsert" and up.assign == {"n": "n + values(n)", "s": "concat('a = b, c', s)"}
    assert parse("UPDATE t SET a = b >= 2, c = (select max(x) from u where y = 1) WHERE d <> 'where'") == Statement("update", "t", assign={"a": "b >= 2", "c": "(select max(x) from u where y = 1)"}, where="d <> 'where'")
    assert parse("delete from t where a = 1").where == "a = 1" and parse("delete from t").where == "" and parse("truncate table t").kind == "truncate"
    assert parse("replace into t set a = 1, b = 2") == Statement("replace", "t", ("a", "b"), "SELECT 1, 2") and parse("insert ignore into t values (1)").kind == "ignore"
    assert parse("select 1").kind == "query" and cut("a,(b,c),'d,e'", ",") == ["a", "(b,c)", "'d,e'"]
    for bad in ("update t", "insert into t", "delete t", "update t set a", "truncate a b"):
        with pytest.raises(StatementError):
            parse(bad)


def test_statements_change_tables(spark, place):
    e = Engine(spark, place)
    e.create_table("acc", {"id": "BIGINT", "email": "VARCHAR(50)", "n": "INT", "at": "VARCHAR(20)"}, ["id"], [["email"]], ["n >= 0"], auto_increment="id", defaults={"n": "7"}, on_update={"at": "'now'"})
    assert e.execute("INSERT INTO acc (email) VALUES ('a'), ('b')") == 2
    assert e.execute("INSERT INTO acc (id, email, n) VALUES (50, 'c', 1)") == 1
    assert e.execute("INSERT INTO acc (email, n) SELECT concat(email, email), n + 1 FROM acc WHERE email IN ('a', 'b')") == 2
    assert [r[0] for r in rows(e, "SELECT id FROM acc")] == [1, 2, 50, 51, 52] and e.table("acc").meta()["counter"] == 53
    assert e.execute("UPDATE acc SET n = n * 10 WHERE id <= 2") == 2 and rows(e, "SELECT id, n, at FROM acc WHERE id < 3") == [(1, 70, "now"), (2, 70, "now")]
    with pytest.raises(ConstraintError, match="unique"):
        e.execute("INSERT INTO acc (email) VALUES ('a')")
    with pytest.raises(ConstraintError, match="check"):
        e.execute("UPDATE acc SET n = -1")
    with pytest.raises(LookupError):
        e.execute("INSERT INTO acc (nothing) VALUES (1)")
    assert e.execute("INSERT INTO acc (id, email, n) VALUES (1, 'z', 5), (90, 'new', 5) ON DUPLICATE KEY UPDATE n = n + VALUES(n)") == 2
    assert rows(e, "SELECT id, email, n FROM acc WHERE id IN (1, 90)") == [(1, "a", 75), (90, "new", 5)]
    assert e.execute("REPLACE INTO acc (id, email, n) VALUES (91, 'a', 3)") == 1 and rows(e, "SELECT id FROM acc WHERE email = 'a'") == [(91,)]
    assert e.execute("INSERT IGNORE INTO acc (id, email) VALUES (91, 'q'), (92, 'b'), (93, 'ok')") == 3 and rows(e, "SELECT id FROM acc WHERE id > 90") == [(91,), (93,)]
    s = e.begin("acc")
    assert e.execute("DELETE FROM acc WHERE n > 1", s) > 0 and e.sql("SELECT 1 FROM acc WHERE n > 1").count() > 0
    s.rollback()
    assert e.execute("DELETE FROM acc WHERE id = 93") == 1 and e.execute("SELECT count(*) AS n FROM acc").first()["n"] == 6
    assert e.execute("TRUNCATE TABLE acc") == 6 and e.table("acc").meta()["counter"] == 1
    e.execute("INSERT INTO acc (email) VALUES ('first')")
    assert rows(e, "SELECT id, email, n FROM acc") == [(1, "first", 7)]


def test_tables_without_a_key(spark, place):
    e = Engine(spark, place)
    e.create_table("notes", {"name": "TEXT", "n": "INT"})
    e.execute("INSERT INTO notes VALUES ('a', 1), ('a', 1), ('b', 2)")
    assert e.execute("UPDATE notes SET n = n + 1 WHERE name = 'a'") == 2 and rows(e, "SELECT * FROM notes") == [("a", 2), ("a", 2), ("b", 2)]
    assert e.execute("DELETE FROM notes WHERE name = 'a'") == 2 and rows(e, "SELECT * FROM notes") == [("b", 2)]
    with pytest.raises(ValueError):
        e.execute("REPLACE INTO notes VALUES ('a', 1)")


def test_catalog(spark, place):
    e = Engine(spark, place)
    e.create_database("App")
    with pytest.raises(FileExistsError):
        e.create_database("app")
    e.create_database("other")
    assert e.databases() == ["app", "other"]
    e.create_table("t", {"id": "BIGINT", "s": "TEXT"}, ["id"], rows=spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, s string"))
    e.create_index("t", "by_s", ["s"])
    e.rename_index("t", "BY_S", "named")
    assert e.indexes("t") == [("PRIMARY", ["id"]), ("named", ["s"])]
    with pytest.raises(LookupError):
        e.rename_index("t", "gone", "x")
    e.create_view("high", "SELECT id FROM t WHERE id > 1")
    e.execute("INSERT INTO t VALUES (3, 'z')")
    again = Engine(spark, place)
    assert rows(again, "SELECT * FROM high") == [(2,), (3,)]
    again.create_view("high", "SELECT id FROM t WHERE id > 2", replace=True)
    assert rows(e, "SELECT * FROM HIGH") == [(3,)]
    e.drop_view("high")
    assert e.definitions("view") == {}
    e.drop_primary_key("t")
    assert e.table("t").meta()["primary_key"] == [] and e.table("t").read().count() == 3
    e.execute("INSERT INTO t VALUES (3, 'again')")
    with pytest.raises(ConstraintError):
        e.add_primary_key("t", ["id"])
    e.execute("DELETE FROM t WHERE s = 'again'")
    e.add_primary_key("t", ["id"])
    e.use("other")
    assert e.tables() == []
    e.use("app")
    assert e.tables() == ["t"]
    e.drop_database("other")
    assert e.databases() == ["app"]
    with pytest.raises(LookupError):
        e.use("other")


def test_stored_full_text_follows_the_table(spark, place):
    e = Engine(spark, place)
    texts = [(i, " ".join(f"word{(i * k) % 17}" for k in range(12)) + (" special" if i % 5 == 0 else "")) for i in range(40)] + [(99, None)]
    e.create_table("d", {"id": "BIGINT", "body": "TEXT"}, ["id"], rows=spark.createDataFrame(texts, "id bigint, body string"))
    e.create_fulltext("d", "ft", "body")
    words = ["special", "Word3", "absent"]
    plain = lambda: sorted(map(tuple, fulltext.match(e.table("d").read(), "id", "body", words).collect()))
    assert sorted(map(tuple, e.match("d", "ft", words).collect())) == plain()
    e.execute("UPDATE d SET body = 'special special word3 treasure' WHERE id IN (1, 2)")
    e.execute("DELETE FROM d WHERE id = 5")
    e.execute("INSERT INTO d VALUES (200, 'quite special indeed')")
    got = e.match("d", "ft", words)
    assert sorted(map(tuple, got.collect())) == plain() and 200 in {r["id"] for r in got.collect()}
    path = f"{e.table('d').path}/_fulltext/ft/v{e.table('d').meta()['fulltext']['ft']['version']}"
    assert sorted(r["id"] for r in fulltext.phrase_stored(spark, path, ["special", "WORD3"]).collect()) == [1, 2]
    assert "PartitionFilters: [" in e.match("d", "ft", ["special"])._jdf.queryExecution().toString()


def test_two_tables_change_together(spark, place):
    e = Engine(spark, place)
    for n in ("a", "b"):
        e.create_table(n, {"id": "BIGINT"}, ["id"], rows=spark.createDataFrame([(1,)], "id bigint"))
    one, two = e.begin("a"), e.begin("b")
    e.execute("INSERT INTO a VALUES (2)", one)
    e.execute("DELETE FROM b", two)
    e.commit_together([one, two])
    assert e.recover() == {} and rows(e, "SELECT * FROM a") == [(1,), (2,)] and rows(e, "SELECT * FROM b") == []
