"""Statements that define, show, load, shard and copy tables, and transactions as text."""

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.functions.aggregates import Aggregate
from quarry.operators.constraints import ConstraintError
from quarry.plans import definitions as D
from quarry.plans.router import RouteError
from quarry.plans.statements import StatementError
from quarry.sources.tables import spool


@pytest.fixture
def e(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/w")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parts_of_definitions():
    own = D.Definition()
    body, rest = D.inside("(a DECIMAL(10,2) NOT NULL DEFAULT 1.5 COMMENT 'x, (y)', b ENUM('p','q)'), CHECK (a > (0)), UNIQUE KEY u (a, b(3))) COMMENT='t'")
    for part in D.cut(body, ","):
        assert own.clause(part) or own.column(part)[1] == ""
    assert own.columns == {"a": "DECIMAL(10,2)", "b": "ENUM('p','q)')"}
    assert own.checks == ["`a` IS NOT NULL", "a > (0)"] and own.defaults == {"a": "1.5"} and own.comments == {"a": "x, (y)"}
    assert own.indexes == {"u": (["a", "b"], True, {"b": 3})} and D._options(rest) == {"comment": "t"}
    assert D.unquoted(r"'it''s\n\\'") == "it's\n\\"


def test_create_insert_and_constraints(e):
    e.execute("CREATE TABLE t (id BIGINT AUTO_INCREMENT, v VARCHAR(9) NOT NULL, n INT DEFAULT 4, PRIMARY KEY (id), UNIQUE KEY once (v), CHECK (n < 9))")
    e.execute("INSERT INTO t (v) VALUES ('a'), ('b')")
    assert rows(e.sql("SELECT * FROM t")) == [(1, "a", 4), (2, "b", 4)]
    for bad in ("INSERT INTO t (v) VALUES ('a')", "INSERT INTO t (v) VALUES (NULL)", "INSERT INTO t (v, n) VALUES ('c', 9)"):
        with pytest.raises(ConstraintError):
            e.execute(bad)
    assert e.execute("CREATE TABLE IF NOT EXISTS t (id INT)") == 0
    with pytest.raises(StatementError):
        e.execute("CREATE TABLE u (id INT nonsense)")
    assert [r.table_name for r in e.execute("SHOW TABLES").collect()] == ["t"]


def test_alter_keeps_keys_in_step(e):
    e.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v VARCHAR(9), n INT, KEY by_n (n), CHECK (n > 0))")
    e.execute("INSERT INTO t VALUES (1, 'a', 5), (2, 'b', 6)")
    e.execute("ALTER TABLE t RENAME COLUMN n TO m, ADD COLUMN w INT DEFAULT 7 FIRST")
    assert e.table("t").read().columns == ["w", "id", "v", "m"] and e.indexes("t") == [("PRIMARY", ["id"]), ("by_n", ["m"])]
    with pytest.raises(ConstraintError):
        e.execute("INSERT INTO t VALUES (1, 3, 'c', 0)")
    with pytest.raises(ValueError):
        e.execute("ALTER TABLE t DROP COLUMN m")  # checked
    with pytest.raises(ValueError):
        e.execute("ALTER TABLE t DROP COLUMN id")
    with pytest.raises(ConstraintError):
        e.execute("ALTER TABLE t ADD CHECK (m > 5)")
    e.execute("ALTER TABLE t DROP COLUMN v, MODIFY m BIGINT NOT NULL, ALTER COLUMN w SET DEFAULT 8, COMMENT = 'x', RENAME TO u")
    e.execute("INSERT INTO u (id, m) VALUES (3, 9)")
    assert rows(e.sql("SELECT id, m, w FROM u")) == [(1, 5, 7), (2, 6, 7), (3, 9, 8)] and e.table("u").meta()["comment"] == "x"
    e.execute("ALTER TABLE u DROP PRIMARY KEY, ADD PRIMARY KEY (m)")
    assert e.indexes("u")[0] == ("PRIMARY", ["m"])


def test_refused_key_leaves_no_table(e):
    with pytest.raises(LookupError):
        e.execute("CREATE TABLE child (id INT PRIMARY KEY, p INT, FOREIGN KEY (p) REFERENCES nowhere (id))")
    assert e.tables() == []


def test_transaction_text(e):
    for t in ("a", "b"):
        e.execute(f"CREATE TABLE {t} (k INT PRIMARY KEY, v INT)")
    c, other = e.connect(), e.connect()
    c.execute("BEGIN")
    c.execute("INSERT INTO a VALUES (1, 1)")
    c.execute("SAVEPOINT s")
    c.execute("INSERT INTO b VALUES (1, 1)")
    c.execute("SAVEPOINT t")
    assert rows(c.execute("SELECT k FROM b")) == [(1,)] and rows(other.execute("SELECT k FROM b")) == []
    c.execute("ROLLBACK TO s")
    assert rows(c.execute("SELECT k FROM b")) == [] and rows(c.execute("SELECT k FROM a")) == [(1,)]
    with pytest.raises(LookupError):
        c.execute("RELEASE SAVEPOINT t")
    c.execute("INSERT INTO b VALUES (2, 2)")
    c.execute("COMMIT")
    assert rows(other.execute("SELECT k FROM a")) == [(1,)] and rows(other.execute("SELECT k FROM b")) == [(2,)]
    c.execute("BEGIN")
    c.execute("DELETE FROM a")
    c.execute("CREATE TABLE d (k INT)")  # commits what is open
    assert rows(other.execute("SELECT k FROM a")) == [] and c.sessions is None
    c.execute("BEGIN")
    with pytest.raises(StatementError):
        c.execute("INSERT INTO d VALUES (1)")
    with pytest.raises(StatementError):
        other.execute("SAVEPOINT x")


def test_ranges_as_text(e):
    e.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v VARCHAR(9))")
    e.execute("INSERT INTO t VALUES (1, 'a'), (20, 'b')")
    with pytest.raises(RouteError):
        e.execute("SHARD TABLE t BY id RANGE START 0 END 10 GROUP g0")  # 20 is in none
    with pytest.raises(RouteError):
        e.execute("SHARD TABLE t BY id RANGE END 10 RANGE START 5")
    e.execute("SHARD TABLE t BY id CHECK v RANGE START 0 END 10 GROUP g0 RANGE START 10 END 30 GROUP g1")
    with pytest.raises(RouteError):
        e.execute("INSERT INTO t VALUES (99, 'c')")
    e.execute("SHARD TABLE t BY id RANGE START 30 GROUP g2")
    e.execute("INSERT INTO t VALUES (99, 'c')")
    with pytest.raises(ConstraintError):
        e.execute("INSERT INTO t VALUES (5, 'c')")  # unique over all ranges
    with pytest.raises(ValueError):
        e.execute("ALTER TABLE t RENAME COLUMN id TO k")
    e.execute("SPLIT RANGE t AT 15")
    assert [tuple(r)[:3] for r in e.execute("SHOW RANGES FROM t").collect()] == [("g0", 0, 10), ("g1", 10, 16), ("g3", 16, 30), ("g2", 30, None)]
    assert rows(e.sql("SELECT id FROM t")) == [(1,), (20,), (99,)]


def test_files_and_procedures(e, tmp_path):
    e.execute("CREATE TABLE t (k INT PRIMARY KEY, v VARCHAR(99))")
    e.execute(r"INSERT INTO t VALUES (1, 'a,b'), (2, NULL), (3, ''), (4, 'say \"x\"')")
    out = f"file://{tmp_path}/out"
    assert e.execute(f"SELECT * FROM t INTO OUTFILE '{out}' FIELDS TERMINATED BY ',' ENCLOSED BY '\"'") == 4
    e.execute("CREATE TABLE u (k INT PRIMARY KEY, v VARCHAR(99))")
    load = "INTO TABLE u FIELDS TERMINATED BY ',' ENCLOSED BY '\"'"
    assert e.execute(f"LOAD DATA INFILE '{out}' {load}") == 4
    assert e.sql("SELECT * FROM t").exceptAll(e.sql("SELECT * FROM u")).isEmpty()
    with pytest.raises(ConstraintError):
        e.execute(f"LOAD DATA INFILE '{out}' {load}")
    e.execute(f"LOAD DATA INFILE '{out}' REPLACE {load}")
    assert e.table("u").read().count() == 4
    e.execute("CREATE PROCEDURE p(x INT) BEGIN DELETE FROM u WHERE k = x; SELECT count(*) AS n FROM u; END")
    assert e.execute("CALL p(2)").first().n == 3
    with pytest.raises(StatementError):
        e.execute("CALL p()")
    e.execute("DROP PROCEDURE p")
    with pytest.raises(LookupError):
        e.execute("CALL p(1)")


def test_show_create_makes_the_table_again(e):
    e.execute("CREATE TABLE t (id BIGINT AUTO_INCREMENT PRIMARY KEY, `v` VARCHAR(9) NOT NULL DEFAULT 'it''s' COMMENT 'c', n INT DEFAULT (1 + 2), UNIQUE KEY u (v), KEY k (n), CHECK (n > 0)) COMMENT='x'")
    first, keys = e.execute("SHOW CREATE TABLE t").first().statement, e.indexes("t")
    e.execute("DROP TABLE t")
    e.execute(first)
    assert e.execute("SHOW CREATE TABLE t").first().statement == first and e.indexes("t") == keys


def test_own_aggregates_and_pages(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    mean = Aggregate(("x",), {"s": "sum(x)", "n": "count(x)"}, "s / n")
    assert rows(df.groupBy("g").agg(mean("id").alias("m"))) == [(0, 4.0), (1, 5.0)]
    with pytest.raises(ValueError):
        mean("id", "g")
    assert [len(p) for p in spool(df.orderBy("id"), 4)] == [4, 4, 2] and list(spool(df.limit(0))) == []
