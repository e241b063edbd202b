"""Queries of the overlay, row changes, constraints, ranges, change capture, statistics and schema changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import constraints, ddl, dml, fulltext, stats
from quarry.operators.overlay import edit_rows, merge
from quarry.operators.rank import global_rank
from quarry.operators.transactions import Session
from quarry.plans import ranges as R
from quarry.plans import router as P
from quarry.registry import query
from quarry.sources.staging import shared_dir
from quarry.sources.storage import CommitConflict, TwoPhase, VersionedTable
from quarry.sources.tables import register, table
from quarry.streaming import changes as C

KEY = ["o_orderkey"]


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _place(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 5 <> 2
UNION ALL SELECT -o_orderkey, o_custkey, 'M' FROM orders WHERE o_orderkey % 5 = 2
UNION ALL SELECT o_orderkey, o_custkey, 'B' FROM orders WHERE o_orderkey % 10 = 0
""")
def overlay_merge(spark, d):
    """Deletes, updates in place, updates that move a key, and inserts that bring a deleted key back."""
    base = _orders(spark, d).drop("o_totalprice")
    at = lambda n: F.lit(n)
    mod = F.col("o_orderkey") % 5
    gone = edit_rows(base.where(mod == 0), KEY, "delete", at(1))
    changed = edit_rows(base.where(mod == 1).withColumn("o_orderstatus", F.lit("X")), KEY, "update", at(2))
    moved = edit_rows(
        base.where(mod == 2).withColumn("o_orderkey", -F.col("o_orderkey")).withColumn("o_orderstatus", F.lit("M")), KEY, "update", at(3), F.struct((-F.col("o_orderkey")).alias("o_orderkey"))
    )
    back = edit_rows(base.where(F.col("o_orderkey") % 10 == 0).withColumn("o_orderstatus", F.lit("B")), KEY, "insert", at(4))
    return merge(base, gone.unionByName(changed).unionByName(moved).unionByName(back), KEY)


@query("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey + 1000000000, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def dml_insert(spark, d):
    base = _orders(spark, d).select("o_orderkey", "o_custkey")
    new = _orders(spark, d).where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), "o_custkey")
    return dml.insert(base, new, KEY)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS o_totalprice FROM orders")
def dml_update(spark, d):
    out = dml.update(_orders(spark, d), F.col("o_orderstatus") == "O", {"o_totalprice": F.col("o_totalprice") * 2})
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_custkey FROM orders")
def dml_update_pk(spark, d):
    return dml.update(_orders(spark, d), F.col("o_orderstatus") == "P", {"o_orderkey": -F.col("o_orderkey") - 1}, KEY).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 50000)")
def dml_delete(spark, d):
    return dml.delete(_orders(spark, d), F.col("o_totalprice") < 50000).select("o_orderkey")


@query("SELECT p_brand, p_size, count(*) - (CASE WHEN p_size < 10 THEN 1 ELSE 0 END) AS n FROM part GROUP BY 1, 2 HAVING count(*) - (CASE WHEN p_size < 10 THEN 1 ELSE 0 END) > 0")
def dml_keyless_delete(spark, d):
    base = table(spark, d, "part").select("p_brand", "p_size")
    out = dml.delete_keyless(base, base.where("p_size < 10").distinct())
    return out.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))


@query("""
SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT DISTINCT CAST(1000 + s_nationkey AS INTEGER), 'new' FROM supplier
""")
def dml_ignore(spark, d):
    base = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    s = table(spark, d, "supplier")
    rows = s.select(F.col("s_nationkey").alias("k"), F.lit("taken").alias("v")).unionByName(s.select((F.col("s_nationkey") + 1000).alias("k"), F.lit("new").alias("v")))
    return dml.insert_ignore(base, rows, ["k"])


@query("""
SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT o_custkey, CAST(max(o_orderkey) AS VARCHAR) FROM orders GROUP BY 1
""")
def dml_replace(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    rows = _orders(spark, d).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("string").alias("v"), F.col("o_orderkey").alias("at"))
    return dml.replace(base, rows, ["k"], "at")


@query("""
SELECT coalesce(c_custkey, k) AS k, CASE WHEN k IS NULL THEN 0 WHEN c_custkey IS NULL THEN n ELSE n + 100 END AS n
FROM customer FULL JOIN (SELECT o_custkey * 2 AS k, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = k
""")
def dml_odku(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("n"))
    rows = _orders(spark, d).groupBy((F.col("o_custkey") * 2).alias("k")).agg(F.count("*").alias("n"))
    return dml.upsert(base, rows, ["k"], {"n": F.col("new.n") + 100})


@query("SELECT p_size, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1 HAVING count(*) > 1")
def check_unique_nulls(spark, d):
    rows = table(spark, d, "part").select(F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"))
    return constraints.duplicates(rows, ["p_size"])


@query("SELECT lower(c_mktsegment) AS seg, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def check_unique_ci(spark, d):
    mixed = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.upper("c_mktsegment"))
    out = constraints.duplicates(table(spark, d, "customer").select(mixed.alias("seg")), ["seg"], "UTF8_LCASE")
    return out.select(F.lower("seg").alias("seg"), "n")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def check_fk(spark, d):
    parent = table(spark, d, "customer").where("c_acctbal > 0")
    return constraints.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], parent, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity <= 45 OR l_discount > 0.05)")
def check_expr(spark, d):
    return constraints.check_failures(table(spark, d, "lineitem"), "l_quantity <= 45 OR l_discount > 0.05").select("l_orderkey", "l_linenumber")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey < m THEN 5000 + r - 1 WHEN o_orderkey = m THEN 900000000 ELSE 900000000 + r - rm END AS id
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, (SELECT max(c_custkey) FROM customer) AS m,
  (SELECT count(*) FROM orders WHERE o_orderkey <= (SELECT max(c_custkey) FROM customer)) AS rm FROM orders)
""")
def auto_increment(spark, d):
    """An explicit value in the middle raises the counter for what follows."""
    top = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    rows = _orders(spark, d).select("o_orderkey", F.when(F.col("o_orderkey") == top, F.lit(900000000)).cast("long").alias("id"))
    return dml.auto_increment(rows, "id", 5000, "o_orderkey")


@query("SELECT 'removed' AS what, count(*) AS n FROM nation UNION ALL SELECT 'left', 0 UNION ALL SELECT 'next', 1")
def truncate(spark, d):
    """All rows go, their number is told, and the counter begins anew."""
    e = _engine(spark)
    e.create_table("n", {"k": "BIGINT", "v": "TEXT"}, ["k"], rows=table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("k"), F.col("n_name").alias("v")), auto_increment="k", counter=900)
    n = e.execute("TRUNCATE TABLE n")
    left = e.table("n").read().count()
    e.execute("INSERT INTO n (v) VALUES ('first')")
    return spark.createDataFrame([("removed", n), ("left", left), ("next", e.sql("SELECT max(k) AS k FROM n").first()["k"])], "what string, n bigint")


@query("""
SELECT o_orderkey, round(CASE WHEN c_acctbal < 0 THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
""")
def update_join(spark, d):
    c = table(spark, d, "customer").where("c_acctbal < 0")
    out = dml.update_join(_orders(spark, d), c, F.col("b.o_custkey") == F.col("o.c_custkey"), {"o_totalprice": F.col("b.o_totalprice") * 2}, KEY)
    return out.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_join(spark, d):
    bad = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return dml.delete_join(_orders(spark, d), bad, ["o_custkey"]).select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 101, 'second' UNION ALL SELECT 104, 'fourth'")
def savepoint_rollback(spark, d):
    """insert, savepoint, insert, savepoint, delete, back to the first, insert, commit."""
    t = VersionedTable.create(spark, _place(spark, "nation"), table(spark, d, "nation").select("n_nationkey", "n_name"))
    s = Session(t, ["n_nationkey"])
    row = lambda k, v: spark.createDataFrame([(k, v)], "n_nationkey int, n_name string")
    s.insert(row(101, "second"))
    s.savepoint("a")
    s.insert(row(102, "third"))
    s.savepoint("b")
    s.delete(F.col("n_nationkey") == 1)
    s.rollback_to("a")
    s.insert(row(104, "fourth"))
    s.delete(F.col("n_nationkey") == 3)
    s.commit()
    return t.read()


@query("SELECT 'pinned' AS who, count(*) AS n FROM nation UNION ALL SELECT 'latest', count(*) - 1 FROM nation")
def snapshot_read(spark, d):
    """A repeatable read keeps its version while another session commits."""
    t = VersionedTable.create(spark, _place(spark, "snapshot"), table(spark, d, "nation").select("n_nationkey", "n_name"))
    pinned, latest, writer = Session(t, ["n_nationkey"]), Session(t, ["n_nationkey"], "read committed"), Session(t, ["n_nationkey"])
    writer.delete(F.col("n_nationkey") == 0)
    writer.commit()
    count = lambda s, who: s.read().agg(F.lit(who).alias("who"), F.count("*").alias("n"))
    return count(pinned, "pinned").unionByName(count(latest, "latest"))


@query("SELECT count(*) + 1 AS n FROM nation")
def row_count_pending(spark, d):
    t = VersionedTable.create(spark, _place(spark, "pending"), table(spark, d, "nation").select("n_nationkey", "n_name"))
    s = Session(t, ["n_nationkey"])
    s.insert(spark.createDataFrame([(500, "pending")], "n_nationkey int, n_name string"))
    return s.read().agg(F.count("*").alias("n"))


def _engine(spark):
    from quarry.engine import Engine

    return Engine(spark, _place(spark, "engine"))


def _nation(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"), F.col("n_regionkey").alias("r"))


@query("SELECT n_nationkey::BIGINT AS k, n_name AS v, CASE WHEN n_nationkey < 5 THEN 'first' ELSE 'old' END AS who FROM nation UNION ALL SELECT 100, 'NEW', 'first'")
def insert_race(spark, d):
    """Two sessions insert one key: the first to commit has it, all of the other's edits are refused."""
    t = VersionedTable.create(spark, _place(spark, "race"), _nation(spark, d).select("k", "v", F.lit("old").alias("who")))
    new = lambda who: spark.createDataFrame([(100, "NEW", who)], "k bigint, v string, who string")
    one, two = Session(t, ["k"]), Session(t, ["k"])
    one.insert(new("first"))
    one.update(F.col("k") < 5, {"who": F.lit("first")})
    two.insert(new("second"))
    two.update(F.col("k") >= 20, {"who": F.lit("second")})
    one.commit()
    try:
        two.commit()
    except constraints.ConstraintError:
        two.rollback()
    return t.read()


@query("""
SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey = 3 THEN 'RENAMED' ELSE n_name END AS v FROM nation UNION ALL SELECT 50, 'FRESH' UNION ALL SELECT 51, NULL UNION ALL SELECT 52, NULL
""")
def session_unique(spark, d):
    """UNIQUE holds at each statement and at commit; NULLs are exempt."""
    e = _engine(spark)
    e.create_table("n", {"k": "BIGINT", "v": "TEXT"}, ["k"], [["v"]], rows=_nation(spark, d).select("k", "v"))
    row = lambda *r: spark.createDataFrame(list(r), "k bigint, v string")
    one, two = e.begin("n"), e.begin("n")
    one.insert(row((50, "FRESH"), (51, None), (52, None)))
    one.update(F.col("k") == 3, {"v": F.lit("RENAMED")})
    two.insert(row((60, "FRESH")))
    taken = table(spark, d, "nation").orderBy("n_nationkey").first()["n_name"]
    for bad in (lambda: one.insert(row((70, taken))), lambda: one.update(F.col("k") == 51, {"v": F.lit(taken)}), one.commit, two.commit):
        try:
            bad()
        except constraints.ConstraintError:
            pass
    return e.table("n").read()


@query("SELECT s_suppkey AS k, round(CASE WHEN s_acctbal >= 0 THEN s_acctbal + 10 ELSE s_acctbal END, 2) AS n FROM supplier")
def session_check(spark, d):
    """CHECK refuses a whole statement, and lets NULL pass."""
    e = _engine(spark)
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("n"))
    e.create_table("s", {"k": "BIGINT", "n": "DOUBLE"}, ["k"], checks=["n > -100000"], rows=rows)
    e.execute("UPDATE s SET n = n + 10 WHERE n >= 0")
    for bad in ("UPDATE s SET n = n - 1000000 WHERE k % 2 = 0", "INSERT INTO s VALUES (-1, -100000)"):
        try:
            e.execute(bad)
        except constraints.ConstraintError:
            pass
    e.execute("INSERT INTO s VALUES (-2, NULL)")
    e.execute("DELETE FROM s WHERE n IS NULL")
    return e.table("s").read().select("k", F.round("n", 2).alias("n"))


@query("SELECT 'one' AS tbl, count(*) - 1 AS n FROM nation UNION ALL SELECT 'two', count(*) - 1 FROM region")
def two_phase_conflict(spark, d):
    """While a transaction is prepared no other moves its tables; one that finds a table moved changes none."""
    one = VersionedTable.create(spark, _place(spark, "one"), table(spark, d, "nation"))
    two = VersionedTable.create(spark, _place(spark, "two"), table(spark, d, "region"))
    tx = TwoPhase(spark, _place(spark, "meta"))
    tx.prepare("a", {"one": (one, one.read().where("n_nationkey > 0")), "two": (two, two.read().where("r_regionkey > 0"))})
    for refused in (lambda: one.commit(one.read().limit(0), 0), lambda: tx.prepare("b", {"two": (two, two.read().limit(0)), "one": (one, one.read().limit(0))})):
        try:
            refused()
        except CommitConflict:
            pass
    tx.decide("a")
    tx.recover(spark)
    return one.read().agg(F.lit("one").alias("tbl"), F.count("*").alias("n")).unionByName(two.read().agg(F.lit("two").alias("tbl"), F.count("*").alias("n")))


@query("""
SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE s_name END AS name, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey BETWEEN 1 AND 3 THEN 5 ELSE 0 END AS n
FROM supplier WHERE s_suppkey % 7 <> 0 OR s_suppkey <= 3 UNION ALL SELECT max(s_suppkey) + 1, 'counted', 0 FROM supplier UNION ALL SELECT max(s_suppkey) + 1000, 'given', 2 FROM supplier
""")
def dml_sql(spark, d):
    """INSERT with a counter and defaults, UPDATE, DELETE and ON DUPLICATE KEY UPDATE as text."""
    e, s = _engine(spark), table(spark, d, "supplier")
    top = s.agg(F.max("s_suppkey")).first()[0]
    e.create_table("s", {"id": "BIGINT", "name": "VARCHAR(64)", "n": "INT"}, ["id"], rows=s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 0, F.lit("debt")).otherwise(F.col("s_name")).alias("name"), F.lit(0).alias("n")), auto_increment="id", counter=top + 1, defaults={"n": "0"})
    e.execute("INSERT INTO s (name) VALUES ('counted')")
    e.execute(f"INSERT INTO s VALUES ({top + 1000}, 'given', 2)")
    e.execute("UPDATE s SET n = n + 1 WHERE name = 'debt'")
    e.execute("INSERT INTO s (id, name, n) VALUES (1, 'x', 5), (2, 'x', 5), (3, 'x', 5) ON DUPLICATE KEY UPDATE n = n + VALUES(n)")
    e.execute(f"DELETE FROM s WHERE id % 7 = 0 AND id <= {top} AND id > 3")
    return e.table("s").read()


@query("SELECT p_brand, p_size, count(*) AS n FROM (SELECT p_brand, CASE WHEN p_size < 10 THEN p_size + 100 ELSE p_size END AS p_size FROM part) GROUP BY 1, 2")
def dml_keyless_update(spark, d):
    """UPDATE of a table without a key: equal rows change together."""
    e = _engine(spark)
    e.create_table("p", {"p_brand": "TEXT", "p_size": "INT"}, rows=table(spark, d, "part").select("p_brand", "p_size"))
    e.execute("UPDATE p SET p_size = p_size + 100 WHERE p_size < 10")
    return e.table("p").read().groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))


@query("""
SELECT n_nationkey::BIGINT AS k, n_name AS v FROM nation WHERE n_name NOT IN ('FRANCE', 'CHINA') AND n_nationkey <> 0
UNION ALL SELECT 0, 'FRANCE' UNION ALL SELECT 500, 'CHINA'
""")
def replace_unique(spark, d):
    """REPLACE takes out every row that holds its primary key or a unique value."""
    e = _engine(spark)
    e.create_table("n", {"k": "BIGINT", "v": "TEXT"}, ["k"], [["v"]], rows=_nation(spark, d).select("k", "v"))
    e.execute("REPLACE INTO n VALUES (0, 'FRANCE'), (500, 'CHINA')")
    return e.table("n").read()


# ranges
RANGES = [P.KeyRange("g0", None, 2500), P.KeyRange("g1", 2500, 9000), P.KeyRange("g2", 9000, None)]


@query("""
SELECT * FROM (VALUES ('point', 'shard', 'g0'), ('cut', 'scatter', 'g0,g1'), ('between', 'shard', 'g1'), ('or', 'scatter', 'g0,g1,g2'),
 ('other', 'scatter', 'g0,g1,g2'), ('nothing', 'empty', ''), ('in', 'scatter', 'g0,g1,g2'), ('not_equal', 'scatter', 'g0,g1,g2'), ('text', 'scatter', 'g0,g1,g2')) t(name, kind, groups)
""")
def route_decision(spark, d):
    k = "o_orderkey"
    cases = {
        "point": P.compare(k, "=", 40), "cut": P.both(P.compare(k, ">=", 2000), P.compare(k, "<", 3000)), "between": P.between(k, 2500, 8999),
        "or": P.both(P.compare(k, "=", 1), P.either(P.compare("x", "=", 1), P.compare("y", "=", 2))), "other": P.compare("o_custkey", "=", 7),
        "nothing": P.both(P.compare(k, ">", 5), P.compare(k, "<", 3)), "in": P.both(P.one_of(k, [1, 2]), P.compare(k, "=", 1)),
        "not_equal": P.both(P.compare(k, "<>", 5), P.compare(k, "=", 7)), "text": P.compare(k, "=", "7"),
    }
    found = [(n, (r := P.route(p, k, RANGES)).kind, ",".join(r.groups)) for n, p in cases.items()]
    return spark.createDataFrame(found, "name string, kind string, groups string")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey >= 2000 AND o_orderkey < 8000 GROUP BY 1")
def range_scatter_agg(spark, d):
    """A read over several ranges gives the answer of the one table."""
    p = P.both(P.compare("o_orderkey", ">=", 2000), P.compare("o_orderkey", "<", 8000))
    rows = R.pruned(R.placed(_orders(spark, d), "o_orderkey", RANGES), "o_orderkey", RANGES, p, F.expr("o_orderkey >= 2000 AND o_orderkey < 8000"))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT CASE WHEN o_orderkey < 2500 THEN 'g0' WHEN o_orderkey < 9000 THEN 'g1' ELSE 'g2' END AS range_id, count(*) AS n FROM orders GROUP BY 1")
def range_scatter_per_range(spark, d):
    return R.per_range(R.placed(_orders(spark, d), "o_orderkey", RANGES), RANGES, lambda p: p.agg(F.count("*").alias("n"))).where("n > 0").select("range_id", "n")


@query("""
SELECT 'c_name' AS "column", c_name AS value, 'table' AS "where" FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT 'c_name', 'twice', 'statement'
""")
def range_unique_check(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 7 = 0").select("c_name").unionByName(spark.createDataFrame([("twice",), ("twice",), (None,)], "c_name string"))
    return R.unique_across(c, new, ["c_name"])


@query("""
SELECT range_id, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM (SELECT o_orderkey,
 CASE WHEN o_orderkey < 2500 THEN 'g0' WHEN o_orderkey <= 4000 THEN 'g1' WHEN o_orderkey < 9000 THEN 'g3' ELSE 'g2' END AS range_id FROM orders) GROUP BY 1
""")
def range_split(spark, d):
    """The split key stays on the left."""
    rows = R.placed(_orders(spark, d), "o_orderkey", R.split(RANGES, 4000, "g3"))
    return rows.groupBy("range_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("SELECT o_orderkey AS k FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r = (SELECT count(*) // 2 FROM orders)")
def split_key(spark, d):
    return spark.createDataFrame([(R.split_key(_orders(spark, d), "o_orderkey"),)], "k bigint")


@query("SELECT 'decided' AS tx, count(*) - 1 AS n FROM nation UNION ALL SELECT 'undecided', count(*) FROM region")
def two_phase_recover(spark, d):
    """After a crash a decided transaction is finished everywhere, an undecided one nowhere."""
    one = VersionedTable.create(spark, _place(spark, "one"), table(spark, d, "nation"))
    two = VersionedTable.create(spark, _place(spark, "two"), table(spark, d, "region"))
    tx = TwoPhase(spark, _place(spark, "meta"))
    tx.prepare("a", {"one": (one, one.read().where("n_nationkey > 0"))})
    tx.decide("a")
    tx.prepare("b", {"two": (two, two.read().limit(0))})
    tx.recover(spark)
    return one.read().agg(F.lit("decided").alias("tx"), F.count("*").alias("n")).unionByName(two.read().agg(F.lit("undecided").alias("tx"), F.count("*").alias("n")))


# change capture
@query("""
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'delete' WHEN o_orderkey % 3 = 1 THEN 'update' ELSE 'insert' END AS op, o_orderkey FROM orders WHERE o_orderkey % 3 < 2
UNION ALL SELECT 'insert', o_orderkey + 1000000000 FROM orders WHERE o_orderkey % 3 = 2
""")
def cdc_capture(spark, d):
    before = _orders(spark, d)
    key = F.col("o_orderkey")
    after = before.where(key % 3 == 1).withColumn("o_orderstatus", F.lit("Z")).unionByName(before.where(key % 3 == 2))
    after = after.unionByName(before.where(key % 3 == 2).withColumn("o_orderkey", key + 1000000000))
    return C.capture(before, after, KEY).select("op", "o_orderkey")


def _events(spark, d):
    """Events as a change log: transactions by user, tables by kind."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_id") % 7 == 0, "delete").when(F.col("event_id") % 2 == 0, "update").otherwise("insert")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("gtid"), F.lit("app").alias("db"), F.col("event_type").alias("tbl"), op.alias("op"), "user_id", "value")


@query("""
WITH e AS (SELECT event_id AS seq, 'u:' || CAST(user_id AS VARCHAR) AS gtid, event_type AS tbl,
  CASE WHEN event_id % 7 = 0 THEN 'delete' WHEN event_id % 2 = 0 THEN 'update' ELSE 'insert' END AS op FROM events),
m AS (SELECT *, CASE WHEN lag(tbl) OVER w = tbl AND lag(op) OVER w = op THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY gtid ORDER BY seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY gtid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT gtid, CAST(island AS BIGINT) AS island, tbl, op, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM i GROUP BY 1, 2, 3, 4
""")
def cdc_grouping(spark, d):
    return C.grouped(_events(spark, d)).drop("db")


@query("SELECT event_id AS seq FROM events WHERE user_id % 2 = 1")
def cdc_dedup(spark, d):
    e = _events(spark, d)
    done = e.where("user_id % 2 = 0").select("gtid").distinct()
    return C.deduplicated(e.unionByName(e), done).select("seq")


def _keyed(spark, d):
    e = _events(spark, d)
    row = F.struct(F.col("user_id").alias("k"), F.col("value").alias("v"))
    gone = F.col("op") == "delete"
    return e.select("seq", "gtid", "db", "tbl", "op", F.when(F.col("op") != "insert", row).alias("before"), F.when(~gone, row).alias("after"))


_LAST = """
SELECT user_id AS k, round(value, 6) AS v FROM (SELECT user_id, value, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE {where}) WHERE r = 1 AND event_id % 7 <> 0
"""


@query(_LAST.format(where="event_id > 400"))
def cdc_replay_after(spark, d):
    base = spark.createDataFrame([], "k bigint, v double")
    return C.apply(base, C.after(_keyed(spark, d), 400), ["k"]).withColumn("v", F.round("v", 6))


@query("SELECT event_id AS seq FROM events WHERE event_type IN ('click', 'view', 'purchase') AND event_type <> 'view'")
def cdc_filter(spark, d):
    f = C.Filters(do_db=("app",), wild_do=("app.c%", "app.v%", "app.purchase"), ignore_table=("app.view",))
    return _events(spark, d).where(f.column()).select("seq")


@query("SELECT user_id, greatest(0, CAST(epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(ts))) AS BIGINT)) AS seconds_behind FROM events GROUP BY 1")
def cdc_lag(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last_event"), F.lit(False).alias("idle"))
    return C.lag_seconds(e, F.lit("2030-01-01 00:00:00").cast("timestamp")).select("user_id", "seconds_behind")


@query(_LAST.format(where="true"))
def cdc_stream_apply(spark, d):
    """The stream's result is that of one batch."""
    log = _place(spark, "log")
    keyed = _keyed(spark, d)
    C.write_log(keyed, log, 2000)
    t = VersionedTable.create(spark, _place(spark, "target"), spark.createDataFrame([], "k bigint, v double"))
    C.start_applying(spark, log, keyed.schema, t, ["k"], _place(spark, "progress")).awaitTermination()
    return t.read().withColumn("v", F.round("v", 6))


# statistics, schema, full text
@query("""
SELECT count(*) AS n_rows, count(DISTINCT coalesce(c_mktsegment, '') || ' ' || CAST(c_nationkey AS VARCHAR)) AS distinct_rows, CAST(0 AS BIGINT) AS null_rows FROM customer
""")
def analyze_stats(spark, d):
    return stats.analyze(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"]).drop("avg_size")


@query("""
WITH s AS (SELECT greatest(1, count(*) // 16) AS step FROM supplier),
r AS (SELECT s_nationkey, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier)
SELECT CAST((rn - 1) // step AS BIGINT) AS bucket, count(*) AS n, arg_max(CAST(s_nationkey AS VARCHAR), rn) AS bound FROM r, s GROUP BY 1
""")
def analyze_histogram(spark, d):
    return stats.histogram(table(spark, d, "supplier"), ["s_nationkey"], ["s_suppkey"])


@query("SELECT CAST(7 AS INTEGER) AS flag, s_suppkey, s_name, CAST(s_suppkey * 2 AS BIGINT) AS twice FROM supplier")
def alter_add_first(spark, d):
    out = ddl.add_column(table(spark, d, "supplier").select("s_suppkey", "s_name"), "flag", "INT", "7", first=True)
    return ddl.with_generated(out, "twice", "s_suppkey * 2", "BIGINT")


@query("SELECT p_partkey, CAST(p_size AS SMALLINT)::VARCHAR AS size FROM part")
def alter_modify(spark, d):
    out = ddl.modify_column(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "SMALLINT", to="size")
    return ddl.modify_column(out, "size", "VARCHAR(10)")


@query("SELECT column_name, row_number() OVER () AS ordinal_position FROM (VALUES ('p_partkey'), ('p_brand')) t(column_name)")
def alter_drop(spark, d):
    """A dropped column is gone from the stored table and the catalog."""
    e = _engine(spark)
    e.create_table("p", {"p_partkey": "BIGINT", "p_size": "INT", "p_brand": "TEXT"}, ["p_partkey"], rows=table(spark, d, "part").select("p_partkey", "p_size", "p_brand"))
    e.alter("p", ddl.drop_column(e.table("p").read(), "p_size"), {"p_partkey": "BIGINT", "p_brand": "TEXT"})
    return e.information_schema().select("column_name", F.col("ordinal_position").cast("long").alias("ordinal_position"))


@query("SELECT 'added' AS step, count(*) AS n FROM nation UNION ALL SELECT 'refused', count(*) FROM region UNION ALL SELECT 'dropped', 2 * count(*) FROM nation")
def pk_add_check(spark, d):
    """A primary key is added where it holds, refused where it doesn't, and dropped again."""
    e = _engine(spark)
    e.create_table("n", {"k": "BIGINT", "r": "BIGINT"}, rows=_nation(spark, d).select("k", F.col("r").cast("long").alias("r")))
    try:
        e.add_primary_key("n", ["r"])
        refused = 0
    except constraints.ConstraintError:
        refused = e.table("n").read().select("r").distinct().count()
    e.add_primary_key("n", ["k"])
    added = e.sql("SELECT count(*) AS n FROM n").first()["n"]
    e.drop_primary_key("n")
    e.execute("INSERT INTO n SELECT * FROM n")
    return spark.createDataFrame([("added", added), ("refused", refused), ("dropped", e.table("n").read().count())], "step string, n bigint")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
def view_read(spark, d):
    register(spark, d, ("nation", "region"))
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW nations_of AS SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
    return spark.sql("SELECT * FROM nations_of WHERE r_name LIKE 'A%'")


@query("""
SELECT * FROM (VALUES ('app', 'nation', 'n_nationkey', 1, 'int'), ('app', 'nation', 'n_name', 2, 'string'), ('app', 'nation', 'n_regionkey', 3, 'int'),
 ('app', 'region', 'r_regionkey', 1, 'int'), ('app', 'region', 'r_name', 2, 'string')) t(table_schema, table_name, column_name, ordinal_position, data_type)
""")
def information_schema_columns(spark, d):
    return ddl.information_schema_columns(spark, {n: table(spark, d, n) for n in ("nation", "region")}).drop("is_nullable")


@query("SELECT d.doc_id, coalesce(quality, 1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def generated_default(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return ddl.fill_default(both, "quality", "0 + 1")


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word IN ('license', 'mit', 'stupid') GROUP BY 1, 2),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id AS id, round(sum(tf * log10(n / df) * log10(n / df)), 6) AS score FROM tf JOIN df USING (word), n GROUP BY 1
""")
def fulltext_match(spark, d):
    return fulltext.match(table(spark, d, "documents"), "doc_id", "text", ["license", "MIT", "stupid"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def ranked_all(spark, d):
    """A number for every row in a global order, without a single task."""
    return global_rank(_orders(spark, d).select("o_orderkey", "o_totalprice"), "-o_totalprice", "o_orderkey").select("o_orderkey", "rn")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <> 7")
def backup_restore(spark, d):
    """A ranged table with an edit, copied to another place and opened there."""
    own = R.RangedTable.create(spark, _place(spark, "live"), _orders(spark, d).select("o_orderkey", "o_custkey"), "o_orderkey", RANGES)
    s = own.begin(KEY)
    s.delete(F.col("o_orderkey") == 7)
    s.commit()
    target = _place(spark, "backup")
    own.table.drop_unpublished()
    own.table.backup(target)
    return VersionedTable.restore(spark, target, _place(spark, "restored")).read()


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'W' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey BETWEEN 1000 AND 9500 AND o_orderkey % 10 <> 3
""")
def ranged_write(spark, d):
    """One transaction over several ranges, then a split, read through the ranges."""
    own = R.RangedTable.create(spark, _place(spark, "ranged"), _orders(spark, d).select("o_orderkey", "o_orderstatus"), "o_orderkey", RANGES)
    s = own.begin(KEY)
    s.update(F.col("o_orderkey") % 4 == 0, {"o_orderstatus": F.lit("W")})
    s.delete(F.col("o_orderkey") % 10 == 3)
    s.commit()
    own.split(4000, "g3")
    return own.read(P.between("o_orderkey", 1000, 9500), F.expr("o_orderkey BETWEEN 1000 AND 9500"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents WHERE doc_id % 9 <> 0),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word IN ('license', 'mit', 'stupid') GROUP BY 1, 2),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents WHERE doc_id % 9 <> 0)
SELECT doc_id AS id, round(sum(tf * log10(n / df) * log10(n / df)), 6) AS score FROM tf JOIN df USING (word), n GROUP BY 1
""")
def fulltext_stored(spark, d):
    """A stored index that has followed a DELETE, searched without reading any text."""
    e = _engine(spark)
    e.create_table("docs", {"doc_id": "BIGINT", "text": "LONGTEXT"}, ["doc_id"], rows=table(spark, d, "documents").select("doc_id", "text"))
    e.create_fulltext("docs", "ft", "text")
    e.execute("DELETE FROM docs WHERE doc_id % 9 = 0")
    return e.match("docs", "ft", ["license", "MIT", "stupid"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 11")
def prepared_statement(spark, d):
    """A statement with a bind variable."""
    register(spark, d, ("orders",))
    return spark.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = :key", args={"key": 11})


@query("SELECT s_suppkey, round(s_acctbal * 2, 2) AS scored FROM supplier")
def sql_function(spark, d):
    """A scalar function defined in SQL."""
    register(spark, d, ("supplier",))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION doubled(x DOUBLE) RETURNS DOUBLE RETURN x * 2")
    return spark.sql("SELECT s_suppkey, round(doubled(s_acctbal), 2) AS scored FROM supplier")


