"""Queries that go through statements as text: definitions, transactions, ranges, files, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.aggregates import Aggregate
from quarry.operators.constraints import ConstraintError
from quarry.operators.transactions import ReadOnlyError
from quarry.plans.change_queries import _LAST, _engine, _keyed, _place
from quarry.registry import query
from quarry.sources.storage import CommitConflict, VersionedTable
from quarry.sources.tables import read_orc, register, spool, table, write
from quarry.streaming import changes as C
from quarry.streaming.replica import Replica, ReplicaError


@query("SELECT c_custkey AS id, c_name AS title, 'new' AS state, CAST(c_nationkey AS BIGINT) AS area FROM customer WHERE c_custkey % 10 <> 0")
def ddl_sql(spark, d):
    """A table that statements make, fill and change: columns added, renamed, widened, moved and dropped."""
    register(spark, d, ("customer",))
    e = _engine(spark)
    e.execute("CREATE TABLE c (id BIGINT NOT NULL, name VARCHAR(64) NOT NULL, nation INT, spare DOUBLE DEFAULT 1.5, PRIMARY KEY (id), CHECK (id >= 0)) COMMENT='made by text'")
    e.execute("INSERT INTO c (id, name, nation) SELECT c_custkey, c_name, c_nationkey FROM customer")
    e.execute("ALTER TABLE c ADD COLUMN state VARCHAR(8) DEFAULT 'new' AFTER name, RENAME COLUMN name TO title, CHANGE nation area BIGINT, DROP COLUMN spare")
    e.execute("DELETE FROM c WHERE id % 10 = 0")
    return e.sql("SELECT id, title, state, area FROM c")


@query("SELECT * FROM (VALUES ('PRIMARY', 1, 's_suppkey', false), ('by_name', 1, 'name', false), ('by_nation', 1, 's_nationkey', true), ('by_nation', 2, 's_suppkey', true)) t(key_name, seq_in_index, column_name, non_unique)")
def ddl_index(spark, d):
    """Indexes made, refused, renamed and dropped; those over a renamed column follow it."""
    e = _engine(spark)
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.expr("s_suppkey div 2").alias("pair"))
    e.create_table("s", {"s_suppkey": "BIGINT", "s_name": "VARCHAR(64)", "s_nationkey": "INT", "pair": "BIGINT"}, ["s_suppkey"], rows=rows)
    try:
        e.execute("CREATE UNIQUE INDEX pair_once ON s (pair)")
    except ConstraintError:
        e.execute("CREATE UNIQUE INDEX by_name ON s (s_name)")
    e.execute("CREATE INDEX n ON s (s_nationkey, s_suppkey)")
    e.execute("CREATE INDEX gone ON s (s_nationkey)")
    e.execute("DROP INDEX gone ON s")
    e.execute("ALTER TABLE s RENAME INDEX n TO by_nation, RENAME COLUMN s_name TO name")
    return e.execute("SHOW INDEX FROM s").select("key_name", "seq_in_index", "column_name", "non_unique")


@query("""
SELECT * FROM (VALUES ('id', 'bigint', 'NO', 'PRI', NULL, 'auto_increment'), ('mail', 'varchar(99)', 'NO', 'UNI', NULL, ''), ('kind', 'int', 'YES', 'MUL', '7', ''),
  ('at', 'datetime', 'YES', '', NULL, 'on update CURRENT_TIMESTAMP')) t(field, type, "null", "key", "default", extra)
""")
def describe_table(spark, d):
    """The columns of a table made again from its own SHOW CREATE TABLE."""
    e = _engine(spark)
    e.execute("CREATE TABLE a (id BIGINT AUTO_INCREMENT PRIMARY KEY, mail VARCHAR(99) NOT NULL UNIQUE, kind INT DEFAULT 7, at DATETIME ON UPDATE CURRENT_TIMESTAMP, KEY k (kind))")
    again = e.execute("SHOW CREATE TABLE a").first()["statement"]
    e.execute("DROP TABLE a")
    e.execute(again)
    return e.execute("DESCRIBE a")


@query("SELECT 'one' AS db, r_regionkey AS k, r_name AS v FROM region UNION ALL SELECT 'two', n_nationkey, n_name FROM nation")
def database_switch(spark, d):
    """Two databases with a table of one name; a third is dropped with its table."""
    register(spark, d, ("region", "nation"))
    e = _engine(spark)
    for db, source in (("one", "SELECT r_regionkey AS k, r_name AS v FROM region"), ("two", "SELECT n_nationkey AS k, n_name AS v FROM nation"), ("three", "SELECT 1 AS k, 'x' AS v")):
        e.execute(f"CREATE DATABASE {db}")
        e.execute(f"USE {db}")
        e.execute(f"CREATE TABLE t AS {source}")
    e.execute("DROP DATABASE three")
    out = []
    for (db,) in e.execute("SHOW DATABASES").collect():
        e.execute(f"USE {db}")
        out.append(e.table("t").read().select(F.lit(db).alias("db"), F.col("k").cast("bigint"), "v"))
    return out[0].unionByName(out[1])


@query("SELECT o_orderkey AS k, o_orderpriority AS v, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders")
def load_data(spark, d):
    """SELECT ... INTO OUTFILE with NULLs, and LOAD DATA of the same files."""
    register(spark, d, ("orders",))
    e, out = _engine(spark), _place(spark, "outfile")
    form = "FIELDS TERMINATED BY ',' ENCLOSED BY '\"'"
    e.execute(f"SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END FROM orders INTO OUTFILE '{out}' {form}")
    e.execute("CREATE TABLE loaded (k BIGINT PRIMARY KEY, v VARCHAR(32), price DOUBLE)")
    e.execute(f"LOAD DATA INFILE '{out}' INTO TABLE loaded {form} (k, v, price)")
    return e.table("loaded").read()


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 25")
def orc_roundtrip(spark, d):
    rows, path = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), _place(spark, "orc")
    write(rows, path, "orc")
    return read_orc(spark, path, rows.schema).where("p_size > 25").drop("p_size")


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
  round(quantile_cont(l_extendedprice, 0.95), 4) AS q95, true AS sketch_ok FROM lineitem GROUP BY 1
""")
def agg_quantile(spark, d):
    """Exact quantiles, and whether the sketch's median is within a hundredth of the rows of the exact one."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    exact = lambda *at: F.expr(f"percentile(l_extendedprice, array({', '.join(f'{a}D' for a in at)}))")
    out = rows.groupBy("l_returnflag").agg(exact(0.25, 0.5, 0.95).alias("q"), exact(0.49, 0.51).alias("band"), F.percentile_approx("l_extendedprice", 0.5, 10000).alias("near"))
    named = [F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q25", "q50", "q95"))]
    return out.select("l_returnflag", *named, F.col("near").between(F.col("band")[0], F.col("band")[1]).alias("sketch_ok"))


@query("""
SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END AS v, 'n' AS t FROM nation WHERE n_nationkey <> 3
UNION ALL SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'one' ELSE r_name END, 'r' FROM region UNION ALL SELECT 100, 'both', 'r'
""")
def sql_transaction(spark, d):
    """BEGIN to COMMIT over two tables: a savepoint rolled back, a change seen by the transaction alone, a
    transaction that is rolled back, and one that another client's commit refuses."""
    e = _engine(spark)
    for name, source, key, text in (("n", "nation", "n_nationkey", "n_name"), ("r", "region", "r_regionkey", "r_name")):
        e.create_table(name, {"k": "BIGINT", "v": "VARCHAR(32)"}, ["k"], rows=table(spark, d, source).select(F.col(key).alias("k"), F.col(text).alias("v")))
    one, other = e.connect(), e.connect()
    one.execute("BEGIN")
    one.execute("UPDATE n SET v = 'even' WHERE k % 2 = 0")
    one.execute("SAVEPOINT here")
    one.execute("DELETE FROM n WHERE k > 5")
    one.execute("UPDATE r SET v = 'lost'")
    one.execute("ROLLBACK TO SAVEPOINT here")
    one.execute("DELETE FROM n WHERE k = 3")
    one.execute("INSERT INTO r SELECT 100, 'both' FROM n WHERE v = 'even' AND k = 0")
    other.execute("BEGIN")
    other.execute("UPDATE n SET v = 'late' WHERE k = 3")
    one.execute("UPDATE r SET v = 'one' WHERE k = 1")
    one.execute("COMMIT")
    try:
        other.execute("COMMIT")
    except (CommitConflict, ConstraintError):
        other.execute("START TRANSACTION")
        other.execute("DELETE FROM r")
        other.execute("ROLLBACK")
    return e.sql("SELECT k, v, 'n' AS t FROM n UNION ALL SELECT k, v, 'r' AS t FROM r")


@query("SELECT true AS refused, count(*) AS n FROM nation")
def read_only_guard(spark, d):
    """A read-only transaction reads, and refuses to write."""
    e, refused = _engine(spark), False
    e.create_table("n", {"k": "BIGINT"}, ["k"], rows=table(spark, d, "nation").select(F.col("n_nationkey").alias("k")))
    c = e.connect()
    c.execute("START TRANSACTION READ ONLY")
    try:
        c.execute("DELETE FROM n")
    except ReadOnlyError:
        refused = True
    return c.execute("SELECT count(*) AS n FROM n").select(F.lit(refused).alias("refused"), "n")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey = 1 THEN 'first' ELSE n_name END AS v, true AS refused FROM nation")
def serializable_read(spark, d):
    """A serializable transaction that has read rows which another commit changed can't commit."""
    e, refused = _engine(spark), False
    e.create_table("n", {"k": "BIGINT", "v": "VARCHAR(32)"}, ["k"], rows=table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))
    c = e.connect()
    c.execute("SET TRANSACTION ISOLATION LEVEL SERIALIZABLE")
    c.execute("BEGIN")
    c.execute("UPDATE n SET v = 'stale' WHERE k = 2")
    e.execute("UPDATE n SET v = 'first' WHERE k = 1")
    try:
        c.execute("COMMIT")
    except (CommitConflict, ConstraintError):
        refused = True
    return e.sql("SELECT k, v FROM n").withColumn("refused", F.lit(refused))


@query("""
SELECT CASE WHEN o_orderkey < 2000 THEN 'low' WHEN o_orderkey <= 6000 THEN 'mid' WHEN o_orderkey < 9000 THEN 'new' ELSE 'top' END AS range_id,
  count(*) AS n, sum(o_orderkey) AS keys, 3 * count(*) AS marks FROM (SELECT o_orderkey FROM orders UNION ALL SELECT -5) GROUP BY 1
""")
def shard_table(spark, d):
    """SHARD TABLE, an INSERT, a SPLIT RANGE and a schema change that reaches all ranges at once."""
    e = _engine(spark)
    e.create_table("o", {"o_orderkey": "BIGINT", "o_custkey": "BIGINT"}, ["o_orderkey"], rows=table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    e.execute("SHARD TABLE o BY o_orderkey RANGE END 2000 GROUP low RANGE START 2000 END 9000 GROUP mid RANGE START 9000 GROUP top")
    e.execute("INSERT INTO o VALUES (-5, 1)")
    e.execute("SPLIT RANGE app.o AT 6000 GROUP new")
    e.execute("ALTER TABLE o ADD COLUMN mark INT DEFAULT 3")
    held = F.lit(None)
    for p in e.execute("SHOW RANGES FROM o").collect():
        inside = (F.lit(True) if p.start is None else F.col("o_orderkey") >= p.start) & (F.lit(True) if p.end is None else F.col("o_orderkey") < p.end)
        held = F.when(inside, p.group).otherwise(held)
    rows = e.sql("SELECT * FROM o").withColumn("range_id", held)
    return rows.groupBy("range_id").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.sum("mark").alias("marks"))


@query("SELECT o_orderkey, o_custkey, true AS within FROM orders")
def size_split(spark, d):
    """A table whose ranges are split until none is over a limit of bytes."""
    e = _engine(spark)
    e.create_table("o", {"o_orderkey": "BIGINT", "o_custkey": "BIGINT"}, ["o_orderkey"], rows=table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    e.execute("SHARD TABLE o BY o_orderkey RANGE")
    t = e.table("o")
    limit = t.files.size(f"{t.path}/{t.meta()['folder']}") * 2 // 3
    e.split_over("o", limit)
    within = all(t.files.size(f"{t.path}/{p['folder']}") <= limit for p in t.meta()["ranges"])
    return e.sql("SELECT o_orderkey, o_custkey FROM o").withColumn("within", F.lit(within))


@query("SELECT n_nationkey AS k, n_name || '!' AS v FROM nation WHERE n_regionkey = 2 UNION ALL SELECT -1, 'added'")
def procedure_call(spark, d):
    """A stored procedure with parameters, called by name."""
    e = _engine(spark)
    e.create_table("n", {"k": "BIGINT", "v": "VARCHAR(32)", "r": "INT"}, ["k"], rows=table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"), F.col("n_regionkey").alias("r")))
    e.execute("CREATE PROCEDURE keep(IN region INT, IN tail VARCHAR(9)) BEGIN DELETE FROM n WHERE r <> region; UPDATE n SET v = concat(v, tail); INSERT INTO n VALUES (-1, 'added', region); SELECT k, v FROM n; END")
    return e.execute("CALL keep(2, '!')")


@query("SELECT name, 'AFTER INSERT ON t FOR EACH ROW SET x = 1' AS statement FROM (VALUES ('kept'), ('second')) t(name)")
def trigger_store(spark, d):
    """Triggers are kept by name, taken once, and dropped."""
    e = _engine(spark)
    for name in ("kept", "dropped", "second", "kept"):
        try:
            e.execute(f"CREATE TRIGGER {name} AFTER INSERT ON t FOR EACH ROW SET x = 1")
        except FileExistsError:
            e.execute("DROP TRIGGER dropped")
    return e.execute("SHOW TRIGGERS")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000")
def table_function(spark, d):
    """A function that returns a table, defined in SQL and inlined into the plan; no row leaves the JVM."""
    register(spark, d, ("customer", "orders"))
    spark.sql("""
      CREATE OR REPLACE TEMPORARY FUNCTION orders_over(least DOUBLE) RETURNS TABLE (buyer BIGINT, o_orderkey BIGINT)
      RETURN SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > least""")
    return spark.sql("SELECT c_custkey, o_orderkey FROM customer JOIN orders_over(200000D) ON buyer = c_custkey WHERE c_mktsegment = 'BUILDING'")


@query("SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS geo, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY 1")
def aggregate_function(spark, d):
    """Aggregates of one's own, made of built-in ones, so they are combined before the exchange."""
    geo = Aggregate(("x",), {"s": "sum(ln(x))", "n": "count(x)"}, "exp(s / n)")
    weighted = Aggregate(("x", "w"), {"s": "sum(x * w)", "w": "sum(w)"}, "s / w")
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return rows.groupBy("l_returnflag").agg(F.round(geo("l_extendedprice"), 4).alias("geo"), F.round(weighted("l_extendedprice", "l_quantity"), 4).alias("weighted"))


@query("SELECT n_nationkey, n_name FROM nation")
def result_spool(spark, d):
    """A result passed to a client in pages, in its order."""
    pages = list(spool(table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), 7))
    rows = [r for p in pages if len(p) <= 7 for r in p]
    return spark.createDataFrame([r for a, r in zip([None, *rows], rows) if a is None or a[0] < r[0]], "n_nationkey bigint, n_name string")


@query("SELECT count(*) AS row_count, count(DISTINCT s_nationkey) AS distinct_count, true AS dropped FROM supplier")
def statistics_kept(spark, d):
    """ANALYZE TABLE keeps statistics of each key with the table until they are dropped."""
    e = _engine(spark)
    e.create_table("s", {"s_suppkey": "BIGINT", "s_nationkey": "INT"}, ["s_suppkey"], rows=table(spark, d, "supplier").select("s_suppkey", "s_nationkey"))
    e.execute("CREATE INDEX n ON s (s_nationkey)")
    e.execute("ANALYZE TABLE s")
    own = e.statistics("s", ["s_nationkey"])
    e.drop_statistics("s")
    rows = [(own["n_rows"], own["distinct_rows"], e.statistics("s", ["s_nationkey"]) is None)]
    return spark.createDataFrame(rows, "row_count bigint, distinct_count bigint, dropped boolean")


@query("SELECT r_regionkey AS k, r_name AS v, 'r' AS t FROM region UNION ALL SELECT n_nationkey, n_name, 'n' FROM nation")
def backup_sql(spark, d):
    """BACKUP of a database and RESTORE after its tables are dropped."""
    register(spark, d, ("region", "nation"))
    e, target = _engine(spark), _place(spark, "copy")
    e.execute("CREATE TABLE r AS SELECT r_regionkey AS k, r_name AS v FROM region")
    e.execute("CREATE TABLE n AS SELECT n_nationkey AS k, n_name AS v FROM nation")
    e.execute(f"BACKUP TO '{target}'")
    e.execute("DROP TABLE r, n")
    e.execute(f"RESTORE FROM '{target}'")
    return e.sql("SELECT k, v, 'r' AS t FROM r UNION ALL SELECT k, v, 'n' AS t FROM n")


@query("""
WITH f AS (SELECT user_id, max(event_id) AS fs FROM events WHERE event_id % 50 IN (0, 1) GROUP BY 1),
e AS (SELECT events.*, fs FROM events LEFT JOIN f USING (user_id) WHERE fs IS NULL OR event_id >= fs)
SELECT user_id AS k, round(coalesce(arg_max(value, event_id) FILTER (WHERE event_id % 50 = 1 OR event_id % 2 = 0), -1), 6) AS v,
  coalesce(arg_max(event_type, event_id) FILTER (WHERE event_id % 2 = 1), 'base') AS kind FROM e GROUP BY user_id, fs HAVING coalesce(fs % 50, 1) <> 0
""")
def cdc_partial_rows(spark, d):
    """Changes whose images hold only some columns."""
    e = table(spark, d, "events")
    base = e.select(F.col("user_id").alias("k"), F.lit(-1.0).alias("v"), F.lit("base").alias("kind")).distinct()
    mod = F.col("event_id") % 50
    op = F.when(mod == 0, "delete").when(mod == 1, "insert").otherwise("update")
    present = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("v"))).otherwise(F.array(F.lit("kind")))
    after = F.struct(F.col("user_id").alias("k"), F.col("value").alias("v"), F.col("event_type").alias("kind"))
    changes = e.select(F.col("event_id").alias("seq"), op.alias("op"), F.struct(F.col("user_id").alias("k")).alias("before"), after.alias("after"), present.alias("present"))
    return C.apply_partial(base, changes, ["k"]).withColumn("v", F.round("v", 6))


@query(f"SELECT k, v, true AS refused, 'stopped' AS state FROM ({_LAST.format(where='true')})")
def replica_control(spark, d):
    """A replica that is started, reset, refused a reset while it runs, and started again on a log it has applied."""
    log, keyed, refused = _place(spark, "log"), _keyed(spark, d), False
    C.write_log(keyed, log, 5000)
    t = VersionedTable.create(spark, _place(spark, "target"), spark.createDataFrame([], "k bigint, v double"))
    own = Replica(spark, _place(spark, "replica"), t, keyed.schema, ["k"])
    own.change_source(log)
    own.start()
    own.wait()
    own.reset()
    own.start(every="1 second")
    try:
        own.reset()
    except ReplicaError:
        refused = True
    own.query.processAllAvailable()
    own.stop()
    state = own.status().first()["state"]
    return t.read().select("k", F.round("v", 6).alias("v"), F.lit(refused).alias("refused"), F.lit(state).alias("state"))


@query("SELECT count(DISTINCT event_id // 10) AS executed, max(event_id) AS last_seq, true AS located FROM events")
def log_position(spark, d):
    """Where a log ends, and how many transactions it holds."""
    log = _place(spark, "log")
    C.write_log(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 10).alias("gtid")), log, 2000)
    return C.log_status(spark, log).select("executed", "last_seq", (F.col("position") > 0).alias("located"))


@query("SELECT 'nations' AS name, count(*) AS n_rows, true AS stored FROM nation WHERE n_nationkey <> 4")
def table_status(spark, d):
    """Rows and bytes of a table with an edit."""
    e = _engine(spark)
    e.create_table("nations", {"n_nationkey": "BIGINT", "n_name": "VARCHAR(32)"}, ["n_nationkey"], rows=table(spark, d, "nation").select("n_nationkey", "n_name"))
    e.execute("DELETE FROM nations WHERE n_nationkey = 4")
    return e.execute("SHOW TABLE STATUS").select("name", "n_rows", (F.col("data_length") > 0).alias("stored"))
