"""Further queries: subqueries, file formats, indexes, full text, statistics and log administration."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import mysql as M
from quarry.operators import constraints, fulltext, stats
from quarry.operators.overlay import conflicts
from quarry.operators.scan import latest
from quarry.plans import router as P
from quarry.plans.ranges import RangedTable
from quarry.registry import query
from quarry.sources.staging import shared_dir
from quarry.sources.tables import read_csv, read_json, register, seed_accounts, seed_notes, table, write
from quarry.streaming import changes as C


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def in_subquery(spark, d):
    register(spark, d, ("orders", "customer"))
    return spark.sql("""
      SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
        AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)""")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def not_in_subquery(spark, d):
    register(spark, d, ("orders", "customer"))
    return spark.sql("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")


@query("""
WITH spend AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY 1), top AS (SELECT max(total) AS m FROM spend)
SELECT k, round(total / m, 6) AS share FROM spend, top WHERE total > m / 2
""")
def chained_cte(spark, d):
    register(spark, d, ("orders",))
    return spark.sql("""
      WITH spend AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY 1), top AS (SELECT max(total) AS m FROM spend)
      SELECT k, round(total / m, 6) AS share FROM spend, top WHERE total > m / 2""")


@query("SELECT event_id FROM events WHERE CAST(props AS VARCHAR) LIKE '%\"k\": 1%' OR CAST(props AS VARCHAR) LIKE '%\"k\":1%'")
def json_cast_like(spark, d):
    p = F.col("props").cast("string")
    return table(spark, d, "events").where(p.like('%"k": 1%') | p.like('%"k":1%')).select("event_id")


@query("SELECT left(c_name, 17) AS head, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def prefix_unique(spark, d):
    """What a unique index on the first 17 bytes would refuse."""
    out = constraints.duplicates(table(spark, d, "customer").select("c_name"), ["c_name"], prefixes={"c_name": 17})
    return out.select(F.left("c_name", F.lit(17)).alias("head"), "n")


@query("SELECT true AS ok, count(DISTINCT l_partkey) AS n FROM lineitem")
def agg_approx(spark, d):
    """The sketch is within a twentieth of the exact count."""
    near = F.abs(F.approx_count_distinct("l_partkey", 0.02) - F.count_distinct("l_partkey")) < 0.05 * F.count_distinct("l_partkey") + 1
    return table(spark, d, "lineitem").agg(near.alias("ok"), F.count_distinct("l_partkey").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def agg_conditional(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))


@query("SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority DESC) AS p FROM orders GROUP BY 1")
def group_concat_distinct(spark, d):
    own = F.sort_array(F.collect_set("o_orderpriority"), asc=False)
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.array_join(own, "|").alias("p"))


@query(r"""
SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)
WHERE list_contains(w, 'license') AND NOT list_contains(w, 'stupid')
""")
def fulltext_boolean(spark, d):
    return table(spark, d, "documents").where(fulltext.boolean_match("text", must=["license"], must_not=["stupid"])).select("doc_id")


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents)
SELECT word, count(DISTINCT doc_id) AS df FROM w WHERE length(word) >= 3 GROUP BY 1
""")
def fulltext_index(spark, d):
    """How many rows hold each word: the global counts of the inverted index."""
    return fulltext.index(table(spark, d, "documents"), "doc_id", "text").global_counts


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def csv_roundtrip(spark, d):
    path = _place(spark, "csv")
    write(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, "csv")
    return read_csv(spark, path, "s_suppkey bigint, s_name string, s_nationkey int")


@query("SELECT event_id, event_type, user_id FROM events")
def json_roundtrip(spark, d):
    path = _place(spark, "json")
    write(table(spark, d, "events").select("event_id", "event_type", "user_id"), path, "json")
    return read_json(spark, path, "event_id bigint, event_type string, user_id bigint")


@query("SELECT a AS account_id, 2 AS notes, 2 * a AS last FROM range(1, 5) t(a)")
def example_tables(spark, d):
    """The seed accounts with the number and the last of their notes."""
    last = latest(seed_notes(spark), "account_id", "-id", k=1).select("account_id", F.col("id").alias("last"))
    n = seed_notes(spark).groupBy("account_id").agg(F.count("*").cast("int").alias("notes"))
    return seed_accounts(spark).select(F.col("id").alias("account_id")).join(n, "account_id").join(last, "account_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 3 OR o_orderkey % 50 = 7")
def row_changed(spark, d):
    """Rows that changed or vanished since an edit was based on them."""
    seen = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey") % 50
    now = seen.where(k != 3).withColumn("o_orderstatus", F.when(k == 7, "?").otherwise(F.col("o_orderstatus")))
    return conflicts(now, seen, ["o_orderkey"])


@query("SELECT * FROM (VALUES ('select 1', 'read'), ('update t set a = 1', 'write'), ('begin', 'begin'), ('rollback', 'end'), ('select a from t for update', 'write')) t(statement, kind)")
def statement_kind(spark, d):
    text = ["select 1", "update t set a = 1", "begin", "rollback", "select a from t for update"]
    return spark.createDataFrame([(t, P.classify(t)) for t in text], "statement string, kind string")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 2000 AND o_orderkey < 3000")
def ranged_read(spark, d):
    """A split table read through its ranges."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    t = RangedTable.create(spark, _place(spark, "ranged"), rows, "o_orderkey", [P.KeyRange("g0", None, 2500), P.KeyRange("g1", 2500, None)])
    t.split(2200, "g2")
    return t.read(P.both(P.compare("o_orderkey", ">=", 2000), P.compare("o_orderkey", "<", 3000)), F.expr("o_orderkey >= 2000 AND o_orderkey < 3000"))


@query("SELECT true AS rotated, count(*) AS n FROM events")
def log_rotation(spark, d):
    """A changelog closes a file when it is full."""
    path = _place(spark, "log")
    C.write_log(table(spark, d, "events"), path, 300)
    files = C.log_files(spark, path).agg((F.count("*") > 1).alias("rotated"))
    return files.crossJoin(F.broadcast(spark.read.parquet(path).agg(F.count("*").alias("n"))))


@query("SELECT 'c_mktsegment' AS idx, count(DISTINCT c_mktsegment) AS cardinality, count(*) AS n_rows FROM customer UNION ALL SELECT 'c_custkey', count(DISTINCT c_custkey), count(*) FROM customer")
def index_cardinality(spark, d):
    c = table(spark, d, "customer")
    one = lambda k: stats.analyze(c, [k]).select(F.lit(k).alias("idx"), F.col("distinct_rows").alias("cardinality"), "n_rows")
    return one("c_mktsegment").unionByName(one("c_custkey"))


@query("""
SELECT r_regionkey, '{"added":{"deep":[1,null]},"id":' || r_regionkey || ',"in":{"flag":true,"name":"' || r_name || '"},"kept":1.5}' AS doc FROM region
""")
def json_edit(spark, d):
    """Members set and removed at any depth; numbers, booleans and arrays stay what they are."""
    doc = F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.lit("x").alias("gone"), F.struct(F.lit(True).alias("flag"), F.lit("old").alias("name")).alias("in"), F.lit(1.5).alias("kept")))
    out = M.json_remove(M.json_set(doc, "$.in.name", F.col("r_name")), "$.gone")
    out = M.json_set(M.json_insert(M.json_replace(out, "$.nothing", 1), "$.id", "taken"), "$.added", {"deep": [1, None]})
    return table(spark, d, "region").select("r_regionkey", out.alias("doc"))


@query("""
SELECT c_custkey, CAST(i AS INTEGER) AS ordinality, c_custkey * 10 + i AS n, CASE WHEN i = 2 THEN NULL ELSE c_mktsegment END AS seg FROM customer, (VALUES (1), (2), (3)) t(i) WHERE c_custkey % 4 <> 0
""")
def json_table(spark, d):
    """Rows from the elements of an array within a document."""
    k = F.col("c_custkey")
    item = lambda i: F.struct((k * 10 + i).alias("n"), (F.lit(None).cast("string") if i == 2 else F.col("c_mktsegment")).alias("seg"))
    doc = F.when(k % 4 != 0, F.to_json(F.struct(F.struct(F.array(item(1), item(2), item(3)).alias("items")).alias("o"))))
    rows = table(spark, d, "customer").select("c_custkey", doc.alias("doc"))
    return M.json_table(rows, "doc", "$.o.items", {"n": ("$.n", "bigint"), "seg": ("$.seg", "string")}).drop("doc")


@query("""
SELECT p_partkey, CAST(instr(p_type, ' ') AS BIGINT) AS loc, CASE p_size % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE NULL END AS el, CAST(CASE WHEN p_brand LIKE '%#1%' THEN 2 ELSE 0 END AS BIGINT) AS fs,
  upper(hex(p_size)) AS hx, 'ab' || p_name AS tr, rpad(p_brand, 12, '*') AS rp, concat_ws('-', p_brand, NULL, CAST(p_size AS VARCHAR)) AS cw FROM part
""")
def fn_string_more(spark, d):
    """LOCATE, ELT, FIND_IN_SET, HEX, TRIM, RPAD and CONCAT_WS."""
    sized = F.col("p_size") % 4
    kind = F.when(F.col("p_brand").like("%#1%"), "one").otherwise("none")
    return table(spark, d, "part").select(
        "p_partkey", M.locate(" ", "p_type").alias("loc"), M.elt(sized, "a", "b").alias("el"), M.find_in_set(kind, F.lit("zero,one,two")).alias("fs"), M.hexed("p_size").alias("hx"),
        M.trimmed(F.concat(F.lit("xyxyab"), "p_name", F.lit("xy")), "xy").alias("tr"), M.rpad("p_brand", 12, "*").alias("rp"), M.concat_ws("-", "p_brand", F.lit(None), "p_size").alias("cw"),
    )


@query("""
SELECT o_orderkey, date_diff('day', DATE '1995-02-15', CAST(o_orderdate AS DATE)) AS days, datesub('month', TIMESTAMP '1995-02-15 00:00:00', o_orderdate) AS months, datesub('year', TIMESTAMP '1995-02-15 00:00:00', o_orderdate) AS years,
  CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) AS less, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS ym, CAST(strftime(o_orderdate, '%V') AS BIGINT) AS w3, CAST(strftime(o_orderdate, '%U') AS BIGINT) AS w0,
  strftime(o_orderdate, '%G/%V %U %w') AS txt
FROM orders
""")
def fn_date_more(spark, d):
    """TIMESTAMPDIFF, DATE_SUB, EXTRACT and the weeks."""
    t, since = F.col("o_orderdate"), F.lit("1995-02-15").cast("timestamp")
    return table(spark, d, "orders").select(
        "o_orderkey", F.datediff(t, since).cast("long").alias("days"), M.timestampdiff("MONTH", since, t).alias("months"), M.timestampdiff("YEAR", since, t).alias("years"),
        M.date_sub(t, 1, "month").cast("date").alias("less"), M.extract("YEAR_MONTH", t).alias("ym"), M.week(t, 3).alias("w3"), M.week(t, 0).alias("w0"), M.date_format(t, "%x/%v %U %w").alias("txt"),
    )


@query("""
WITH e AS (SELECT event_id AS seq, 'u:' || CAST(user_id AS VARCHAR) AS gtid, event_type AS tbl, CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'insert' END AS op FROM events),
m AS (SELECT *, CASE WHEN lag(tbl) OVER w = tbl AND lag(op) OVER w = op THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY gtid ORDER BY seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY gtid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT gtid, min(seq) AS seq, 'ROWS' AS event, count(*) AS n FROM i GROUP BY gtid, island
UNION ALL SELECT gtid, min(seq), 'GTID', 0 FROM e GROUP BY 1 UNION ALL SELECT gtid, min(seq), 'BEGIN', 0 FROM e GROUP BY 1 UNION ALL SELECT gtid, max(seq), 'XID', 0 FROM e GROUP BY 1
""")
def cdc_events(spark, d):
    """The events that a log holds for the changes of each transaction."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_id") % 7 == 0, "delete").otherwise("insert")
    log = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("gtid"), F.lit("app").alias("db"), F.col("event_type").alias("tbl"), op.alias("op"))
    return C.events(log).select("gtid", "seq", "event", "n")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_regionkey = 1")
def stored_view(spark, d):
    """A view that is kept with the database and read by another session of it."""
    from quarry.engine import Engine

    place = _place(spark, "engine")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))
    e = Engine(spark, place)
    e.create_table("n", {"id": "BIGINT", "name": "TEXT", "r": "INT"}, ["id"], rows=rows)
    e.create_view("american", "SELECT id, name FROM n WHERE r = 1")
    return Engine(spark, place).sql("SELECT * FROM american")
