"""Queries of the relational core: scans, filters, joins, aggregates, set operations, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.rank import global_rank
from quarry.operators.scan import Span, contains_text, get, latest, matching, ordered, rows_equal, scan
from quarry.registry import query
from quarry.sources.tables import register, table

PAGE = 20


@query("""
WITH page AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name LIKE 'Customer%'
  ORDER BY c_name, c_custkey LIMIT 20),
o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey, c_name, o_orderkey, round(o_totalprice, 2) AS o_totalprice, rn AS note_rank,
  (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name LIKE 'Customer%') AS total
FROM page LEFT JOIN o ON c_custkey = o_custkey AND rn <= 5
""")
def accounts_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of accounts with the latest notes of each, and how many accounts match in all."""
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    found = matching(customers, F.col("c_mktsegment") == "BUILDING", F.col("c_name").like("Customer%"), None)
    page = ordered(found, "c_name", "c_custkey").limit(PAGE).select("c_custkey", "c_name")
    own = orders.join(F.broadcast(page), orders.o_custkey == page.c_custkey, "left_semi")  # a page has a fixed size
    notes = latest(own, "o_custkey", "-o_orderkey", k=5).select("o_custkey", "o_orderkey", "o_totalprice", F.col("rn").cast("long").alias("note_rank"))
    total = found.agg(F.count("*").alias("total"))
    out = page.join(notes, page.c_custkey == notes.o_custkey, "left").crossJoin(F.broadcast(total))
    return out.select("c_custkey", "c_name", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "note_rank", "total")


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def point_get(spark, d):
    return get(table(spark, d, "orders"), o_orderkey=7)


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042'")
def unique_lookup(spark, d):
    return get(table(spark, d, "customer"), c_name="Customer#000000042").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def range_scan(spark, d):
    return global_rank(scan(table(spark, d, "orders"), {"o_orderkey": Span(100, 400)}).select("o_orderkey", "o_custkey"), "o_orderkey")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 400")
def reverse_scan(spark, d):
    return global_rank(scan(table(spark, d, "orders"), {"o_orderkey": Span(100, 400, False, True)}).select("o_orderkey", "o_custkey"), "-o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (3, 5) OR (o_orderkey >= 20 AND o_orderkey < 25) OR o_orderkey >= 990")
def multi_range(spark, d):
    spans = [Span(3, 3, True, True), Span(5, 5, True, True), Span(20, 25), Span(990)]
    return scan(table(spark, d, "orders"), {"o_orderkey": spans}).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 5 AND o_orderkey < 3")
def empty_range(spark, d):
    return scan(table(spark, d, "orders"), {"o_orderkey": Span(5, 3, False, False)}).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 50 AND l_orderkey < 5000 AND l_quantity > 40 AND l_returnflag = 'R'")
def residual_filter(spark, d):
    rest = (F.col("l_quantity") > 40) & (F.col("l_returnflag") == "R")
    return scan(table(spark, d, "lineitem"), {"l_orderkey": Span(50, 5000)}, rest).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
SELECT d.doc_id, quality IS NULL AS unlabelled, coalesce(quality < 1, false) AS low
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR quality < 1
""")
def null_span(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    found = scan(both, {"quality": [Span(null=True), Span(high=1)]})
    return found.select("doc_id", F.col("quality").isNull().alias("unlabelled"), F.coalesce(F.col("quality") < 1, F.lit(False)).alias("low"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT (p_partkey BETWEEN 5 AND 50)")
def between_pred(spark, d):
    return table(spark, d, "part").where(F.col("p_size").between(10, 20) & ~F.col("p_partkey").between(5, 50)).select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query(r"SELECT url, contains(url, '%') AS percent, contains(url, '_') AS under FROM pages WHERE url LIKE '%.example.%' OR contains(url, '%') OR contains(url, '_')")
def like_escape(spark, d):
    p = table(spark, d, "pages")
    percent, under = contains_text("url", "%"), contains_text("url", "_")
    return p.where(contains_text("url", ".example.") | percent | under).select("url", percent.alias("percent"), under.alias("under"))


@query("""
SELECT a.doc_id, a.q AS q_a, b.q AS q_b
FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) a
JOIN (SELECT d.doc_id, l.toxic AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) b
ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.q IS NOT DISTINCT FROM b.q
""")
def nullsafe_eq(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    a = docs.join(labels.select("doc_id", F.col("quality").alias("q")), "doc_id", "left").alias("a")
    b = docs.join(labels.select("doc_id", F.col("toxic").alias("q")), "doc_id", "left").alias("b")
    return a.join(b, rows_equal("a", "b", ["doc_id", "q"])).select("a.doc_id", F.col("a.q").alias("q_a"), F.col("b.q").alias("q_b"))


@query("""
SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5
""")
def notes_topk(spark, d):
    out = latest(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "-o_orderkey", k=5)
    return out.select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_nationkey ASC NULLS FIRST, s_acctbal DESC NULLS LAST, s_suppkey) AS rn FROM supplier")
def mixed_order(spark, d):
    return global_rank(table(spark, d, "supplier"), "s_nationkey", "-s_acctbal", "s_suppkey").select("s_suppkey", "s_nationkey", "rn")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return _nations(spark, d, "customer", "c").union(_nations(spark, d, "supplier", "s")).distinct()


@query("SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return _nations(spark, d, "customer", "c").union(_nations(spark, d, "supplier", "s"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return _nations(spark, d, "customer", "c").intersect(_nations(spark, d, "supplier", "s"))


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier", name="except")
def except_(spark, d):
    return _nations(spark, d, "nation", "n").subtract(_nations(spark, d, "supplier", "s"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, d):
    return _nations(spark, d, "customer", "c").intersectAll(_nations(spark, d, "supplier", "s"))


@query("SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, d):
    return _nations(spark, d, "customer", "c").exceptAll(_nations(spark, d, "supplier", "s"))


def _nations(spark, d, name, letter):
    return table(spark, d, name).select(F.col(f"{letter}_nationkey").alias("nation"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def join_inner(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def join_left(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT d.doc_id AS doc_id, l.doc_id AS label_id, quality FROM (SELECT doc_id FROM documents WHERE lang = 'en') d FULL JOIN labels l ON d.doc_id = l.doc_id")
def join_full(spark, d):
    docs, labels = table(spark, d, "documents").where("lang = 'en'").alias("d"), table(spark, d, "labels").alias("l")
    return docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "full").select("d.doc_id", F.col("l.doc_id").alias("label_id"), "quality")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    """Two dimensions of fixed size."""
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def join_theta(spark, d):
    """An inequality within an equality: the equal keys carry the exchange."""
    s = table(spark, d, "supplier")
    on = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_acctbal") < F.col("b.s_acctbal"))
    return s.alias("a").join(s.alias("b"), on).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 200000")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id)")
def join_using(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), on=["doc_id"]).select("doc_id", "quality", "n_chars")


@query("SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels")
def join_natural(spark, d):
    register(spark, d, ("documents", "labels"))
    return spark.sql("SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels")


@query("""
SELECT c_custkey, list(o_orderkey ORDER BY o_orderkey)::VARCHAR AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def parent_child(spark, d):
    """Children attached to their parents as a sorted list."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("own"))
    out = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    return out.select("c_custkey", F.concat(F.lit("["), F.array_join("own", ", "), F.lit("]")).alias("orders"))


@query("""
SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer
""")
def lateral_scalar(spark, d):
    register(spark, d, ("customer", "orders"))
    return spark.sql("""
      SELECT c_custkey, t.top, t.n FROM customer,
      LATERAL (SELECT max(o_totalprice) AS top, count(*) AS n FROM orders WHERE o_custkey = c_custkey) t""")


@query("""
WITH RECURSIVE t(k, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT k * 2, depth + 1 FROM t WHERE depth < 12)
SELECT t.k, t.depth, o_custkey FROM t JOIN orders ON o_orderkey = t.k
""")
def recursive_cte(spark, d):
    register(spark, d, ("orders",))
    return spark.sql("""
      WITH RECURSIVE t(k, depth) AS (SELECT 1L, 0 UNION ALL SELECT k * 2, depth + 1 FROM t WHERE depth < 12)
      SELECT t.k, t.depth, o_custkey FROM t JOIN orders ON o_orderkey = t.k""")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 4) AS disc,
  min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10
""")
def agg_group_having(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 4).alias("disc"),
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"),
    )
    return out.where("n > 10")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_rows(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def agg_count_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def agg_listagg(spark, d):
    register(spark, d, ("nation",))
    return spark.sql("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY 1")


@query("SELECT s_nationkey, bit_and(s_suppkey) AS b_and, bit_or(s_suppkey) AS b_or, bit_xor(s_suppkey) AS b_xor FROM supplier GROUP BY 1")
def agg_bit(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.bit_and("s_suppkey").alias("b_and"), F.bit_or("s_suppkey").alias("b_or"), F.bit_xor("s_suppkey").alias("b_xor"))


@query("""
SELECT c_mktsegment, round(stddev_pop(c_acctbal), 4) AS sd, round(stddev_samp(c_acctbal), 4) AS sds, round(var_pop(c_acctbal), 2) AS vp,
  any_value(c_mktsegment) AS one FROM customer GROUP BY 1
""")
def agg_stats(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.round(F.stddev_pop("c_acctbal"), 4).alias("sd"), F.round(F.stddev_samp("c_acctbal"), 4).alias("sds"),
        F.round(F.var_pop("c_acctbal"), 2).alias("vp"), F.any_value("c_mktsegment").alias("one"),
    )


@query("SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS names FROM nation GROUP BY 1")
def agg_json_array(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list("n_name"))).alias("names"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::TINYINT AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").alias("g"))


@query("""
SELECT l_shipmode_n, round(revenue, 2) AS revenue FROM (SELECT n_name AS l_shipmode_n, sum(l_extendedprice * (1 - l_discount)) AS revenue
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
""")
def join_chain(spark, d):
    """A fact table through three dimensions, summed."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    li = li.groupBy("l_orderkey").agg(F.sum("r").alias("r"))  # summed before the joins: fewer rows are shuffled
    out = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.groupBy("o_custkey").agg(F.sum("r").alias("r")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy(F.col("n_name").alias("l_shipmode_n")).agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT c_name, c_acctbal, row_number() OVER (ORDER BY c_name, c_custkey) AS rn FROM (SELECT * FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40)")
def limit_offset(spark, d):
    page = ordered(table(spark, d, "customer"), "c_name", "c_custkey").offset(40).limit(PAGE)
    return global_rank(page, "c_name", "c_custkey").select("c_name", "c_acctbal", "rn")
