"""Queries of window functions, scalar functions, types and key encodings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import mysql as M
from quarry.functions.keys import encode_int, folded
from quarry.functions.types import enum_index, enum_text, field, set_bits, zero_date
from quarry.registry import query
from quarry.sources.tables import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query("""
SELECT o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def win_rank(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"),
        F.round(F.percent_rank().over(w), 6).alias("pct"), F.round(F.cume_dist().over(w), 6).alias("cume"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")).cast("long").alias("rn"),
    )


@query("""
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS run, count(*) OVER w AS n FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def win_rows_frame(spark, d):
    w = _by_customer().rowsBetween(-2, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("run"), F.count("*").over(w).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, count(*) OVER w AS n, max(l_quantity) OVER w AS top FROM lineitem
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)
""")
def win_range_frame(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_quantity").rangeBetween(-2, 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("n"), F.max("l_quantity").over(w).alias("top"))


@query("""
SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2, -1) OVER w AS next2 FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def win_lag_lead(spark, d):
    w = _by_customer()
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey", 2, -1).over(w).alias("next2"))


@query("SELECT o_orderkey, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS part FROM orders")
def win_ntile(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.ntile(3).over(_by_customer()).cast("long").alias("part"))


@query("""
SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, nth_value(o_orderkey, 2) OVER w AS second, last_value(o_orderkey) OVER w AS last FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def win_nth(spark, d):
    w = _by_customer().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "orders").select("o_orderkey", F.first("o_orderkey").over(w).alias("first"), F.nth_value("o_orderkey", 2).over(w).alias("second"), F.last("o_orderkey").over(w).alias("last"))


@query("""
SELECT p_partkey, upper(p_name) AS up, substring(p_type, 1, 5) AS sub, split_part(p_brand, '#', 1) AS head, lpad(CAST(p_size AS VARCHAR), 4, '0') AS pad,
  replace(p_type, ' ', '_') AS rep, reverse(p_brand) AS rev, length(p_name) AS len, base64(encode(p_brand)) AS b64, md5(p_name) AS m5,
  CASE p_size WHEN 1 THEN 1 WHEN 5 THEN 2 WHEN 9 THEN 3 ELSE 0 END AS fld, instr(p_type, ' ') AS at,
  CASE WHEN p_brand < p_type THEN -1 WHEN p_brand > p_type THEN 1 ELSE 0 END AS cmp,
  CASE WHEN length(p_name) >= 2 THEN substring(p_name, 1, 1) || 'XY' || substring(p_name, 4) ELSE p_name END AS ins
FROM part
""")
def fn_string(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.substring("p_type", 1, 5).alias("sub"), M.substring_index("p_brand", "#", 1).alias("head"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("pad"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("rep"), F.reverse("p_brand").alias("rev"),
        F.length("p_name").cast("long").alias("len"), M.to_base64("p_brand").alias("b64"), F.md5("p_name").alias("m5"), M.field("p_size", 1, 5, 9).cast("int").alias("fld"),
        M.instr("p_type", " ").cast("long").alias("at"), M.strcmp("p_brand", "p_type").alias("cmp"), M.insert("p_name", 2, 2, "XY").alias("ins"),
    )


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS plus,
  CAST(last_day(o_orderdate) AS DATE) AS lst, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, strftime(o_orderdate, '%Y/%m/%d') AS txt,
  dayname(o_orderdate) AS dn, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') = date_trunc('day', o_orderdate) AS back
FROM orders
""")
def fn_date(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.year(t).alias("y"), F.quarter(t).alias("q"), F.add_months(t, 1).alias("plus"), F.last_day(t).alias("lst"),
        F.datediff(t, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), M.date_format(t, "%Y/%m/%d").alias("txt"), M.dayname(t).alias("dn"),
        (M.str_to_date(M.date_format(t, "%d.%m.%Y"), "%d.%m.%Y") == F.date_trunc("day", t)).alias("back"),
    )


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_linenumber - 1, 0), 4) AS q, CAST(l_orderkey // 7 AS BIGINT) AS dv,
  l_orderkey % 7 AS md, trunc(l_extendedprice / 100) AS tr, pow(l_linenumber, 2) AS pw, floor(l_extendedprice) AS fl, (l_quantity > 25) <> (l_tax > 0.04) AS xr
FROM lineitem
""")
def fn_math(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(M.divide("l_extendedprice", F.col("l_linenumber") - 1), 4).alias("q"), M.int_divide("l_orderkey", F.lit(7)).alias("dv"),
        M.mod("l_orderkey", F.lit(7)).alias("md"), M.truncate(F.col("l_extendedprice") / 100).alias("tr"), F.pow("l_linenumber", F.lit(2)).alias("pw"),
        F.floor("l_extendedprice").cast("double").alias("fl"), M.logical_xor(F.col("l_quantity") > 25, F.col("l_tax") > 0.04).alias("xr"),
    )


@query(r"""
SELECT c_custkey, coalesce(TRY_CAST(regexp_extract(substring(c_name, 10) || 'abc', '^\s*([+-]?[0-9]+\.?[0-9]*)', 1) AS DOUBLE), 0) AS num,
  0.0::DOUBLE AS none, CAST(c_acctbal > 0 AS INTEGER) AS pos
FROM customer
""")
def fn_cast_prefix(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", M.to_number(F.concat(F.substring("c_name", 10, 100), F.lit("abc"))).alias("num"), M.to_number("c_mktsegment").alias("none"), M.truth(F.col("c_acctbal") > 0).alias("pos")
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AND json_valid(props) AS ok FROM events")
def fn_json(spark, d):
    return table(spark, d, "events").select("event_id", M.json_extract("props", "$.k").alias("k"), F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("ok"))


@query("""
SELECT d.doc_id, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' ELSE 'none' END AS q, coalesce(toxic, -1) AS t, nullif(toxic, 0) AS n, ifnull(quality, 9) AS i
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def fn_case_null(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    case = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").otherwise("none")
    return both.select("doc_id", case.alias("q"), F.coalesce("toxic", F.lit(-1)).alias("t"), F.nullif("toxic", F.lit(0)).alias("n"), F.ifnull("quality", F.lit(9)).alias("i"))


@query("SELECT o_orderkey, regexp_matches(o_orderpriority, '^[12]-') AS top, regexp_replace(o_orderpriority, '^[0-9]-', '') AS word FROM orders")
def fn_regexp(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").rlike("^[12]-").alias("top"), F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("word"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2))::VARCHAR AS dec, CAST(o_orderkey AS VARCHAR) AS big, o_orderdate AS ts, o_orderstatus = 'O' AS open FROM orders")
def type_roundtrip(spark, d):
    """Declared types written into a schema and read back as they were."""
    o = table(spark, d, "orders")
    kinds = {"dec": field("dec", "DECIMAL(12,2)").dataType, "big": field("big", "BIGINT UNSIGNED").dataType, "open": field("open", "BOOL").dataType}
    out = o.select("o_orderkey", F.col("o_totalprice").cast(kinds["dec"]).alias("dec"), F.col("o_orderkey").cast(kinds["big"]).alias("big"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "O").cast("int").cast(kinds["open"]).alias("open"))
    return out.select("o_orderkey", F.col("dec").cast("string").alias("dec"), F.col("big").cast("string").alias("big"), "ts", (F.col("open") == 1).alias("open"))


@query("""
SELECT o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS idx, o_orderpriority AS back,
  (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END)::BIGINT AS bits FROM orders
""")
def enum_order(spark, d):
    """An ENUM sorts by its place in the list; a SET is a bit mask."""
    o = table(spark, d, "orders")
    if other := o.where(~F.col("o_orderpriority").isin(PRIORITIES)).select("o_orderpriority").first():
        raise ValueError(f"not in the ENUM's list: {other[0]}")
    idx = enum_index(PRIORITIES, "o_orderpriority")
    return o.select("o_orderkey", idx.alias("idx"), enum_text(PRIORITIES, idx).alias("back"), set_bits(["F", "O"], "o_orderstatus").alias("bits"))


@query("""
SELECT l_orderkey, l_linenumber, (CASE WHEN s < 0 THEN '-' ELSE '' END) || lpad(CAST(abs(s) // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(abs(s) // 3600 AS VARCHAR))) AS INTEGER), '0')
  || ':' || lpad(CAST(abs(s) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(s) % 60 AS VARCHAR), 2, '0') AS t, s AS back
FROM (SELECT l_orderkey, l_linenumber, CAST(floor((l_quantity - 25) * 12345) AS BIGINT) AS s FROM lineitem)
""")
def time_interval(spark, d):
    """TIME as text, negative and beyond a day, and back to seconds."""
    s = F.floor((F.col("l_quantity") - 25) * 12345)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.sec_to_time(s).alias("t"), M.time_to_sec(M.sec_to_time(s)).alias("back"))


@query("SELECT lower(c_mktsegment) AS seg, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' OR lower(c_mktsegment) = 'machinery' GROUP BY 1")
def collation_ci(spark, d):
    c = table(spark, d, "customer").withColumn("k", folded("c_mktsegment"))
    found = c.where((F.col("k") == F.lit("BuiLDing")) | (F.col("k") == F.lit("machinerY")))
    return found.groupBy("k").agg(F.count("*").alias("n")).select(F.lower(F.col("k").cast("string")).alias("seg"), "n")


@query("""
SELECT s_suppkey, row_number() OVER (ORDER BY v NULLS FIRST, s_suppkey) AS rn FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN NULL
  ELSE (s_suppkey - 50) * (CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END) * 1000000007 END AS v FROM supplier)
""")
def key_encode_int(spark, d):
    """Encoded keys sort as the signed integers do, NULL first."""
    from quarry.operators.rank import global_rank

    v = F.when(F.col("s_suppkey") % 10 == 0, F.lit(None)).otherwise((F.col("s_suppkey") - 50) * F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(-1) * 1000000007)
    rows = table(spark, d, "supplier").select("s_suppkey", encode_int(v.cast("long")).alias("k"))
    return global_rank(rows, "k", "s_suppkey").select("s_suppkey", "rn")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day, event_id % 3 = 0 AS zero FROM events")
def zero_dates(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "0000-00-00").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    day, zero = zero_date("x")
    return table(spark, d, "events").select("event_id", text.alias("x")).select("event_id", day.alias("day"), zero.alias("zero"))
