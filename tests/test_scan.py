import pytest
from pyspark.sql import functions as F

from quarry.functions import mysql as M
from quarry.functions.keys import encode_int, encode_text
from quarry.functions.types import field
from quarry.operators import stats
from quarry.operators.scan import Span, contains_text, get, ordered, scan
from quarry.streaming.changes import Filters, matches


def test_integer_and_string_order(spark):
    n = spark.createDataFrame([(10,), (2,), (-2,), (-10,)], "id bigint")
    ids = lambda df: [r[0] for r in df.collect()]
    assert ids(ordered(n, "id")) == [-10, -2, 2, 10] and ids(ordered(n, "id", reverse=True)) == [10, 2, -2, -10]
    assert ids(ordered(scan(n, {"id": Span(2, low_closed=False)}), "id")) == [10]
    assert ids(ordered(scan(n, {"id": Span(high=2)}), "id")) == [-10, -2]
    assert ids(scan(n, {"id": Span(5, 3)})) == [] and ids(get(n, id=2)) == [2]
    w = spark.createDataFrame([("b",), ("aa",), ("a",)], "id string")
    assert ids(ordered(w, "id")) == ["a", "aa", "b"] and ids(ordered(scan(w, {"id": Span(high="b")}), "id")) == ["a", "aa"]


def test_mixed_order(spark):
    p = spark.createDataFrame([(1, "apple", 1), (2, "apricot", 2), (3, "banana", 3), (5, "app", 5)], "pk bigint, s string, n2 bigint")
    found = scan(p, {"n2": Span(1, low_closed=False)})
    assert [r["pk"] for r in ordered(found, "-n2", "s").collect()] == [5, 3, 2]
    assert [r["pk"] for r in ordered(found, "-n2", "s", reverse=True).collect()] == [2, 3, 5]


def test_null_spans_and_escapes(spark):
    t = spark.createDataFrame([(1, None), (2, "a%b"), (3, "axb"), (4, "a_b\\")], "id int, s string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(scan(t, {"s": Span(null=True)})) == [1] and ids(scan(t, {"s": Span()})) == [2, 3, 4]
    assert ids(t.where(contains_text("s", "%"))) == [2] and ids(t.where(contains_text("s", "_"))) == [4] and ids(t.where(contains_text("s", "\\"))) == [4]
    assert ids(t.where(contains_text("s", "XB", fold=True))) == [3]


def test_encoded_keys_sort(spark):
    values = [None, -(1 << 63), -2, 0, 3, (1 << 63) - 1]
    t = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", encode_int("v").alias("k"))
    assert [r["v"] for r in t.orderBy("k").collect()] == values
    w = spark.createDataFrame([("b",), ("aa",), ("a",), (None,)], "v string").select("v", encode_text("v").alias("k"))
    assert [r["v"] for r in w.orderBy("k").collect()] == [None, "a", "aa", "b"]


@pytest.mark.parametrize("n,buckets", [(5, 5), (16, 16), (17, 17), (31, 31), (100, 17)])
def test_histogram_bucket_count(spark, n, buckets):
    h = stats.histogram(spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("v")), ["v"], ["id"]).collect()
    assert len(h) == buckets and sum(r["n"] for r in h) == n


def test_analyze_collapses_null_and_empty(spark):
    t = spark.createDataFrame([("a b", "c"), ("a", "b c"), (None, ""), ("", None)], "x string, y string")
    r = stats.analyze(t, ["x", "y"]).first()
    assert (r["n_rows"], r["distinct_rows"], r["null_rows"]) == (4, 2, 2)


def test_dialect_functions(spark):
    r = spark.range(1).select(
        M.to_number(F.lit("12abc")).alias("a"), M.to_number(F.lit("x")).alias("b"), M.divide(F.lit(1), F.lit(0)).alias("c"), M.int_divide(F.lit(-7), F.lit(2)).alias("d"),
        M.sec_to_time(F.lit(-90061)).alias("e"), M.field(F.lit("b"), "a", "b").alias("f"), M.json_set(F.lit('{"a":"1"}'), "b", F.lit(2)).alias("g"),
        M.truncate(F.lit(-1.99), 1).alias("h"), M.str_to_date(F.lit("31.12.2020"), "%d.%m.%Y").cast("string").alias("i"), M.json_remove(F.lit('{"a":"1","b":"2"}'), "a").alias("j"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"], r["g"], r["h"]) == (12.0, 0.0, None, -3, "-25:01:01", 2, '{"a":"1","b":2}', -1.9)
    assert r["i"] == "2020-12-31 00:00:00" and r["j"] == '{"b":"2"}'


def test_types():
    assert field("x", "DECIMAL(10,2)").dataType.simpleString() == "decimal(10,2)" and field("x", "BIGINT UNSIGNED").dataType.simpleString() == "decimal(20,0)"
    assert field("x", "ENUM('a','b''c')").metadata["values"] == ["a", "b'c"]
    with pytest.raises(ValueError):
        field("x", "DECIMAL(65,2)")


def test_filters(spark):
    t = spark.createDataFrame([("app", "t"), ("other", "t"), ("mysql", "user"), ("app", "secret")], "db string, tbl string")
    seen = lambda f: {f"{r['db']}.{r['tbl']}" for r in t.where(f.column()).collect()}
    assert seen(Filters(do_db=("app",))) == {"app.t", "app.secret"} and "mysql.user" not in seen(Filters(ignore_db=("mysql",)))
    assert seen(Filters(do_db=("app",), ignore_table=("app.secret",))) == {"app.t"}
    assert matches("app.%", "APP.x") and not matches("app._", "app.xy")
