import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import mysql as M

DAYS = [datetime.datetime(y, 1, 1) + datetime.timedelta(days=d) for y in (2004, 2011, 2020, 2021, 2024) for d in [*range(0, 12), 58, 59, 60, 200, *range(355, 365)]]


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame([(d,) for d in DAYS], "t timestamp")


def test_weeks(days):
    """Against the formats of Python: %U counts from the first Sunday, %V is the ISO week."""
    got = days.select("t", M.week("t", 0).alias("w0"), M.week("t", 2).alias("w2"), M.week("t", 3).alias("w3"), M.date_format("t", "%U %v %x %X/%V %w %D|%Y").alias("f"), M.week("t", 1).alias("w1")).collect()
    for r in got:
        d = r["t"].date()
        u, (iso_year, iso, _) = int(d.strftime("%U")), d.isocalendar()
        begins = d - datetime.timedelta(days=(d.weekday() + 1) % 7)
        assert (r["w0"], r["w3"]) == (u, iso)
        assert r["w2"] == (u or int(datetime.date(d.year - 1, 12, 31).strftime("%U")))
        assert r["w1"] == (iso if iso_year == d.year else 0 if iso_year < d.year else (d - datetime.timedelta(days=7)).isocalendar()[1] + 1)
        n = d.day
        tail = "th" if 11 <= n <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
        assert r["f"] == f"{u:02d} {iso:02d} {iso_year} {begins.year}/{r['w2']:02d} {(d.weekday() + 1) % 7} {n}{tail}|{d.year}"


def test_intervals(spark):
    rows = [("2024-01-31 10:00:00", "2024-02-29 09:59:59", 0, 28, 0), ("2024-01-31 10:00:00", "2024-03-31 10:00:00", 2, 60, 0), ("2020-02-29 00:00:00", "2024-02-28 23:00:00", 47, 1460, 3), ("2024-03-01 00:00:00", "2023-03-01 00:00:01", -11, -365, 0), ("2024-03-01 00:00:00", "2023-02-28 00:00:00", -12, -367, -1)]
    df = spark.createDataFrame(rows, "a string, b string, months int, days int, years int")
    got = df.select("*", M.timestampdiff("month", "a", "b").alias("m"), M.timestampdiff("day", "a", "b").alias("d"), M.timestampdiff("year", "a", "b").alias("y"), M.timestampdiff("second", "a", "b").alias("s")).collect()
    for r in got:
        a, b = (datetime.datetime.fromisoformat(r[c]) for c in "ab")
        assert (r["m"], r["y"], r["s"]) == (r["months"], r["years"], int((b - a).total_seconds())) and r["d"] == int((b - a).total_seconds() / 86400)
    one = spark.createDataFrame([("2024-01-31 10:20:30",)], "t string").select(
        M.date_add("t", 1, "month").cast("string").alias("a"), M.date_sub("t", 1, "quarter").cast("string").alias("b"), M.date_add("t", 2, "week").cast("string").alias("c"), M.date_sub("t", 30, "second").cast("string").alias("d"),
        M.extract("YEAR_MONTH", "t").alias("e"), M.extract("DAY_SECOND", "t").alias("f"), M.extract("QUARTER", "t").alias("g"), M.extract("HOUR_MINUTE", "t").alias("h"),
    ).first()
    assert tuple(one) == ("2024-02-29 10:20:30", "2023-10-31 10:20:30", "2024-02-14 10:20:30", "2024-01-31 10:20:00", 202401, 31102030, 1, 1020)


def test_strings(spark):
    df = spark.createDataFrame([("xxabcxx", 2, "b,c,xxabcxx"), (None, 0, None)], "s string, n int, l string")
    got = df.select(M.locate("x", "s", 3).alias("a"), M.locate("x", "s", 0).alias("z"), M.elt("n", "one", "two").alias("b"), M.find_in_set("s", "l").alias("c"), M.hexed("s").alias("d"), M.trimmed("s", "xx").alias("e"), M.trimmed("s", "x", "leading").alias("f"), M.trimmed("s", ".").alias("g"), M.concat_ws("/", "s", "n").alias("h")).collect()
    assert tuple(got[0]) == (6, 0, "two", 3, "78786162637878", "abc", "abcxx", "xxabcxx", "xxabcxx/2")
    assert got[1]["b"] is None and got[1]["c"] is None and got[1]["h"] == "0"


def test_json_keeps_types(spark):
    doc = '{"a":1,"o":{"x":1,"y":[1,{"z":null}]},"b":true,"s":"q\\"é"}'
    one = lambda c: spark.createDataFrame([(doc, 7)], "d string, n int").select(c.alias("r")).first()["r"]
    assert one(M.json_set("d", "b", 2)) == '{"a":1,"b":2,"o":{"x":1,"y":[1,{"z":null}]},"s":"q\\"é"}'
    assert one(M.json_set("d", "$.o.x", F.col("n"))) == '{"a":1,"b":true,"o":{"x":7,"y":[1,{"z":null}]},"s":"q\\"é"}'
    assert one(M.json_set("d", "$.o.new", {"k": [True]})) == '{"a":1,"b":true,"o":{"new":{"k":[true]},"x":1,"y":[1,{"z":null}]},"s":"q\\"é"}'
    assert one(M.json_remove("d", "$.o.y")) == '{"a":1,"b":true,"o":{"x":1},"s":"q\\"é"}'
    assert one(M.json_remove(M.json_remove("d", "o"), "nothing")) == '{"a":1,"b":true,"s":"q\\"é"}'
    assert one(M.json_set("d", "$.a.b", 1)) == one(M.json_insert("d", "a", 9)) == one(M.json_replace("d", "new", 9)) == '{"a":1,"b":true,"o":{"x":1,"y":[1,{"z":null}]},"s":"q\\"é"}'
    assert one(M.json_set(F.lit("[1,2]"), "a", 1)) == "[1,2]" and one(M.json_set(F.lit(None).cast("string"), "a", 1)) is None
