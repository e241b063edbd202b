"""The list of an ENUM is the declared one, whatever a table holds."""

import pytest

from quarry.plans.function_queries import PRIORITIES, enum_order


def orders(spark, place, values):
    rows = [(i, v, "O") for i, v in enumerate(values)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(f"{place}/orders.parquet")
    return place


def test_a_missing_value_does_not_move_the_others(spark, place):
    got = enum_order(spark, orders(spark, place, [PRIORITIES[2], PRIORITIES[4], None])).collect()
    assert {r["o_orderkey"]: (r["idx"], r["back"]) for r in got} == {0: (3, PRIORITIES[2]), 1: (5, PRIORITIES[4]), 2: (None, None)}


def test_values_outside_the_list_are_told(spark, place):
    with pytest.raises(ValueError, match="not in the ENUM's list"):
        enum_order(spark, orders(spark, place, [*PRIORITIES, *(f"{i}-OTHER" for i in range(10, 160))]))
