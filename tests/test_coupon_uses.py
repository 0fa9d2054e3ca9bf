"""Coupon uses: one row for each order and coupon, made without a sort or an aggregate over the lines of a task."""

import re
from datetime import datetime

import __spark_entry__ as entry
from lakemart.plans import facts_cdc as C
from lakemart.plans import facts_trade as T
from lakemart.sources import cdc_trade as S
from lakemart.sources import domain as D

LINES = [(1, 11, 0.1), (1, 21, 0.1), (1, 12, 0.1), (1, 13, 0.0), (2, None, 0.1), (2, None, 0.2), (3, None, 0.1), (3, -4, 0.1), (9, 1, 0.1), (None, 1, 0.1)]
ORDERS = [(1, 5, "F", datetime(2001, 7, 30, 8)), (1, 5, "F", datetime(2001, 7, 30, 8)), (2, 6, None, datetime(2001, 8, 1, 9)), (3, 7, "O", datetime(2001, 7, 1)), (4, 8, "F", None)]


class Tables:
    def __init__(self, spark):
        self.lineitem = spark.createDataFrame(LINES, "l_orderkey long, l_suppkey long, l_tax double")
        self.orders = spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_uses_of_odd_lines(spark):
    uses = [(1, 1, 5), (1, 2, 5), (2, None, 6), (3, -4, 7), (3, None, 7)]
    inc = D.coupon_use_inc(Tables(spark))
    assert rows(T.coupon_get(inc), "id", "coupon_id", "user_id") == sorted([(None if c is None else o * 10 + c, c, u) for o, c, u in uses], key=repr)
    assert rows(T.coupon_order(inc), "order_id", "coupon_id", "user_id") == sorted(uses, key=repr)
    assert rows(T.coupon_pay(inc), "order_id", "coupon_id") == [(1, 1), (1, 2)]


def test_history_keeps_uses_without_an_id(spark):
    """Before, uses without a coupon number, and so without an id, were one group."""
    boot = S.coupon_use_boot(Tables(spark))
    assert rows(C.coupon_first(boot, S.BOOT, "get_time", "get_time"), "coupon_id", "user_id", "get_time") == sorted(
        [(1, 5, "2001-07-29 10:00:00"), (2, 5, "2001-07-29 10:00:00"), (None, 6, "2001-07-31 10:00:00"), (-4, 7, "2001-06-30 10:00:00"),
         (None, 7, "2001-06-30 10:00:00")], key=repr)
    assert rows(C.coupon_first(boot, S.BOOT, "using_time", "order_time"), "order_id", "coupon_id") == [(1, 1), (1, 2), (3, -4), (3, None)]
    assert rows(C.coupon_first(boot, S.BOOT, "used_time", "payment_time"), "order_id", "coupon_id", "payment_time") == [
        (1, 1, "2001-07-30 08:00:00"), (1, 2, "2001-07-30 08:00:00")]


def plan(spark, sf, name):
    return entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_history_reads_the_lines_once(spark, sf):
    for name in ("fact_coupon_get_first", "fact_coupon_order_first", "fact_coupon_pay_first"):
        p = plan(spark, sf, name)
        assert "SortAggregate" not in p and len(re.findall(r"FileScan parquet .*l_orderkey", p)) == 1


def test_lines_are_summed_up_before_the_join(spark, sf):
    for name in ("fact_coupon_get", "fact_coupon_order", "fact_coupon_pay"):
        p = plan(spark, sf, name)
        assert "SortAggregate" not in p and p.index("Join") < p.index("HashAggregate")
