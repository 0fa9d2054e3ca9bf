"""Daily loads of the trade and cart layers give what the reports give when composed from the driver tables."""

from pyspark.sql import functions as F

from lakemart import registry
from lakemart.functions.scalar import add_days
from lakemart.plans.layers import Layers
from lakemart.plans.layers_trade import load_cart_day, load_trade_day, state_of
from lakemart.sinks.writers import drop_table
from lakemart.sources import domain as D
from lakemart.sources.driver import Driver


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def same(got, want, day):
    assert rows(got.where(F.col("dt") == day), *want.columns) == rows(want, *want.columns)


def test_trade_layers(spark, sf, tmp_path):
    day, drv, layers = D.TRADE_DAY, Driver(spark, sf), Layers(spark, str(tmp_path / "wh"))
    load_trade_day(layers, drv, add_days(day, -1), first=True, history=30)
    load_trade_day(layers, drv, day)
    reports = load_trade_day(layers, drv, day)  # a rerun gives the same
    queries = registry.load_all()[0]
    for name, key in (("ads_trade_stats", "rpt_trade_stats"), ("ads_order_by_province", "rpt_order_by_province"), ("ads_coupon_stats", "rpt_coupon_reduce_rate"),
                      ("ads_activity_stats", "rpt_activity_reduce_rate"), ("ads_new_buyer_stats", "rpt_new_buyers"),
                      ("ads_repeat_purchase_by_tm", "rpt_repeat_rate_by_brand"), ("ads_trade_stats_by_cate", "rpt_trade_by_category")):
        same(reports[name], queries[key](spark, sf), day)
    # the states: right, and each a table of its own day
    for name, key in (("order_td", "user_order_td"), ("payment_td", "user_payment_td")):
        state = state_of(layers, name)
        want = queries[key](spark, sf).drop("dt")
        assert rows(state.read(day), *want.columns) == rows(want, *want.columns)
        assert state.read(add_days(day, -1)).count() <= state.read(day).count()
        for t in (state.table(day), state.table(day) + "_inc", state.table(add_days(day, -1))):
            drop_table(spark, t)


def test_cart_layers(spark, sf, tmp_path):
    day, drv, layers = D.TRAFFIC_DAY, Driver(spark, sf), Layers(spark, str(tmp_path / "wh"))
    load_cart_day(layers, drv, add_days(day, -1), first=True)
    load_cart_day(layers, drv, day)
    out = load_cart_day(layers, drv, day)
    queries = registry.load_all()[0]
    same(out["ads_sku_cart_num_top3_by_cate"], queries["rpt_cart_top3_by_category"](spark, sf), day)
    same(out["dws_user_cart_add_nd"], queries["user_cart_add_nd"](spark, sf), day)
