"""Daily loads of the trade layers: orders, payments, refunds, cart, provinces, coupons and activities, their to-date states
and reports.

As in ``layers.py`` a load of day D reads landed rows of D alone, replaces the partitions ``dt=D``, and makes everything later
from stored partitions (1 day, or the last 30).  The to-date states are bucketed tables (``sinks/state.py``): the step from
D-1 to D exchanges no row of the state.  A rerun of D starts from the same D-1 and replaces what D wrote.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import add_days
from ..sinks.state import BucketedState
from ..sources import domain as D
from ..sources import snapshots as S
from ..sources.dictionary import dictionary
from ..sources.driver import Driver
from . import dims as DM
from . import facts_trade as T
from . import reports as P
from . import rollups as R
from .layers import Layers, append_report


def state_of(layers: Layers, name: str, key: str = "user_id") -> BucketedState:
    """The state tables of a set of layers: their names hold a digest of its base folder."""
    own = hashlib.sha256(layers.base.encode()).hexdigest()[:10]
    return BucketedState(layers.spark, f"lakemart_{name}_{own}", key, int(layers.spark.conf.get("spark.sql.shuffle.partitions")))


def _step(layers: Layers, state: BucketedState, day: str, first: bool, one_day: DataFrame, begin, step) -> DataFrame:
    if first:
        return state.write(begin(one_day, day).drop("dt"), day).withColumn("dt", F.lit(day))
    today = one_day.where(F.col("dt") == day)
    return state.advance(add_days(day, -1), today, day, lambda prev, inc: step(prev, inc, day).drop("dt")).withColumn("dt", F.lit(day))


def load_trade_day(layers: Layers, drv: Driver, day: str, first: bool = False, history: int | None = None) -> dict[str, DataFrame]:
    """Run the layers and reports of day ``day``; ``first``: fills all earlier days, or the last ``history`` of them (30 are
    what later loads read), and starts the states, which always cover every day.  Returns the report tables."""
    spark = layers.spark
    lo, own = (None if history is None else add_days(day, 1 - history), None) if first else (day, day)
    since, month = lo or "0000-00-00", add_days(day, -29)
    dic, province, sku = dictionary(spark), D.province(drv), D.sku(drv)

    def layer(name: str, df: DataFrame, whole: bool = True) -> None:
        layers.write(df, name, own if whole else day)
        schemas[name] = df.schema

    def stored(name: str, lowest: str = month) -> DataFrame:
        return layers.read(name, schemas[name], lowest, day)

    schemas: dict = {}
    detail = D.order_detail(drv, lo, day)
    layer("dwd_order_detail", detail)
    layer("dwd_order_refund", D.refund_info(drv, lo, day))
    layer("dwd_pay_detail", T.pay_detail(detail, D.payment_info(drv, lo, day), dic))
    facts, refunds, paid = (stored(n, since) for n in ("dwd_order_detail", "dwd_order_refund", "dwd_pay_detail"))
    layer("dws_user_order_1d", R.user_order_1d(facts))
    layer("dws_user_refund_1d", R.user_refund_1d(refunds))
    layer("dws_user_payment_1d", R.user_payment_1d(paid))
    layer("dws_province_order_1d", R.province_order_1d(facts, province))
    layer("dws_user_sku_order_1d", R.user_sku_order_1d(facts, sku))
    layer("dws_user_sku_refund_1d", R.user_sku_refund_1d(refunds, sku))
    for name, make in (("user_order", R.user_order_nd), ("user_refund", R.user_refund_nd), ("user_payment", R.user_payment_nd),
                       ("province_order", R.province_order_nd), ("user_sku_order", R.user_sku_order_nd)):
        layer(f"dws_{name}_nd", make(stored(f"dws_{name}_1d"), day), whole=False)
    lines = stored("dwd_order_detail")
    layer("dws_coupon_order_nd", R.coupon_order_nd(DM.dim_coupon(S.coupon_info(drv), dic), lines, day), whole=False)
    layer("dws_activity_order_nd", R.activity_order_nd(DM.dim_activity(S.activity_rule(drv), S.activity_info(drv), dic), lines, day), whole=False)
    orders_1d, paid_1d = stored("dws_user_order_1d", since), stored("dws_user_payment_1d", since)
    if first and lo is not None:  # the states start from days that the layers don't keep
        whole = D.order_detail(drv, None, day)
        orders_1d, paid_1d = R.user_order_1d(whole), R.user_payment_1d(T.pay_detail(whole, D.payment_info(drv, None, day), dic))
    orders_td = _step(layers, state_of(layers, "order_td"), day, first, orders_1d, R.user_order_td_first, R.user_order_td_step)
    paid_td = _step(layers, state_of(layers, "payment_td"), day, first, paid_1d, R.user_payment_td_first, R.user_payment_td_step)

    def nd(name: str) -> DataFrame:
        return stored(f"dws_{name}_nd", day)

    rows = {
        "ads_trade_stats": P.trade_stats(stored("dws_user_order_1d", day), nd("user_order"), stored("dws_user_refund_1d", day), nd("user_refund"), day),
        "ads_order_by_province": P.order_by_province(stored("dws_province_order_1d", day), nd("province_order"), day),
        "ads_coupon_stats": P.coupon_reduce_rate(nd("coupon_order"), day),
        "ads_activity_stats": P.activity_reduce_rate(nd("activity_order"), day),
        "ads_new_buyer_stats": P.new_buyers(orders_td, paid_td, day),
        "ads_repeat_purchase_by_tm": P.repeat_rate_by_brand(nd("user_sku_order"), day),
        "ads_trade_stats_by_cate": P.trade_by_category(stored("dws_user_sku_order_1d"), stored("dws_user_sku_refund_1d"), day),
    }
    return {name: append_report(layers, x, name, day) for name, x in rows.items()}


def load_cart_day(layers: Layers, drv: Driver, day: str, first: bool = False) -> dict[str, DataFrame]:
    """Cart layers of the event days: adds and their rollups, the day's full cart and its report."""
    lo, own = (None, None) if first else (day, day)
    inc = D.cart_inc(drv).where(F.col("dt") <= day)
    adds = T.cart_add(inc if lo is None else inc.where(F.col("dt") == lo), dictionary(layers.spark))
    layers.write(adds, "dwd_cart_add", own)
    one = R.user_cart_add_1d(layers.read("dwd_cart_add", adds.schema, lo or "0000-00-00", day))
    layers.write(one, "dws_user_cart_add_1d", own)
    month = R.user_cart_add_nd(layers.read("dws_user_cart_add_1d", one.schema, add_days(day, -29), day), day)
    layers.write(month, "dws_user_cart_add_nd", day)
    full = T.cart_full(D.cart_snapshot(drv, day))
    layers.write(full, "dwd_cart_full", day)
    rows = P.cart_top3_by_category(layers.read("dwd_cart_full", full.schema, day, day), D.sku(drv), day)
    return {"ads_sku_cart_num_top3_by_cate": append_report(layers, rows, "ads_sku_cart_num_top3_by_cate", day),
            "dws_user_cart_add_nd": layers.read("dws_user_cart_add_nd", month.schema, day, day)}
