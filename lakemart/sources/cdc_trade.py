"""Separate trade CDC streams derived from the driver tables: order lines, headers, line
activities, line coupons, payments, refund requests and refund payments, and bootstrap
snapshots of the cart, coupon, favourite and comment tables.

Everything that happened up to ``BOOT`` lands there as ``bootstrap-insert`` with its state of
that day; later rows land on their own day as ``insert`` and each change as ``update`` whose
``old`` map names what changed.  An order is paid (status F) on its day or the next (odd keys);
a returned line (flag R) is requested on its ship day, and repaid (line status F) that day or
the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import add_days, money, nvl0
from . import domain as D
from .driver import Driver

DAY = D.TRADE_DAY
BOOT = add_days(DAY, -1)
TRAFFIC_BOOT = add_days(D.TRAFFIC_DAY, -1)


def _stream(df: DataFrame, kind: str, day: Column | str, data: Column, old: Column | None = None) -> DataFrame:
    dt = F.lit(day) if isinstance(day, str) else day
    return df.select(F.lit(kind).alias("type"), F.unix_timestamp(F.to_timestamp(dt, "yyyy-MM-dd")).alias("ts"), data.alias("data"),
                     (F.lit(None) if old is None else old).cast("map<string,string>").alias("old"), dt.alias("dt"))


def _landed(df: DataFrame, day: str, data: Column, boot: str = BOOT) -> DataFrame:
    """Rows of up to ``boot`` as its bootstrap rows, later ones as inserts of their day."""
    return _stream(df.where(F.col(day) <= boot), "bootstrap-insert", boot, data) \
        .unionByName(_stream(df.where(F.col(day) > boot), "insert", F.col(day), data))


def _later(day: str, key: str) -> Column:
    """The day itself for even keys, the next for odd ones."""
    return F.date_format(F.date_add(F.col(day).cast("date"), (F.col(key) % 2).cast("int")), "yyyy-MM-dd")


def _orders(drv: Driver) -> DataFrame:
    x = drv.orders.join(drv.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return x.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("c_nationkey").alias("province_id"),
                    "o_orderstatus", F.concat(F.lit("110"), F.substring("o_orderpriority", 1, 1)).alias("payment_type"),
                    F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("create_time"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def _line_id() -> Column:
    """A line's id.  The driver's (order, line number) pairs repeat, so part, supplier and
    quantity are in it as well."""
    return (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000) * 100 \
        + F.col("l_quantity").cast("bigint")


def _lines(drv: Driver) -> DataFrame:
    o = _orders(drv).select("order_id", "create_time", "day")
    return drv.lineitem.join(o, F.col("l_orderkey") == F.col("order_id")).withColumn("id", _line_id())


def detail_inc(drv: Driver) -> DataFrame:
    price = money("l_extendedprice")
    act = F.when(F.col("l_discount") > 0, (price * money("l_discount")).cast("decimal(16,2)"))
    cou = F.when(F.col("l_tax") > 0, (price * money("l_tax")).cast("decimal(16,2)"))
    data = F.struct("id", "order_id", F.col("l_partkey").alias("sku_id"), F.col("l_suppkey").alias("source_id"),
                    F.concat(F.lit("240"), (F.col("l_linenumber") % 4 + 1).cast("string")).alias("source_type"),
                    F.col("l_quantity").cast("bigint").alias("sku_num"), (F.col("l_partkey") % 1000 + 1).cast("decimal(16,2)").alias("order_price"),
                    (price - nvl0(act) - nvl0(cou)).cast("decimal(16,2)").alias("split_total_amount"),
                    act.alias("split_activity_amount"), cou.alias("split_coupon_amount"), "create_time")
    return _landed(_lines(drv), "day", data)


def detail_activity_inc(drv: Driver) -> DataFrame:
    data = F.struct(F.col("id").alias("order_detail_id"), (F.col("l_suppkey") % 7).alias("activity_id"),
                    (F.col("l_suppkey") % 7 * 10 + F.col("l_linenumber") % 3).alias("activity_rule_id"))
    return _landed(_lines(drv).where(F.col("l_discount") > 0), "day", data)


def detail_coupon_inc(drv: Driver) -> DataFrame:
    data = F.struct(F.col("id").alias("order_detail_id"), (F.col("l_suppkey") % 10).alias("coupon_id"))
    return _landed(_lines(drv).where(F.col("l_tax") > 0), "day", data)


def _returns(drv: Driver) -> DataFrame:
    """Returned lines with their request day and, where repaid, the day of that."""
    o = _orders(drv).select("order_id", "user_id", "province_id", "payment_type")
    li = drv.lineitem.where(F.col("l_returnflag") == "R").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    x = li.join(o, F.col("l_orderkey") == F.col("order_id")).withColumn("id", _line_id())
    return x.withColumn("repaid", F.when(F.col("l_linestatus") == "F", _later("day", "order_id")))


def header_inc(drv: Driver) -> DataFrame:
    def data(status: str, time: Column) -> Column:
        return F.struct(F.col("order_id").alias("id"), "user_id", "province_id", F.lit(status).alias("order_status"), time.alias("operate_time"))

    out = _landed(_orders(drv), "day", data("1001", F.lit(None).cast("string")))
    back = _returns(drv)
    for status, before, day in (("1005", "1004", "day"), ("1006", "1005", "repaid")):
        x = back.where(F.col(day) > BOOT).select("order_id", "user_id", "province_id", F.col(day).alias("at")).distinct()
        out = out.unionByName(_stream(x, "update", F.col("at"), data(status, F.concat("at", F.lit(" 12:00:00"))),
                                      F.create_map(F.lit("order_status"), F.lit(before))))
    return out


def payment_inc(drv: Driver) -> DataFrame:
    x = _orders(drv).where(F.col("o_orderstatus") == "F").withColumn("paid", _later("day", "order_id"))
    time = F.concat("paid", F.lit(" 11:00:00"))

    def data(done: Column) -> Column:
        return F.struct(F.col("order_id").alias("id"), "user_id", "order_id", "payment_type",
                        F.when(done, F.lit("1602")).otherwise(F.lit("1601")).alias("payment_status"), F.when(done, time).alias("callback_time"))

    return _landed(x, "day", data(F.col("paid") <= BOOT)).unionByName(
        _stream(x.where(F.col("paid") > BOOT), "update", F.col("paid"), data(F.lit(True)),
                F.create_map(F.lit("payment_status"), F.lit("1601"))))


def refund_inc(drv: Driver) -> DataFrame:
    x = _returns(drv)

    def data(done: Column) -> Column:
        return F.struct("id", "user_id", "order_id", F.col("l_partkey").alias("sku_id"),
                        F.concat(F.lit("150"), (F.col("l_linenumber") % 2 + 1).cast("string")).alias("refund_type"),
                        F.col("l_quantity").cast("bigint").alias("refund_num"), money("l_extendedprice").alias("refund_amount"),
                        F.concat(F.lit("130"), (F.col("l_linenumber") % 7 + 1).cast("string")).alias("refund_reason_type"),
                        F.concat(F.lit("reason "), (F.col("id") % 5).cast("string")).alias("refund_reason_txt"),
                        F.when(done, F.lit("0705")).otherwise(F.lit("0701")).alias("refund_status"),
                        F.concat("day", F.lit(" 10:00:00")).alias("create_time"))

    return _landed(x, "day", data(F.coalesce(F.col("repaid") <= BOOT, F.lit(False)))).unionByName(
        _stream(x.where(F.col("repaid") > BOOT), "update", F.col("repaid"), data(F.lit(True)),
                F.create_map(F.lit("refund_status"), F.lit("0701"))))


def refund_payment_inc(drv: Driver) -> DataFrame:
    x = _returns(drv).where(F.col("repaid").isNotNull())

    def data(done: Column) -> Column:
        return F.struct("id", "order_id", F.col("l_partkey").alias("sku_id"), "payment_type", money("l_extendedprice").alias("total_amount"),
                        F.when(done, F.lit("1602")).otherwise(F.lit("1601")).alias("refund_status"),
                        F.when(done, F.concat("repaid", F.lit(" 15:00:00"))).alias("callback_time"))

    return _landed(x, "day", data(F.col("repaid") <= BOOT)).unionByName(
        _stream(x.where(F.col("repaid") > BOOT), "update", F.col("repaid"), data(F.lit(True)),
                F.create_map(F.lit("refund_status"), F.lit("1601"))))


def cancelled_header_boot(drv: Driver) -> DataFrame:
    """Headers as of ``BOOT``: cancelled (status P) orders carry the time of that."""
    o = _orders(drv).where(F.col("day") <= BOOT).withColumn("off", _later("day", "order_id"))
    done = (F.col("o_orderstatus") == "P") & (F.col("off") <= BOOT)
    data = F.struct(F.col("order_id").alias("id"), "user_id", "province_id",
                    F.when(done, F.lit("1003")).otherwise(F.lit("1001")).alias("order_status"),
                    F.when(done, F.concat("off", F.lit(" 12:00:00"))).alias("operate_time"))
    return _stream(o, "bootstrap-insert", BOOT, data)


def coupon_use_boot(drv: Driver) -> DataFrame:
    """Coupons received up to ``BOOT`` with what was known of their use then."""
    get_day, get_time, use_time = D.coupon_use_times()
    x = D.coupon_uses(drv).where(F.date_format(get_day, "yyyy-MM-dd") <= BOOT)
    come = F.date_format("o_orderdate", "yyyy-MM-dd") <= BOOT
    return _stream(x, "bootstrap-insert", BOOT,
                   D.coupon_use_data(get_time, F.when(come, use_time), F.when(come & F.col("paid"), use_time)))


def cart_boot(drv: Driver) -> DataFrame:
    """Cart rows of the days up to the traffic day's eve."""
    x = drv.events.where((F.col("event_type") == "click") & (F.date_format("ts", "yyyy-MM-dd") <= TRAFFIC_BOOT))
    data = F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user_id"), (F.col("event_id") % 200).alias("sku_id"),
                    (F.floor("value") + 1).cast("bigint").alias("sku_num"), (F.col("event_id") % 50).alias("source_id"),
                    F.concat(F.lit("240"), (F.col("event_id") % 4 + 1).cast("string")).alias("source_type"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("create_time"))
    return _stream(x, "bootstrap-insert", TRAFFIC_BOOT, data)


def interaction_boot(drv: Driver, kind: str) -> DataFrame:
    """Favourites or comments of the days up to the traffic day's eve."""
    x = D.interaction_inc(drv, kind).where(F.col("dt") <= TRAFFIC_BOOT).select("data")
    return _stream(x, "bootstrap-insert", TRAFFIC_BOOT, F.col("data"))
