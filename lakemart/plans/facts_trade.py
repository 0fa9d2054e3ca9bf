"""Trade / tool / interaction transaction facts J-08..J-19 from CDC envelopes.

``day`` is the landing day of the daily load; ``day=None`` replays every landed day at
once (each CDC row handled by the load of its own landing day), which is what the
registered queries run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ORDER_CANCELLED, REFUND_DONE
from ..functions.scalar import add_days, local_time_s
from ..operators.cdc import cdc_rows, decode, old_value


def _day(df: DataFrame, day: str | None) -> DataFrame:
    return df if day is None else df.where(F.col("dt") == day)


# J-08
def cart_add(cart_inc: DataFrame, dic: DataFrame, day: str | None = None) -> DataFrame:
    """Inserts, plus updates that raised the quantity (quantity = the increase)."""
    old_num = old_value("sku_num", "bigint")
    x = _day(cart_inc, day).where(
        (F.col("type") == "insert")
        | ((F.col("type") == "update") & old_num.isNotNull() & (F.col("data.sku_num") > old_num)))
    x = x.select(F.col("data.id").alias("id"), F.col("data.user_id").alias("user_id"),
                 F.col("data.sku_id").alias("sku_id"), local_time_s("ts", "yyyy-MM-dd").alias("date_id"),
                 local_time_s("ts").alias("create_time"), F.col("data.source_id").alias("source_id"),
                 F.col("data.source_type").alias("source_type_code"),
                 F.when(F.col("type") == "insert", F.col("data.sku_num"))
                  .otherwise(F.col("data.sku_num") - old_num).alias("sku_num"), "dt")
    x = decode(x, "source_type_code", dic, "24", "source_type_name")
    return x.select("id", "user_id", "sku_id", "date_id", "create_time", "source_id", "source_type_code",
                    "source_type_name", "sku_num", "dt")


# J-09
def order_detail(detail: DataFrame, dic: DataFrame) -> DataFrame:
    """Order lines with the source type decoded (lines already carry activity/coupon)."""
    x = decode(detail, "source_type", dic, "24", "source_type_name")
    return x.select("order_id", "user_id", "sku_id", "province_id", "activity_id", "activity_rule_id", "coupon_id",
                    F.substring("create_time", 1, 10).alias("date_id"), "create_time", "source_id",
                    F.col("source_type").alias("source_type_code"), "source_type_name", "sku_num",
                    "split_original_amount", "split_activity_amount", "split_coupon_amount", "split_total_amount",
                    "dt")


# J-10
def cancel_detail(detail: DataFrame, order_inc: DataFrame, dic: DataFrame, day: str | None = None) -> DataFrame:
    """Lines of orders whose status changed to cancelled on the landing day; the lines
    were created that day or the day before (S-09)."""
    oi = cdc_rows(_day(order_inc, day), kinds=("update",), changed="order_status") \
        .where(F.col("data.order_status") == ORDER_CANCELLED) \
        .select(F.col("data.id").alias("_oid"), F.col("data.operate_time").alias("cancel_time"),
                F.col("dt").alias("_cdt"))
    od = detail if day is None else detail.where(F.col("dt").isin(day, add_days(day, -1)))
    j = od.join(oi, (od.order_id == oi._oid)
                & ((od.dt == oi._cdt) | (od.dt == F.date_format(F.date_sub(oi._cdt.cast("date"), 1), "yyyy-MM-dd"))))
    j = decode(j, "source_type", dic, "24", "source_type_name")
    return j.select("order_id", "user_id", "sku_id", "province_id", "activity_id", "activity_rule_id", "coupon_id",
                    F.substring("cancel_time", 1, 10).alias("date_id"), "cancel_time", "source_id",
                    F.col("source_type").alias("source_type_code"), "source_type_name", "sku_num",
                    "split_original_amount", "split_activity_amount", "split_coupon_amount", "split_total_amount",
                    F.col("_cdt").alias("dt"))


# J-11
def pay_detail(detail: DataFrame, payment: DataFrame, dic: DataFrame) -> DataFrame:
    """Lines of paid orders (inner join to successful payments), payment type and
    source type decoded; partitioned by payment day."""
    p = payment.select(F.col("order_id").alias("_oid"), "payment_type", "callback_time", F.col("dt").alias("_pdt"))
    j = detail.join(p, detail.order_id == p._oid)
    j = decode(j, "payment_type", dic, "11", "payment_type_name")
    j = decode(j, "source_type", dic, "24", "source_type_name")
    return j.select("order_id", "user_id", "sku_id", "province_id", "activity_id", "activity_rule_id", "coupon_id",
                    F.col("payment_type").alias("payment_type_code"), "payment_type_name",
                    F.substring("callback_time", 1, 10).alias("date_id"), "callback_time", "source_id",
                    F.col("source_type").alias("source_type_code"), "source_type_name", "sku_num",
                    "split_original_amount", "split_activity_amount", "split_coupon_amount",
                    F.col("split_total_amount").alias("split_payment_amount"), F.col("_pdt").alias("dt"))


# J-12
def order_refund(refund: DataFrame, dic: DataFrame) -> DataFrame:
    x = decode(refund, "refund_type", dic, "15", "refund_type_name")
    x = decode(x, "refund_reason_type", dic, "13", "refund_reason_type_name")
    return x.select("user_id", "order_id", "sku_id", "province_id", F.substring("create_time", 1, 10).alias("date_id"),
                    "create_time", F.col("refund_type").alias("refund_type_code"), "refund_type_name",
                    F.col("refund_reason_type").alias("refund_reason_type_code"), "refund_reason_type_name",
                    F.col("refund_reason_type_name").alias("refund_reason_txt"), "refund_num", "refund_amount", "dt")


# J-13
def refund_paid(refund: DataFrame, dic: DataFrame) -> DataFrame:
    """Completed refund payments; quantity from the refund request on (order, sku)."""
    pay = refund.where(F.col("refund_status") == REFUND_DONE).select(
        "order_id", "sku_id", "user_id", "province_id", "payment_type", F.col("create_time").alias("callback_time"),
        F.col("refund_amount").alias("refund_amount"), "dt")
    req = refund.select(F.col("order_id").alias("_o"), F.col("sku_id").alias("_s"), "refund_num")
    j = pay.join(req, (pay.order_id == req._o) & (pay.sku_id == req._s), "left")
    j = decode(j, "payment_type", dic, "11", "payment_type_name")
    return j.select("user_id", "order_id", "sku_id", "province_id", F.col("payment_type").alias("payment_type_code"),
                    "payment_type_name", F.substring("callback_time", 1, 10).alias("date_id"), "callback_time",
                    "refund_num", "refund_amount", "dt")


# J-14
def cart_full(cart_snapshot: DataFrame) -> DataFrame:
    return (cart_snapshot.where(F.col("is_ordered") == "0")
            .select("id", "user_id", "sku_id", F.concat(F.lit("sku "), F.col("sku_id").cast("string")).alias("sku_name"),
                    "sku_num", "dt"))


# J-15
def coupon_get(coupon_inc: DataFrame, day: str | None = None) -> DataFrame:
    x = cdc_rows(_day(coupon_inc, day), kinds=("insert",))
    return x.select(F.col("data.id").alias("id"), F.col("data.coupon_id").alias("coupon_id"),
                    F.col("data.user_id").alias("user_id"), F.substring("data.get_time", 1, 10).alias("date_id"),
                    F.col("data.get_time").alias("get_time"), "dt")


# J-16
def coupon_order(coupon_inc: DataFrame, day: str | None = None) -> DataFrame:
    x = cdc_rows(_day(coupon_inc, day), kinds=("update",), changed="using_time")
    return x.select(F.col("data.id").alias("id"), F.col("data.coupon_id").alias("coupon_id"),
                    F.col("data.user_id").alias("user_id"), F.col("data.order_id").alias("order_id"),
                    F.substring("data.using_time", 1, 10).alias("date_id"),
                    F.col("data.using_time").alias("order_time"), "dt")


# J-17
def coupon_pay(coupon_inc: DataFrame, day: str | None = None) -> DataFrame:
    x = cdc_rows(_day(coupon_inc, day), kinds=("update",), changed="used_time")
    return x.select(F.col("data.id").alias("id"), F.col("data.coupon_id").alias("coupon_id"),
                    F.col("data.user_id").alias("user_id"), F.col("data.order_id").alias("order_id"),
                    F.substring("data.used_time", 1, 10).alias("date_id"),
                    F.col("data.used_time").alias("payment_time"), "dt")


# J-18
def favor_add(favor_inc: DataFrame, day: str | None = None) -> DataFrame:
    x = cdc_rows(_day(favor_inc, day), kinds=("insert",))
    return x.select(F.col("data.id").alias("id"), F.col("data.user_id").alias("user_id"),
                    F.col("data.sku_id").alias("sku_id"), F.substring("data.create_time", 1, 10).alias("date_id"),
                    F.col("data.create_time").alias("create_time"), "dt")


# J-19
def comment(comment_inc: DataFrame, dic: DataFrame, day: str | None = None) -> DataFrame:
    x = cdc_rows(_day(comment_inc, day), kinds=("insert",)).select(
        F.col("data.id").alias("id"), F.col("data.user_id").alias("user_id"), F.col("data.sku_id").alias("sku_id"),
        F.col("data.order_id").alias("order_id"), F.substring("data.create_time", 1, 10).alias("date_id"),
        F.col("data.create_time").alias("create_time"), F.col("data.appraise").alias("appraise_code"), "dt")
    x = decode(x, "appraise_code", dic, "12", "appraise_name")
    return x.select("id", "user_id", "sku_id", "order_id", "date_id", "create_time", "appraise_code", "appraise_name",
                    "dt")
