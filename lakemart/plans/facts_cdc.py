"""Trade fact loads from the separate CDC streams, as first and as daily loads.

A first load reads the ``bootstrap-insert`` rows of the day the history landed and spreads
them over the days on which things happened; a daily load reads what landed on day D (lines,
headers, activities and coupons of a payment: on D or the day before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ORDER_CANCELLED, ORDER_REFUND_ASKED, ORDER_REFUND_DONE, PAYMENT_PAID, REFUND_DONE
from ..functions.scalar import MONEY
from ..operators.cdc import cdc_rows, decode, two_days

BOOTSTRAP = ("bootstrap-insert",)
INSERTED = ("insert", "bootstrap-insert")


def _fields(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    return df.select(*[F.col(f"data.{n}").alias(n) for n in names], *[F.col(f"data.{c}").alias(n) for n, c in renamed.items()])


def _day_of(c: str) -> Column:
    return F.substring(c, 1, 10)


def _lines(detail: DataFrame) -> DataFrame:
    """Line columns with ``sku_num * order_price`` as the original amount."""
    x = _fields(detail, "id", "order_id", "sku_id", "source_id", "source_type", "sku_num", "order_price", "split_total_amount",
                "split_activity_amount", "split_coupon_amount", "create_time")
    return x.withColumn("split_original_amount", (F.col("sku_num") * F.col("order_price")).try_cast(MONEY)).drop("order_price")


def _with_activity_coupon(lines: DataFrame, activity: DataFrame, coupon: DataFrame) -> DataFrame:
    a = _fields(activity, "activity_id", "activity_rule_id", _aid="order_detail_id")
    c = _fields(coupon, "coupon_id", _cid="order_detail_id")
    return lines.join(a, lines.id == a._aid, "left").join(c, lines.id == c._cid, "left")


# J-09
def order_detail(detail: DataFrame, header: DataFrame, activity: DataFrame, coupon: DataFrame, dic: DataFrame, day: str,
                 first: bool = False) -> DataFrame:
    """Order lines with header, activity and coupon (left joins: a line keeps its row without them)."""
    kinds = BOOTSTRAP if first else ("insert",)
    landed = [cdc_rows(s, day, kinds) for s in (detail, header, activity, coupon)]
    x = _with_activity_coupon(_lines(landed[0]), landed[2], landed[3])
    h = _fields(landed[1], "user_id", "province_id", _oid="id")
    x = decode(x.join(h, x.order_id == h._oid, "left"), "source_type", dic, "24", "source_type_name")
    return x.select("id", "order_id", "user_id", "sku_id", "province_id", "activity_id", "activity_rule_id", "coupon_id",
                    _day_of("create_time").alias("date_id"), "create_time", "source_id", F.col("source_type").alias("source_type_code"),
                    "source_type_name", "sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount",
                    "split_total_amount", (_day_of("create_time") if first else F.lit(day)).alias("dt"))


# J-10 first load
def cancel_detail_first(detail: DataFrame, header: DataFrame, activity: DataFrame, coupon: DataFrame, dic: DataFrame, day: str) -> DataFrame:
    """Lines of the orders that had been cancelled when the history landed."""
    landed = [cdc_rows(s, day, BOOTSTRAP) for s in (detail, header, activity, coupon)]
    h = _fields(landed[1].where(F.col("data.order_status") == ORDER_CANCELLED), "user_id", "province_id", _oid="id", cancel_time="operate_time")
    x = _lines(landed[0])
    x = _with_activity_coupon(x.join(h, x.order_id == h._oid), landed[2], landed[3])
    x = decode(x, "source_type", dic, "24", "source_type_name")
    return x.select("id", "order_id", "user_id", "sku_id", "province_id", "activity_id", "activity_rule_id", "coupon_id",
                    _day_of("cancel_time").alias("date_id"), "cancel_time", "source_id", F.col("source_type").alias("source_type_code"),
                    "source_type_name", "sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount",
                    "split_total_amount", _day_of("cancel_time").alias("dt"))


# J-11
def payment_success(detail: DataFrame, header: DataFrame, activity: DataFrame, coupon: DataFrame, payment: DataFrame, dic: DataFrame,
                    day: str, first: bool = False) -> DataFrame:
    """Lines of the orders whose payment turned successful on D (first load: was so)."""
    if first:
        paid = cdc_rows(payment, day, BOOTSTRAP)
        landed = [cdc_rows(s, day, BOOTSTRAP) for s in (detail, header, activity, coupon)]
    else:
        paid = cdc_rows(payment, day, ("update",), changed="payment_status")
        landed = [cdc_rows(s, two_days(day), INSERTED) for s in (detail, header, activity, coupon)]
    p = _fields(paid.where(F.col("data.payment_status") == PAYMENT_PAID), "user_id", "payment_type", "callback_time", _poid="order_id")
    x = _lines(landed[0])
    h = _fields(landed[1], "province_id", _oid="id")
    x = _with_activity_coupon(x.join(p, x.order_id == p._poid), landed[2], landed[3])
    x = x.join(h, x.order_id == h._oid, "left")
    x = decode(decode(x, "payment_type", dic, "11", "payment_type_name"), "source_type", dic, "24", "source_type_name")
    return x.select("id", "order_id", "user_id", "sku_id", "province_id", "activity_id", "activity_rule_id", "coupon_id",
                    F.col("payment_type").alias("payment_type_code"), "payment_type_name", _day_of("callback_time").alias("date_id"),
                    "callback_time", "source_id", F.col("source_type").alias("source_type_code"), "source_type_name", "sku_num",
                    "split_original_amount", "split_activity_amount", "split_coupon_amount",
                    F.col("split_total_amount").alias("split_payment_amount"), (_day_of("callback_time") if first else F.lit(day)).alias("dt"))


# J-12
def order_refund(refund: DataFrame, header: DataFrame, dic: DataFrame, day: str, first: bool = False) -> DataFrame:
    """Refund requests with the province of the header whose status changed with them."""
    r = cdc_rows(refund, day, BOOTSTRAP if first else ("insert",))
    h = cdc_rows(header, day, BOOTSTRAP) if first else \
        cdc_rows(header, day, ("update",), changed="order_status").where(F.col("data.order_status") == ORDER_REFUND_ASKED)
    x = _fields(r, "id", "user_id", "order_id", "sku_id", "refund_type", "refund_num", "refund_amount", "refund_reason_type",
                "refund_reason_txt", "create_time")
    h = _fields(h, "province_id", _oid="id")
    x = x.join(h, x.order_id == h._oid, "left")
    x = decode(decode(x, "refund_type", dic, "15", "refund_type_name"), "refund_reason_type", dic, "13", "refund_reason_type_name")
    return x.select("id", "user_id", "order_id", "sku_id", "province_id", _day_of("create_time").alias("date_id"), "create_time",
                    F.col("refund_type").alias("refund_type_code"), "refund_type_name",
                    F.col("refund_reason_type").alias("refund_reason_type_code"), "refund_reason_type_name", "refund_reason_txt",
                    "refund_num", "refund_amount", (_day_of("create_time") if first else F.lit(day)).alias("dt"))


# J-13
def refund_paid(payment: DataFrame, header: DataFrame, refund: DataFrame, dic: DataFrame, day: str, first: bool = False) -> DataFrame:
    """Refund payments that succeeded, with user and province of the header and the quantity
    of the request on (order, sku)."""
    if first:
        p, h, r = (cdc_rows(s, day, BOOTSTRAP) for s in (payment, header, refund))
    else:
        p = cdc_rows(payment, day, ("update",), changed="refund_status")
        h = cdc_rows(header, day, ("update",), changed="order_status").where(F.col("data.order_status") == ORDER_REFUND_DONE)
        r = cdc_rows(refund, day, ("update",), changed="refund_status").where(F.col("data.refund_status") == REFUND_DONE)
    x = _fields(p.where(F.col("data.refund_status") == PAYMENT_PAID), "id", "order_id", "sku_id", "payment_type", "callback_time", "total_amount")
    h = _fields(h, "user_id", "province_id", _oid="id")
    r = _fields(r, "refund_num", _ro="order_id", _rs="sku_id")
    x = x.join(h, x.order_id == h._oid, "left").join(r, (x.order_id == r._ro) & (x.sku_id == r._rs), "left")
    x = decode(x, "payment_type", dic, "11", "payment_type_name")
    return x.select("id", "user_id", "order_id", "sku_id", "province_id", F.col("payment_type").alias("payment_type_code"), "payment_type_name",
                    _day_of("callback_time").alias("date_id"), "callback_time", "refund_num", F.col("total_amount").alias("refund_amount"),
                    (_day_of("callback_time") if first else F.lit(day)).alias("dt"))


# J-08 first load
def cart_add_first(cart: DataFrame, dic: DataFrame, day: str) -> DataFrame:
    x = _fields(cdc_rows(cart, day, BOOTSTRAP), "id", "user_id", "sku_id", "create_time", "source_id", "source_type", "sku_num")
    x = decode(x, "source_type", dic, "24", "source_type_name")
    return x.select("id", "user_id", "sku_id", _day_of("create_time").alias("date_id"), "create_time", "source_id",
                    F.col("source_type").alias("source_type_code"), "source_type_name", "sku_num", _day_of("create_time").alias("dt"))


# J-15, J-16, J-17 first loads
def coupon_first(coupon_use: DataFrame, day: str, time: str, out: str) -> DataFrame:
    """Coupons whose ``time`` (get, using or used time) had come when the history landed."""
    x = _fields(cdc_rows(coupon_use, day, BOOTSTRAP), "id", "coupon_id", "user_id", "order_id", at=time).where(F.col("at").isNotNull())
    order = [] if time == "get_time" else ["order_id"]
    return x.select("id", "coupon_id", "user_id", *order, _day_of("at").alias("date_id"), F.col("at").alias(out), _day_of("at").alias("dt"))


# J-18 first load
def favor_add_first(favor: DataFrame, day: str) -> DataFrame:
    x = _fields(cdc_rows(favor, day, BOOTSTRAP), "id", "user_id", "sku_id", "create_time")
    return x.select("id", "user_id", "sku_id", _day_of("create_time").alias("date_id"), "create_time", _day_of("create_time").alias("dt"))


# J-19 first load
def comment_first(comment: DataFrame, dic: DataFrame, day: str) -> DataFrame:
    x = _fields(cdc_rows(comment, day, BOOTSTRAP), "id", "user_id", "sku_id", "order_id", "create_time", appraise_code="appraise")
    x = decode(x, "appraise_code", dic, "12", "appraise_name")
    return x.select("id", "user_id", "sku_id", "order_id", _day_of("create_time").alias("date_id"), "create_time", "appraise_code",
                    "appraise_name", _day_of("create_time").alias("dt"))


# J-25 first load
def user_register_first(user_inc: DataFrame, log: DataFrame, province: DataFrame, day: str, register_page: str = "signup") -> DataFrame:
    """Users of the history, with the device of a register page view of the landing day."""
    u = _fields(cdc_rows(user_inc, day, BOOTSTRAP), "create_time", user_id="id")
    g = log.where((F.col("dt") == day) & (F.col("page.page_id") == register_page) & F.col("common.uid").isNotNull()) \
        .select(F.col("common.ar").alias("area_code"), F.col("common.ba").alias("brand"), F.col("common.ch").alias("channel"),
                F.col("common.md").alias("model"), F.col("common.mid").alias("mid_id"), F.col("common.os").alias("operate_system"),
                F.col("common.uid").cast("bigint").alias("_uid"), F.col("common.vc").alias("version_code"))
    p = province.select(F.col("id").alias("province_id"), F.col("area_code").alias("_ac"))
    x = u.join(g, u.user_id == g._uid, "left").join(p, F.col("area_code") == F.col("_ac"), "left")
    return x.select("user_id", _day_of("create_time").alias("date_id"), "create_time", "channel", "province_id", "version_code", "mid_id",
                    "brand", "model", "operate_system", _day_of("create_time").alias("dt"))
