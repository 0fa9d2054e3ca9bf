"""Driver tables -> the warehouse's landed (ODS-shaped) frames.

The reference reads CDC JSON, app logs and daily snapshots that are not shipped; the
rules below derive equivalent frames deterministically from the driver tables
(FIXTURES.md §3).  Every frame is a lazy DataFrame over whole driver tables; optional
``lo``/``hi`` day bounds are applied to the raw timestamp columns so they reach the
parquet scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ORDER_CANCELLED, ORDER_PAID, ORDER_UNPAID, PAYMENT_PAID, REFUND_DONE
from ..functions.scalar import add_days, day_of, epoch_ms, money, nvl0
from .driver import Driver

# Anchor days: the last order day, and the last day of the event stream.
TRADE_DAY = "2001-08-01"
TRAFFIC_DAY = "2024-01-30"


def _ts(day: str):
    return F.lit(day).cast("timestamp_ntz")


def _between(df: DataFrame, c: str, lo: str | None, hi: str | None) -> DataFrame:
    if lo is not None:
        df = df.where(F.col(c) >= _ts(lo))
    if hi is not None:
        df = df.where(F.col(c) < _ts(add_days(hi, 1)))
    return df


def _orders(drv: Driver, lo=None, hi=None) -> DataFrame:
    o = drv.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                          "o_orderpriority")
    return _between(o, "o_orderdate", lo, hi)


def _customer(drv: Driver) -> DataFrame:
    return drv.customer.select("c_custkey", "c_nationkey")


# ---------------------------------------------------------------- trade domain
def order_detail(drv: Driver, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Order lines (dwd order detail shape): lineitem ⋈ orders ⋈ customer."""
    li = drv.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                             "l_extendedprice", "l_discount", "l_tax")
    o = _orders(drv, lo, hi).select("o_orderkey", "o_custkey", "o_orderdate")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(_customer(drv), F.col("o_custkey") == F.col("c_custkey"))
         .withColumn("_ct", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    orig = money("l_extendedprice")
    act = F.when(F.col("l_discount") > 0, (orig * money("l_discount")).cast("decimal(16,2)"))
    cpn = F.when(F.col("l_tax") > 0, (orig * money("l_tax")).cast("decimal(16,2)"))
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("sku_id"),
        F.col("c_nationkey").alias("province_id"),
        F.when(F.col("l_discount") > 0, F.col("l_suppkey") % 7).alias("activity_id"),
        F.when(F.col("l_discount") > 0, F.col("l_suppkey") % 7 * 10 + F.col("l_linenumber") % 3)
         .alias("activity_rule_id"),
        F.when(F.col("l_tax") > 0, F.col("l_suppkey") % 10).alias("coupon_id"),
        F.concat(F.lit("240"), (F.col("l_linenumber") % 4 + 1).cast("string")).alias("source_type"),
        F.col("l_suppkey").alias("source_id"),
        F.col("l_quantity").cast("bigint").alias("sku_num"),
        orig.alias("split_original_amount"),
        act.alias("split_activity_amount"),
        cpn.alias("split_coupon_amount"),
        (orig - nvl0(act) - nvl0(cpn)).cast("decimal(16,2)").alias("split_total_amount"),
        F.col("_ct").alias("create_time"),
        F.substring("_ct", 1, 10).alias("dt"),
    )


def order_info(drv: Driver, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Order headers: orders ⋈ customer; status F paid, P cancelled, O unpaid."""
    o = _orders(drv, lo, hi)
    j = o.join(_customer(drv), F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("c_nationkey").alias("province_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit(ORDER_PAID))
         .when(F.col("o_orderstatus") == "P", F.lit(ORDER_CANCELLED))
         .otherwise(F.lit(ORDER_UNPAID)).alias("order_status"),
        F.concat(F.lit("110"), F.substring("o_orderpriority", 1, 1)).alias("payment_type"),
        money("o_totalprice").alias("total_amount"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("create_time"),
        day_of("o_orderdate").alias("dt"),
    )


def payment_info(drv: Driver, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Successful payments: one per paid (status F) order, on the order day."""
    h = order_info(drv, lo, hi).where(F.col("order_status") == ORDER_PAID)
    return h.select(
        F.col("order_id").alias("id"), "order_id", "user_id", "province_id", "payment_type",
        "total_amount", F.lit(PAYMENT_PAID).alias("payment_status"),
        F.col("create_time").alias("callback_time"), "dt")


def refund_info(drv: Driver, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Refund requests: returned lines (l_returnflag='R') on their ship day."""
    li = drv.lineitem.where(F.col("l_returnflag") == "R").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate")
    li = _between(li, "l_shipdate", lo, hi)
    o = drv.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    j = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(_customer(drv), F.col("o_custkey") == F.col("c_custkey")))
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("sku_id"),
        F.col("c_nationkey").alias("province_id"),
        F.concat(F.lit("150"), (F.col("l_linenumber") % 2 + 1).cast("string")).alias("refund_type"),
        F.col("l_quantity").cast("bigint").alias("refund_num"),
        money("l_extendedprice").alias("refund_amount"),
        F.concat(F.lit("130"), (F.col("l_linenumber") % 7 + 1).cast("string")).alias("refund_reason_type"),
        F.when(F.col("l_linestatus") == "F", F.lit(REFUND_DONE)).otherwise(F.lit("0701")).alias("refund_status"),
        F.concat(F.lit("110"), F.substring("o_orderpriority", 1, 1)).alias("payment_type"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("create_time"),
        day_of("l_shipdate").alias("dt"),
    )


def sku(drv: Driver) -> DataFrame:
    """Product dimension slice: brand = p_brand, category path = (type, size, name)."""
    p = drv.part
    c2 = F.concat_ws("/", "p_type", F.col("p_size").cast("string"))
    c3 = F.concat_ws("/", "p_type", F.col("p_size").cast("string"), "p_name")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("sku_name"),
        money("p_retailprice").alias("price"),
        F.col("p_brand").alias("tm_id"), F.col("p_brand").alias("tm_name"),
        F.col("p_type").alias("category1_id"), F.col("p_type").alias("category1_name"),
        c2.alias("category2_id"), c2.alias("category2_name"),
        c3.alias("category3_id"), c3.alias("category3_name"),
    )


# ---------------------------------------------------------------- users
def users(drv: Driver) -> DataFrame:
    """User rows from customer; registration day spread over the event month."""
    c = drv.customer.select("c_custkey", "c_name", "c_nationkey")
    created = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int"))
    return c.select(
        F.col("c_custkey").alias("id"),
        F.lower(F.regexp_replace("c_name", "#", "_")).alias("login_name"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("138"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone_num"),
        F.concat(F.col("c_custkey").cast("string"), F.lit("@mail.test")).alias("email"),
        (F.col("c_nationkey") % 5 + 1).cast("string").alias("user_level"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
        F.concat(F.date_format(created, "yyyy-MM-dd"), F.lit(" 08:00:00")).alias("create_time"),
        F.col("c_nationkey").alias("province_id"),
    )


# ---------------------------------------------------------------- app log
def page_log(drv: Driver, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """App log rows from events (FIXTURES §3.3): device = user, page = event type,
    a ``signup`` row starts a session (no ``last_page_id``); uid missing on every
    fourth event; clicks carry actions, views carry displays, signups an app start,
    errors an error struct."""
    e = _between(drv.events, "ts", lo, hi)
    k = F.get_json_object("props", "$.k").try_cast("int")
    ms = epoch_ms("ts")
    et = F.col("event_type")
    common = F.struct(
        F.lpad((F.col("user_id") % 25).cast("string"), 6, "0").alias("ar"),
        F.concat(F.lit("brand"), (F.col("user_id") % 3).cast("string")).alias("ba"),
        F.concat(F.lit("ch"), (F.col("user_id") % 5).cast("string")).alias("ch"),
        F.when(F.col("user_id") % 3 == 0, F.lit("1")).otherwise(F.lit("0")).alias("is_new"),
        F.concat(F.lit("model"), (F.col("user_id") % 4).cast("string")).alias("md"),
        F.col("user_id").cast("string").alias("mid"),
        F.concat(F.lit("os"), (F.col("user_id") % 2).cast("string")).alias("os"),
        F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string")).alias("uid"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("vc"),
    )
    page = F.struct(
        F.floor(F.col("value") * 1000).cast("bigint").alias("during_time"),
        (F.col("event_id") % 200).cast("string").alias("item"),
        F.lit("sku_id").alias("item_type"),
        F.when(et != "signup", F.lit("home")).alias("last_page_id"),
        et.alias("page_id"),
        F.lit("2401").alias("source_type"),
    )
    actions = F.when(et == "click", F.transform(
        F.sequence(F.lit(1), F.lit(1) + k % 3),
        lambda x: F.struct(F.concat(F.lit("act"), x.cast("string")).alias("action_id"),
                           (F.col("event_id") % 200).cast("string").alias("item"),
                           F.lit("sku_id").alias("item_type"),
                           (ms + x).cast("bigint").alias("ts"))))
    displays = F.when(et == "view", F.transform(
        F.sequence(F.lit(1), F.lit(1) + k % 2),
        lambda x: F.struct(F.lit("promotion").alias("display_type"),
                           ((F.col("event_id") + x) % 200).cast("string").alias("item"),
                           F.lit("sku_id").alias("item_type"),
                           x.cast("string").alias("order"),
                           (k % 5).cast("string").alias("pos_id"))))
    start = F.when(et == "signup", F.struct(
        F.lit("icon").alias("entry"), k.cast("bigint").alias("loading_time"),
        (k % 7).cast("bigint").alias("open_ad_id"), (k * 10).cast("bigint").alias("open_ad_ms"),
        (k * 5).cast("bigint").alias("open_ad_skip_ms")))
    err = F.when(et == "error", F.struct(k.cast("bigint").alias("error_code"),
                                         F.concat(F.lit("error "), k.cast("string")).alias("msg")))
    return e.select(common.alias("common"), page.alias("page"), actions.alias("actions"),
                    displays.alias("displays"), start.alias("start"), err.alias("err"),
                    ms.alias("ts"), "event_id", day_of("ts").alias("dt"))


def cart_snapshot(drv: Driver, day: str) -> DataFrame:
    """Cart contents on ``day``: every click up to that day is a cart row."""
    e = _between(drv.events.where(F.col("event_type") == "click"), "ts", None, day)
    k = F.get_json_object("props", "$.k").try_cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        (F.col("event_id") % 200).alias("sku_id"),
        (F.floor("value") + 1).cast("bigint").alias("sku_num"),
        F.when(k % 3 == 0, F.lit("1")).otherwise(F.lit("0")).alias("is_ordered"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("create_time"),
        F.lit(day).alias("dt"),
    )


def province(drv: Driver) -> DataFrame:
    """Province dimension (J-04 shape): nation ⋈ region."""
    n = drv.nation
    r = drv.region
    j = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("province_name"),
        F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"),
        F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("area_code"),
        F.concat(F.lit("CN-"), F.col("n_nationkey").cast("string")).alias("iso_code"),
        F.concat(F.lit("CN-"), F.upper(F.substring("n_name", 1, 2))).alias("iso_3166_2"),
    )


# ---------------------------------------------------------------- CDC streams
def user_inc(drv: Driver, day: str = TRAFFIC_DAY) -> DataFrame:
    """User CDC envelope (type, ts, data, old, dt).  Users created before ``day``
    land as ``bootstrap-insert`` on ``day-1``; users created on ``day`` as ``insert``;
    every fifth user (id % 5 = 1) gets two ``update`` rows on ``day`` raising
    ``user_level`` (ts 1 then 2), so newest-per-key matters."""
    u = users(drv)
    cday = F.substring("create_time", 1, 10)
    birthday = F.date_format(F.date_add(F.lit("1980-01-01").cast("date"), (F.col("id") % 7300).cast("int")),
                             "yyyy-MM-dd")

    def data(level, op_time):
        return F.struct(F.col("id").alias("id"), F.col("login_name").alias("login_name"),
                        F.col("name").alias("nick_name"), F.col("name").alias("name"),
                        F.col("phone_num").alias("phone_num"), F.col("email").alias("email"),
                        level.alias("user_level"), birthday.alias("birthday"), F.col("gender").alias("gender"),
                        F.col("create_time").alias("create_time"), op_time.alias("operate_time"))

    no_map = F.lit(None).cast("map<string,string>")
    no_time = F.lit(None).cast("string")
    boot = u.where(cday < day).select(
        F.lit("bootstrap-insert").alias("type"), F.unix_timestamp("create_time").alias("ts"),
        data(F.col("user_level"), no_time).alias("data"), no_map.alias("old"), F.lit(add_days(day, -1)).alias("dt"))
    ins = u.where(cday == day).select(
        F.lit("insert").alias("type"), F.unix_timestamp("create_time").alias("ts"),
        data(F.col("user_level"), no_time).alias("data"), no_map.alias("old"), F.lit(day).alias("dt"))
    v = F.col("_v")
    upd = (u.where(F.col("id") % 5 == 1).withColumn("_v", F.explode(F.array(F.lit(1), F.lit(2))))
           .select(F.lit("update").alias("type"),
                   (F.unix_timestamp(F.lit(day + " 10:00:00")) + v).alias("ts"),
                   data((v + 1).cast("string"),
                        F.concat(F.lit(day + " 10:00:0"), v.cast("string"))).alias("data"),
                   F.create_map(F.lit("user_level"), v.cast("string")).alias("old"),
                   F.lit(day).alias("dt")))
    return boot.unionByName(ins).unionByName(upd)


def _epoch_s(ts):
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000)).cast("bigint")


def cart_inc(drv: Driver) -> DataFrame:
    """Cart CDC from clicks: each click inserts a cart row on its day; by ``k % 4`` a
    second row raises the quantity (kept as a delta), lowers it (dropped), or
    changes another column (dropped)."""
    e = drv.events.where(F.col("event_type") == "click")
    k = F.get_json_object("props", "$.k").try_cast("int")
    x = e.select("event_id", "user_id", "value", "ts", k.alias("k"), _epoch_s("ts").alias("ts_s"),
                 day_of("ts").alias("dt"))
    num = (F.floor("value") + 1).cast("bigint")

    def data(n):
        return F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user_id"),
                        (F.col("event_id") % 200).alias("sku_id"), n.alias("sku_num"),
                        (F.col("event_id") % 50).alias("source_id"),
                        F.concat(F.lit("240"), (F.col("event_id") % 4 + 1).cast("string")).alias("source_type"))

    no_map = F.lit(None).cast("map<string,string>")
    ins = x.select(F.lit("insert").alias("type"), F.col("ts_s").alias("ts"), data(num).alias("data"),
                   no_map.alias("old"), "dt")
    m = F.col("k") % 4
    upd = x.where(m != 0).select(
        F.lit("update").alias("type"), (F.col("ts_s") + 60).alias("ts"),
        data(F.when(m == 1, num + 2).otherwise(num)).alias("data"),
        F.when(m == 1, F.create_map(F.lit("sku_num"), num.cast("string")))
         .when(m == 2, F.create_map(F.lit("sku_num"), (num + 1).cast("string")))
         .otherwise(F.create_map(F.lit("is_checked"), F.lit("0"))).alias("old"),
        "dt")
    return ins.unionByName(upd)


def order_inc(drv: Driver) -> DataFrame:
    """Order-header CDC: an insert per order on its day; cancelled (P) orders get an
    ``order_status`` update on the order day or the next (by key parity); every third
    cancelled order also gets a later edit whose ``old`` lacks ``order_status``."""
    o = drv.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    j = o.join(_customer(drv), F.col("o_custkey") == F.col("c_custkey"))
    day = F.to_date("o_orderdate")

    def data(status, op_time):
        return F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                        F.col("c_nationkey").alias("province_id"), F.lit(status).alias("order_status"),
                        op_time.alias("operate_time"))

    ins = j.select(F.lit("insert").alias("type"), _epoch_s("o_orderdate").alias("ts"),
                   data(ORDER_UNPAID, F.lit(None).cast("string")).alias("data"),
                   F.lit(None).cast("map<string,string>").alias("old"), day_of("o_orderdate").alias("dt"))
    p = j.where(F.col("o_orderstatus") == "P")
    cday = F.date_add(day, (F.col("o_orderkey") % 2).cast("int"))
    cancel = p.select(F.lit("update").alias("type"), F.unix_timestamp(cday.cast("timestamp")).alias("ts"),
                      data(ORDER_CANCELLED, F.concat(F.date_format(cday, "yyyy-MM-dd"), F.lit(" 12:00:00")))
                      .alias("data"),
                      F.create_map(F.lit("order_status"), F.lit(ORDER_UNPAID)).alias("old"),
                      F.date_format(cday, "yyyy-MM-dd").alias("dt"))
    eday = F.date_add(cday, 1)
    edit = p.where(F.col("o_orderkey") % 3 == 0).select(
        F.lit("update").alias("type"), F.unix_timestamp(eday.cast("timestamp")).alias("ts"),
        data(ORDER_CANCELLED, F.concat(F.date_format(eday, "yyyy-MM-dd"), F.lit(" 09:00:00"))).alias("data"),
        F.create_map(F.lit("order_comment"), F.lit("")).alias("old"), F.date_format(eday, "yyyy-MM-dd").alias("dt"))
    return ins.unionByName(cancel).unionByName(edit)


def coupon_uses(drv: Driver) -> DataFrame:
    """A row for each order and coupon that lines of it carry: ``order_id, coupon_id, user_id, paid, o_orderdate``.

    An order's coupons (the remainders -9..9, and NULL) are summed up as bits before the join, and an order repeated
    in the input counts once, so that a task holds a row of fixed width an order and not one a line."""
    bit = F.coalesce(F.col("l_suppkey") % 10 + 9, F.lit(19)).cast("int")
    li = (drv.lineitem.where(F.col("l_tax") > 0)
          .groupBy("l_orderkey").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_coupons")))
    o = (drv.orders.select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("paid"), "o_orderdate")
         .dropDuplicates(["o_orderkey"]))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(19)), lambda i: F.getbit("_coupons", i) == 1)
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .select("l_orderkey", "o_custkey", "paid", "o_orderdate", F.explode(set_bits).alias("_bit"))
            .select(F.col("l_orderkey").alias("order_id"), F.when(F.col("_bit") < 19, F.col("_bit") - 9).cast("bigint").alias("coupon_id"),
                    F.col("o_custkey").alias("user_id"), "paid", "o_orderdate"))


def coupon_use_times() -> tuple[Column, Column, Column]:
    """The day a coupon of ``coupon_uses`` was received (the day before the order), and the times of that and of its use."""
    get_day = F.date_add(F.to_date("o_orderdate"), -1)
    return (get_day, F.concat(F.date_format(get_day, "yyyy-MM-dd"), F.lit(" 10:00:00")),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def coupon_use_data(get_time: Column, using: Column, used: Column) -> Column:
    return F.struct((F.col("order_id") * 10 + F.col("coupon_id")).alias("id"), F.col("coupon_id").alias("coupon_id"),
                    F.col("user_id").alias("user_id"), F.col("order_id").alias("order_id"),
                    get_time.alias("get_time"), using.alias("using_time"), used.alias("used_time"))


def coupon_use_inc(drv: Driver) -> DataFrame:
    """Coupon-use CDC from order lines carrying a coupon: received the day before the
    order (insert), used at order (update naming ``using_time``), used at payment for
    paid orders (update naming ``used_time``)."""
    u = coupon_uses(drv)
    get_day, t_get, t_use = coupon_use_times()
    null_s = F.lit(None).cast("string")
    ins = u.select(F.lit("insert").alias("type"), F.unix_timestamp(get_day.cast("timestamp")).alias("ts"),
                   coupon_use_data(t_get, null_s, null_s).alias("data"), F.lit(None).cast("map<string,string>").alias("old"),
                   F.date_format(get_day, "yyyy-MM-dd").alias("dt"))
    using = u.select(F.lit("update").alias("type"), _epoch_s("o_orderdate").alias("ts"),
                     coupon_use_data(t_get, t_use, null_s).alias("data"),
                     F.create_map(F.lit("using_time"), null_s, F.lit("coupon_status"), F.lit("1401")).alias("old"),
                     day_of("o_orderdate").alias("dt"))
    used = u.where("paid").select(
        F.lit("update").alias("type"), (_epoch_s("o_orderdate") + 1).alias("ts"),
        coupon_use_data(t_get, t_use, t_use).alias("data"),
        F.create_map(F.lit("used_time"), null_s, F.lit("coupon_status"), F.lit("1402")).alias("old"),
        day_of("o_orderdate").alias("dt"))
    return ins.unionByName(using).unionByName(used)


def interaction_inc(drv: Driver, kind: str) -> DataFrame:
    """Favourites (every tenth view, by ``k``) or comments (purchases) as insert rows."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    if kind == "favor":
        e = drv.events.where((F.col("event_type") == "view") & (k % 10 == 0))
        extra = [F.lit("0").alias("is_cancel")]
    else:
        e = drv.events.where(F.col("event_type") == "purchase")
        extra = [F.col("event_id").alias("order_id"),
                 F.concat(F.lit("120"), (k % 4 + 1).cast("string")).alias("appraise")]
    data = F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user_id"),
                    (F.col("event_id") % 200).alias("sku_id"), *extra,
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("create_time"))
    return e.select(F.lit("insert").alias("type"), _epoch_s("ts").alias("ts"), data.alias("data"),
                    F.lit(None).cast("map<string,string>").alias("old"), day_of("ts").alias("dt"))
