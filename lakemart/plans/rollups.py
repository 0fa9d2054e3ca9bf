"""DWS rollups J-27..J-48 (and draft variants J-64..J-68).

Sums are returned in the declared DECIMAL(16,2) with ``try_cast``: a total that no
longer fits becomes NULL (the original engine's answer) instead of failing the job
under ANSI mode — at 100 TB a 30-day total can outgrow 16 digits.

Each 1-day rollup aggregates the fact *before* joining the dimension (A-16), so the
join sees one row per group instead of one per event.  n-day rollups are one scan of
30 daily partitions with conditional sums; to-date rollups fold yesterday's state with
today's 1-day rows through one full outer join on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MONEY, add_days, nvl0
from ..operators.rollup import daily, daily_distinct, to_date_first, to_date_step, trailing

SKU_ATTRS = ["sku_name", "category1_id", "category1_name", "category2_id", "category2_name",
             "category3_id", "category3_name", "tm_id", "tm_name"]


def _with_sku(agg: DataFrame, sku: DataFrame, lead: list[str], measures: list[str]) -> DataFrame:
    s = sku.select(F.col("id").alias("_sku_id"), *SKU_ATTRS)
    j = agg.join(s, agg.sku_id == s._sku_id, "left")
    return j.select(*lead, *SKU_ATTRS, *measures, "dt")


# J-27
def user_sku_order_1d(detail: DataFrame, sku: DataFrame) -> DataFrame:
    """user × sku × day order rollup (dynamic partitions by ``dt``)."""
    m = {
        "order_count_1d": F.count(F.lit(1)),
        "order_num_1d": F.sum("sku_num"),
        "order_original_amount_1d": F.sum("split_original_amount").try_cast(MONEY),
        "activity_reduce_amount_1d": F.sum(nvl0("split_activity_amount")).try_cast(MONEY),
        "coupon_reduce_amount_1d": F.sum(nvl0("split_coupon_amount")).try_cast(MONEY),
        "order_total_amount_1d": F.sum("split_total_amount").try_cast(MONEY),
    }
    agg = daily(detail, ["dt", "user_id", "sku_id"], m)
    return _with_sku(agg, sku, ["user_id", "sku_id"], list(m))


ORDER_STEMS = ["order_count", "order_num", "order_original_amount", "activity_reduce_amount",
               "coupon_reduce_amount", "order_total_amount"]
MONEY_STEMS = {"order_original_amount", "activity_reduce_amount", "coupon_reduce_amount",
               "order_total_amount", "order_refund_amount", "payment_amount"}


def _nd(df_1d: DataFrame, keys: list[str], stems: list[str], day: str) -> DataFrame:
    casts = {s: MONEY for s in stems if s in MONEY_STEMS}
    out = trailing(df_1d, keys, {s: f"{s}_1d" for s in stems}, day, casts=casts)
    order = [f"{s}_{w}d" for w in (7, 30) for s in stems]
    return out.select(*keys, *order).withColumn("dt", F.lit(day))


# J-28
def user_sku_order_nd(od1d: DataFrame, day: str) -> DataFrame:
    return _nd(od1d, ["user_id", "sku_id", *SKU_ATTRS], ORDER_STEMS, day)


# J-29
def user_sku_refund_1d(refund: DataFrame, sku: DataFrame) -> DataFrame:
    m = {
        "order_refund_count_1d": F.count(F.lit(1)),
        "order_refund_num_1d": F.sum("refund_num"),
        "order_refund_amount_1d": F.sum("refund_amount").try_cast(MONEY),
    }
    agg = daily(refund, ["dt", "user_id", "sku_id"], m)
    return _with_sku(agg, sku, ["user_id", "sku_id"], list(m))


REFUND_STEMS = ["order_refund_count", "order_refund_num", "order_refund_amount"]


# J-30
def user_sku_refund_nd(rf1d: DataFrame, day: str) -> DataFrame:
    return _nd(rf1d, ["user_id", "sku_id", *SKU_ATTRS], REFUND_STEMS, day)


# J-31
def user_order_1d(detail: DataFrame) -> DataFrame:
    sums = {
        "order_num_1d": F.sum("sku_num"),
        "order_original_amount_1d": F.sum("split_original_amount"),
        "activity_reduce_amount_1d": F.sum(nvl0("split_activity_amount")),
        "coupon_reduce_amount_1d": F.sum(nvl0("split_coupon_amount")),
        "order_total_amount_1d": F.sum("split_total_amount"),
    }
    agg = daily_distinct(detail, ["user_id", "dt"], "order_id", "order_count_1d", sums)
    return agg.select("user_id", "order_count_1d", F.col("order_num_1d"),
                      *[F.col(c).try_cast(MONEY).alias(c) for c in list(sums)[1:]], "dt")


# J-32
def user_order_nd(uo1d: DataFrame, day: str) -> DataFrame:
    return _nd(uo1d, ["user_id"], ORDER_STEMS, day)


TD_ORDER = {"order_count_td": "order_count_1d", "order_num_td": "order_num_1d",
            "original_amount_td": "order_original_amount_1d",
            "activity_reduce_amount_td": "activity_reduce_amount_1d",
            "coupon_reduce_amount_td": "coupon_reduce_amount_1d",
            "total_amount_td": "order_total_amount_1d"}
TD_ORDER_CASTS = {k: MONEY for k in list(TD_ORDER)[2:]}


# J-33 first load
def user_order_td_first(uo1d: DataFrame, day: str) -> DataFrame:
    return (to_date_first(uo1d, "user_id", TD_ORDER, "order_date_first", "order_date_last", day,
                          casts=TD_ORDER_CASTS)
            .withColumn("dt", F.lit(day)))


# J-33 daily load
def user_order_td_step(prev_td: DataFrame, uo1d: DataFrame, day: str) -> DataFrame:
    today = uo1d.where(F.col("dt") == day)
    return (to_date_step(prev_td, today, "user_id", TD_ORDER, "order_date_first", "order_date_last", day,
                         casts=TD_ORDER_CASTS)
            .withColumn("dt", F.lit(day)))


# J-34
def user_cart_add_1d(cart_add: DataFrame) -> DataFrame:
    m = {"cart_add_count_1d": F.count(F.lit(1)), "cart_add_num_1d": F.sum("sku_num")}
    return daily(cart_add, ["user_id", "dt"], m).select("user_id", *m, "dt")


# J-35 (read by the funnel report but never created in the reference; built by analogy)
def user_cart_add_nd(ca1d: DataFrame, day: str) -> DataFrame:
    return _nd(ca1d, ["user_id"], ["cart_add_count", "cart_add_num"], day)


# J-36
def user_payment_1d(pay_detail: DataFrame) -> DataFrame:
    sums = {"payment_num_1d": F.sum("sku_num"), "payment_amount_1d": F.sum("split_payment_amount")}
    agg = daily_distinct(pay_detail, ["user_id", "dt"], "order_id", "payment_count_1d", sums)
    return agg.select("user_id", "payment_count_1d", "payment_num_1d",
                      F.col("payment_amount_1d").try_cast(MONEY).alias("payment_amount_1d"), "dt")


PAY_STEMS = ["payment_count", "payment_num", "payment_amount"]


# J-37
def user_payment_nd(up1d: DataFrame, day: str) -> DataFrame:
    return _nd(up1d, ["user_id"], PAY_STEMS, day)


TD_PAY = {"payment_count_td": "payment_count_1d", "payment_num_td": "payment_num_1d",
          "payment_amount_td": "payment_amount_1d"}


# J-38
def user_payment_td_first(up1d: DataFrame, day: str) -> DataFrame:
    return (to_date_first(up1d, "user_id", TD_PAY, "payment_date_first", "payment_date_last", day,
                          casts={"payment_amount_td": MONEY})
            .withColumn("dt", F.lit(day)))


def user_payment_td_step(prev_td: DataFrame, up1d: DataFrame, day: str) -> DataFrame:
    today = up1d.where(F.col("dt") == day)
    return (to_date_step(prev_td, today, "user_id", TD_PAY, "payment_date_first", "payment_date_last", day,
                         casts={"payment_amount_td": MONEY})
            .withColumn("dt", F.lit(day)))


# J-39
def province_order_1d(detail: DataFrame, province: DataFrame) -> DataFrame:
    sums = {
        "order_original_amount_1d": F.sum("split_original_amount"),
        "activity_reduce_amount_1d": F.sum(nvl0("split_activity_amount")),
        "coupon_reduce_amount_1d": F.sum(nvl0("split_coupon_amount")),
        "order_total_amount_1d": F.sum("split_total_amount"),
    }
    agg = daily_distinct(detail, ["province_id", "dt"], "order_id", "order_count_1d", sums)
    agg = agg.select("province_id", "dt", "order_count_1d", *[F.col(c).try_cast(MONEY).alias(c) for c in sums])
    m = ["order_count_1d", *sums]
    p = province.select(F.col("id").alias("_pid"), "province_name", "area_code", "iso_code", "iso_3166_2")
    j = agg.join(p, agg.province_id == p._pid, "left")
    return j.select("province_id", "province_name", "area_code", "iso_code", "iso_3166_2", *m, "dt")


# J-40
def province_order_nd(po1d: DataFrame, day: str) -> DataFrame:
    stems = ["order_count", "order_original_amount", "activity_reduce_amount", "coupon_reduce_amount",
             "order_total_amount"]
    return _nd(po1d, ["province_id", "province_name", "area_code", "iso_code", "iso_3166_2"], stems, day)


# J-41
def user_refund_1d(refund: DataFrame) -> DataFrame:
    m = {"order_refund_count_1d": F.count(F.lit(1)), "order_refund_num_1d": F.sum("refund_num"),
         "order_refund_amount_1d": F.sum("refund_amount").try_cast(MONEY)}
    return daily(refund, ["user_id", "dt"], m).select("user_id", *m, "dt")


# J-42
def user_refund_nd(ur1d: DataFrame, day: str) -> DataFrame:
    return _nd(ur1d, ["user_id"], REFUND_STEMS, day)


# J-43
def session_page_view_1d(page_view: DataFrame, day: str | None = None) -> DataFrame:
    """``day=None``: every day at once (grouped by ``dt`` too)."""
    keys = ["session_id", "mid_id", "brand", "model", "operate_system", "version_code", "channel"]
    src = page_view if day is None else page_view.where(F.col("dt") == day)
    return (src.groupBy(*keys, "dt")
            .agg(F.sum("during_time").cast("bigint").alias("during_time_1d"),
                 F.count(F.lit(1)).alias("page_count_1d"))
            .select(*keys, "during_time_1d", "page_count_1d", "dt"))


def registrations(user_inc: DataFrame) -> DataFrame:
    """Registration rows of every landed day (J-25 first-load shape, no device)."""
    return (user_inc.where(F.col("type").isin("bootstrap-insert", "insert"))
            .select(F.col("data.id").alias("user_id"),
                    F.substring("data.create_time", 1, 10).alias("date_id"),
                    F.substring("data.create_time", 1, 10).alias("dt")))


PV_KEYS = ["mid_id", "brand", "model", "operate_system", "page_id"]


# J-44
def page_visitor_view_1d(page_view: DataFrame) -> DataFrame:
    return (page_view.groupBy(*PV_KEYS, "dt")
            .agg(F.sum("during_time").cast("bigint").alias("during_time_1d"),
                 F.count(F.lit(1)).alias("view_count_1d"))
            .select(*PV_KEYS, "during_time_1d", "view_count_1d", "dt"))


# J-45
def page_visitor_view_nd(pv1d: DataFrame, day: str) -> DataFrame:
    out = trailing(pv1d, PV_KEYS, {"during_time": "during_time_1d", "view_count": "view_count_1d"}, day)
    return out.select(*PV_KEYS, "during_time_7d", "view_count_7d", "during_time_30d", "view_count_30d") \
              .withColumn("dt", F.lit(day))


# J-48
def user_login_td_first(users_open: DataFrame, login: DataFrame, day: str) -> DataFrame:
    u = users_open.select("id", "create_time")
    lg = (login.where(F.col("dt") <= day).groupBy("user_id")
          .agg(F.max("dt").alias("login_date_last"), F.count(F.lit(1)).alias("login_count_td")))
    j = u.join(lg, u.id == lg.user_id, "left")
    return j.select(F.col("id").alias("user_id"),
                    F.coalesce("login_date_last", F.date_format("create_time", "yyyy-MM-dd")).alias("login_date_last"),
                    F.coalesce("login_count_td", F.lit(1).cast("bigint")).alias("login_count_td"),
                    F.lit(day).alias("dt"))


def user_logins_1d(login: DataFrame, day: str) -> DataFrame:
    return login.where(F.col("dt") == day).groupBy("user_id").agg(F.count(F.lit(1)).alias("login_count_1d"))


def user_login_td_step(prev_td: DataFrame, login: DataFrame, day: str) -> DataFrame:
    return user_login_td_join(prev_td, user_logins_1d(login, day), day)


def user_login_td_join(prev_td: DataFrame, today: DataFrame, day: str) -> DataFrame:
    o, n = prev_td.alias("old"), today.alias("new")
    j = o.join(n, F.col("old.user_id") == F.col("new.user_id"), "full")
    return j.select(F.coalesce("old.user_id", "new.user_id").alias("user_id"),
                    F.when(F.col("new.user_id").isNull(), F.col("old.login_date_last"))
                     .otherwise(F.lit(day)).alias("login_date_last"),
                    (F.coalesce("old.login_count_td", F.lit(0)) + F.coalesce("new.login_count_1d", F.lit(0)))
                    .cast("bigint").alias("login_count_td"),
                    F.lit(day).alias("dt"))


# ---------------------------------------------------------------- draft variants (J-64..J-68)
def draft_user_brand_1d(detail: DataFrame, sku: DataFrame) -> DataFrame:
    """J-64: join the dimension first, then aggregate (A-17)."""
    s = sku.select(F.col("id").alias("_sid"), "tm_id", "tm_name")
    j = detail.join(s, detail.sku_id == s._sid, "left")
    return (j.groupBy("user_id", "tm_id", "tm_name", "dt")
            .agg(F.count(F.lit(1)).alias("order_count"), F.sum("sku_num").alias("order_num"),
                 F.sum("split_total_amount").try_cast(MONEY).alias("order_total_amount"))
            .select("user_id", "tm_id", "tm_name", "order_count", "order_num", "order_total_amount", "dt"))


def draft_user_brand_nd(ub1d: DataFrame, day: str) -> DataFrame:
    """J-65 with the draft's typos fixed (day literal, ``user_id`` in the grouping)."""
    out = trailing(ub1d, ["user_id", "tm_id", "tm_name"],
                   {"order_count": "order_count", "order_num": "order_num", "order_total_amount": "order_total_amount"},
                   day, casts={"order_total_amount": MONEY})
    return out.select("user_id", "tm_id", "tm_name", "order_count_7d", "order_num_7d", "order_total_amount_7d",
                      "order_count_30d", "order_num_30d", "order_total_amount_30d").withColumn("dt", F.lit(day))


DRAFT_TD = ["order_count", "order_num", "order_total_amount"]


def draft_order_td_first(detail: DataFrame, day: str) -> DataFrame:
    """J-66: to-date totals straight from the fact."""
    return (detail.where(F.col("dt") <= day).groupBy("user_id")
            .agg(F.min("dt").alias("order_date_first"), F.max("dt").alias("order_date_last"),
                 F.count_distinct("order_id").alias("order_count"), F.sum("sku_num").alias("order_num"),
                 F.sum("split_total_amount").try_cast(MONEY).alias("order_total_amount"))
            .withColumn("dt", F.lit(day)))


def _draft_today(detail: DataFrame, day: str) -> DataFrame:
    return (detail.where(F.col("dt") == day).groupBy("user_id")
            .agg(F.count_distinct("order_id").alias("order_count"), F.sum("sku_num").alias("order_num"),
                 F.sum("split_total_amount").try_cast(MONEY).alias("order_total_amount")))


def draft_order_td_full_outer(prev: DataFrame, detail: DataFrame, day: str) -> DataFrame:
    """J-67: state(D-1) full outer today's per-user totals (last date fixed, §7.4 #21)."""
    return (to_date_step(prev, _draft_today(detail, day), "user_id", {c: c for c in DRAFT_TD},
                         "order_date_first", "order_date_last", day, casts={"order_total_amount": MONEY})
            .withColumn("dt", F.lit(day)))


def draft_order_td_union(prev: DataFrame, detail: DataFrame, day: str) -> DataFrame:
    """J-68: ``union all`` of state and increment, re-aggregated (no join at all: one
    shuffle by user, partial aggregation on both inputs)."""
    inc = _draft_today(detail, day).select("user_id", F.lit(day).alias("order_date_first"),
                                           F.lit(day).alias("order_date_last"), *DRAFT_TD)
    st = prev.select("user_id", "order_date_first", "order_date_last", *DRAFT_TD)
    return (st.unionByName(inc).groupBy("user_id")
            .agg(F.min("order_date_first").alias("order_date_first"), F.max("order_date_last").alias("order_date_last"),
                 F.sum("order_count").cast("bigint").alias("order_count"),
                 F.sum("order_num").cast("bigint").alias("order_num"),
                 F.sum("order_total_amount").try_cast(MONEY).alias("order_total_amount"))
            .withColumn("dt", F.lit(day)))


# J-46
def coupon_order_nd(dim_coupon: DataFrame, detail: DataFrame, day: str) -> DataFrame:
    """Coupons published in the last 30 days (upper bound added, §7.4 #24).  The lines are
    summed per coupon before the join, so raw lines never meet on a coupon id."""
    lo = add_days(day, -29)
    cou = (dim_coupon.select("id", "coupon_name", "coupon_type_code", "coupon_type_name", "benefit_rule",
                             F.date_format("start_time", "yyyy-MM-dd").alias("start_date"))
           .where((F.col("start_date") >= lo) & (F.col("start_date") <= day)))
    od = (detail.where((F.col("dt") >= lo) & (F.col("dt") <= day) & F.col("coupon_id").isNotNull())
          .groupBy("coupon_id").agg(F.sum("split_original_amount").alias("_o"), F.sum("split_coupon_amount").alias("_c")))
    return (cou.join(od, cou.id == od.coupon_id, "left")
            .select(F.col("id").alias("coupon_id"), "coupon_name", "coupon_type_code", "coupon_type_name",
                    F.col("benefit_rule").alias("coupon_rule"), "start_date",
                    F.col("_o").try_cast(MONEY).alias("original_amount_30d"),
                    F.col("_c").try_cast(MONEY).alias("coupon_reduce_amount_30d"), F.lit(day).alias("dt")))


# J-47
def activity_order_nd(dim_activity: DataFrame, detail: DataFrame, day: str) -> DataFrame:
    """Activities started in the last 30 days; the rule-grain dimension is first reduced to
    one row per activity (group by without aggregates, A-12), the lines to one per activity."""
    lo = add_days(day, -29)
    act = (dim_activity.where((F.date_format("start_time", "yyyy-MM-dd") >= lo)
                              & (F.date_format("start_time", "yyyy-MM-dd") <= day))
           .select("activity_id", "activity_name", "activity_type_code", "activity_type_name", "start_time")
           .dropDuplicates())
    od = (detail.where((F.col("dt") >= lo) & (F.col("dt") <= day) & F.col("activity_id").isNotNull())
          .groupBy(F.col("activity_id").alias("_aid"))
          .agg(F.sum("split_original_amount").alias("_o"), F.sum("split_activity_amount").alias("_c")))
    return (act.join(od, act.activity_id == od._aid, "left")
            .select("activity_id", "activity_name", "activity_type_code", "activity_type_name",
                    F.date_format("start_time", "yyyy-MM-dd").alias("start_date"),
                    F.col("_o").try_cast(MONEY).alias("original_amount_30d"),
                    F.col("_c").try_cast(MONEY).alias("activity_reduce_amount_30d"), F.lit(day).alias("dt")))
