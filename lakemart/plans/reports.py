"""ADS report jobs J-49..J-63.

Each returns the rows of one stat day; ``lakemart.sinks.append_distinct`` adds them to
the report table (K-09).  1/7/30-day answers come either from a fan-out over daily
partitions (``recent_days``) or from the ``nd`` tables fanned out over (7, 30) and
picked with ``choose_period`` — the two shapes the reference uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import PERIODS
from ..functions.scalar import MONEY, add_days, ratio
from ..operators.distinct import day_sets, latest_counts, period_counts, with_positions
from ..operators.joins import full_outer_coalesce
from ..operators.periods import choose_period, fan_out, recent_days
from ..operators.scan import steps
from ..operators.topk import top_k_per_group


def _nd_pick(nd: DataFrame, day: str, stems: list[str]) -> DataFrame:
    x = fan_out(nd.where(F.col("dt") == day), (7, 30))
    for s in stems:
        x = x.withColumn(s, choose_period("recent_days", {7: f"{s}_7d", 30: f"{s}_30d"}))
    return x


# J-49
def _visit_sums() -> dict:
    """What the averages and rates of a channel are made of, from 1-day sessions."""
    time, pages = F.col("during_time_1d"), F.col("page_count_1d")
    return {"_time": time, "_timed": time.isNotNull().cast("int"), "_pages": pages, "_paged": pages.isNotNull().cast("int"),
            "_visits": F.lit(1), "_bounced": (pages == 1).cast("int")}


def _traffic(x: DataFrame, day: str) -> DataFrame:
    def mean(total, count):  # as avg(): a double, NULL without values
        return F.try_divide(F.col(total).cast("double"), F.col(count))

    return x.select(F.lit(day).alias("dt"), "recent_days", "channel", "uv_count", (mean("_time", "_timed") / 1000).cast("bigint").alias("avg_duration_sec"),
                    mean("_pages", "_paged").cast("bigint").alias("avg_page_count"), F.col("_visits").cast("bigint").alias("sv_count"),
                    ratio(F.coalesce("_bounced", F.lit(0)), F.col("_visits")).alias("bounce_rate"))


def visitor_sets(session_1d: DataFrame, ids: DataFrame) -> DataFrame:
    """Layer state of J-49: each day's and channel's devices as bitmaps over the dictionary ``ids`` (``mid_id, pos``), with the
    sums."""
    return day_sets(with_positions(session_1d, "mid_id", ids), ["channel"], "pos", _visit_sums())


def traffic_report(state: DataFrame, day: str) -> DataFrame:
    """The report from the stored states of the last 30 days: one pass, no row is fanned out, no device shuffled."""
    return _traffic(period_counts(state, ["channel"], day, PERIODS, "uv_count", {c: c for c in _visit_sums()}), day)


def traffic_by_channel(session_1d: DataFrame, day: str) -> DataFrame:
    """Variant B, straight from 1-day sessions: one pass, devices shuffled once."""
    return _traffic(latest_counts(session_1d, ["channel"], "mid_id", day, PERIODS, "uv_count", _visit_sums()), day)


def traffic_by_channel_sets(session_1d: DataFrame, day: str, ids: DataFrame) -> DataFrame:
    """Variant C, by way of the states that the daily loads keep."""
    x = session_1d.where((F.col("dt") >= add_days(day, -(max(PERIODS) - 1))) & (F.col("dt") <= day))
    return traffic_report(visitor_sets(x, ids), day)


# J-49 (variant A: one scan per period + union all) — same answer, kept as the equivalence check
def traffic_by_channel_union(session_1d: DataFrame, day: str) -> DataFrame:
    parts = []
    for p in (1, 7, 30):
        x = session_1d.where((F.col("dt") >= add_days(day, -(p - 1))) & (F.col("dt") <= day))
        parts.append(x.groupBy("channel").agg(
            F.count_distinct("mid_id").cast("bigint").alias("uv_count"),
            (F.avg("during_time_1d") / 1000).cast("bigint").alias("avg_duration_sec"),
            F.avg("page_count_1d").cast("bigint").alias("avg_page_count"),
            F.count(F.lit(1)).cast("bigint").alias("sv_count"),
            ratio(F.sum(F.when(F.col("page_count_1d") == 1, 1).otherwise(0)), F.count(F.lit(1)))
            .alias("bounce_rate")).select(F.lit(day).alias("dt"), F.lit(p).alias("recent_days"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# J-50
def page_path(page_view: DataFrame, day: str, rows: int | None = None) -> DataFrame:
    """Transition counts ``step-n:page -> step-n+1:next``, steps in the order of (``ts``,
    ``event_id``).  Steps are numbered once per session (a session lies inside one day, so its membership in a period is
    all-or-nothing); transitions are counted per day, then fanned out to the periods —
    the window runs once instead of three times and the fan-out sees counts, not rows.
    Sessions with a NULL id (rows before a device's first start) are left out.  ``rows``: a bound on the page views,
    where one is known without reading them."""
    x = page_view.where(F.col("session_id").isNotNull() & (F.col("dt") >= add_days(day, -29))
                        & (F.col("dt") <= day))
    # step numbers and next pages in one segmented scan, so one very long session is not one task
    x = steps(x.select("session_id", "ts", "event_id", "page_id", "dt"), ["session_id"], ["ts", "event_id"], "page_id", "rn", "next_page_id", rows)
    x = x.select("dt",
                 F.concat(F.lit("step-"), F.col("rn").cast("string"), F.lit(":"), F.col("page_id")).alias("source"),
                 F.coalesce(F.concat(F.lit("step-"), (F.col("rn") + 1).cast("string"), F.lit(":"),
                                     F.col("next_page_id")), F.lit("null")).alias("target"))
    per_day = x.groupBy("dt", "source", "target").agg(F.count(F.lit(1)).alias("n"))
    return (recent_days(per_day, day).groupBy("recent_days", "source", "target")
            .agg(F.sum("n").cast("bigint").alias("path_count"))
            .select(F.lit(day).alias("dt"), "recent_days", "source", "target", "path_count"))


# J-51
def user_change(login_td_today: DataFrame, login_td_prev: DataFrame, day: str) -> DataFrame:
    churn = (login_td_today.where(F.col("login_date_last") == add_days(day, -7))
             .agg(F.count(F.lit(1)).alias("user_churn_count")))
    t1 = login_td_today.select("user_id", "login_date_last")
    t2 = login_td_prev.select("user_id", F.col("login_date_last").alias("login_date_previous"))
    back = (t1.join(t2, "user_id")
            .where(F.datediff(F.col("login_date_last").cast("date"), F.col("login_date_previous").cast("date")) >= 8)
            .agg(F.count(F.lit(1)).alias("user_back_count")))
    # the reference joins two 1-row aggregates on the stat day; the second one is
    # attached as a scalar subquery instead (no join)
    return churn.select(F.lit(day).alias("dt"), "user_churn_count",
                        back.select("user_back_count").scalar().alias("user_back_count"))


# J-52
def retention(register: DataFrame, login_td: DataFrame, day: str) -> DataFrame:
    r = register.where((F.col("dt") >= add_days(day, -7)) & (F.col("dt") < day)) \
                .select("user_id", F.col("date_id").alias("login_date_first"))
    j = r.join(login_td.select("user_id", "login_date_last"), "user_id")
    kept = F.sum(F.when(F.col("login_date_last") == day, 1).otherwise(0))
    return (j.groupBy("login_date_first")
            .agg(kept.cast("bigint").alias("retention_count"), F.count(F.lit(1)).alias("new_user_count"),
                 ratio(kept * 100, F.count(F.lit(1))).alias("retention_rate"))
            .select(F.lit(day).alias("dt"), F.col("login_date_first").alias("create_date"),
                    F.datediff(F.lit(day).cast("date"), F.col("login_date_first").cast("date"))
                    .cast("int").alias("retention_day"),
                    "retention_count", "new_user_count", "retention_rate"))


def _counts_since(df: DataFrame, date: str, day: str, out: str) -> DataFrame:
    """How many rows have ``date`` in the last 1, 7 and 30 days up to ``day``: one pass of
    conditional counts, and the one row turned into three."""
    one = df.agg(*[F.count_if(F.col(date) >= F.lit(add_days(day, -(p - 1)))).alias(f"_{p}") for p in PERIODS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("recent_days"), F.col(f"_{p}").alias(out)) for p in PERIODS]))
                      .alias("s")).select("s.*")


# J-53 (new users from registrations, active users from logins; the reference swaps them)
def user_stats(login_td: DataFrame, register: DataFrame, day: str) -> DataFrame:
    active = _counts_since(login_td, "login_date_last", day, "active_user_count")
    lately = register.where((F.col("dt") >= add_days(day, -(max(PERIODS) - 1))) & (F.col("dt") <= day))
    new = _counts_since(lately, "date_id", day, "new_user_count")
    return new.join(active, "recent_days").select(F.lit(day).alias("dt"), "recent_days", "new_user_count",
                                                  "active_user_count")


# J-54
def funnel(pv1d: DataFrame, pvnd: DataFrame, ca1d: DataFrame, cand: DataFrame, uo1d: DataFrame, uond: DataFrame,
           up1d: DataFrame, upnd: DataFrame, day: str, home: str = "home", detail: str = "good_detail") -> DataFrame:
    def count_if(c):
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")

    p1 = (pv1d.where((F.col("dt") == day) & F.col("page_id").isin(home, detail))
          .agg(count_if(F.col("page_id") == home).alias("home_count"),
               count_if(F.col("page_id") == detail).alias("good_detail_count"))
          .select(F.lit(1).alias("recent_days"), "*"))
    pn = (_nd_pick(pvnd.where(F.col("page_id").isin(home, detail)), day, ["view_count"])
          .groupBy("recent_days")
          .agg(count_if((F.col("page_id") == home) & (F.col("view_count") > 0)).alias("home_count"),
               count_if((F.col("page_id") == detail) & (F.col("view_count") > 0)).alias("good_detail_count")))
    page = p1.unionByName(pn)

    def branch(t1d, tnd, stem, out):
        one = t1d.where(F.col("dt") == day).agg(F.count(F.lit(1)).alias(out)).select(F.lit(1).alias("recent_days"), out)
        nd = (_nd_pick(tnd, day, [stem]).groupBy("recent_days")
              .agg(count_if(F.col(stem) > 0).alias(out)))
        return one.unionByName(nd)

    cart = branch(ca1d, cand, "cart_add_count", "cart_count")
    order = branch(uo1d, uond, "order_count", "order_count")
    pay = branch(up1d, upnd, "payment_count", "payment_count")
    return (page.join(cart, "recent_days").join(order, "recent_days").join(pay, "recent_days")
            .select(F.lit(day).alias("dt"), "recent_days", "home_count", "good_detail_count", "cart_count",
                    "order_count", "payment_count"))


# J-55
def new_buyers(order_td: DataFrame, payment_td: DataFrame, day: str) -> DataFrame:
    o = _counts_since(order_td.where(F.col("dt") == day), "order_date_first", day, "new_order_user_count")
    p = _counts_since(payment_td.where(F.col("dt") == day), "payment_date_first", day, "new_payment_user_count")
    return o.join(p, "recent_days").select(F.lit(day).alias("dt"), "recent_days", "new_order_user_count",
                                           "new_payment_user_count")


# J-56
def repeat_rate_by_brand(od_nd: DataFrame, day: str) -> DataFrame:
    per_user = (_nd_pick(od_nd, day, ["order_count"])
                .groupBy("recent_days", "user_id", "tm_id", "tm_name")
                .agg(F.sum("order_count").alias("order_count")))
    return (per_user.groupBy("recent_days", "tm_id", "tm_name")
            .agg(ratio(F.sum(F.when(F.col("order_count") >= 2, 1).otherwise(0)),
                       F.sum(F.when(F.col("order_count") >= 1, 1).otherwise(0))).alias("order_repeat_rate"))
            .select(F.lit(day).alias("dt"), F.col("recent_days").cast("bigint").alias("recent_days"),
                    "tm_id", "tm_name", "order_repeat_rate"))


def buyer_sets(t1d: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Layer state of J-57 / J-58: the users of each day and group as bitmaps, with the day's count."""
    return day_sets(t1d, keys, "user_id", {"_c": F.col(count)}, F.col(count) > 0)


def _trade_by(orders: DataFrame, refunds: DataFrame, day: str, keys: list[str]) -> DataFrame:
    """Counts and distinct users of 1, 7 and 30 days, of orders and of refunds."""
    j = full_outer_coalesce(orders, refunds, ["recent_days", *keys])
    counts = ["order_count", "order_user_count", "order_refund_count", "order_refund_user_count"]
    return j.select(F.lit(day).alias("dt"), "recent_days", *keys, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])


#: A group with rows in the last 30 days has rows for 7 and 30 days, as the n-day tables have.
ALWAYS = (7, 30)


# J-57
BRAND = ["tm_id", "tm_name"]


def trade_by_brand(orders: DataFrame, refunds: DataFrame, day: str) -> DataFrame:
    """``orders``, ``refunds``: ``buyer_sets`` by ``BRAND`` of the last 30 days (few groups with many users each)."""
    return _trade_by(period_counts(orders, BRAND, day, PERIODS, "order_user_count", {"order_count": "_c"}, ALWAYS),
                     period_counts(refunds, BRAND, day, PERIODS, "order_refund_user_count", {"order_refund_count": "_c"}, ALWAYS), day, BRAND)


CATE = ["category1_id", "category1_name", "category2_id", "category2_name", "category3_id", "category3_name"]


# J-58
def trade_by_category(od1d: DataFrame, rf1d: DataFrame, day: str) -> DataFrame:
    """From the 1-day rollups: the third category level has many groups of few users, so no bitmaps."""
    def side(t1d, count, out, users):
        return latest_counts(t1d, CATE, "user_id", day, PERIODS, users, {out: F.col(count)}, F.col(count) > 0, ALWAYS)

    return _trade_by(side(od1d, "order_count_1d", "order_count", "order_user_count"),
                     side(rf1d, "order_refund_count_1d", "order_refund_count", "order_refund_user_count"), day, CATE)


# J-59
def cart_top3_by_category(cart_full: DataFrame, sku: DataFrame, day: str, k: int = 3) -> DataFrame:
    cart = (cart_full.where(F.col("dt") == day).groupBy("sku_id")
            .agg(F.sum("sku_num").cast("bigint").alias("cart_num")))
    s = sku.select(F.col("id").alias("_id"), "sku_name", *CATE)
    j = cart.join(s, cart.sku_id == s._id, "left")
    top = top_k_per_group(j, ["category1_id", "category2_id", "category3_id"], [F.col("cart_num").desc()], k,
                          ties="rank", out="rk")
    return top.select(F.lit(day).alias("dt"), *CATE, "sku_id", "sku_name", "cart_num",
                      F.col("rk").cast("bigint").alias("rk"))


# J-60
def trade_stats(uo1d, uond, ur1d, urnd, day: str) -> DataFrame:
    o1 = (uo1d.where(F.col("dt") == day)
          .agg(F.sum("order_total_amount_1d").try_cast(MONEY).alias("order_total_amount"),
               F.sum("order_count_1d").cast("bigint").alias("order_count"),
               F.count(F.lit(1)).alias("order_user_count")).select(F.lit(1).alias("recent_days"), "*"))
    on = (_nd_pick(uond, day, ["order_total_amount", "order_count"]).groupBy("recent_days")
          .agg(F.sum("order_total_amount").try_cast(MONEY).alias("order_total_amount"),
               F.sum("order_count").cast("bigint").alias("order_count"),
               F.sum(F.when(F.col("order_count") > 0, 1).otherwise(0)).cast("bigint").alias("order_user_count")))
    r1 = (ur1d.where(F.col("dt") == day)
          .agg(F.sum("order_refund_count_1d").cast("bigint").alias("order_refund_count"),
               F.count(F.lit(1)).alias("order_refund_user_count")).select(F.lit(1).alias("recent_days"), "*"))
    rn = (_nd_pick(urnd, day, ["order_refund_count"]).groupBy("recent_days")
          .agg(F.sum("order_refund_count").cast("bigint").alias("order_refund_count"),
               F.sum(F.when(F.col("order_refund_count") > 0, 1).otherwise(0)).cast("bigint")
               .alias("order_refund_user_count")))
    return (o1.unionByName(on).join(r1.unionByName(rn), "recent_days")
            .select(F.lit(day).alias("dt"), "recent_days", "order_total_amount", "order_count", "order_user_count",
                    "order_refund_count", "order_refund_user_count"))


PROV = ["province_id", "province_name", "area_code", "iso_code", "iso_3166_2"]


# J-61
def order_by_province(po1d: DataFrame, pond: DataFrame, day: str) -> DataFrame:
    one = po1d.where(F.col("dt") == day).select(
        F.lit(1).alias("recent_days"), *PROV, F.col("order_count_1d").cast("bigint").alias("order_count"),
        F.col("order_total_amount_1d").try_cast(MONEY).alias("order_total_amount"))
    nd = (_nd_pick(pond, day, ["order_count", "order_total_amount"]).groupBy("recent_days", *PROV)
          .agg(F.sum("order_count").cast("bigint").alias("order_count"),
               F.sum("order_total_amount").try_cast(MONEY).alias("order_total_amount")))
    return (one.unionByName(nd).distinct()
            .select(F.lit(day).alias("dt"), "recent_days", *PROV[:4],
                    F.col("iso_3166_2").alias("iso_code_3166_2"), "order_count", "order_total_amount"))


# J-62
def coupon_reduce_rate(coupon_nd: DataFrame, day: str) -> DataFrame:
    x = coupon_nd.where(F.col("dt") == day)
    return x.select(F.lit(day).alias("dt"), "coupon_id", "coupon_name", "start_date",
                    F.col("coupon_rule").alias("rule_name"),
                    ratio("coupon_reduce_amount_30d", "original_amount_30d").alias("reduce_rate"))


# J-63
def activity_reduce_rate(activity_nd: DataFrame, day: str) -> DataFrame:
    x = activity_nd.where(F.col("dt") == day)
    return x.select(F.lit(day).alias("dt"), "activity_id", "activity_name", "start_date",
                    ratio("activity_reduce_amount_30d", "original_amount_30d").alias("reduce_rate"))
