"""Registered rollup queries (J-27..J-33, J-39..J-42) over the trade domain."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import add_days
from ..oracle.domain import SKU_ATTRS, nd_sql, with_ctes
from ..plans import rollups as R
from ..registry import register
from ..sinks.state import BucketedState, compare
from ..sources import domain as D
from ..sources.driver import Driver

DAY = D.TRADE_DAY
LO30 = add_days(DAY, -29)
MONEY_STEMS = {"order_original_amount", "activity_reduce_amount", "coupon_reduce_amount",
               "order_total_amount", "order_refund_amount", "payment_amount"}


def _d(spark, sf):
    return Driver(spark, sf)


@register("user_sku_order_1d", with_ctes("select * from od1d", "od1d"))
def q_user_sku_order_1d(spark, sf):
    """J-27 first load: every day of the order fact, dynamic partitions."""
    d = _d(spark, sf)
    return R.user_sku_order_1d(D.order_detail(d), D.sku(d))


def od1d_window(d, day=DAY):
    return R.user_sku_order_1d(D.order_detail(d, add_days(day, -29), day), D.sku(d))


@register("user_sku_order_nd", with_ctes(
    nd_sql("od1d", f"user_id, sku_id, {SKU_ATTRS}", R.ORDER_STEMS, DAY, MONEY_STEMS), "od1d"))
def q_user_sku_order_nd(spark, sf):
    """J-28: 7/30-day rollup from one scan of 30 daily partitions."""
    return R.user_sku_order_nd(od1d_window(_d(spark, sf)), DAY)


@register("user_sku_refund_1d", with_ctes("select * from rf1d", "rf1d"))
def q_user_sku_refund_1d(spark, sf):
    """J-29 first load."""
    d = _d(spark, sf)
    return R.user_sku_refund_1d(D.refund_info(d), D.sku(d))


def rf1d_window(d, day=DAY):
    return R.user_sku_refund_1d(D.refund_info(d, add_days(day, -29), day), D.sku(d))


@register("user_sku_refund_nd", with_ctes(
    nd_sql("rf1d", f"user_id, sku_id, {SKU_ATTRS}", R.REFUND_STEMS, DAY, MONEY_STEMS), "rf1d"))
def q_user_sku_refund_nd(spark, sf):
    """J-30."""
    return R.user_sku_refund_nd(rf1d_window(_d(spark, sf)), DAY)


@register("user_order_1d", with_ctes("select * from uo1d", "uo1d"))
def q_user_order_1d(spark, sf):
    """J-31: user × day, exact distinct order count."""
    return R.user_order_1d(D.order_detail(_d(spark, sf)))


@register("user_order_nd", with_ctes(nd_sql("uo1d", "user_id", R.ORDER_STEMS, DAY, MONEY_STEMS), "uo1d"))
def q_user_order_nd(spark, sf):
    """J-32."""
    d = _d(spark, sf)
    return R.user_order_nd(R.user_order_1d(D.order_detail(d, LO30, DAY)), DAY)


TD_SQL = """select user_id, min(dt) order_date_first, max(dt) order_date_last,
  cast(sum(order_count_1d) as bigint) order_count_td, cast(sum(order_num_1d) as bigint) order_num_td,
  cast(sum(order_original_amount_1d) as decimal(16,2)) original_amount_td,
  cast(sum(activity_reduce_amount_1d) as decimal(16,2)) activity_reduce_amount_td,
  cast(sum(coupon_reduce_amount_1d) as decimal(16,2)) coupon_reduce_amount_td,
  cast(sum(order_total_amount_1d) as decimal(16,2)) total_amount_td, '{day}' dt
from uo1d where dt <= '{day}' group by user_id"""


@register("user_order_td", with_ctes(TD_SQL.format(day=DAY), "uo1d"))
def q_user_order_td(spark, sf):
    """J-33 first load: aggregate every 1-day partition up to D."""
    return R.user_order_td_first(R.user_order_1d(D.order_detail(_d(spark, sf))), DAY)


PREV = add_days(DAY, -1)


@register("user_order_td_step", with_ctes(TD_SQL.format(day=DAY), "uo1d"))
def q_user_order_td_step(spark, sf):
    """J-33 daily load: state(D-1) full outer 1d(D).  Its answer must equal the
    first-load aggregate at D (the td invariant), so the oracle is the same SQL."""
    d = _d(spark, sf)
    prev = R.user_order_td_first(R.user_order_1d(D.order_detail(d, None, PREV)), PREV).drop("dt")
    return R.user_order_td_step(prev, R.user_order_1d(D.order_detail(d, DAY, DAY)), DAY)


def _state(spark, name):
    """A to-date state of its own name; as many buckets as shuffle partitions."""
    return BucketedState(spark, f"lakemart_{name}_{uuid.uuid4().hex[:8]}", "user_id", int(spark.conf.get("spark.sql.shuffle.partitions")))


@register("user_order_td_state", with_ctes(TD_SQL.format(day=DAY), "uo1d"))
def q_user_order_td_state(spark, sf):
    """J-33 on co-bucketed tables: state(D-1) and 1d(D) lie by user, so the full outer join exchanges nothing."""
    d = _d(spark, sf)
    s = _state(spark, "order_td")
    s.write(R.user_order_td_first(R.user_order_1d(D.order_detail(d, None, PREV)), PREV).drop("dt"), PREV)
    return s.joined(PREV, R.user_order_1d(D.order_detail(d, DAY, DAY)), DAY, lambda prev, today: R.user_order_td_step(prev, today, DAY))


@register("join_self_state_bucketed", with_ctes(f"""select a.user_id, a.order_date_last, b.order_date_last prev_last
from ({TD_SQL.format(day=DAY)}) a join ({TD_SQL.format(day=PREV)}) b on a.user_id = b.user_id""", "uo1d"))
def q_self_state_bucketed(spark, sf):
    """N-09 on co-bucketed states of D and D-1 (the one made from the other): a merge join without an exchange."""
    d = _d(spark, sf)
    s = _state(spark, "order_td")
    s.write(R.user_order_td_first(R.user_order_1d(D.order_detail(d, None, PREV)), PREV).drop("dt"), PREV)
    now = s.advance(PREV, R.user_order_1d(D.order_detail(d, DAY, DAY)), DAY, lambda prev, today: R.user_order_td_step(prev, today, DAY).drop("dt"))
    return compare(now, s.read(PREV), "user_id").select("user_id", "order_date_last", F.col("prev_order_date_last").alias("prev_last"))


@register("province_order_1d", with_ctes("select * from po1d", "po1d"))
def q_province_order_1d(spark, sf):
    """J-39."""
    d = _d(spark, sf)
    return R.province_order_1d(D.order_detail(d), D.province(d))


@register("province_order_nd", with_ctes(nd_sql(
    "po1d", "province_id, province_name, area_code, iso_code, iso_3166_2",
    ["order_count", "order_original_amount", "activity_reduce_amount", "coupon_reduce_amount",
     "order_total_amount"], DAY, MONEY_STEMS), "po1d"))
def q_province_order_nd(spark, sf):
    """J-40."""
    d = _d(spark, sf)
    return R.province_order_nd(R.province_order_1d(D.order_detail(d, LO30, DAY), D.province(d)), DAY)


@register("user_refund_1d", with_ctes("select * from ur1d", "ur1d"))
def q_user_refund_1d(spark, sf):
    """J-41."""
    return R.user_refund_1d(D.refund_info(_d(spark, sf)))


@register("user_refund_nd", with_ctes(nd_sql("ur1d", "user_id", R.REFUND_STEMS, DAY, MONEY_STEMS), "ur1d"))
def q_user_refund_nd(spark, sf):
    """J-42."""
    return R.user_refund_nd(R.user_refund_1d(D.refund_info(_d(spark, sf), LO30, DAY)), DAY)


# ------------------------------------------------------------------ draft variants J-64..J-68
UB1D = """select user_id, tm_id, tm_name, count(*) order_count, cast(sum(sku_num) as bigint) order_num,
  cast(sum(split_total_amount) as decimal(16,2)) order_total_amount, dt
from order_detail od left join (select id, tm_id, tm_name from sku) s on od.sku_id = s.id
group by user_id, tm_id, tm_name, dt"""


@register("draft_user_brand_1d", with_ctes(UB1D, "order_detail", "sku"))
def q_draft_ub1d(spark, sf):
    """J-64: user × brand × day, join then aggregate."""
    d = _d(spark, sf)
    return R.draft_user_brand_1d(D.order_detail(d), D.sku(d))


@register("draft_user_brand_nd", with_ctes(
    f"with ub1d as ({UB1D})\n" + nd_sql("ub1d", "user_id, tm_id, tm_name", R.DRAFT_TD, DAY,
                                        {"order_total_amount"}).replace("_1d", ""),
    "order_detail", "sku"))
def q_draft_ubnd(spark, sf):
    """J-65: 7/30-day user × brand (typos of the draft fixed)."""
    d = _d(spark, sf)
    return R.draft_user_brand_nd(R.draft_user_brand_1d(D.order_detail(d, LO30, DAY), D.sku(d)), DAY)


DRAFT_TD_SQL = """select user_id, min(dt) order_date_first, max(dt) order_date_last,
  count(distinct order_id) order_count, cast(sum(sku_num) as bigint) order_num,
  cast(sum(split_total_amount) as decimal(16,2)) order_total_amount, '{day}' dt
from order_detail where dt <= '{day}' group by user_id"""


@register("draft_order_td_first", with_ctes(DRAFT_TD_SQL.format(day=DAY), "order_detail"))
def q_draft_td_first(spark, sf):
    """J-66."""
    return R.draft_order_td_first(D.order_detail(_d(spark, sf)), DAY)


@register("draft_order_td_full_outer", with_ctes(DRAFT_TD_SQL.format(day=DAY), "order_detail"))
def q_draft_td_fo(spark, sf):
    """J-67: must equal J-66 at D (state at D-1 from J-66)."""
    d = _d(spark, sf)
    state = R.draft_order_td_first(D.order_detail(d, None, PREV), PREV).drop("dt")
    return R.draft_order_td_full_outer(state, D.order_detail(d, DAY, DAY), DAY)


@register("draft_order_td_union", with_ctes(DRAFT_TD_SQL.format(day=DAY), "order_detail"))
def q_draft_td_union(spark, sf):
    """J-68: union all + re-aggregate; must equal J-66 and J-67."""
    d = _d(spark, sf)
    state = R.draft_order_td_first(D.order_detail(d, None, PREV), PREV).drop("dt")
    return R.draft_order_td_union(state, D.order_detail(d, DAY, DAY), DAY)
