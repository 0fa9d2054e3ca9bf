"""First and daily loads of the trade facts from the separate CDC streams.  The oracles are
written on the driver tables themselves, not on the streams."""

from __future__ import annotations

from ..oracle.domain import cte, with_ctes
from ..plans import facts_cdc as C
from ..registry import register
from ..sources import cdc_trade as S
from ..sources import domain as D
from ..sources.dictionary import dictionary
from ..sources.driver import Driver
from .facts import dic_join

DAY, BOOT, TDAY, TBOOT = S.DAY, S.BOOT, D.TRAFFIC_DAY, S.TRAFFIC_BOOT

LATER = "strftime(cast(o_orderdate as date) + cast({key} % 2 as integer), '%Y-%m-%d')"
# the driver's (order, line number) pairs repeat: a line is named by its part, supplier and quantity as well
LINE_ID = ("(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000) * 100 + cast(l_quantity as bigint)")
cte("cdc_line", f"""
select *, cast(original - coalesce(activity, 0) - coalesce(coupon, 0) as decimal(16,2)) total,
  {LATER.format(key='order_id')} later
from (select {LINE_ID} id, l_orderkey order_id, o_custkey user_id, l_partkey sku_id, c_nationkey province_id,
  case when l_discount > 0 then l_suppkey % 7 end activity_id,
  case when l_discount > 0 then l_suppkey % 7 * 10 + l_linenumber % 3 end activity_rule_id,
  case when l_tax > 0 then l_suppkey % 10 end coupon_id, l_suppkey source_id,
  '240' || cast(l_linenumber % 4 + 1 as varchar) source_type, cast(l_quantity as bigint) sku_num,
  cast(cast(l_quantity as bigint) * (l_partkey % 1000 + 1) as decimal(16,2)) split_original_amount,
  cast(l_extendedprice as decimal(16,2)) original,
  case when l_discount > 0 then cast(cast(l_extendedprice as decimal(16,2)) * cast(l_discount as decimal(16,2)) as decimal(16,2)) end activity,
  case when l_tax > 0 then cast(cast(l_extendedprice as decimal(16,2)) * cast(l_tax as decimal(16,2)) as decimal(16,2)) end coupon,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') create_time, strftime(o_orderdate, '%Y-%m-%d') on_day, o_orderdate, o_orderstatus,
  '110' || substr(o_orderpriority, 1, 1) payment_type
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey) t""")
cte("cdc_return", f"""
select {LINE_ID} id, l_orderkey order_id, o_custkey user_id, l_partkey sku_id, c_nationkey province_id,
  '150' || cast(l_linenumber % 2 + 1 as varchar) refund_type, cast(l_quantity as bigint) refund_num,
  cast(l_extendedprice as decimal(16,2)) refund_amount, '130' || cast(l_linenumber % 7 + 1 as varchar) refund_reason_type,
  '110' || substr(o_orderpriority, 1, 1) payment_type, strftime(l_shipdate, '%Y-%m-%d') on_day,
  case when l_linestatus = 'F' then strftime(cast(l_shipdate as date) + cast(l_orderkey % 2 as integer), '%Y-%m-%d') end repaid,
  strftime(o_orderdate, '%Y-%m-%d') order_day
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_returnflag = 'R'""")

HEAD = "id, order_id, user_id, sku_id, province_id, activity_id, activity_rule_id, coupon_id"
TAIL = "sku_num, split_original_amount, activity split_activity_amount, coupon split_coupon_amount"


def _detail(where: str) -> str:
    return with_ctes(f"""select {HEAD}, on_day date_id, create_time, source_id, source_type source_type_code, d.dic_name source_type_name,
  {TAIL}, total split_total_amount, on_day dt
from cdc_line o {dic_join('d', '24', 'o.source_type')} where {where}""", "cdc_line", "dic")


def _paid(where: str) -> str:
    return with_ctes(f"""select {HEAD}, payment_type payment_type_code, p.dic_name payment_type_name, later date_id,
  later || ' 11:00:00' callback_time, source_id, source_type source_type_code, d.dic_name source_type_name,
  {TAIL}, total split_payment_amount, later dt
from cdc_line o {dic_join('d', '24', 'o.source_type')} {dic_join('p', '11', 'o.payment_type')}
where o_orderstatus = 'F' and {where}""", "cdc_line", "dic")


def _asked(where: str, province: str = "province_id") -> str:
    return with_ctes(f"""select id, user_id, order_id, sku_id, {province} province_id, on_day date_id, on_day || ' 10:00:00' create_time,
  refund_type refund_type_code, t.dic_name refund_type_name, refund_reason_type refund_reason_type_code,
  w.dic_name refund_reason_type_name, 'reason ' || cast(id % 5 as varchar) refund_reason_txt, refund_num, refund_amount, on_day dt
from cdc_return r {dic_join('t', '15', 'r.refund_type')} {dic_join('w', '13', 'r.refund_reason_type')}
where {where}""", "cdc_return", "dic")


def _repaid(where: str, requests: str, header: str = "p.{}") -> str:
    return with_ctes(f"""select p.id, {header.format('user_id')} user_id, p.order_id, p.sku_id, {header.format('province_id')} province_id, p.payment_type payment_type_code,
  d.dic_name payment_type_name, p.repaid date_id, p.repaid || ' 15:00:00' callback_time, q.refund_num, p.refund_amount, p.repaid dt
from (select * from cdc_return where {where}) p
left join (select order_id, sku_id, refund_num from cdc_return where {requests}) q on p.order_id = q.order_id and p.sku_id = q.sku_id
{dic_join('d', '11', 'p.payment_type')}""", "cdc_return", "dic")


def _line_streams(d: Driver):
    return S.detail_inc(d), S.header_inc(d), S.detail_activity_inc(d), S.detail_coupon_inc(d)


@register("fact_order_detail_first", _detail(f"on_day <= '{BOOT}'"))
def q_detail_first(spark, sf):
    """J-09 first load: four streams joined, spread over the order days."""
    return C.order_detail(*_line_streams(Driver(spark, sf)), dictionary(spark), BOOT, first=True)


@register("fact_order_detail_daily", _detail(f"on_day = '{DAY}'"))
def q_detail_daily(spark, sf):
    """J-09 daily load."""
    return C.order_detail(*_line_streams(Driver(spark, sf)), dictionary(spark), DAY)


@register("fact_payment_success_first", _paid(f"later <= '{BOOT}' and on_day <= '{BOOT}'"))
def q_paid_first(spark, sf):
    """J-11 first load."""
    d = Driver(spark, sf)
    return C.payment_success(*_line_streams(d), S.payment_inc(d), dictionary(spark), BOOT, first=True)


@register("fact_payment_success_daily", _paid(f"later = '{DAY}'"))
def q_paid_daily(spark, sf):
    """J-11 daily load: status changes of D, lines of D and the day before."""
    d = Driver(spark, sf)
    return C.payment_success(*_line_streams(d), S.payment_inc(d), dictionary(spark), DAY)


@register("fact_order_refund_first", _asked(f"on_day <= '{BOOT}'", f"case when order_day <= '{BOOT}' then province_id end"))
def q_asked_first(spark, sf):
    """J-12 first load."""
    d = Driver(spark, sf)
    return C.order_refund(S.refund_inc(d), S.header_inc(d), dictionary(spark), BOOT, first=True)


@register("fact_order_refund_daily", _asked(f"on_day = '{DAY}'"))
def q_asked_daily(spark, sf):
    """J-12 daily load: the header's change to 1005 gives the province."""
    d = Driver(spark, sf)
    return C.order_refund(S.refund_inc(d), S.header_inc(d), dictionary(spark), DAY)


@register("fact_refund_paid_first", _repaid(f"repaid <= '{BOOT}'", f"on_day <= '{BOOT}'",
                                             "case when p.order_day <= '" + BOOT + "' then p.{} end"))
def q_repaid_first(spark, sf):
    """J-13 first load."""
    d = Driver(spark, sf)
    return C.refund_paid(S.refund_payment_inc(d), S.header_inc(d), S.refund_inc(d), dictionary(spark), BOOT, first=True)


@register("fact_refund_paid_daily", _repaid(f"repaid = '{DAY}'", f"repaid = '{DAY}'"))
def q_repaid_daily(spark, sf):
    """J-13 daily load: three update streams."""
    d = Driver(spark, sf)
    return C.refund_paid(S.refund_payment_inc(d), S.header_inc(d), S.refund_inc(d), dictionary(spark), DAY)


@register("fact_cancel_detail_first", with_ctes(f"""select {HEAD}, later date_id, later || ' 12:00:00' cancel_time, source_id,
  source_type source_type_code, d.dic_name source_type_name, {TAIL}, total split_total_amount, later dt
from cdc_line o {dic_join('d', '24', 'o.source_type')}
where o_orderstatus = 'P' and on_day <= '{BOOT}' and later <= '{BOOT}'""", "cdc_line", "dic"))
def q_cancel_first(spark, sf):
    """J-10 first load."""
    d = Driver(spark, sf)
    detail, _, activity, coupon = _line_streams(d)
    return C.cancel_detail_first(detail, S.cancelled_header_boot(d), activity, coupon, dictionary(spark), BOOT)


@register("fact_cart_add_first", with_ctes(f"""
select event_id id, user_id, event_id % 200 sku_id, strftime(ts, '%Y-%m-%d') date_id, strftime(ts, '%Y-%m-%d %H:%M:%S') create_time,
  event_id % 50 source_id, source_type source_type_code, d.dic_name source_type_name, cast(floor(value) + 1 as bigint) sku_num,
  strftime(ts, '%Y-%m-%d') dt
from (select *, '240' || cast(event_id % 4 + 1 as varchar) source_type from events where event_type = 'click') e
{dic_join('d', '24', 'e.source_type')} where strftime(ts, '%Y-%m-%d') <= '{TBOOT}'""", "dic"))
def q_cart_first(spark, sf):
    """J-08 first load."""
    return C.cart_add_first(S.cart_boot(Driver(spark, sf)), dictionary(spark), TBOOT)


COUPONS = """(select distinct l_orderkey * 10 + l_suppkey % 10 id, l_suppkey % 10 coupon_id, o_custkey user_id, l_orderkey order_id,
  strftime(cast(o_orderdate as date) - 1, '%Y-%m-%d') got, strftime(o_orderdate, '%Y-%m-%d') used,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') used_at, o_orderstatus
from lineitem join orders on l_orderkey = o_orderkey where l_tax > 0) c"""


@register("fact_coupon_get_first", f"""select id, coupon_id, user_id, got date_id, got || ' 10:00:00' get_time, got dt
from {COUPONS} where got <= '{BOOT}'""")
def q_coupon_get_first(spark, sf):
    """J-15 first load."""
    return C.coupon_first(S.coupon_use_boot(Driver(spark, sf)), BOOT, "get_time", "get_time")


@register("fact_coupon_order_first", f"""select id, coupon_id, user_id, order_id, used date_id, used_at order_time, used dt
from {COUPONS} where used <= '{BOOT}'""")
def q_coupon_order_first(spark, sf):
    """J-16 first load: ``using_time is not null``."""
    return C.coupon_first(S.coupon_use_boot(Driver(spark, sf)), BOOT, "using_time", "order_time")


@register("fact_coupon_pay_first", f"""select id, coupon_id, user_id, order_id, used date_id, used_at payment_time, used dt
from {COUPONS} where used <= '{BOOT}' and o_orderstatus = 'F'""")
def q_coupon_pay_first(spark, sf):
    """J-17 first load: ``used_time is not null``."""
    return C.coupon_first(S.coupon_use_boot(Driver(spark, sf)), BOOT, "used_time", "payment_time")


@register("fact_favor_add_first", f"""select event_id id, user_id, event_id % 200 sku_id, strftime(ts, '%Y-%m-%d') date_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S') create_time, strftime(ts, '%Y-%m-%d') dt
from events where event_type = 'view' and cast(json_extract_string(props, '$.k') as integer) % 10 = 0
  and strftime(ts, '%Y-%m-%d') <= '{TBOOT}'""")
def q_favor_first(spark, sf):
    """J-18 first load."""
    return C.favor_add_first(S.interaction_boot(Driver(spark, sf), "favor"), TBOOT)


@register("fact_comment_first", with_ctes(f"""select id, user_id, sku_id, order_id, date_id, create_time, appraise_code, d.dic_name appraise_name, date_id dt
from (select event_id id, user_id, event_id % 200 sku_id, event_id order_id, strftime(ts, '%Y-%m-%d') date_id,
        strftime(ts, '%Y-%m-%d %H:%M:%S') create_time,
        '120' || cast(cast(json_extract_string(props, '$.k') as integer) % 4 + 1 as varchar) appraise_code
      from events where event_type = 'purchase' and strftime(ts, '%Y-%m-%d') <= '{TBOOT}') c
{dic_join('d', '12', 'c.appraise_code')}""", "dic"))
def q_comment_first(spark, sf):
    """J-19 first load."""
    return C.comment_first(S.interaction_boot(Driver(spark, sf), "comment"), dictionary(spark), TBOOT)


@register("fact_user_register_first", with_ctes(f"""
select u.id user_id, substr(u.create_time, 1, 10) date_id, u.create_time, channel, p.id province_id, version_code, mid_id, brand, model,
  operate_system, substr(u.create_time, 1, 10) dt
from (select id, create_time from users where substr(create_time, 1, 10) <= '{TBOOT}') u
left join (select common.ar area_code, common.ba brand, common.ch channel, common.md model, common.mid mid_id,
             common.os operate_system, cast(common.uid as bigint) uid, common.vc version_code
           from page_log where page.page_id = 'signup' and common.uid is not null and dt = '{TBOOT}') g on u.id = g.uid
left join province p on g.area_code = p.area_code""", "users", "page_log", "province"))
def q_register_first(spark, sf):
    """J-25 first load: users of the history, devices of the landing day."""
    d = Driver(spark, sf)
    return C.user_register_first(D.user_inc(d, TDAY), D.page_log(d, TBOOT, TBOOT), D.province(d), TBOOT)
