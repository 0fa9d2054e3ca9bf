"""Registered fact queries: app-log facts J-20..J-26 (every landed day)."""

from __future__ import annotations

from ..oracle.domain import cte, user_inc_sql, with_ctes
from ..plans import facts_log as L
from ..registry import register
from ..sources import domain as D
from ..sources.driver import Driver

TDAY = D.TRAFFIC_DAY


def _d(spark, sf):
    return Driver(spark, sf)


def _log(spark, sf):
    d = _d(spark, sf)
    return d, D.page_log(d), D.province(d)


LOCAL = "strftime(epoch_ms({ms}) + interval 8 hour, '{fmt}')"


def lt(ms, fmt="%Y-%m-%d %H:%M:%S"):
    return LOCAL.format(ms=ms, fmt=fmt)


DEV = ("common.ar area_code, common.ba brand, common.ch channel, common.is_new is_new, common.md model, "
       "common.mid mid_id, common.os operate_system, common.uid user_id, common.vc version_code")
PG = ("page.during_time during_time, page.item page_item, page.item_type page_item_type, "
      "page.last_page_id last_page_id, page.page_id page_id, page.source_type source_type")
DEV_OUT = "p.id province_id, brand, channel, is_new, model, mid_id, operate_system, user_id, version_code"
PG_OUT = "page_item, page_item_type, last_page_id, page_id, source_type"

cte("page_view", f"""
select {DEV_OUT}, {PG_OUT}, {lt('ts', '%Y-%m-%d')} date_id, {lt('ts')} view_time,
  mid_id || '-' || cast(last_value(case when last_page_id is null then ts end ignore nulls)
     over (partition by dt, mid_id order by ts) as varchar) session_id,
  during_time, ts, event_id, dt
from (select {DEV}, {PG}, ts, event_id, dt from page_log where page is not null) l
left join province p on l.area_code = p.area_code""", ("page_log", "province"))

cte("user_login", f"""
select user_id, {lt('ts', '%Y-%m-%d')} date_id, {lt('ts')} login_time, channel, p.id province_id,
  version_code, mid_id, brand, model, operate_system, dt
from (
  select *, row_number() over (partition by dt, session_id order by ts, user_id, channel, area_code,
      version_code, mid_id, brand, model, operate_system) rn
  from (select common.uid user_id, common.ch channel, common.ar area_code, common.vc version_code,
          common.mid mid_id, common.ba brand, common.md model, common.os operate_system, ts, dt,
          common.mid || '-' || cast(last_value(case when page.last_page_id is null then ts end ignore nulls)
             over (partition by dt, common.mid order by ts) as varchar) session_id
        from page_log where page is not null) s
  where user_id is not null and session_id is not null) t
left join province p on t.area_code = p.area_code
where rn = 1""", ("page_log", "province"))


@register("fact_page_view", with_ctes("select * from page_view", "page_view"))
def q_page_view(spark, sf):
    """J-20: sessionised page views (skew-safe two-level running max)."""
    _, log, prov = _log(spark, sf)
    return L.page_view(log, prov)


@register("fact_app_start", with_ctes(f"""
select {DEV_OUT}, entry, open_ad_id, {lt('ts', '%Y-%m-%d')} date_id, {lt('ts')} start_time,
  loading_time_ms, open_ad_ms, open_ad_skip_ms, dt
from (select {DEV}, "start".entry entry, "start".loading_time loading_time_ms, "start".open_ad_id open_ad_id,
        "start".open_ad_ms open_ad_ms, "start".open_ad_skip_ms open_ad_skip_ms, ts, dt
      from page_log where "start" is not null) l
left join province p on l.area_code = p.area_code""", "page_log", "province"))
def q_app_start(spark, sf):
    """J-21."""
    _, log, prov = _log(spark, sf)
    return L.app_start(log, prov)


@register("fact_action", with_ctes(f"""
select {DEV_OUT}, during_time, {PG_OUT}, a.action_id action_id, a.item action_item,
  a.item_type action_item_type, {lt('a.ts', '%Y-%m-%d')} date_id, {lt('a.ts')} action_time, dt
from (select {DEV}, {PG}, unnest(actions) a, dt from page_log
      where page is not null and actions is not null) l
left join province p on l.area_code = p.area_code""", "page_log", "province"))
def q_action(spark, sf):
    """J-22: one row per action (explode of an array of structs)."""
    _, log, prov = _log(spark, sf)
    return L.action(log, prov)


@register("fact_display", with_ctes(f"""
select {DEV_OUT}, during_time, {PG_OUT}, {lt('ts', '%Y-%m-%d')} date_id, {lt('ts')} display_time,
  d.display_type display_type, d.item display_item, d.item_type display_item_type,
  d."order" display_order, d.pos_id display_pos_id, dt
from (select {DEV}, {PG}, unnest(displays) d, ts, dt from page_log
      where page is not null and displays is not null) l
left join province p on l.area_code = p.area_code""", "page_log", "province"))
def q_display(spark, sf):
    """J-23: one row per impression."""
    _, log, prov = _log(spark, sf)
    return L.display(log, prov)


@register("fact_error", with_ctes(f"""
select {DEV_OUT}, {PG_OUT}, entry, loading_time, open_ad_id, open_ad_ms, open_ad_skip_ms, actions, displays,
  {lt('ts', '%Y-%m-%d')} date_id, {lt('ts')} error_time, error_code, error_msg, dt
from (select {DEV}, {PG}, "start".entry entry, "start".loading_time loading_time, "start".open_ad_id open_ad_id,
        "start".open_ad_ms open_ad_ms, "start".open_ad_skip_ms open_ad_skip_ms, actions, displays,
        err.error_code error_code, err.msg error_msg, ts, dt
      from page_log where err is not null) l
join province p on l.area_code = p.area_code""", "page_log", "province"))
def q_error(spark, sf):
    """J-24: errors, nested arrays kept; inner join to province."""
    _, log, prov = _log(spark, sf)
    return L.error(log, prov)


cte("user_inc", user_inc_sql(TDAY), ("users",))


@register("fact_user_register", with_ctes(f"""
select ui.user_id, substr(ui.create_time, 1, 10) date_id, ui.create_time, channel, p.id province_id,
  version_code, mid_id, brand, model, operate_system, ui.dt
from (select data.id user_id, data.create_time create_time, dt from user_inc where type = 'insert') ui
left join (select common.ar area_code, common.ba brand, common.ch channel, common.md model, common.mid mid_id,
             common.os operate_system, cast(common.uid as bigint) uid, common.vc version_code, dt ldt
           from page_log where page.page_id = 'signup' and common.uid is not null) lg
  on ui.user_id = lg.uid and ui.dt = lg.ldt
left join province p on lg.area_code = p.area_code""", "user_inc", "page_log", "province"))
def q_user_register(spark, sf):
    """J-25 daily load: users inserted on D + device of their register page view."""
    d, log, prov = _log(spark, sf)
    return L.user_register(D.user_inc(d, TDAY), log, prov)


@register("fact_user_login", with_ctes("select * from user_login", "user_login"))
def q_user_login(spark, sf):
    """J-26: first row with a user id in each session (min-struct aggregate)."""
    _, log, prov = _log(spark, sf)
    return L.user_login(log, prov)


# ------------------------------------------------------------------ trade facts (CDC)
from ..plans import facts_trade as T  # noqa: E402
from ..sources.dictionary import dictionary, dictionary_sql  # noqa: E402

cte("dic", dictionary_sql())


def dic_join(alias: str, parent: str, code: str) -> str:
    return (f"left join (select dic_code, dic_name from dic where parent_code = '{parent}') {alias} "
            f"on {code} = {alias}.dic_code")


@register("fact_cart_add", with_ctes(f"""
select id, user_id, sku_id, date_id, create_time, source_id, source_type_code, d.dic_name source_type_name, sku_num, dt
from (select data.id id, data.user_id user_id, data.sku_id sku_id, {lt('ts * 1000', '%Y-%m-%d')} date_id,
        {lt('ts * 1000')} create_time, data.source_id source_id, data.source_type source_type_code,
        case when type = 'insert' then data.sku_num else data.sku_num - cast(old['sku_num'] as bigint) end sku_num, dt
      from cart_inc
      where type = 'insert' or (type = 'update' and old['sku_num'] is not null
                                and data.sku_num > cast(old['sku_num'] as bigint))) c
{dic_join('d', '24', 'c.source_type_code')}""", "cart_inc", "dic"))
def q_cart_add(spark, sf):
    """J-08: inserts + quantity increases (delta), map lookup on ``old``."""
    return T.cart_add(D.cart_inc(_d(spark, sf)), dictionary(spark))


OD_COLS = ("order_id, user_id, sku_id, province_id, activity_id, activity_rule_id, coupon_id")
AMT = "sku_num, split_original_amount, split_activity_amount, split_coupon_amount"


@register("fact_order_detail", with_ctes(f"""
select {OD_COLS}, substr(create_time, 1, 10) date_id, create_time, source_id, source_type source_type_code,
  d.dic_name source_type_name, {AMT}, split_total_amount, dt
from order_detail o {dic_join('d', '24', 'o.source_type')}""", "order_detail", "dic"))
def q_order_detail(spark, sf):
    """J-09: order lines ⋈ header ⋈ customer, source type decoded (broadcast dictionary)."""
    return T.order_detail(D.order_detail(_d(spark, sf)), dictionary(spark))


@register("fact_cancel_detail", with_ctes(f"""
select {OD_COLS}, substr(cancel_time, 1, 10) date_id, cancel_time, source_id, source_type source_type_code,
  d.dic_name source_type_name, {AMT}, split_total_amount, cdt dt
from order_detail o
join (select data.id oid, data.operate_time cancel_time, dt cdt from order_inc
      where type = 'update' and data.order_status = '1003' and list_contains(map_keys(old), 'order_status')) c
  on o.order_id = c.oid and (o.dt = c.cdt or o.dt = strftime(cast(c.cdt as date) - 1, '%Y-%m-%d'))
{dic_join('d', '24', 'o.source_type')}""", "order_detail", "order_inc", "dic"))
def q_cancel_detail(spark, sf):
    """J-10: status-change filter on the CDC ``old`` map; lines of D and D-1."""
    d = _d(spark, sf)
    return T.cancel_detail(D.order_detail(d), D.order_inc(d), dictionary(spark))


cte("pay_detail", f"""
select {OD_COLS}, p.payment_type payment_type_code, pt.dic_name payment_type_name, substr(callback_time, 1, 10) date_id,
  callback_time, source_id, source_type source_type_code, st.dic_name source_type_name, {AMT},
  split_total_amount split_payment_amount, p.dt
from order_detail o join (select order_id oid, payment_type, callback_time, dt from payment_info) p on o.order_id = p.oid
{dic_join('pt', '11', 'p.payment_type')}
{dic_join('st', '24', 'o.source_type')}""", ("order_detail", "payment_info", "dic"))


@register("fact_payment_success", with_ctes("select * from pay_detail", "pay_detail"))
def q_pay_detail(spark, sf):
    """J-11: paid lines, payment and source type decoded."""
    d = _d(spark, sf)
    return T.pay_detail(D.order_detail(d), D.payment_info(d), dictionary(spark))


@register("fact_order_refund", with_ctes(f"""
select user_id, order_id, sku_id, province_id, substr(create_time, 1, 10) date_id, create_time,
  refund_type refund_type_code, t.dic_name refund_type_name, refund_reason_type refund_reason_type_code,
  r2.dic_name refund_reason_type_name, r2.dic_name refund_reason_txt, refund_num, refund_amount, dt
from refund_info r {dic_join('t', '15', 'r.refund_type')} {dic_join('r2', '13', 'r.refund_reason_type')}""",
    "refund_info", "dic"))
def q_order_refund(spark, sf):
    """J-12: refund requests with two dictionary decodes."""
    return T.order_refund(D.refund_info(_d(spark, sf)), dictionary(spark))


@register("fact_refund_paid", with_ctes(f"""
select p.user_id, p.order_id, p.sku_id, p.province_id, p.payment_type payment_type_code, d.dic_name payment_type_name,
  substr(p.create_time, 1, 10) date_id, p.create_time callback_time, q.refund_num, p.refund_amount, p.dt
from (select * from refund_info where refund_status = '0705') p
left join (select order_id, sku_id, refund_num from refund_info) q on p.order_id = q.order_id and p.sku_id = q.sku_id
{dic_join('d', '11', 'p.payment_type')}""", "refund_info", "dic"))
def q_refund_paid(spark, sf):
    """J-13: composite-key join (order, sku) back to the request."""
    return T.refund_paid(D.refund_info(_d(spark, sf)), dictionary(spark))


@register("fact_cart_full", with_ctes(f"""
select id, user_id, sku_id, 'sku ' || cast(sku_id as varchar) sku_name, sku_num, '{TDAY}' dt
from cart_all where event_dt <= '{TDAY}' and is_ordered = '0'""", "cart_all"))
def q_cart_full(spark, sf):
    """J-14: periodic snapshot of un-ordered cart rows on D."""
    return T.cart_full(D.cart_snapshot(_d(spark, sf), TDAY))


@register("fact_coupon_get", with_ctes("""
select data.id id, data.coupon_id coupon_id, data.user_id user_id, substr(data.get_time, 1, 10) date_id,
  data.get_time get_time, dt from coupon_use_inc where type = 'insert'""", "coupon_use_inc"))
def q_coupon_get(spark, sf):
    """J-15."""
    return T.coupon_get(D.coupon_use_inc(_d(spark, sf)))


@register("fact_coupon_order", with_ctes("""
select data.id id, data.coupon_id coupon_id, data.user_id user_id, data.order_id order_id,
  substr(data.using_time, 1, 10) date_id, data.using_time order_time, dt
from coupon_use_inc where type = 'update' and list_contains(map_keys(old), 'using_time')""", "coupon_use_inc"))
def q_coupon_order(spark, sf):
    """J-16: updates that changed ``using_time``."""
    return T.coupon_order(D.coupon_use_inc(_d(spark, sf)))


@register("fact_coupon_pay", with_ctes("""
select data.id id, data.coupon_id coupon_id, data.user_id user_id, data.order_id order_id,
  substr(data.used_time, 1, 10) date_id, data.used_time payment_time, dt
from coupon_use_inc where type = 'update' and list_contains(map_keys(old), 'used_time')""", "coupon_use_inc"))
def q_coupon_pay(spark, sf):
    """J-17: updates that changed ``used_time``."""
    return T.coupon_pay(D.coupon_use_inc(_d(spark, sf)))


@register("fact_favor_add", with_ctes("""
select data.id id, data.user_id user_id, data.sku_id sku_id, substr(data.create_time, 1, 10) date_id,
  data.create_time create_time, dt from favor_inc where type = 'insert'""", "favor_inc"))
def q_favor_add(spark, sf):
    """J-18."""
    return T.favor_add(D.interaction_inc(_d(spark, sf), "favor"))


@register("fact_comment", with_ctes(f"""
select id, user_id, sku_id, order_id, date_id, create_time, appraise_code, d.dic_name appraise_name, dt
from (select data.id id, data.user_id user_id, data.sku_id sku_id, data.order_id order_id,
        substr(data.create_time, 1, 10) date_id, data.create_time create_time, data.appraise appraise_code, dt
      from comment_inc where type = 'insert') c {dic_join('d', '12', 'c.appraise_code')}""", "comment_inc", "dic"))
def q_comment(spark, sf):
    """J-19: reviews with the appraise code decoded."""
    return T.comment(D.interaction_inc(_d(spark, sf), "comment"), dictionary(spark))
