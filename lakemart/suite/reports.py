"""Registered report queries (J-49..J-53, J-55..J-61) with DuckDB oracles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.scalar import add_days
from ..oracle.domain import SKU_ATTRS, cte, nd_sql, with_ctes
from .rollups import TD_SQL, _state
from ..operators.distinct import number_ids
from ..plans import facts_log as L
from ..plans import reports as P
from ..plans import rollups as R
from ..registry import register
from ..sinks.writers import stored
from ..sources import domain as D
from ..sources.driver import Driver
from . import facts as _facts  # noqa: F401  (registers page_view / user_login CTEs)

DAY = D.TRADE_DAY
TDAY = D.TRAFFIC_DAY
LO30 = add_days(DAY, -29)
MONEY = {"order_original_amount", "activity_reduce_amount", "coupon_reduce_amount", "order_total_amount",
         "order_refund_amount", "payment_amount"}


def RATIO(a, b):
    # Spark casts a double to decimal through its shortest text form (HALF_UP);
    # going through VARCHAR makes DuckDB round the same way.
    return f"cast(cast(cast({a} as double) / nullif({b}, 0) as varchar) as decimal(16,2))"


def _d(spark, sf):
    return Driver(spark, sf)


# ------------------------------------------------------------------ trade-side frames
def buyer_frames(d, keys, day=DAY):
    """The distinct-set states of orders and refunds of the last 30 days."""
    lo = add_days(day, -29)
    od1d = R.user_sku_order_1d(D.order_detail(d, lo, day), D.sku(d))
    rf1d = R.user_sku_refund_1d(D.refund_info(d, lo, day), D.sku(d))
    return P.buyer_sets(od1d, keys, "order_count_1d"), P.buyer_sets(rf1d, keys, "order_refund_count_1d")


def trade_frames(d, day=DAY):
    lo = add_days(day, -29)
    od1d = R.user_sku_order_1d(D.order_detail(d, lo, day), D.sku(d))
    rf1d = R.user_sku_refund_1d(D.refund_info(d, lo, day), D.sku(d))
    return od1d, R.user_sku_order_nd(od1d, day), rf1d, R.user_sku_refund_nd(rf1d, day)


cte("odnd", nd_sql("od1d", f"user_id, sku_id, {SKU_ATTRS}", R.ORDER_STEMS, DAY, MONEY), ("od1d",))
cte("rfnd", nd_sql("rf1d", f"user_id, sku_id, {SKU_ATTRS}", R.REFUND_STEMS, DAY, MONEY), ("rf1d",))


def trade_by_sql(keys: list[str], day=DAY) -> str:
    k = ", ".join(keys)
    side = """
  select 1 recent_days, {k}, cast(sum({c1}) as bigint) {oc}, count(distinct user_id) {ou}
  from {t1} where dt = '{day}' group by {k}
  union all
  select recent_days, {k}, cast(sum(c) as bigint), count(distinct case when c > 0 then user_id end)
  from (select recent_days, user_id, {k}, case recent_days when 7 then {s}_7d when 30 then {s}_30d end c
        from {tn}, (values (7), (30)) v(recent_days) where dt = '{day}') t
  group by recent_days, {k}"""
    odr = side.format(k=k, c1="order_count_1d", oc="order_count", ou="order_user_count", t1="od1d", tn="odnd",
                      s="order_count", day=day)
    ref = side.format(k=k, c1="order_refund_count_1d", oc="order_refund_count", ou="order_refund_user_count",
                      t1="rf1d", tn="rfnd", s="order_refund_count", day=day)
    on = " and ".join(f"o.{c} = r.{c}" for c in ["recent_days", *keys])
    co = ", ".join(f"coalesce(o.{c}, r.{c}) {c}" for c in keys)
    return f"""select '{day}' dt, coalesce(o.recent_days, r.recent_days) recent_days, {co},
  coalesce(order_count, 0) order_count, coalesce(order_user_count, 0) order_user_count,
  coalesce(order_refund_count, 0) order_refund_count, coalesce(order_refund_user_count, 0) order_refund_user_count
from ({odr}) o full outer join ({ref}) r on {on}"""


@register("rpt_trade_by_brand", with_ctes(trade_by_sql(["tm_id", "tm_name"]), "od1d", "odnd", "rf1d", "rfnd"))
def q_trade_by_brand(spark, sf):
    """J-57: brand trade stats 1/7/30 d (refund users counted distinct, §7.4 #6)."""
    return P.trade_by_brand(*buyer_frames(_d(spark, sf), P.BRAND), DAY)


@register("rpt_trade_by_category", with_ctes(trade_by_sql(list(P.CATE)), "od1d", "odnd", "rf1d", "rfnd"))
def q_trade_by_category(spark, sf):
    """J-58: full outer join on 7 keys (recent_days + category path)."""
    od1d, _, rf1d, _ = trade_frames(_d(spark, sf))
    return P.trade_by_category(od1d, rf1d, DAY)


@register("rpt_repeat_rate_by_brand", with_ctes(f"""
select '{DAY}' dt, cast(recent_days as bigint) recent_days, tm_id, tm_name,
  {RATIO("sum(case when order_count >= 2 then 1 else 0 end)", "sum(case when order_count >= 1 then 1 else 0 end)")}
    order_repeat_rate
from (select recent_days, user_id, tm_id, tm_name, sum(c) order_count
      from (select recent_days, user_id, tm_id, tm_name,
              case recent_days when 7 then order_count_7d when 30 then order_count_30d end c
            from odnd, (values (7), (30)) v(recent_days) where dt = '{DAY}') t1
      group by recent_days, user_id, tm_id, tm_name) t2
group by recent_days, tm_id, tm_name""", "odnd"))
def q_repeat_rate(spark, sf):
    """J-56: aggregate of an aggregate (user × brand, then brand)."""
    _, odnd, _, _ = trade_frames(_d(spark, sf))
    return P.repeat_rate_by_brand(odnd, DAY)


cte("uond", nd_sql("uo1d", "user_id", R.ORDER_STEMS, DAY, MONEY), ("uo1d",))
cte("urnd", nd_sql("ur1d", "user_id", R.REFUND_STEMS, DAY, MONEY), ("ur1d",))


@register("rpt_trade_stats", with_ctes(f"""
select '{DAY}' dt, o.recent_days, order_total_amount, order_count, order_user_count, order_refund_count,
  order_refund_user_count
from (select 1 recent_days, cast(sum(order_total_amount_1d) as decimal(16,2)) order_total_amount,
        cast(sum(order_count_1d) as bigint) order_count, count(*) order_user_count
      from uo1d where dt = '{DAY}'
      union all
      select recent_days, cast(sum(a) as decimal(16,2)), cast(sum(c) as bigint),
        cast(sum(case when c > 0 then 1 else 0 end) as bigint)
      from (select recent_days,
              case recent_days when 7 then order_total_amount_7d when 30 then order_total_amount_30d end a,
              case recent_days when 7 then order_count_7d when 30 then order_count_30d end c
            from uond, (values (7), (30)) v(recent_days) where dt = '{DAY}') t group by recent_days) o
join (select 1 recent_days, cast(sum(order_refund_count_1d) as bigint) order_refund_count,
        count(*) order_refund_user_count from ur1d where dt = '{DAY}'
      union all
      select recent_days, cast(sum(c) as bigint), cast(sum(case when c > 0 then 1 else 0 end) as bigint)
      from (select recent_days,
              case recent_days when 7 then order_refund_count_7d when 30 then order_refund_count_30d end c
            from urnd, (values (7), (30)) v(recent_days) where dt = '{DAY}') t group by recent_days) r
on o.recent_days = r.recent_days""", "uo1d", "uond", "ur1d", "urnd"))
def q_trade_stats(spark, sf):
    """J-60: GMV, orders, buyers, refunds for 1/7/30 days (4 branches, 2 joins)."""
    d = _d(spark, sf)
    uo1d = R.user_order_1d(D.order_detail(d, LO30, DAY))
    ur1d = R.user_refund_1d(D.refund_info(d, LO30, DAY))
    return P.trade_stats(uo1d, R.user_order_nd(uo1d, DAY), ur1d, R.user_refund_nd(ur1d, DAY), DAY)


PROV = "province_id, province_name, area_code, iso_code, iso_3166_2"
cte("pond", nd_sql("po1d", PROV, ["order_count", "order_original_amount", "activity_reduce_amount",
                                  "coupon_reduce_amount", "order_total_amount"], DAY, MONEY), ("po1d",))


@register("rpt_order_by_province", with_ctes(f"""
select '{DAY}' dt, recent_days, province_id, province_name, area_code, iso_code, iso_3166_2 iso_code_3166_2,
  order_count, order_total_amount from (
select 1 recent_days, {PROV}, cast(order_count_1d as bigint) order_count,
  cast(order_total_amount_1d as decimal(16,2)) order_total_amount from po1d where dt = '{DAY}'
union
select recent_days, {PROV}, cast(sum(c) as bigint), cast(sum(a) as decimal(16,2))
from (select recent_days, {PROV},
        case recent_days when 7 then order_count_7d when 30 then order_count_30d end c,
        case recent_days when 7 then order_total_amount_7d when 30 then order_total_amount_30d end a
      from pond, (values (7), (30)) v(recent_days) where dt = '{DAY}') t
group by recent_days, {PROV}) u""", "po1d", "pond"))
def q_order_by_province(spark, sf):
    """J-61: 1-day rows ∪ 7/30-day rows (set union)."""
    d = _d(spark, sf)
    po1d = R.province_order_1d(D.order_detail(d, LO30, DAY), D.province(d))
    return P.order_by_province(po1d, R.province_order_nd(po1d, DAY), DAY)


# ------------------------------------------------------------------ traffic side
cte("session_1d", """
select session_id, mid_id, brand, model, operate_system, version_code, channel,
  cast(sum(during_time) as bigint) during_time_1d, count(*) page_count_1d, dt
from page_view group by session_id, mid_id, brand, model, operate_system, version_code, channel, dt""",
    ("page_view",))


def _session_1d(spark, sf):
    d = _d(spark, sf)
    pv = L.page_view(D.page_log(d, add_days(TDAY, -29), TDAY), D.province(d), rows=d.events.count())
    return R.session_page_view_1d(pv)


CHANNEL_AGGS = f"""cast(count(distinct mid_id) as bigint) uv_count,
  cast(trunc(avg(during_time_1d) / 1000) as bigint) avg_duration_sec,
  cast(trunc(avg(page_count_1d)) as bigint) avg_page_count, cast(count(*) as bigint) sv_count,
  {RATIO("sum(case when page_count_1d = 1 then 1 else 0 end)", "count(*)")} bounce_rate"""


@register("rpt_traffic_by_channel", with_ctes(f"""
select '{TDAY}' dt, recent_days, channel, {CHANNEL_AGGS}
from session_1d, (values (1), (7), (30)) v(recent_days)
where dt >= strftime(date '{TDAY}' - cast(recent_days - 1 as integer), '%Y-%m-%d') and dt <= '{TDAY}'
group by recent_days, channel""", "session_1d"))
def q_traffic_by_channel(spark, sf):
    """J-49 variant B: the last day of each (channel, device) tells its periods."""
    return P.traffic_by_channel(_session_1d(spark, sf), TDAY)


@register("rpt_traffic_by_channel_sets", with_ctes(f"""
select '{TDAY}' dt, recent_days, channel, {CHANNEL_AGGS}
from session_1d, (values (1), (7), (30)) v(recent_days)
where dt >= strftime(date '{TDAY}' - cast(recent_days - 1 as integer), '%Y-%m-%d') and dt <= '{TDAY}'
group by recent_days, channel""", "session_1d"))
def q_traffic_by_channel_sets(spark, sf):
    """J-49 by mergeable states: devices as day bitmaps over a dictionary of the log's devices, OR-ed for 1/7/30 days."""
    d = _d(spark, sf)
    devices = D.page_log(d, add_days(TDAY, -29), TDAY).select(F.col("common.mid").alias("mid_id"))
    return P.traffic_by_channel_sets(_session_1d(spark, sf), TDAY, number_ids(devices, "mid_id", rows=d.events.count()))


@register("rpt_traffic_by_channel_union", with_ctes(" union all ".join(f"""
select '{TDAY}' dt, {p} recent_days, channel, {CHANNEL_AGGS}
from session_1d where dt >= '{add_days(TDAY, -(p - 1))}' and dt <= '{TDAY}' group by channel""" for p in (1, 7, 30)),
    "session_1d"))
def q_traffic_by_channel_union(spark, sf):
    """J-49 variant A: three scans + union all (equivalence pair of variant B)."""
    return P.traffic_by_channel_union(_session_1d(spark, sf), TDAY)


@register("rpt_page_path", with_ctes(f"""
select '{TDAY}' dt, recent_days, source, coalesce(target, 'null') target, count(*) path_count
from (select recent_days, 'step-' || cast(rn as varchar) || ':' || page_id source,
        'step-' || cast(rn + 1 as varchar) || ':' || next_page_id target
      from (select recent_days, page_id,
              lead(page_id, 1) over (partition by session_id, recent_days order by ts, event_id) next_page_id,
              row_number() over (partition by session_id, recent_days order by ts, event_id) rn
            from page_view, (values (1), (7), (30)) v(recent_days)
            where session_id is not null and dt <= '{TDAY}'
              and dt >= strftime(date '{TDAY}' - cast(recent_days - 1 as integer), '%Y-%m-%d')) t1) t2
group by recent_days, source, coalesce(target, 'null')""", "page_view"))
def q_page_path(spark, sf):
    """J-50: lead/row_number per session, counted per day then fanned out.  The page views are read once: the events'
    number, from the files' footers, bounds theirs."""
    d = _d(spark, sf)
    rows = d.events.count()
    return P.page_path(L.page_view(D.page_log(d, add_days(TDAY, -29), TDAY), D.province(d), rows=rows), TDAY, rows)


# login to-date state at D-1 and D
def login_td_sql(day: str) -> str:
    prev = add_days(day, -1)
    return f"""
select coalesce(o.user_id, n.user_id) user_id,
  case when n.user_id is null then o.login_date_last else '{day}' end login_date_last,
  cast(coalesce(o.login_count_td, 0) + coalesce(n.login_count_1d, 0) as bigint) login_count_td, '{day}' dt
from (select u.id user_id, coalesce(l.login_date_last, substr(u.create_time, 1, 10)) login_date_last,
        coalesce(l.login_count_td, 1) login_count_td
      from users u left join (select cast(user_id as bigint) user_id, max(dt) login_date_last, count(*) login_count_td
                              from user_login where dt <= '{prev}' group by user_id) l on u.id = l.user_id) o
full outer join (select cast(user_id as bigint) user_id, count(*) login_count_1d from user_login
                 where dt = '{day}' group by user_id) n
on o.user_id = n.user_id"""


def login_td_first_sql(day: str) -> str:
    return f"""
select u.id user_id, coalesce(l.login_date_last, substr(u.create_time, 1, 10)) login_date_last,
  coalesce(l.login_count_td, 1) login_count_td, '{day}' dt
from users u left join (select cast(user_id as bigint) user_id, max(dt) login_date_last, count(*) login_count_td
                        from user_login where dt <= '{day}' group by user_id) l on u.id = l.user_id"""


cte("login_td", login_td_sql(TDAY), ("users", "user_login"))
cte("login_td_prev", login_td_first_sql(add_days(TDAY, -1)), ("users", "user_login"))


def login_frames(spark, sf, day=TDAY):
    d = _d(spark, sf)
    login = L.user_login(D.page_log(d), D.province(d), rows=d.events.count()).withColumn("user_id", F.col("user_id").cast("bigint"))
    users = D.users(d)
    prev = R.user_login_td_first(users, login, add_days(day, -1))
    today = R.user_login_td_step(prev.drop("dt"), login, day)
    return d, login, prev, today


@register("user_login_td", with_ctes("select * from login_td", "login_td"))
def q_login_td(spark, sf):
    """J-48: first load at D-1 (users left join logins), daily step at D (full outer)."""
    return login_frames(spark, sf)[3]


def login_states(spark, sf, day=TDAY):
    """J-48 on co-bucketed tables: the states of D-1 and D."""
    d = _d(spark, sf)
    login = L.user_login(D.page_log(d), D.province(d), rows=d.events.count()).withColumn("user_id", F.col("user_id").cast("bigint"))
    login = stored(login, "user_login")
    prev, s = add_days(day, -1), _state(spark, "login_td")
    s.write(R.user_login_td_first(D.users(d), login, prev).drop("dt"), prev)
    today = login.where(F.col("dt") == day)
    now = s.advance(prev, R.user_logins_1d(today, day), day, lambda old, inc: R.user_login_td_join(old, inc, day).drop("dt"))
    return now.withColumn("dt", F.lit(day)), s.read(prev)


@register("user_login_td_state", with_ctes("select * from login_td", "login_td"))
def q_login_td_state(spark, sf):
    """J-48: the day's state made without an exchange of the state before."""
    return login_states(spark, sf)[0]


@register("rpt_user_change_state", with_ctes(f"""
select c.dt, user_churn_count, user_back_count
from (select '{TDAY}' dt, count(*) user_churn_count from login_td where login_date_last = '{add_days(TDAY, -7)}') c
join (select '{TDAY}' dt, count(*) user_back_count
      from login_td t1 join login_td_prev t2 on t1.user_id = t2.user_id
      where datediff('day', cast(t2.login_date_last as date), cast(t1.login_date_last as date)) >= 8) b
on c.dt = b.dt""", "login_td", "login_td_prev"))
def q_user_change_state(spark, sf):
    """J-51 on the two co-bucketed states."""
    now, prev = login_states(spark, sf)
    return P.user_change(now, prev, TDAY)


@register("rpt_user_change", with_ctes(f"""
select c.dt, user_churn_count, user_back_count
from (select '{TDAY}' dt, count(*) user_churn_count from login_td where login_date_last = '{add_days(TDAY, -7)}') c
join (select '{TDAY}' dt, count(*) user_back_count
      from login_td t1 join login_td_prev t2 on t1.user_id = t2.user_id
      where datediff('day', cast(t2.login_date_last as date), cast(t1.login_date_last as date)) >= 8) b
on c.dt = b.dt""", "login_td", "login_td_prev"))
def q_user_change(spark, sf):
    """J-51: churned and returning users (self join of the to-date state at D and D-1)."""
    _, _, prev, today = login_frames(spark, sf)
    return P.user_change(today, prev, TDAY)


cte("registrations", """
select data.id user_id, substr(data.create_time, 1, 10) date_id, substr(data.create_time, 1, 10) dt
from user_inc where type in ('bootstrap-insert', 'insert')""", ("user_inc",))


@register("rpt_retention", with_ctes(f"""
select '{TDAY}' dt, login_date_first create_date,
  cast(datediff('day', cast(login_date_first as date), date '{TDAY}') as integer) retention_day,
  cast(sum(case when login_date_last = '{TDAY}' then 1 else 0 end) as bigint) retention_count,
  count(*) new_user_count,
  {RATIO("sum(case when login_date_last = '" + TDAY + "' then 1 else 0 end) * 100", "count(*)")} retention_rate
from (select user_id, date_id login_date_first from registrations
      where dt >= '{add_days(TDAY, -7)}' and dt < '{TDAY}') t1
join login_td t2 on t1.user_id = t2.user_id
group by login_date_first""", "registrations", "login_td"))
def q_retention(spark, sf):
    """J-52: cohorts registered D-7..D-1 still logging in on D."""
    d, _, _, today = login_frames(spark, sf)
    return P.retention(R.registrations(D.user_inc(d, TDAY)), today, TDAY)


@register("rpt_user_stats", with_ctes(f"""
select '{TDAY}' dt, n.recent_days, new_user_count, active_user_count
from (select recent_days, cast(sum(case when date_id >= strftime(date '{TDAY}' - cast(recent_days - 1 as integer),
        '%Y-%m-%d') then 1 else 0 end) as bigint) new_user_count
      from registrations, (values (1), (7), (30)) v(recent_days) where dt <= '{TDAY}' group by recent_days) n
join (select recent_days, cast(sum(case when login_date_last >= strftime(date '{TDAY}' - cast(recent_days - 1 as integer),
        '%Y-%m-%d') then 1 else 0 end) as bigint) active_user_count
      from login_td, (values (1), (7), (30)) v(recent_days) group by recent_days) a
on n.recent_days = a.recent_days""", "registrations", "login_td"))
def q_user_stats(spark, sf):
    """J-53: new users (registrations) and active users (logins), 1/7/30 d."""
    d, _, _, today = login_frames(spark, sf)
    return P.user_stats(today, R.registrations(D.user_inc(d, TDAY)), TDAY)


# ------------------------------------------------------------------ cart / payment rollups and the reports on them
from ..plans import facts_trade as T  # noqa: E402
from ..sources.dictionary import dictionary  # noqa: E402

cte("ca1d", """
select user_id, count(*) cart_add_count_1d, cast(sum(sku_num) as bigint) cart_add_num_1d, dt
from (select data.user_id user_id, case when type = 'insert' then data.sku_num
        else data.sku_num - cast(old['sku_num'] as bigint) end sku_num, dt
      from cart_inc where type = 'insert' or (type = 'update' and old['sku_num'] is not null
                                              and data.sku_num > cast(old['sku_num'] as bigint))) c
group by user_id, dt""", ("cart_inc",))
cte("cand", nd_sql("ca1d", "user_id", ["cart_add_count", "cart_add_num"], TDAY), ("ca1d",))
cte("up1d", """
select user_id, count(distinct order_id) payment_count_1d, cast(sum(sku_num) as bigint) payment_num_1d,
  cast(sum(split_payment_amount) as decimal(16,2)) payment_amount_1d, dt
from pay_detail group by user_id, dt""", ("pay_detail",))
cte("upnd", nd_sql("up1d", "user_id", R.PAY_STEMS, DAY, MONEY), ("up1d",))
TD_PAY_SQL = """select user_id, min(dt) payment_date_first, max(dt) payment_date_last,
  cast(sum(payment_count_1d) as bigint) payment_count_td, cast(sum(payment_num_1d) as bigint) payment_num_td,
  cast(sum(payment_amount_1d) as decimal(16,2)) payment_amount_td, '{day}' dt
from up1d where dt <= '{day}' group by user_id"""
cte("uptd", TD_PAY_SQL.format(day=DAY), ("up1d",))


def _cart_add_1d(spark, sf):
    return R.user_cart_add_1d(T.cart_add(D.cart_inc(_d(spark, sf)), dictionary(spark)))


def _pay_1d(spark, sf, lo=None, hi=None):
    d = _d(spark, sf)
    return R.user_payment_1d(T.pay_detail(D.order_detail(d, lo, hi), D.payment_info(d, lo, hi), dictionary(spark)))


@register("user_cart_add_1d", with_ctes("select * from ca1d", "ca1d"))
def q_cart_add_1d(spark, sf):
    """J-34."""
    return _cart_add_1d(spark, sf)


@register("user_cart_add_nd", with_ctes("select * from cand", "cand"))
def q_cart_add_nd(spark, sf):
    """J-35 (read by the funnel but never created in the reference; built by analogy)."""
    return R.user_cart_add_nd(_cart_add_1d(spark, sf), TDAY)


@register("user_payment_1d", with_ctes("select * from up1d", "up1d"))
def q_payment_1d(spark, sf):
    """J-36."""
    return _pay_1d(spark, sf)


@register("user_payment_nd", with_ctes("select * from upnd", "upnd"))
def q_payment_nd(spark, sf):
    """J-37."""
    return R.user_payment_nd(_pay_1d(spark, sf, LO30, DAY), DAY)


@register("user_payment_td", with_ctes("select * from uptd", "uptd"))
def q_payment_td(spark, sf):
    """J-38 (daily step from the D-1 state; equals the first-load aggregate at D)."""
    prev = R.user_payment_td_first(_pay_1d(spark, sf, None, add_days(DAY, -1)), add_days(DAY, -1)).drop("dt")
    return R.user_payment_td_step(prev, _pay_1d(spark, sf, DAY, DAY), DAY)


@register("user_payment_td_state", with_ctes("select * from uptd", "uptd"))
def q_payment_td_state(spark, sf):
    """J-38 on co-bucketed tables."""
    prev, s = add_days(DAY, -1), _state(spark, "payment_td")
    s.write(R.user_payment_td_first(_pay_1d(spark, sf, None, prev), prev).drop("dt"), prev)
    return s.joined(prev, _pay_1d(spark, sf, DAY, DAY), DAY, lambda old, today: R.user_payment_td_step(old, today, DAY))


@register("session_page_view_1d", with_ctes("select * from session_1d", "session_1d"))
def q_session_1d(spark, sf):
    """J-43 (every day)."""
    d = _d(spark, sf)
    return R.session_page_view_1d(L.page_view(D.page_log(d), D.province(d), rows=d.events.count()))


cte("pv1d", """
select mid_id, brand, model, operate_system, page_id, cast(sum(during_time) as bigint) during_time_1d,
  count(*) view_count_1d, dt
from page_view group by mid_id, brand, model, operate_system, page_id, dt""", ("page_view",))
cte("pvnd", nd_sql("pv1d", "mid_id, brand, model, operate_system, page_id", ["during_time", "view_count"], TDAY),
    ("pv1d",))


def _pv1d(spark, sf, lo=None, hi=None):
    d = _d(spark, sf)
    return R.page_visitor_view_1d(L.page_view(D.page_log(d, lo, hi), D.province(d), rows=d.events.count()))


@register("page_visitor_view_1d", with_ctes("select * from pv1d", "pv1d"))
def q_pv1d(spark, sf):
    """J-44."""
    return _pv1d(spark, sf)


@register("page_visitor_view_nd", with_ctes(
    "select mid_id, brand, model, operate_system, page_id, during_time_7d, view_count_7d, during_time_30d, "
    "view_count_30d, dt from pvnd", "pvnd"))
def q_pvnd(spark, sf):
    """J-45."""
    return R.page_visitor_view_nd(_pv1d(spark, sf, add_days(TDAY, -29), TDAY), TDAY)


@register("rpt_new_buyers", with_ctes(f"""
select '{DAY}' dt, o.recent_days, new_order_user_count, new_payment_user_count
from (select recent_days, cast(sum(case when order_date_first >= strftime(date '{DAY}' - cast(recent_days - 1 as integer),
        '%Y-%m-%d') then 1 else 0 end) as bigint) new_order_user_count
      from ({TD_SQL.format(day=DAY)}) t, (values (1), (7), (30)) v(recent_days) group by recent_days) o
join (select recent_days, cast(sum(case when payment_date_first >= strftime(date '{DAY}' - cast(recent_days - 1 as integer),
        '%Y-%m-%d') then 1 else 0 end) as bigint) new_payment_user_count
      from uptd, (values (1), (7), (30)) v(recent_days) group by recent_days) p
on o.recent_days = p.recent_days""", "uo1d", "uptd"))
def q_new_buyers(spark, sf):
    """J-55: first-time orderers and payers from the to-date states."""
    d = _d(spark, sf)
    otd = R.user_order_td_first(R.user_order_1d(D.order_detail(d)), DAY)
    ptd = R.user_payment_td_first(_pay_1d(spark, sf), DAY)
    return P.new_buyers(otd, ptd, DAY)


@register("rpt_cart_top3_by_category", with_ctes(f"""
select '{TDAY}' dt, category1_id, category1_name, category2_id, category2_name, category3_id, category3_name,
  sku_id, sku_name, cart_num, rk
from (select cart.sku_id, s.sku_name, s.category1_id, s.category1_name, s.category2_id, s.category2_name,
        s.category3_id, s.category3_name, cart_num,
        rank() over (partition by s.category1_id, s.category2_id, s.category3_id order by cart_num desc) rk
      from (select sku_id, cast(sum(sku_num) as bigint) cart_num from cart_all
            where event_dt <= '{TDAY}' and is_ordered = '0' group by sku_id) cart
      left join sku s on cart.sku_id = s.id) t
where rk <= 3""", "cart_all", "sku"))
def q_cart_top3(spark, sf):
    """J-59: top 3 SKUs in carts per category, ties kept (rank + WindowGroupLimit)."""
    d = _d(spark, sf)
    return P.cart_top3_by_category(T.cart_full(D.cart_snapshot(d, TDAY)), D.sku(d), TDAY)


FUNNEL_HOME, FUNNEL_DETAIL = "view", "click"  # page ids of the event stream standing in for home / detail
# The driver's orders and events lie years apart.  The funnel reads both in one month, so the
# 30 days of trade up to DAY are dated as the 30 days up to TDAY.
SHIFT = (date.fromisoformat(TDAY) - date.fromisoformat(DAY)).days


def _redated_sql(t: str) -> str:
    return f"""(select * replace (strftime(cast(dt as date) + cast({SHIFT} as integer), '%Y-%m-%d') as dt)
      from {t} where dt >= '{LO30}' and dt <= '{DAY}')"""


def _redated(df):
    return df.withColumn("dt", F.date_format(F.date_add(F.col("dt").cast("date"), SHIFT), "yyyy-MM-dd"))


@register("rpt_funnel", with_ctes(f"""
select '{TDAY}' dt, pg.recent_days, home_count, good_detail_count, cart_count, order_count, payment_count
from (select 1 recent_days, cast(sum(case when page_id = '{FUNNEL_HOME}' then 1 else 0 end) as bigint) home_count,
        cast(sum(case when page_id = '{FUNNEL_DETAIL}' then 1 else 0 end) as bigint) good_detail_count
      from pv1d where dt = '{TDAY}' and page_id in ('{FUNNEL_HOME}', '{FUNNEL_DETAIL}')
      union all
      select recent_days, cast(sum(case when page_id = '{FUNNEL_HOME}' and vc > 0 then 1 else 0 end) as bigint),
        cast(sum(case when page_id = '{FUNNEL_DETAIL}' and vc > 0 then 1 else 0 end) as bigint)
      from (select recent_days, page_id, case recent_days when 7 then view_count_7d when 30 then view_count_30d end vc
            from pvnd, (values (7), (30)) v(recent_days)
            where dt = '{TDAY}' and page_id in ('{FUNNEL_HOME}', '{FUNNEL_DETAIL}')) t group by recent_days) pg
join (select 1 recent_days, count(*) cart_count from ca1d where dt = '{TDAY}'
      union all
      select recent_days, cast(sum(case when c > 0 then 1 else 0 end) as bigint)
      from (select recent_days, case recent_days when 7 then cart_add_count_7d when 30 then cart_add_count_30d end c
            from cand, (values (7), (30)) v(recent_days) where dt = '{TDAY}') t group by recent_days) ct
  on pg.recent_days = ct.recent_days
join (select 1 recent_days, count(*) order_count from {_redated_sql('uo1d')} r where dt = '{TDAY}'
      union all
      select recent_days, cast(sum(case when c > 0 then 1 else 0 end) as bigint)
      from (select recent_days, case recent_days when 7 then order_count_7d when 30 then order_count_30d end c
            from ({nd_sql(_redated_sql("uo1d") + " r", "user_id", R.ORDER_STEMS, TDAY, MONEY)}) n, (values (7), (30)) v(recent_days)) t
      group by recent_days) od on pg.recent_days = od.recent_days
join (select 1 recent_days, count(*) payment_count from {_redated_sql('up1d')} r where dt = '{TDAY}'
      union all
      select recent_days, cast(sum(case when c > 0 then 1 else 0 end) as bigint)
      from (select recent_days, case recent_days when 7 then payment_count_7d when 30 then payment_count_30d end c
            from ({nd_sql(_redated_sql("up1d") + " r", "user_id", R.PAY_STEMS, TDAY, MONEY)}) n, (values (7), (30)) v(recent_days)) t
      group by recent_days) py on pg.recent_days = py.recent_days""", "pv1d", "pvnd", "ca1d", "cand", "uo1d", "up1d"))
def q_funnel(spark, sf):
    """J-54 at the traffic day, over a month that holds page, cart, order and payment rows
    (the trade month is dated as the traffic month): all three periods."""
    d = _d(spark, sf)
    pv1d = _pv1d(spark, sf)
    ca1d = _cart_add_1d(spark, sf)
    uo1d = _redated(R.user_order_1d(D.order_detail(d, LO30, DAY)))
    up1d = _redated(_pay_1d(spark, sf, LO30, DAY))
    return P.funnel(pv1d, R.page_visitor_view_nd(pv1d, TDAY), ca1d, R.user_cart_add_nd(ca1d, TDAY),
                    uo1d, R.user_order_nd(uo1d, TDAY), up1d, R.user_payment_nd(up1d, TDAY), TDAY,
                    home=FUNNEL_HOME, detail=FUNNEL_DETAIL)
