"""DuckDB versions of the landed frames in ``lakemart.sources.domain``.

Each entry is ``name -> (sql, dependencies)``; ``with_ctes`` prepends exactly the
frames a query needs, in dependency order.
"""

from __future__ import annotations

import re

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, deps: tuple[str, ...] = ()):
    CTES[name] = (sql, deps)


cte("order_detail", """
select l_orderkey order_id, o_custkey user_id, l_partkey sku_id, c_nationkey province_id,
  case when l_discount > 0 then l_suppkey % 7 end activity_id,
  case when l_discount > 0 then l_suppkey % 7 * 10 + l_linenumber % 3 end activity_rule_id,
  case when l_tax > 0 then l_suppkey % 10 end coupon_id,
  '240' || cast(l_linenumber % 4 + 1 as varchar) source_type,
  l_suppkey source_id,
  cast(l_quantity as bigint) sku_num,
  cast(l_extendedprice as decimal(16,2)) split_original_amount,
  case when l_discount > 0 then cast(cast(l_extendedprice as decimal(16,2)) * cast(l_discount as decimal(16,2)) as decimal(16,2)) end split_activity_amount,
  case when l_tax > 0 then cast(cast(l_extendedprice as decimal(16,2)) * cast(l_tax as decimal(16,2)) as decimal(16,2)) end split_coupon_amount,
  cast(cast(l_extendedprice as decimal(16,2))
       - coalesce(case when l_discount > 0 then cast(cast(l_extendedprice as decimal(16,2)) * cast(l_discount as decimal(16,2)) as decimal(16,2)) end, 0)
       - coalesce(case when l_tax > 0 then cast(cast(l_extendedprice as decimal(16,2)) * cast(l_tax as decimal(16,2)) as decimal(16,2)) end, 0)
       as decimal(16,2)) split_total_amount,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') create_time,
  strftime(o_orderdate, '%Y-%m-%d') dt
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""")

cte("order_info", """
select o_orderkey order_id, o_custkey user_id, c_nationkey province_id,
  case o_orderstatus when 'F' then '1002' when 'P' then '1003' else '1001' end order_status,
  '110' || substr(o_orderpriority, 1, 1) payment_type,
  cast(o_totalprice as decimal(16,2)) total_amount,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') create_time,
  strftime(o_orderdate, '%Y-%m-%d') dt
from orders join customer on o_custkey = c_custkey""")

cte("payment_info", """
select order_id id, order_id, user_id, province_id, payment_type, total_amount,
  '1602' payment_status, create_time callback_time, dt
from order_info where order_status = '1002'""", ("order_info",))

cte("refund_info", """
select l_orderkey order_id, o_custkey user_id, l_partkey sku_id, c_nationkey province_id,
  '150' || cast(l_linenumber % 2 + 1 as varchar) refund_type,
  cast(l_quantity as bigint) refund_num,
  cast(l_extendedprice as decimal(16,2)) refund_amount,
  '130' || cast(l_linenumber % 7 + 1 as varchar) refund_reason_type,
  case when l_linestatus = 'F' then '0705' else '0701' end refund_status,
  '110' || substr(o_orderpriority, 1, 1) payment_type,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') create_time,
  strftime(l_shipdate, '%Y-%m-%d') dt
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
where l_returnflag = 'R'""")

cte("sku", """
select p_partkey id, p_name sku_name, cast(p_retailprice as decimal(16,2)) price,
  p_brand tm_id, p_brand tm_name, p_type category1_id, p_type category1_name,
  concat_ws('/', p_type, cast(p_size as varchar)) category2_id,
  concat_ws('/', p_type, cast(p_size as varchar)) category2_name,
  concat_ws('/', p_type, cast(p_size as varchar), p_name) category3_id,
  concat_ws('/', p_type, cast(p_size as varchar), p_name) category3_name
from part""")

cte("users", """
select c_custkey id, lower(replace(c_name, '#', '_')) login_name, c_name name,
  '138' || lpad(cast(c_custkey as varchar), 8, '0') phone_num,
  cast(c_custkey as varchar) || '@mail.test' email,
  cast(c_nationkey % 5 + 1 as varchar) user_level,
  case when c_custkey % 2 = 0 then 'F' else 'M' end gender,
  strftime(date '2024-01-01' + cast(c_custkey % 30 as integer), '%Y-%m-%d') || ' 08:00:00' create_time,
  c_nationkey province_id
from customer""")

cte("page_log", """
select
  struct_pack(ar := lpad(cast(user_id % 25 as varchar), 6, '0'), ba := 'brand' || cast(user_id % 3 as varchar),
    ch := 'ch' || cast(user_id % 5 as varchar),
    is_new := case when user_id % 3 = 0 then '1' else '0' end,
    md := 'model' || cast(user_id % 4 as varchar), mid := cast(user_id as varchar),
    os := 'os' || cast(user_id % 2 as varchar),
    uid := case when event_id % 4 <> 0 then cast(user_id as varchar) end,
    vc := 'v' || cast(user_id % 3 as varchar)) common,
  struct_pack(during_time := cast(floor(value * 1000) as bigint), item := cast(event_id % 200 as varchar),
    item_type := 'sku_id', last_page_id := case when event_type <> 'signup' then 'home' end,
    page_id := event_type, source_type := '2401') page,
  case when event_type = 'click' then list_transform(generate_series(1, 1 + k % 3), lambda x:
    struct_pack(action_id := 'act' || cast(x as varchar), item := cast(event_id % 200 as varchar),
                item_type := 'sku_id', ts := cast(ms + x as bigint))) end actions,
  case when event_type = 'view' then list_transform(generate_series(1, 1 + k % 2), lambda x:
    struct_pack(display_type := 'promotion', item := cast((event_id + x) % 200 as varchar),
                item_type := 'sku_id', "order" := cast(x as varchar), pos_id := cast(k % 5 as varchar))) end displays,
  case when event_type = 'signup' then struct_pack(entry := 'icon', loading_time := cast(k as bigint),
    open_ad_id := cast(k % 7 as bigint), open_ad_ms := cast(k * 10 as bigint),
    open_ad_skip_ms := cast(k * 5 as bigint)) end "start",
  case when event_type = 'error' then struct_pack(error_code := cast(k as bigint),
    msg := 'error ' || cast(k as varchar)) end err,
  ms ts, event_id, strftime(ts, '%Y-%m-%d') dt
from (select *, cast(json_extract_string(props, '$.k') as integer) k, epoch_us(ts) // 1000 ms from events) e""")

cte("cart_all", """
select event_id id, user_id, event_id % 200 sku_id, cast(floor(value) + 1 as bigint) sku_num,
  case when cast(json_extract_string(props, '$.k') as integer) % 3 = 0 then '1' else '0' end is_ordered,
  strftime(ts, '%Y-%m-%d %H:%M:%S') create_time, strftime(ts, '%Y-%m-%d') event_dt
from events where event_type = 'click'""")


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it names (and their dependencies)."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    body = body.strip()
    parts = [f"{n} as ({CTES[n][0].strip()})" for n in order]
    if re.match(r"(?is)^with\s", body):
        return "with " + ",\n".join(parts) + ",\n" + body[4:].lstrip()
    return "with " + ",\n".join(parts) + "\n" + body


# ---------------------------------------------------------------- rollup layer (day-free)
SKU_ATTRS = ("sku_name, category1_id, category1_name, category2_id, category2_name, "
             "category3_id, category3_name, tm_id, tm_name")

cte("od1d", f"""
select od.user_id, od.sku_id, {', '.join('s.' + a.strip() for a in SKU_ATTRS.split(','))},
  od.order_count_1d, od.order_num_1d, od.order_original_amount_1d, od.activity_reduce_amount_1d,
  od.coupon_reduce_amount_1d, od.order_total_amount_1d, od.dt
from (select dt, user_id, sku_id, count(*) order_count_1d, cast(sum(sku_num) as bigint) order_num_1d,
        cast(sum(split_original_amount) as decimal(16,2)) order_original_amount_1d,
        cast(sum(coalesce(split_activity_amount, 0)) as decimal(16,2)) activity_reduce_amount_1d,
        cast(sum(coalesce(split_coupon_amount, 0)) as decimal(16,2)) coupon_reduce_amount_1d,
        cast(sum(split_total_amount) as decimal(16,2)) order_total_amount_1d
      from order_detail group by dt, user_id, sku_id) od
left join sku s on od.sku_id = s.id""", ("order_detail", "sku"))

cte("rf1d", f"""
select r.user_id, r.sku_id, {', '.join('s.' + a.strip() for a in SKU_ATTRS.split(','))},
  r.order_refund_count_1d, r.order_refund_num_1d, r.order_refund_amount_1d, r.dt
from (select dt, user_id, sku_id, count(*) order_refund_count_1d, cast(sum(refund_num) as bigint) order_refund_num_1d,
        cast(sum(refund_amount) as decimal(16,2)) order_refund_amount_1d
      from refund_info group by dt, user_id, sku_id) r
left join sku s on r.sku_id = s.id""", ("refund_info", "sku"))

cte("uo1d", """
select user_id, count(distinct order_id) order_count_1d, cast(sum(sku_num) as bigint) order_num_1d,
  cast(sum(split_original_amount) as decimal(16,2)) order_original_amount_1d,
  cast(sum(coalesce(split_activity_amount, 0)) as decimal(16,2)) activity_reduce_amount_1d,
  cast(sum(coalesce(split_coupon_amount, 0)) as decimal(16,2)) coupon_reduce_amount_1d,
  cast(sum(split_total_amount) as decimal(16,2)) order_total_amount_1d, dt
from order_detail group by user_id, dt""", ("order_detail",))

cte("ur1d", """
select user_id, count(*) order_refund_count_1d, cast(sum(refund_num) as bigint) order_refund_num_1d,
  cast(sum(refund_amount) as decimal(16,2)) order_refund_amount_1d, dt
from refund_info group by user_id, dt""", ("refund_info",))

cte("province", """
select n_nationkey id, n_name province_name, r_regionkey region_id, r_name region_name,
  lpad(cast(n_nationkey as varchar), 6, '0') area_code, 'CN-' || cast(n_nationkey as varchar) iso_code,
  'CN-' || upper(substr(n_name, 1, 2)) iso_3166_2
from nation left join region on n_regionkey = r_regionkey""")

cte("po1d", """
select o.province_id, p.province_name, p.area_code, p.iso_code, p.iso_3166_2,
  o.order_count_1d, o.order_original_amount_1d, o.activity_reduce_amount_1d, o.coupon_reduce_amount_1d,
  o.order_total_amount_1d, o.dt
from (select province_id, dt, count(distinct order_id) order_count_1d,
        cast(sum(split_original_amount) as decimal(16,2)) order_original_amount_1d,
        cast(sum(coalesce(split_activity_amount, 0)) as decimal(16,2)) activity_reduce_amount_1d,
        cast(sum(coalesce(split_coupon_amount, 0)) as decimal(16,2)) coupon_reduce_amount_1d,
        cast(sum(split_total_amount) as decimal(16,2)) order_total_amount_1d
      from order_detail group by province_id, dt) o
left join province p on o.province_id = p.id""", ("order_detail", "province"))


def nd_sql(src: str, keys: str, stems: list[str], day: str, money: set[str] = frozenset()) -> str:
    """SQL for a 7/30-day rollup of a 1-day CTE."""
    from ..functions.scalar import add_days
    lo7, lo30 = add_days(day, -6), add_days(day, -29)
    cols = []
    for w, lo in ((7, lo7), (30, None)):
        for s in stems:
            typ = "decimal(16,2)" if s in money else "bigint"
            v = f"{s}_1d" if lo is None else f"case when dt >= '{lo}' then {s}_1d else 0 end"
            cols.append(f"cast(sum({v}) as {typ}) {s}_{w}d")
    return (f"select {keys}, {', '.join(cols)}, '{day}' dt from {src} "
            f"where dt >= '{lo30}' and dt <= '{day}' group by {keys}")


def user_inc_sql(day: str) -> str:
    from ..functions.scalar import add_days
    prev = add_days(day, -1)
    data = ("struct_pack(id := id, login_name := login_name, nick_name := name, name := name, "
            "phone_num := phone_num, email := email, user_level := {lvl}, "
            "birthday := strftime(date '1980-01-01' + cast(id % 7300 as integer), '%Y-%m-%d'), "
            "gender := gender, create_time := create_time, operate_time := {op})")
    return f"""
select 'bootstrap-insert' type, epoch(strptime(create_time, '%Y-%m-%d %H:%M:%S'))::bigint ts,
  {data.format(lvl='user_level', op='cast(null as varchar)')} data, cast(null as map(varchar, varchar)) old, '{prev}' dt
from users where substr(create_time, 1, 10) < '{day}'
union all
select 'insert', epoch(strptime(create_time, '%Y-%m-%d %H:%M:%S'))::bigint,
  {data.format(lvl='user_level', op='cast(null as varchar)')}, cast(null as map(varchar, varchar)), '{day}'
from users where substr(create_time, 1, 10) = '{day}'
union all
select 'update', epoch(timestamp '{day} 10:00:00')::bigint + v,
  {data.format(lvl='cast(v + 1 as varchar)', op=f"'{day} 10:00:0' || cast(v as varchar)")},
  map(['user_level'], [cast(v as varchar)]), '{day}'
from users, (values (1), (2)) t(v) where id % 5 = 1"""


cte("cart_inc", """
select 'insert' type, ts_s ts, struct_pack(id := event_id, user_id := user_id, sku_id := event_id % 200, sku_num := num,
    source_id := event_id % 50, source_type := '240' || cast(event_id % 4 + 1 as varchar)) data,
  cast(null as map(varchar, varchar)) old, dt
from c
union all
select 'update', ts_s + 60, struct_pack(id := event_id, user_id := user_id, sku_id := event_id % 200,
    sku_num := case when k % 4 = 1 then num + 2 else num end,
    source_id := event_id % 50, source_type := '240' || cast(event_id % 4 + 1 as varchar)),
  case when k % 4 = 1 then map(['sku_num'], [cast(num as varchar)])
       when k % 4 = 2 then map(['sku_num'], [cast(num + 1 as varchar)])
       else map(['is_checked'], ['0']) end, dt
from c where k % 4 <> 0""")
CTES["cart_inc"] = ("with c as (select event_id, user_id, cast(floor(value) + 1 as bigint) num, "
                    "cast(json_extract_string(props, '$.k') as integer) k, epoch_us(ts) // 1000000 ts_s, "
                    "strftime(ts, '%Y-%m-%d') dt from events where event_type = 'click') " + CTES["cart_inc"][0], ())

cte("order_inc", """
with j as (select o_orderkey, o_custkey, o_orderstatus, o_orderdate, c_nationkey,
             cast(o_orderdate as date) d, cast(o_orderdate as date) + cast(o_orderkey % 2 as integer) cd
           from orders join customer on o_custkey = c_custkey)
select 'insert' type, epoch_us(o_orderdate) // 1000000 ts,
  struct_pack(id := o_orderkey, user_id := o_custkey, province_id := c_nationkey, order_status := '1001',
              operate_time := cast(null as varchar)) data,
  cast(null as map(varchar, varchar)) old, strftime(o_orderdate, '%Y-%m-%d') dt
from j
union all
select 'update', epoch(cast(cd as timestamp))::bigint,
  struct_pack(id := o_orderkey, user_id := o_custkey, province_id := c_nationkey, order_status := '1003',
              operate_time := strftime(cd, '%Y-%m-%d') || ' 12:00:00'),
  map(['order_status'], ['1001']), strftime(cd, '%Y-%m-%d')
from j where o_orderstatus = 'P'
union all
select 'update', epoch(cast(cd + 1 as timestamp))::bigint,
  struct_pack(id := o_orderkey, user_id := o_custkey, province_id := c_nationkey, order_status := '1003',
              operate_time := strftime(cd + 1, '%Y-%m-%d') || ' 09:00:00'),
  map(['order_comment'], ['']), strftime(cd + 1, '%Y-%m-%d')
from j where o_orderstatus = 'P' and o_orderkey % 3 = 0""")

cte("coupon_use_inc", """
with u as (select distinct on (l_orderkey, l_suppkey % 10) l_orderkey order_id, l_suppkey % 10 coupon_id,
             o_custkey user_id, o_orderstatus, o_orderdate, cast(o_orderdate as date) - 1 gd
           from lineitem join orders on l_orderkey = o_orderkey where l_tax > 0)
select 'insert' type, epoch(cast(gd as timestamp))::bigint ts,
  struct_pack(id := order_id * 10 + coupon_id, coupon_id := coupon_id, user_id := user_id, order_id := order_id,
    get_time := strftime(gd, '%Y-%m-%d') || ' 10:00:00', using_time := cast(null as varchar),
    used_time := cast(null as varchar)) data,
  cast(null as map(varchar, varchar)) old, strftime(gd, '%Y-%m-%d') dt
from u
union all
select 'update', epoch_us(o_orderdate) // 1000000,
  struct_pack(id := order_id * 10 + coupon_id, coupon_id := coupon_id, user_id := user_id, order_id := order_id,
    get_time := strftime(gd, '%Y-%m-%d') || ' 10:00:00', using_time := strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'),
    used_time := cast(null as varchar)),
  map(['using_time', 'coupon_status'], [cast(null as varchar), '1401']), strftime(o_orderdate, '%Y-%m-%d')
from u
union all
select 'update', epoch_us(o_orderdate) // 1000000 + 1,
  struct_pack(id := order_id * 10 + coupon_id, coupon_id := coupon_id, user_id := user_id, order_id := order_id,
    get_time := strftime(gd, '%Y-%m-%d') || ' 10:00:00', using_time := strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'),
    used_time := strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')),
  map(['used_time', 'coupon_status'], [cast(null as varchar), '1402']), strftime(o_orderdate, '%Y-%m-%d')
from u where o_orderstatus = 'F'""")

cte("favor_inc", """
select 'insert' type, epoch_us(ts) // 1000000 ts,
  struct_pack(id := event_id, user_id := user_id, sku_id := event_id % 200, is_cancel := '0',
              create_time := strftime(ts, '%Y-%m-%d %H:%M:%S')) data,
  cast(null as map(varchar, varchar)) old, strftime(ts, '%Y-%m-%d') dt
from events where event_type = 'view' and cast(json_extract_string(props, '$.k') as integer) % 10 = 0""")

cte("comment_inc", """
select 'insert' type, epoch_us(ts) // 1000000 ts,
  struct_pack(id := event_id, user_id := user_id, sku_id := event_id % 200, order_id := event_id,
              appraise := '120' || cast(cast(json_extract_string(props, '$.k') as integer) % 4 + 1 as varchar),
              create_time := strftime(ts, '%Y-%m-%d %H:%M:%S')) data,
  cast(null as map(varchar, varchar)) old, strftime(ts, '%Y-%m-%d') dt
from events where event_type = 'purchase'""")
