"""Registered dimension queries (J-01..J-07) and the coupon/activity rollups and
reports built on them (J-46, J-47, J-62, J-63)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.codes import OPEN_END
from ..functions.scalar import add_days
from ..oracle.domain import cte, with_ctes
from ..plans import dims as DM
from ..plans import reports as P
from ..plans import rollups as R
from ..registry import register
from ..sinks import writers as K
from ..sources import domain as D
from ..sources import snapshots as S
from ..sources.dictionary import dictionary
from ..sources.driver import Driver
from ..sources.readers import read_delimited
from .facts import dic_join
from .reports import RATIO

DAY = D.TRADE_DAY
TDAY = D.TRAFFIC_DAY
FIRST = add_days(TDAY, -1)


def _d(spark, sf):
    return Driver(spark, sf)


C2 = "concat_ws('/', p_type, cast(p_size as varchar))"
C3 = "concat_ws('/', p_type, cast(p_size as varchar), p_name)"

cte("dim_sku", f"""
with sku as (select p_partkey id, p_name spu_id, cast(p_retailprice as decimal(16,2)) price, p_name sku_name,
               concat_ws(' ', p_name, p_type) sku_desc, cast(p_size as decimal(16,2)) weight, p_brand tm_id,
               {C3} category3_id, case when p_partkey % 10 = 0 then '0' else '1' end is_sale,
               '2001-01-01 00:00:00' create_time from part),
  spu as (select distinct p_name id, 'spu ' || p_name spu_name from part),
  c3 as (select distinct {C3} id, {C3} name, {C2} category2_id from part),
  c2 as (select distinct {C2} id, {C2} name, p_type category1_id from part),
  c1 as (select distinct p_type id, p_type name from part),
  tm as (select distinct p_brand id, p_brand tm_name from part),
  attr as (select l_partkey sku_id, list_sort(list(struct_pack(attr_id := '1', value_id := cast(l_suppkey as varchar),
             attr_name := 'supplier', value_name := s_name))) attrs
           from (select distinct l_partkey, l_suppkey from lineitem) p left join supplier on l_suppkey = s_suppkey
           group by l_partkey),
  sale as (select l_partkey sku_id, list_sort(list(struct_pack(sale_attr_id := '1', sale_attr_value_id := l_returnflag,
             sale_attr_name := 'return flag', sale_attr_value_name := l_returnflag))) sale_attrs
           from (select distinct l_partkey, l_returnflag from lineitem) p group by l_partkey)
select sku.id, price, sku_name, sku_desc, weight, is_sale = '1' is_sale, spu_id, spu_name, sku.category3_id,
  c3.name category3_name, c3.category2_id, c2.name category2_name, c2.category1_id, c1.name category1_name,
  sku.tm_id, tm.tm_name, attr.attrs sku_attr_values, sale.sale_attrs sku_sale_attr_values, create_time
from sku left join spu on sku.spu_id = spu.id left join c3 on sku.category3_id = c3.id
left join c2 on c3.category2_id = c2.id left join c1 on c2.category1_id = c1.id left join tm on sku.tm_id = tm.id
left join attr on sku.id = attr.sku_id left join sale on sku.id = sale.sku_id""")


@register("dim_sku", with_ctes("select * from dim_sku", "dim_sku"))
def q_dim_sku(spark, sf):
    """J-01: 7 chained left joins (snowflake c3 -> c2 -> c1) + 2 sorted attribute sets."""
    d = _d(spark, sf)
    return DM.dim_sku(S.sku_info(d), S.spu_info(d), S.base_category3(d), S.base_category2(d),
                      S.base_category1(d), S.base_trademark(d), S.sku_attr_value(d), S.sku_sale_attr_value(d))


BENEFIT = {
    "coupon": """case coupon_type
      when '3201' then '满' || cast(condition_amount as varchar) || '元减' || cast(benefit_amount as varchar) || '元'
      when '3202' then '满' || cast(condition_num as varchar) || '件打' || cast(10 * (1 - benefit_discount) as varchar) || '折'
      when '3203' then '减' || cast(benefit_amount as varchar) || '元' end""",
    "activity": """case r.activity_type
      when '3101' then '满' || cast(condition_amount as varchar) || '元减' || cast(benefit_amount as varchar) || '元'
      when '3102' then '满' || cast(condition_num as varchar) || '件打' || cast(10 * (1 - benefit_discount) as varchar) || '折'
      when '3103' then '打' || cast(10 * (1 - benefit_discount) as varchar) || '折' end""",
}

cte("coupon_info", """
select id, 'coupon ' || cast(id as varchar) coupon_name, '320' || cast(id % 3 + 1 as varchar) coupon_type,
  cast((id + 1) * 100 as decimal(16,2)) condition_amount, cast(id % 3 + 1 as bigint) condition_num,
  cast(null as bigint) activity_id, cast((id + 1) * 10 as decimal(16,2)) benefit_amount,
  cast((id % 5 + 1) / 10 as decimal(16,2)) benefit_discount, '2001-01-01 00:00:00' create_time,
  '330' || cast(id % 3 + 1 as varchar) range_type, cast(1 as bigint) limit_num, cast(id * 7 as bigint) taken_count,
  strftime(date '2001-06-20' + cast(id * 5 as integer), '%Y-%m-%d %H:%M:%S') start_time,
  strftime(date '2001-06-20' + cast(id * 5 + 60 as integer), '%Y-%m-%d %H:%M:%S') end_time,
  cast(null as varchar) operate_time, cast(null as varchar) expire_time
from (select distinct s_suppkey % 10 id from supplier) s""")

cte("dim_coupon", f"""
select id, coupon_name, coupon_type coupon_type_code, t.dic_name coupon_type_name, condition_amount, condition_num,
  activity_id, benefit_amount, benefit_discount, {BENEFIT['coupon']} benefit_rule, create_time,
  range_type range_type_code, r.dic_name range_type_name, limit_num, taken_count, start_time, end_time, operate_time,
  expire_time
from coupon_info c {dic_join('t', '32', 'c.coupon_type')} {dic_join('r', '33', 'c.range_type')}""",
    ("coupon_info", "dic"))


@register("dim_coupon", with_ctes("select * from dim_coupon", "dim_coupon"))
def q_dim_coupon(spark, sf):
    """J-02: two dictionary decodes + benefit text (case without else)."""
    return DM.dim_coupon(S.coupon_info(_d(spark, sf)), dictionary(spark))


cte("activity_info", """
select id, 'activity ' || cast(id as varchar) activity_name, '310' || cast(id % 3 + 1 as varchar) activity_type,
  'promotion ' || cast(id as varchar) activity_desc,
  strftime(date '2001-06-25' + cast(id * 6 as integer), '%Y-%m-%d %H:%M:%S') start_time,
  strftime(date '2001-06-25' + cast(id * 6 + 30 as integer), '%Y-%m-%d %H:%M:%S') end_time,
  '2001-01-01 00:00:00' create_time
from (select distinct s_suppkey % 7 id from supplier) s""")

cte("dim_activity", f"""
select r.id activity_rule_id, r.activity_id, activity_name, r.activity_type activity_type_code,
  t.dic_name activity_type_name, activity_desc, start_time, end_time, create_time, condition_amount, condition_num,
  benefit_amount, benefit_discount, {BENEFIT['activity']} benefit_rule, benefit_level
from (select a.id * 10 + lv id, a.id activity_id, a.activity_type,
        cast((lv + 1) * 100 as decimal(16,2)) condition_amount, cast(lv + 1 as bigint) condition_num,
        cast((lv + 1) * 10 as decimal(16,2)) benefit_amount, cast((lv + 1) / 20 as decimal(16,2)) benefit_discount,
        cast(lv + 1 as bigint) benefit_level
      from activity_info a, (values (0), (1), (2)) v(lv)) r
left join activity_info i on r.activity_id = i.id
{dic_join('t', '31', 'r.activity_type')}""", ("activity_info", "dic"))


@register("dim_activity", with_ctes("select * from dim_activity", "dim_activity"))
def q_dim_activity(spark, sf):
    """J-03: rule ⋈ activity, decoded type, benefit text."""
    d = _d(spark, sf)
    return DM.dim_activity(S.activity_rule(d), S.activity_info(d), dictionary(spark))


@register("dim_province", with_ctes("""
select n_nationkey id, n_name province_name, lpad(cast(n_nationkey as varchar), 6, '0') area_code,
  'CN-' || cast(n_nationkey as varchar) iso_code, 'CN-' || upper(substr(n_name, 1, 2)) iso_3166_2,
  n_regionkey region_id, r_name region_name
from nation left join region on n_regionkey = r_regionkey"""))
def q_dim_province(spark, sf):
    """J-04: province ⋈ region."""
    d = _d(spark, sf)
    prov = d.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                           F.col("n_regionkey").alias("region_id"),
                           F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("area_code"),
                           F.concat(F.lit("CN-"), F.col("n_nationkey").cast("string")).alias("iso_code"),
                           F.concat(F.lit("CN-"), F.upper(F.substring("n_name", 1, 2))).alias("iso_3166_2"))
    reg = d.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("region_name"))
    return DM.dim_province(prov, reg)


@register("dim_date", with_ctes("""
select strftime(d, '%Y-%m-%d') date_id, cast(weekofyear(d) as varchar) week_id,
  cast(isodow(d) as varchar) week_day, cast(day(d) as varchar) "day", cast(month(d) as varchar) "month",
  cast(quarter(d) as varchar) "quarter", cast(year(d) as varchar) "year",
  case when isodow(d) in (6, 7) then '0' else '1' end is_workday, cast(null as varchar) holiday_id
from (select distinct cast(o_orderdate as date) d from orders) t"""))
def q_dim_date(spark, sf):
    """J-05: the seed as delimited text, loaded into a staging table, and the dimension
    overwritten whole from it (K-08)."""
    seed = S.date_seed(_d(spark, sf))
    text = K.shared_path(spark, "landing", "date_seed")
    seed.write.option("sep", "\t").option("nullValue", "").csv(text)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seed.schema.fields)
    tmp, dim = (f"lakemart_{n}_{uuid.uuid4().hex[:8]}" for n in ("tmp_date", "dim_date"))
    for t in (tmp, dim):
        spark.sql(f"CREATE TABLE {t} ({columns}) USING parquet LOCATION '{K.shared_path(spark, 'tables', t)}'")
    K.load_files(spark, tmp, read_delimited(spark, text, columns, sep="\t"), overwrite=True)
    K.overwrite_table(spark, DM.dim_date(spark.table(tmp)), dim)
    K.drop_table(spark, tmp)
    return spark.table(dim)


ZIP_SQL = """id, login_name, nick_name, md5(name) name, md5(phone_num) phone_num, md5(email) email, user_level,
  birthday, gender, create_time, operate_time"""
cte("zip_init", f"""
select data.id id, data.login_name login_name, data.nick_name nick_name, md5(data.name) name,
  md5(data.phone_num) phone_num, md5(data.email) email, data.user_level user_level, data.birthday birthday,
  data.gender gender, data.create_time create_time, data.operate_time operate_time,
  '{FIRST}' start_date, '{OPEN_END}' end_date, '{OPEN_END}' dt
from user_inc where dt = '{FIRST}' and type = 'bootstrap-insert'""", ("user_inc",))


@register("dim_user_zip_init", with_ctes("select * from zip_init", "zip_init"))
def q_zip_init(spark, sf):
    """J-06: open SCD2 rows from bootstrap rows, PII masked."""
    return DM.user_zip_init(D.user_inc(_d(spark, sf), TDAY), FIRST)


ZC = ["id", "login_name", "nick_name", "name", "phone_num", "email", "user_level", "birthday", "gender",
      "create_time", "operate_time", "start_date", "end_date"]


@register("dim_user_zip_apply", with_ctes(f"""
with n as (
  select data.id id, data.login_name login_name, data.nick_name nick_name, md5(data.name) name,
    md5(data.phone_num) phone_num, md5(data.email) email, data.user_level user_level, data.birthday birthday,
    data.gender gender, data.create_time create_time, data.operate_time operate_time,
    '{TDAY}' start_date, '{OPEN_END}' end_date
  from (select *, row_number() over (partition by data.id order by ts desc, data desc) rn
        from user_inc where dt = '{TDAY}') t where rn = 1),
tmp as (select {', '.join(f'o.{c} o_{c}' for c in ZC)}, {', '.join(f'n.{c} n_{c}' for c in ZC)}
        from zip_init o full outer join n on o.id = n.id)
select {', '.join(f'case when n_id is not null then n_{c} else o_{c} end {c}' for c in ZC)}, '{OPEN_END}' dt
from tmp
union all
select {', '.join(f'o_{c} {c}' for c in ZC[:-1])}, '{add_days(TDAY, -1)}' end_date, '{add_days(TDAY, -1)}' dt
from tmp where o_id is not null and n_id is not null""", "zip_init", "user_inc"))
def q_zip_apply(spark, sf):
    """J-07: newest change per user, full outer with open rows, current + closed rows."""
    inc = D.user_inc(_d(spark, sf), TDAY)
    return DM.user_zip_apply(DM.user_zip_init(inc, FIRST).drop("dt"), inc, TDAY)


# ------------------------------------------------------------------ coupon / activity n-day rollups + reports
LO30 = add_days(DAY, -29)


cte("coupon_nd", f"""
select id coupon_id, coupon_name, coupon_type_code, coupon_type_name, benefit_rule coupon_rule, start_date,
  cast(sum(split_original_amount) as decimal(16,2)) original_amount_30d,
  cast(sum(split_coupon_amount) as decimal(16,2)) coupon_reduce_amount_30d, '{DAY}' dt
from (select id, coupon_name, coupon_type_code, coupon_type_name, benefit_rule, substr(start_time, 1, 10) start_date
      from dim_coupon where substr(start_time, 1, 10) >= '{LO30}' and substr(start_time, 1, 10) <= '{DAY}') cou
left join (select coupon_id, split_original_amount, split_coupon_amount from order_detail
           where dt >= '{LO30}' and dt <= '{DAY}' and coupon_id is not null) od on cou.id = od.coupon_id
group by id, coupon_name, coupon_type_code, coupon_type_name, benefit_rule, start_date""",
    ("dim_coupon", "order_detail"))

cte("activity_nd", f"""
select act.activity_id, activity_name, activity_type_code, activity_type_name, substr(start_time, 1, 10) start_date,
  cast(sum(split_original_amount) as decimal(16,2)) original_amount_30d,
  cast(sum(split_activity_amount) as decimal(16,2)) activity_reduce_amount_30d, '{DAY}' dt
from (select activity_id, activity_name, activity_type_code, activity_type_name, start_time from dim_activity
      where substr(start_time, 1, 10) >= '{LO30}' and substr(start_time, 1, 10) <= '{DAY}'
      group by activity_id, activity_name, activity_type_code, activity_type_name, start_time) act
left join (select activity_id, split_original_amount, split_activity_amount from order_detail
           where dt >= '{LO30}' and dt <= '{DAY}' and activity_id is not null) od on act.activity_id = od.activity_id
group by act.activity_id, activity_name, activity_type_code, activity_type_name, start_time""",
    ("dim_activity", "order_detail"))


def _coupon_nd(spark, sf):
    d = _d(spark, sf)
    return R.coupon_order_nd(DM.dim_coupon(S.coupon_info(d), dictionary(spark)), D.order_detail(d, LO30, DAY), DAY)


def _activity_nd(spark, sf):
    d = _d(spark, sf)
    return R.activity_order_nd(DM.dim_activity(S.activity_rule(d), S.activity_info(d), dictionary(spark)),
                             D.order_detail(d, LO30, DAY), DAY)


@register("coupon_order_nd", with_ctes("select * from coupon_nd", "coupon_nd"))
def q_coupon_nd(spark, sf):
    """J-46."""
    return _coupon_nd(spark, sf)


@register("activity_order_nd", with_ctes("select * from activity_nd", "activity_nd"))
def q_activity_nd(spark, sf):
    """J-47."""
    return _activity_nd(spark, sf)


@register("rpt_coupon_reduce_rate", with_ctes(f"""
select '{DAY}' dt, coupon_id, coupon_name, start_date, coupon_rule rule_name,
  {RATIO('coupon_reduce_amount_30d', 'original_amount_30d')} reduce_rate
from coupon_nd where dt = '{DAY}'""", "coupon_nd"))
def q_coupon_rate(spark, sf):
    """J-62: coupon cut / original amount (NULL on a zero denominator)."""
    return P.coupon_reduce_rate(_coupon_nd(spark, sf), DAY)


@register("rpt_activity_reduce_rate", with_ctes(f"""
select '{DAY}' dt, activity_id, activity_name, start_date,
  {RATIO('activity_reduce_amount_30d', 'original_amount_30d')} reduce_rate
from activity_nd where dt = '{DAY}'""", "activity_nd"))
def q_activity_rate(spark, sf):
    """J-63."""
    return P.activity_reduce_rate(_activity_nd(spark, sf), DAY)
