"""Generic operator queries: one small query per operator id, over
the driver tables or frames Spark derives from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import add_days, local_time, mask, ratio
from ..operators import cdc
from ..operators.joins import full_outer_coalesce, one_row_join
from ..operators.periods import fan_out, recent_days
from ..operators.sessions import first_per_group, last_per_group
from ..oracle.domain import with_ctes
from ..plans import rollups as R
from ..registry import register
from ..sources import domain as D
from ..sources import worked as WS
from ..sources.dictionary import dictionary
from ..sources.driver import Driver
from .reports import RATIO

DAY = D.TRADE_DAY
TDAY = D.TRAFFIC_DAY
LO7 = add_days(DAY, -6)


def _d(spark, sf):
    return Driver(spark, sf)


# ----------------------------------------------------------------- projection / filter
@register("project_rename", with_ctes("""select order_id id, user_id uid, total_amount amount, dt stat_day
from order_info""", "order_info"))
def p01(spark, sf):
    """P-01 column list with aliases."""
    return D.order_info(_d(spark, sf)).select(F.col("order_id").alias("id"), F.col("user_id").alias("uid"),
                                              F.col("total_amount").alias("amount"), F.col("dt").alias("stat_day"))


@register("struct_field", with_ctes("""select common.mid mid_id, page.page_id page_id, "start".entry entry,
  err.error_code error_code, dt from page_log""", "page_log"))
def p02(spark, sf):
    """P-02 nested field access (``common.mid``, ``start.entry``)."""
    return D.page_log(_d(spark, sf)).select(F.col("common.mid").alias("mid_id"), F.col("page.page_id").alias("page_id"),
                                            F.col("start.entry").alias("entry"),
                                            F.col("err.error_code").alias("error_code"), "dt")


@register("map_lookup", with_ctes("select data.id id, type, old['sku_num'] old_sku_num from cart_inc", "cart_inc"))
def p03(spark, sf):
    """P-03 ``old['sku_num']``, NULL when the key is absent."""
    return D.cart_inc(_d(spark, sf)).select(F.col("data.id").alias("id"), "type",
                                            cdc.old_value("sku_num").alias("old_sku_num"))


@register("struct_not_null", with_ctes("""select common.mid mid_id, ts, dt from page_log where "start" is not null""",
                                       "page_log"))
def p04(spark, sf):
    """P-04 keep rows whose struct is present."""
    return D.page_log(_d(spark, sf)).where(F.col("start").isNotNull()).select(F.col("common.mid").alias("mid_id"),
                                                                              "ts", "dt")


@register("null_filters", with_ctes("""select order_id, sku_id, coupon_id is null no_coupon, dt from order_detail
where activity_id is null""", "order_detail"))
def p05(spark, sf):
    """P-05 ``is null`` / ``is not null``."""
    return (D.order_detail(_d(spark, sf)).where(F.col("activity_id").isNull())
            .select("order_id", "sku_id", F.col("coupon_id").isNull().alias("no_coupon"), "dt"))


@register("bool_predicates", with_ctes("""select order_id, sku_id, dt from order_detail
where (activity_id is not null or coupon_id is not null) and not (activity_id is not null and coupon_id is not null)""",
    "order_detail"))
def p06(spark, sf):
    """P-06 and/or/not predicate trees."""
    act, cou = F.col("activity_id").isNotNull(), F.col("coupon_id").isNotNull()
    return D.order_detail(_d(spark, sf)).where((act | cou) & ~(act & cou)).select("order_id", "sku_id", "dt")


@register("in_list", "select event_id, event_type from events where event_type in ('click', 'view')")
def p07(spark, sf):
    """P-07 literal IN list (pushed to the scan)."""
    return _d(spark, sf).events.where(F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@register("cdc_changed_column", with_ctes("""select data.id id, ts, data.user_level user_level from user_inc
where type = 'update' and list_contains(map_keys(old), 'user_level')""", "user_inc"))
def p08(spark, sf):
    """P-08 ``array_contains(map_keys(old), 'c')``."""
    x = cdc.cdc_rows(D.user_inc(_d(spark, sf), TDAY), kinds=("update",), changed="user_level")
    return x.select(F.col("data.id").alias("id"), "ts", F.col("data.user_level").alias("user_level"))


@register("cdc_type_filter", with_ctes("""select type, data.id id, dt from user_inc
where type in ('bootstrap-insert', 'insert')""", "user_inc"))
def p09(spark, sf):
    """P-09 select bootstrap / insert rows."""
    x = cdc.cdc_rows(D.user_inc(_d(spark, sf), TDAY), kinds=("bootstrap-insert", "insert"))
    return x.select("type", F.col("data.id").alias("id"), "dt")


@register("literal_column", with_ctes(f"""select id, '{TDAY}' start_date, '9999-12-31' end_date, 1 recent_days
from users""", "users"))
def p10(spark, sf):
    """P-10 constant columns."""
    return D.users(_d(spark, sf)).select("id", F.lit(TDAY).alias("start_date"), F.lit("9999-12-31").alias("end_date"),
                                         F.lit(1).alias("recent_days"))


@register("cte", with_ctes(f"""with paid as (select order_id, user_id from order_info where order_status = '1002'),
big as (select order_id from order_info where total_amount > 300000)
select p.user_id, count(*) big_paid_orders from paid p join big b on p.order_id = b.order_id group by p.user_id""",
    "order_info"))
def p11(spark, sf):
    """P-11 named subqueries as DataFrame variables (each read once by Catalyst)."""
    oi = D.order_info(_d(spark, sf))
    paid = oi.where(F.col("order_status") == "1002").select("order_id", "user_id")
    big = oi.where(F.col("total_amount") > 300000).select("order_id")
    return paid.join(big, "order_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("big_paid_orders"))


@register("derived_table", with_ctes("""select t2.province_id, max(t2.n) max_orders_per_user from (
  select province_id, user_id, count(*) n from (
    select province_id, user_id from order_info where order_status <> '1003') t1
  group by province_id, user_id) t2 group by t2.province_id""", "order_info"))
def p12(spark, sf):
    """P-12 nested subqueries in ``from``."""
    t1 = D.order_info(_d(spark, sf)).where(F.col("order_status") != "1003").select("province_id", "user_id")
    t2 = t1.groupBy("province_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return t2.groupBy("province_id").agg(F.max("n").alias("max_orders_per_user"))


@register("select_distinct", with_ctes('select distinct substr(orderdate, 1, 7) "month" from business', "business"))
def p13(spark, sf):
    """P-13 distinct values."""
    return WS.business(_d(spark, sf)).select(F.substring("orderdate", 1, 7).alias("month")).distinct()


@register("bucket_sample", "select c_custkey, c_name from customer where c_custkey % 4 = 0")
def p14(spark, sf):
    """P-14 ``tablesample (bucket 1 out of 4 on id)``: the bucket of an integer key is
    ``pmod(key, n)``; sampling bucket x keeps ``pmod(key, n) = x - 1``."""
    return _d(spark, sf).customer.where(F.pmod("c_custkey", F.lit(4)) == 0).select("c_custkey", "c_name")


@register("const_date_predicate", with_ctes(f"""select order_id, dt from order_info
where cast(dt as date) >= date '{DAY}' - 6""", "order_info"))
def p15(spark, sf):
    """P-15 text day compared with a ``date_add`` result (cast, then compare)."""
    return (D.order_info(_d(spark, sf), LO7, None)
            .where(F.col("dt").cast("date") >= F.date_add(F.lit(DAY).cast("date"), -6)).select("order_id", "dt"))


# ----------------------------------------------------------------- joins
@register("join_left_equi", with_ctes("""select o.order_id, o.sku_id, s.tm_name from order_detail o
left join sku s on o.sku_id = s.id""", "order_detail", "sku"))
def n01(spark, sf):
    """N-01 left outer on one key."""
    d = _d(spark, sf)
    s = D.sku(d).select(F.col("id").alias("_id"), "tm_name")
    o = D.order_detail(d)
    return o.join(s, o.sku_id == s._id, "left").select("order_id", "sku_id", "tm_name")


@register("join_inner_equi", with_ctes("""select r.order_id, r.sku_id, o.total_amount from refund_info r
join order_info o on r.order_id = o.order_id""", "refund_info", "order_info"))
def n02(spark, sf):
    """N-02 inner on one key."""
    d = _d(spark, sf)
    o = D.order_info(d).select(F.col("order_id").alias("_oid"), "total_amount")
    r = D.refund_info(d)
    return r.join(o, r.order_id == o._oid).select("order_id", "sku_id", "total_amount")


@register("join_multi_key", with_ctes("""select o.order_id, o.sku_id, r.refund_num from order_detail o
join refund_info r on o.order_id = r.order_id and o.sku_id = r.sku_id""", "order_detail", "refund_info"))
def n03(spark, sf):
    """N-03 composite equi key."""
    d = _d(spark, sf)
    r = D.refund_info(d).select(F.col("order_id").alias("_o"), F.col("sku_id").alias("_s"), "refund_num")
    o = D.order_detail(d)
    return o.join(r, (o.order_id == r._o) & (o.sku_id == r._s)).select("order_id", "sku_id", "refund_num")


@register("join_full_outer", with_ctes("""select coalesce(o.user_id, r.user_id) user_id, coalesce(o.dt, r.dt) dt,
  coalesce(order_count_1d, 0) order_count_1d, coalesce(order_refund_count_1d, 0) order_refund_count_1d
from (select user_id, dt, order_count_1d from uo1d) o
full outer join (select user_id, dt, order_refund_count_1d from ur1d) r on o.user_id = r.user_id and o.dt = r.dt""",
    "uo1d", "ur1d"))
def n04(spark, sf):
    """N-04 full outer on (user, day) over all days, keys and measures null-coalesced."""
    d = _d(spark, sf)
    o = R.user_order_1d(D.order_detail(d)).select("user_id", "dt", "order_count_1d")
    r = R.user_refund_1d(D.refund_info(d)).select("user_id", "dt", "order_refund_count_1d")
    return full_outer_coalesce(o, r, ["user_id", "dt"], {"order_count_1d": 0, "order_refund_count_1d": 0})


@register("join_cross", with_ctes("""select o.order_id, o.total_amount, t.avg_amount
from order_info o, (select cast(avg(total_amount) as decimal(16,2)) avg_amount from order_info) t""", "order_info"))
def n05(spark, sf):
    """N-05 join with a 1-row aggregate, attached as a scalar subquery."""
    oi = D.order_info(_d(spark, sf))
    one = oi.agg(F.avg("total_amount").cast("decimal(16,2)").alias("avg_amount"))
    return one_row_join(oi.select("order_id", "total_amount"), one)


@register("join_dim_decode", with_ctes("""select p.order_id, p.payment_type, d.dic_name payment_name
from payment_info p left join (select dic_code, dic_name from dic where parent_code = '11') d
  on p.payment_type = d.dic_code""", "payment_info", "dic"))
def n06(spark, sf):
    """N-06 code -> name through a broadcast dictionary slice."""
    p = D.payment_info(_d(spark, sf)).select("order_id", "payment_type")
    return cdc.decode(p, "payment_type", dictionary(spark), "11", "payment_name")


@register("join_snowflake_chain", with_ctes("""select s.id, c3.name c3_name, c2.name c2_name, c1.name c1_name
from sku s left join (select distinct category3_id id, category3_name name, category2_id from sku) c3
  on s.category3_id = c3.id
left join (select distinct category2_id id, category2_name name, category1_id from sku) c2 on c3.category2_id = c2.id
left join (select distinct category1_id id, category1_name name from sku) c1 on c2.category1_id = c1.id""", "sku"))
def n07(spark, sf):
    """N-07 chained left joins, later key from an earlier join (c3 -> c2 -> c1)."""
    s = D.sku(_d(spark, sf))
    c3 = s.select(F.col("category3_id").alias("_c3"), F.col("category3_name").alias("c3_name"),
                  F.col("category2_id").alias("_c3p")).distinct()
    c2 = s.select(F.col("category2_id").alias("_c2"), F.col("category2_name").alias("c2_name"),
                  F.col("category1_id").alias("_c2p")).distinct()
    c1 = s.select(F.col("category1_id").alias("_c1"), F.col("category1_name").alias("c1_name")).distinct()
    j = (s.select("id", "category3_id").join(c3, F.col("category3_id") == F.col("_c3"), "left")
         .join(c2, F.col("_c3p") == F.col("_c2"), "left").join(c1, F.col("_c2p") == F.col("_c1"), "left"))
    return j.select("id", "c3_name", "c2_name", "c1_name")


@register("join_multiway_star", with_ctes("""select o.order_id, o.sku_id, s.tm_name, p.payment_type, pr.province_name,
  d.dic_name source_name
from order_detail o join payment_info p on o.order_id = p.order_id
left join sku s on o.sku_id = s.id
left join province pr on o.province_id = pr.id
left join (select dic_code, dic_name from dic where parent_code = '24') d on o.source_type = d.dic_code""",
    "order_detail", "payment_info", "sku", "province", "dic"))
def n08(spark, sf):
    """N-08 one fact joined to four other tables (AQE picks each strategy)."""
    d = _d(spark, sf)
    o = D.order_detail(d)
    p = D.payment_info(d).select(F.col("order_id").alias("_p"), "payment_type")
    s = D.sku(d).select(F.col("id").alias("_s"), "tm_name")
    pr = D.province(d).select(F.col("id").alias("_pr"), "province_name")
    j = (o.join(p, o.order_id == p._p).join(s, o.sku_id == s._s, "left")
         .join(pr, o.province_id == pr._pr, "left"))
    j = cdc.decode(j, "source_type", dictionary(spark), "24", "source_name")
    return j.select("order_id", "sku_id", "tm_name", "payment_type", "province_name", "source_name")



@register("join_star_filtered", with_ctes("""select o.order_id, o.sku_id, s.tm_name, p.payment_type
from order_detail o join (select id, tm_name from sku where tm_id = 'Brand#12' or price > 1800) s on o.sku_id = s.id
join (select order_id, payment_type from payment_info where payment_type = '1101') p on o.order_id = p.order_id""",
    "order_detail", "payment_info", "sku"))
def n08_filtered(spark, sf):
    """N-07 / N-08 with selective dimensions: where a side is too large to broadcast, Spark builds a Bloom filter of the filtered
    side's keys and tests the fact's rows at the scan, before their shuffle (``runtime.bloomFilter`` in the job settings)."""
    d = _d(spark, sf)
    s = D.sku(d).where((F.col("tm_id") == "Brand#12") | (F.col("price") > 1800)).select(F.col("id").alias("_s"), "tm_name")
    p = D.payment_info(d).where(F.col("payment_type") == "1101").select(F.col("order_id").alias("_p"), "payment_type")
    o = D.order_detail(d)
    return o.join(s, o.sku_id == s._s).join(p, o.order_id == p._p).select("order_id", "sku_id", "tm_name", "payment_type")


from .rollups import TD_SQL  # noqa: E402

PREV = add_days(DAY, -1)


@register("join_self_state", with_ctes(f"""select a.user_id, a.order_date_last, b.order_date_last prev_last
from ({TD_SQL.format(day=DAY)}) a join ({TD_SQL.format(day=PREV)}) b on a.user_id = b.user_id""", "uo1d"))
def n09(spark, sf):
    """N-09 a state table joined to its own previous partition."""
    uo = R.user_order_1d(D.order_detail(_d(spark, sf)))
    a = R.user_order_td_first(uo, DAY).select("user_id", "order_date_last")
    b = R.user_order_td_first(uo, PREV).select("user_id", F.col("order_date_last").alias("prev_last"))
    return a.join(b, "user_id")


@register("join_small_reports", with_ctes(f"""select o.recent_days, o.orders, r.refunds
from (select recent_days, count(*) orders from order_info, (values (1), (7), (30)) v(recent_days)
      where dt <= '{DAY}' and dt >= strftime(date '{DAY}' - cast(recent_days - 1 as integer), '%Y-%m-%d')
      group by recent_days) o
join (select recent_days, count(*) refunds from refund_info, (values (1), (7), (30)) v(recent_days)
      where dt <= '{DAY}' and dt >= strftime(date '{DAY}' - cast(recent_days - 1 as integer), '%Y-%m-%d')
      group by recent_days) r on o.recent_days = r.recent_days""", "order_info", "refund_info"))
def n10(spark, sf):
    """N-10 per-period aggregates joined on ``recent_days``."""
    d = _d(spark, sf)
    lo = add_days(DAY, -29)
    o = recent_days(D.order_info(d, lo, DAY), DAY).groupBy("recent_days").agg(F.count(F.lit(1)).alias("orders"))
    r = recent_days(D.refund_info(d, lo, DAY), DAY).groupBy("recent_days").agg(F.count(F.lit(1)).alias("refunds"))
    return o.join(r, "recent_days")


@register("join_topn_back", with_ctes("""select t.user_id, o.order_id, o.total_amount
from (select user_id, count(*) n from order_info group by user_id order by n desc, user_id limit 10) t
join order_info o on t.user_id = o.user_id""", "order_info"))
def n11(spark, sf):
    """N-11 top-n subquery (bounded: n rows, broadcast) joined back to the detail."""
    oi = D.order_info(_d(spark, sf))
    top = oi.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)
    return oi.join(F.broadcast(top.select("user_id")), "user_id").select("user_id", "order_id", "total_amount")


# ----------------------------------------------------------------- aggregations
@register("agg_sum_count", with_ctes("""select province_id, cast(sum(refund_num) as bigint) refund_num, count(*) n
from refund_info group by province_id""", "refund_info"))
def a01(spark, sf):
    """A-01 sum and count(*) by key."""
    return D.refund_info(_d(spark, sf)).groupBy("province_id").agg(F.sum("refund_num").alias("refund_num"),
                                                                   F.count(F.lit(1)).alias("n"))


@register("agg_count_distinct", with_ctes("select dt, count(distinct user_id) buyers from order_detail group by dt",
                                          "order_detail"))
def a02(spark, sf):
    """A-02 exact distinct count, through bitmaps of the users' ids: no user is shuffled."""
    from ..operators.distinct import distinct_counts
    return distinct_counts(D.order_detail(_d(spark, sf)), ["dt"], "user_id", "buyers")


LO30 = add_days(DAY, -29)


@register("agg_cond_sum", with_ctes(f"""select province_id,
  cast(sum(case when dt >= '{LO7}' then sku_num else 0 end) as bigint) num_7d, cast(sum(sku_num) as bigint) num_30d
from order_detail where dt >= '{LO30}' and dt <= '{DAY}' group by province_id""", "order_detail"))
def a03(spark, sf):
    """A-03 ``sum(if(p, x, 0))``."""
    x = D.order_detail(_d(spark, sf), LO30, DAY)
    return x.groupBy("province_id").agg(
        F.sum(F.when(F.col("dt") >= LO7, F.col("sku_num")).otherwise(0)).alias("num_7d"),
        F.sum("sku_num").alias("num_30d"))


@register("agg_case_sum", with_ctes("""select province_id,
  cast(sum(case order_status when '1002' then 1 else 0 end) as bigint) paid,
  cast(sum(case order_status when '1003' then 1 else 0 end) as bigint) cancelled
from order_info group by province_id""", "order_info"))
def a04(spark, sf):
    """A-04 ``sum(case c when v then 1 else 0 end)``."""
    s = F.col("order_status")
    return D.order_info(_d(spark, sf)).groupBy("province_id").agg(
        F.sum(F.when(s == "1002", 1).otherwise(0)).cast("bigint").alias("paid"),
        F.sum(F.when(s == "1003", 1).otherwise(0)).cast("bigint").alias("cancelled"))


@register("agg_cond_count_distinct", with_ctes("""select province_id,
  count(distinct case when order_status = '1002' then user_id end) paying_users from order_info group by province_id""",
    "order_info"))
def a05(spark, sf):
    """A-05 ``count(distinct if(p, x, null))``, through bitmaps."""
    from ..operators.distinct import distinct_counts
    return distinct_counts(D.order_info(_d(spark, sf)), ["province_id"], "user_id", "paying_users", F.col("order_status") == "1002")


@register("agg_cond_count", with_ctes("""select province_id,
  count(case when order_status = '1003' then order_id end) cancelled_orders from order_info group by province_id""",
    "order_info"))
def a06(spark, sf):
    """A-06 ``count(if(p, x, null))`` (not distinct)."""
    return D.order_info(_d(spark, sf)).groupBy("province_id").agg(
        F.count(F.when(F.col("order_status") == "1003", F.col("order_id"))).alias("cancelled_orders"))


@register("agg_avg", with_ctes("""select province_id, cast(trunc(avg(cast(total_amount as double))) as bigint) avg_amount
from order_info group by province_id""", "order_info"))
def a07(spark, sf):
    """A-07 average, then integer cast (truncates)."""
    return D.order_info(_d(spark, sf)).groupBy("province_id").agg(
        F.avg(F.col("total_amount").cast("double")).cast("bigint").alias("avg_amount"))


@register("agg_min_max", with_ctes("""select user_id, min(dt) first_day, max(dt) last_day from order_info
group by user_id""", "order_info"))
def a08(spark, sf):
    """A-08 first / last day (ISO text order)."""
    return D.order_info(_d(spark, sf)).groupBy("user_id").agg(F.min("dt").alias("first_day"),
                                                              F.max("dt").alias("last_day"))


@register("agg_collect_set_struct", with_ctes("""select user_id,
  list_sort(list(distinct struct_pack(payment_type := payment_type, province_id := province_id))) pay_kinds
from payment_info group by user_id""", "payment_info"))
def a09(spark, sf):
    """A-09 ``collect_set(named_struct(...))``, sorted for determinism."""
    return D.payment_info(_d(spark, sf)).groupBy("user_id").agg(
        F.sort_array(F.collect_set(F.struct("payment_type", "province_id"))).alias("pay_kinds"))


@register("agg_collect_set_concat", """select p_brand, array_to_string(list_sort(list(distinct p_type)), '|') types
from part group by p_brand""")
def a10(spark, sf):
    """A-10 distinct values joined into one string."""
    return _d(spark, sf).part.groupBy("p_brand").agg(
        F.concat_ws("|", F.sort_array(F.collect_set("p_type"))).alias("types"))


@register("agg_global", with_ctes("""select count(*) n, cast(sum(total_amount) as decimal(38,2)) total
from order_info""", "order_info"))
def a11(spark, sf):
    """A-11 aggregate without keys (one row)."""
    return D.order_info(_d(spark, sf)).agg(F.count(F.lit(1)).alias("n"),
                                           F.sum("total_amount").cast("decimal(38,2)").alias("total"))


@register("agg_group_as_distinct", with_ctes("""select province_id, order_status from order_info
group by province_id, order_status""", "order_info"))
def a12(spark, sf):
    """A-12 ``group by`` without aggregates."""
    return D.order_info(_d(spark, sf)).select("province_id", "order_status").dropDuplicates()


@register("agg_ratio", with_ctes(f"""select province_id,
  {RATIO("sum(case when order_status = '1002' then 1 else 0 end)", "count(*)")} paid_rate
from order_info group by province_id""", "order_info"))
def a13(spark, sf):
    """A-13 ratio of aggregates cast to decimal(16,2)."""
    return D.order_info(_d(spark, sf)).groupBy("province_id").agg(
        ratio(F.sum(F.when(F.col("order_status") == "1002", 1).otherwise(0)), F.count(F.lit(1))).alias("paid_rate"))


@register("agg_two_level", with_ctes("""select tm_id, count(*) users, cast(sum(case when n >= 2 then 1 else 0 end) as bigint) repeat_users
from (select o.user_id, s.tm_id, count(*) n from order_detail o join sku s on o.sku_id = s.id
      group by o.user_id, s.tm_id) t group by tm_id""", "order_detail", "sku"))
def a14(spark, sf):
    """A-14 aggregate of an aggregate."""
    d = _d(spark, sf)
    s = D.sku(d).select(F.col("id").alias("_id"), "tm_id")
    o = D.order_detail(d)
    per = o.join(s, o.sku_id == s._id).groupBy("user_id", "tm_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("tm_id").agg(F.count(F.lit(1)).alias("users"),
                                    F.sum(F.when(F.col("n") >= 2, 1).otherwise(0)).cast("bigint").alias("repeat_users"))


@register("agg_null_safe_sum", with_ctes("""select province_id,
  cast(sum(coalesce(split_activity_amount, 0)) as decimal(38,2)) activity_cut from order_detail group by province_id""",
    "order_detail"))
def a15(spark, sf):
    """A-15 ``sum(nvl(x, 0))``."""
    return D.order_detail(_d(spark, sf)).groupBy("province_id").agg(
        F.sum(F.coalesce("split_activity_amount", F.lit(0))).cast("decimal(38,2)").alias("activity_cut"))


@register("agg_before_join", with_ctes("""select a.sku_id, s.tm_name, a.lines
from (select sku_id, count(*) lines from order_detail group by sku_id) a left join sku s on a.sku_id = s.id""",
    "order_detail", "sku"))
def a16(spark, sf):
    """A-16 pre-aggregate the fact, then join the dimension."""
    d = _d(spark, sf)
    a = D.order_detail(d).groupBy("sku_id").agg(F.count(F.lit(1)).alias("lines"))
    s = D.sku(d).select(F.col("id").alias("_id"), "tm_name")
    return a.join(s, a.sku_id == s._id, "left").select("sku_id", "tm_name", "lines")


@register("agg_after_join", with_ctes("""select s.tm_name, count(*) lines from order_detail o
left join sku s on o.sku_id = s.id group by s.tm_name""", "order_detail", "sku"))
def a17(spark, sf):
    """A-17 join the dimension, then aggregate."""
    d = _d(spark, sf)
    s = D.sku(d).select(F.col("id").alias("_id"), "tm_name")
    o = D.order_detail(d)
    return o.join(s, o.sku_id == s._id, "left").groupBy("tm_name").agg(F.count(F.lit(1)).alias("lines"))


# ----------------------------------------------------------------- windows
EV = """select event_id, user_id, event_type, cast(floor(value * 100) as bigint) cents,
  strftime(ts, '%Y-%m-%d') dt, epoch_us(ts) ts_us from events"""


def _ev(spark, sf):
    e = _d(spark, sf).events
    return e.select("event_id", "user_id", "event_type", F.floor(F.col("value") * 100).cast("bigint").alias("cents"),
                    F.date_format("ts", "yyyy-MM-dd").alias("dt"),
                    F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@register("win_latest_per_key", with_ctes("""select id, ts, user_level from (
  select data.id id, ts, data.user_level user_level,
    row_number() over (partition by data.id order by ts desc, data desc) rn from user_inc) t where rn = 1""",
    "user_inc"))
def w01(spark, sf):
    """W-01 newest change per key, as a max-struct aggregate (no window, no hot task)."""
    x = D.user_inc(_d(spark, sf), TDAY).select("ts", "data", F.col("data.id").alias("id"))
    out = last_per_group(x, ["id"], ["ts"], ["ts", "data"])
    return out.select("id", "ts", F.col("data.user_level").alias("user_level"))


@register("win_last_value_ignore_nulls", f"""select user_id, event_id,
  last_value(case when event_type = 'signup' then ts_us end ignore nulls)
    over (partition by dt, user_id order by ts_us) last_signup_us
from ({EV}) e""")
def w02(spark, sf):
    """W-02 carry the last non-null start forward (a segmented running max)."""
    from ..operators.sessions import session_start
    e = _ev(spark, sf)
    s = session_start(e, "user_id", "ts_us", F.col("event_type") == "signup", part=("dt",), out="last_signup_us", tie=("event_id",))
    return s.select("user_id", "event_id", "last_signup_us")


@register("win_first_per_session", f"""select user_id, dt, event_id first_event, event_type first_type from (
  select *, row_number() over (partition by user_id, dt order by ts_us, event_id) rn from ({EV}) e) t where rn = 1""")
def w03(spark, sf):
    """W-03 first row per group (min-struct aggregate)."""
    return first_per_group(_ev(spark, sf), ["user_id", "dt"], ["ts_us", "event_id"], ["event_id", "event_type"]) \
        .select("user_id", "dt", F.col("event_id").alias("first_event"), F.col("event_type").alias("first_type"))


STEP_W = "partition by user_id, dt order by ts_us, event_id"


@register("win_lead", f"""select event_id, lead(event_type, 1) over ({STEP_W}) next_type from ({EV}) e""")
def w04(spark, sf):
    """W-04 next value in the group (ordered: §7.4 #1); a segmented scan."""
    from ..operators.scan import lead
    x = lead(_ev(spark, sf), ["user_id", "dt"], ["ts_us", "event_id"], "event_type", "next_type")
    return x.select("event_id", "next_type")


@register("win_step_number", f"""select event_id, cast(row_number() over ({STEP_W}) as integer) step
from ({EV}) e""")
def w05(spark, sf):
    """W-05 step number inside the group (a segmented running count)."""
    from ..operators.scan import row_number
    x = row_number(_ev(spark, sf), ["user_id", "dt"], ["ts_us", "event_id"], "step")
    return x.select("event_id", F.col("step").cast("int").alias("step"))


@register("win_lag_default", f"""select event_id,
  lag(event_type, 1, 'none') over (partition by user_id order by ts_us, event_id) prev_type from ({EV}) e""")
def w06(spark, sf):
    """W-06 previous value with a default (a segmented scan)."""
    from ..operators.scan import lag
    x = lag(_ev(spark, sf), ["user_id"], ["ts_us", "event_id"], "event_type", "prev_type", "none")
    return x.select("event_id", "prev_type")


@register("win_total_over_all", """select event_type, count(*) over () types
from events group by event_type""")
def w07(spark, sf):
    """W-07 ``count(*) over ()`` after ``group by``: a 1-row count joined back."""
    g = _d(spark, sf).events.select("event_type").distinct()
    return one_row_join(g, g.agg(F.count(F.lit(1)).alias("types")))


@register("win_partition_total", f"""select event_id, cents,
  cast(sum(cents) over (partition by event_type) as bigint) type_cents from ({EV}) e""")
def w08(spark, sf):
    """W-08 whole-partition total: partial aggregate joined back."""
    from ..operators.ranking import partition_total
    e = _ev(spark, sf)
    return partition_total(e, ["event_type"], "cents", "type_cents") \
        .select("event_id", "cents", F.col("type_cents").cast("bigint").alias("type_cents"))


@register("win_running_rows", f"""select event_id, cast(sum(cents) over (partition by user_id order by ts_us, event_id
  rows between unbounded preceding and current row) as bigint) running from ({EV}) e""")
def w09(spark, sf):
    """W-09 running sum, ROWS frame (a segmented scan)."""
    from ..operators.scan import running
    x = running(_ev(spark, sf), ["user_id"], ["ts_us", "event_id"], "cents", "running")
    return x.select("event_id", F.col("running").cast("bigint").alias("running"))


@register("win_running_range", f"""select event_id, cast(sum(cents) over (partition by user_id order by dt)
  as bigint) running from ({EV}) e""")
def w10(spark, sf):
    """W-10 running sum, default RANGE frame (same-day rows share the value): days are summed up, scanned and joined back."""
    from ..operators.scan import running
    x = running(_ev(spark, sf), ["user_id"], ["dt"], "cents", "running", frame="range")
    return x.select("event_id", F.col("running").cast("bigint").alias("running"))


@register("win_moving_rows", f"""select event_id, cast(sum(cents) over (partition by user_id order by ts_us, event_id
  rows between 1 preceding and 1 following) as bigint) moving from ({EV}) e""")
def w11(spark, sf):
    """W-11 previous + current + next row (neighbours found across slices)."""
    from ..operators.scan import moving_sum
    x = moving_sum(_ev(spark, sf), ["user_id"], ["ts_us", "event_id"], "cents", "moving")
    return x.select("event_id", F.col("moving").cast("bigint").alias("moving"))


@register("win_ntile", f"""select dt, n, cast(ntile(4) over (order by n, dt) as integer) quartile
from (select dt, count(*) n from ({EV}) e group by dt) d""")
def w12(spark, sf):
    """W-12 ntile over an aggregated frame, by global row numbers from the segmented scan."""
    from ..operators.scan import ntile
    per_day = _ev(spark, sf).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
    return ntile(per_day, ["n", "dt"], 4, "quartile").select("dt", "n", "quartile")


@register("win_ntile_rows", f"""select event_id, cast(ntile(7) over (order by cents, event_id) as integer) part
from ({EV}) e""")
def w12_rows(spark, sf):
    """W-12 over every row, with all order values distinct: no task holds more than a slice."""
    from ..operators.scan import ntile
    return ntile(_ev(spark, sf), ["cents", "event_id"], 7, "part").select("event_id", "part")


UT = "select event_type, user_id, count(*) n from events group by event_type, user_id"


@register("win_rank_family", f"""select event_type, user_id, n,
  cast(rank() over (partition by event_type order by n desc) as integer) rp,
  cast(dense_rank() over (partition by event_type order by n desc) as integer) drp,
  cast(row_number() over (partition by event_type order by n desc, user_id) as integer) rmp from ({UT}) t""")
def w13(spark, sf):
    """W-13 rank / dense_rank / row_number (histogram ranks)."""
    from ..operators.ranking import rank_family
    ut = _d(spark, sf).events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rank_family(ut, ["event_type"], "n", tiebreak=["user_id"])


@register("win_rank_over_aggregate", """select event_type, count(*) n,
  cast(rank() over (order by count(*) desc) as integer) rk from events group by event_type""")
def w14(spark, sf):
    """W-14 rank groups by their count."""
    from ..operators.ranking import rank_family
    g = _d(spark, sf).events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return rank_family(g, [], "n", names=("rk", "_d", None)).select("event_type", "n", "rk")


# the same operators over a frame with NULL keys, order values and measures
NEV = f"""select event_id, case when user_id % 7 = 0 then null else user_id end user_id,
  case when event_id % 11 = 0 then null else event_type end event_type,
  case when event_id % 3 = 0 then null else cents end cents, case when event_id % 13 = 0 then null else dt end dt
  from ({EV}) e0"""


def _nev(spark, sf):
    e = _ev(spark, sf)
    return e.select("event_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"),
                    F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
                    F.when(F.col("event_id") % 3 != 0, F.col("cents")).alias("cents"),
                    F.when(F.col("event_id") % 13 != 0, F.col("dt")).alias("dt"))


@register("win_partition_total_nulls", f"""select event_id, cents,
  cast(sum(cents) over (partition by event_type) as bigint) type_cents from ({NEV}) e""")
def w08_nulls(spark, sf):
    """W-08 with NULL keys and measures."""
    from ..operators.ranking import partition_total
    return partition_total(_nev(spark, sf), ["event_type"], "cents", "type_cents") \
        .select("event_id", "cents", F.col("type_cents").cast("bigint").alias("type_cents"))


@register("win_running_rows_nulls", f"""select event_id, cast(sum(cents) over (partition by user_id
  order by dt nulls first, event_id rows between unbounded preceding and current row) as bigint) running from ({NEV}) e""")
def w09_nulls(spark, sf):
    """W-09 with NULL keys, order values and measures."""
    from ..operators.scan import running
    x = running(_nev(spark, sf), ["user_id"], ["dt", "event_id"], "cents", "running")
    return x.select("event_id", F.col("running").cast("bigint").alias("running"))


@register("win_running_range_nulls", f"""select event_id, cast(sum(cents) over (partition by user_id
  order by dt nulls first) as bigint) running from ({NEV}) e""")
def w10_nulls(spark, sf):
    """W-10 with NULL keys, order values and measures."""
    from ..operators.scan import running
    x = running(_nev(spark, sf), ["user_id"], ["dt"], "cents", "running", frame="range")
    return x.select("event_id", F.col("running").cast("bigint").alias("running"))


@register("win_moving_rows_nulls", f"""select event_id, cast(sum(cents) over (partition by user_id
  order by dt nulls first, event_id rows between 1 preceding and 1 following) as bigint) moving from ({NEV}) e""")
def w11_nulls(spark, sf):
    """W-11 with NULL keys, order values and measures."""
    from ..operators.scan import moving_sum
    x = moving_sum(_nev(spark, sf), ["user_id"], ["dt", "event_id"], "cents", "moving")
    return x.select("event_id", F.col("moving").cast("bigint").alias("moving"))


@register("win_first_ntile_nulls", f"""select event_id, dt from (
  select event_id, dt, ntile(5) over (order by dt nulls first, event_id) q from ({NEV}) e) t where q = 1""")
def w12_nulls(spark, sf):
    """W-12 first bucket with NULL order values, which sort first."""
    from ..operators.ranking import first_ntile
    return first_ntile(_nev(spark, sf), "dt", ["event_id"], 5).select("event_id", "dt")


@register("win_rank_family_nulls", f"""select event_id, event_type, cents,
  cast(rank() over (partition by event_type order by cents desc nulls last) as integer) rp,
  cast(dense_rank() over (partition by event_type order by cents desc nulls last) as integer) drp,
  cast(row_number() over (partition by event_type order by cents desc nulls last, event_id) as integer) rmp
  from ({NEV}) t""")
def w13_nulls(spark, sf):
    """W-13 with NULL groups and NULL values."""
    from ..operators.ranking import rank_family
    x = _nev(spark, sf).select("event_id", "event_type", "cents")
    return rank_family(x, ["event_type"], "cents", tiebreak=["event_id"])


@register("win_topk_rank", f"""select event_type, user_id, n from (
  select *, rank() over (partition by event_type order by n desc) rk from ({UT}) t) s where rk <= 3""")
def w15(spark, sf):
    """W-15 top-k per group with ties kept."""
    from ..operators.topk import top_k_per_group
    ut = _d(spark, sf).events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_group(ut, ["event_type"], [F.col("n").desc()], 3, "rank", out=None)


@register("win_topk_row_number", f"""select event_type, user_id, n from (
  select *, row_number() over (partition by event_type order by n desc, user_id) rk from ({UT}) t) s where rk <= 3""")
def w16(spark, sf):
    """W-16 top-k per group, ties cut."""
    from ..operators.topk import top_k_per_group
    ut = _d(spark, sf).events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_group(ut, ["event_type"], [F.col("n").desc(), F.col("user_id")], 3, "row_number", out=None)


# ----------------------------------------------------------------- sort / limit / set / generators
@register("top_n", with_ctes("""select order_id, total_amount from order_info
order by total_amount desc, order_id limit 10""", "order_info"))
def o01(spark, sf):
    """O-01 order by + limit (TakeOrderedAndProject)."""
    from ..operators.topk import top_n
    return top_n(D.order_info(_d(spark, sf)).select("order_id", "total_amount"),
                 [F.col("total_amount").desc(), F.col("order_id")], 10)


@register("top_n_filtered", with_ctes("""select id, category3_name from (
  select id, unnest(string_split(category3_name, '/')) part, category3_name from sku) t
where part = 'ECONOMY' order by id desc limit 5""", "sku"))
def o02(spark, sf):
    """O-02 explode + filter + top-n."""
    from ..operators.topk import top_n
    s = D.sku(_d(spark, sf)).select("id", "category3_name", F.explode(F.split("category3_name", "/")).alias("part"))
    return top_n(s.where(F.col("part") == "ECONOMY").select("id", "category3_name"), [F.col("id").desc()], 5)


@register("sort_result", with_ctes("""select tm_id, count(*) skus from sku group by tm_id order by skus desc, tm_id""",
                                   "sku"))
def o03(spark, sf):
    """O-03 total sort of an aggregate (range-partitioned sort)."""
    return D.sku(_d(spark, sf)).groupBy("tm_id").agg(F.count(F.lit(1)).alias("skus")).orderBy(F.desc("skus"), "tm_id")


UNION_SQL = "select user_id, sku_id from order_detail union {kind} select user_id, sku_id from refund_info"


@register("union_all", with_ctes(UNION_SQL.format(kind="all"), "order_detail", "refund_info"))
def o04(spark, sf):
    """O-04 bag union."""
    d = _d(spark, sf)
    return D.order_detail(d).select("user_id", "sku_id").unionByName(D.refund_info(d).select("user_id", "sku_id"))


@register("union_distinct", with_ctes(UNION_SQL.format(kind=""), "order_detail", "refund_info"))
def o05(spark, sf):
    """O-05 set union."""
    return o04(spark, sf).distinct()


@register("explode_array", with_ctes("""select common.mid mid_id, d.item display_item, d."order" display_order
from (select common, unnest(displays) d from page_log where displays is not null) t""", "page_log"))
def o06(spark, sf):
    """O-06 ``lateral view explode(array)``; NULL / empty arrays give no rows."""
    x = D.page_log(_d(spark, sf)).select("common", F.explode("displays").alias("d"))
    return x.select(F.col("common.mid").alias("mid_id"), F.col("d.item").alias("display_item"),
                    F.col("d.order").alias("display_order"))


@register("explode_split", """select p_partkey, unnest(string_split(p_name, ' ')) word from part""")
def o07(spark, sf):
    """O-07 split a string, then explode."""
    return _d(spark, sf).part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@register("explode_in_select", with_ctes("select unnest(category) category_name from video", "video"))
def o08(spark, sf):
    """O-08 ``select explode(c)`` without a lateral view."""
    return WS.video(_d(spark, sf)).select(F.explode("category").alias("category_name"))


@register("explode_literal_periods", with_ctes(f"""select recent_days, count(*) orders
from order_info, (values (1), (7), (30)) v(recent_days)
where dt <= '{DAY}' and dt >= strftime(date '{DAY}' - cast(recent_days - 1 as integer), '%Y-%m-%d')
group by recent_days""", "order_info"))
def o09(spark, sf):
    """O-09 fan out to (1, 7, 30) and filter per period (widest bound pruned first)."""
    x = recent_days(D.order_info(_d(spark, sf), add_days(DAY, -29), DAY), DAY)
    return x.groupBy("recent_days").agg(F.count(F.lit(1)).alias("orders"))


@register("explode_struct_fields", with_ctes("""select common.mid mid_id, a.action_id action_id, a.ts action_ts
from (select common, unnest(actions) a from page_log where actions is not null) t""", "page_log"))
def o10(spark, sf):
    """O-10 explode an array of structs and read the fields."""
    x = D.page_log(_d(spark, sf)).select("common", F.explode("actions").alias("a"))
    return x.select(F.col("common.mid").alias("mid_id"), F.col("a.action_id").alias("action_id"),
                    F.col("a.ts").alias("action_ts"))


# ----------------------------------------------------------------- scalar functions
@register("fn_concat", with_ctes("""select ts, common.uid || '-' || page.last_page_id uid_page,
  common.mid || '-' || cast(ts as varchar) mid_ts from page_log""", "page_log"))
def f01(spark, sf):
    """F-01 ``concat``: NULL if any argument is NULL; mixed types."""
    x = D.page_log(_d(spark, sf))
    return x.select("ts", F.concat("common.uid", F.lit("-"), "page.last_page_id").alias("uid_page"),
                    F.concat("common.mid", F.lit("-"), F.col("ts").cast("string")).alias("mid_ts"))


@register("fn_concat_ws", """select p_partkey, concat_ws(',', p_type, p_brand) type_brand,
  array_to_string([p_type, p_brand, p_name], '|') joined from part""")
def f02(spark, sf):
    """F-02 ``concat_ws`` on columns and on an array."""
    p = _d(spark, sf).part
    return p.select("p_partkey", F.concat_ws(",", "p_type", "p_brand").alias("type_brand"),
                    F.concat_ws("|", F.array("p_type", "p_brand", "p_name")).alias("joined"))


@register("fn_substring", with_ctes("select orderdate, substr(orderdate, 1, 7) month_key from business", "business"))
def f03(spark, sf):
    """F-03 ``substring(s, 1, 7)``."""
    return WS.business(_d(spark, sf)).select("orderdate", F.substring("orderdate", 1, 7).alias("month_key"))


@register("fn_split", """select p_partkey, string_split(p_name, ' ') words from part""")
def f04(spark, sf):
    """F-04 ``split`` (regular expression)."""
    return _d(spark, sf).part.select("p_partkey", F.split("p_name", " ").alias("words"))


@register("fn_md5", """select c_custkey, md5(c_name) name_md5 from customer""")
def f05(spark, sf):
    """F-05 one-way masking."""
    return _d(spark, sf).customer.select("c_custkey", mask("c_name").alias("name_md5"))


@register("fn_date_format", """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') d,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') dts, strftime(cast(strftime(o_orderdate, '%Y-%m-%d') as date), '%Y-%m')
    month_of_text from orders""")
def f06(spark, sf):
    """F-06 ``date_format`` of a timestamp and of a date string."""
    o = _d(spark, sf).orders
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
                    F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("dts"),
                    F.date_format(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM").alias("month_of_text"))


@register("fn_from_utc_timestamp", """select event_id,
  strftime(epoch_ms(epoch_us(ts) // 1000) + interval 8 hour, '%Y-%m-%d %H:%M:%S') local_time,
  strftime(epoch_ms(epoch_us(ts) // 1000000 * 1000) + interval 8 hour, '%Y-%m-%d') local_day from events""")
def f07(spark, sf):
    """F-07 epoch (ms for logs, s x 1000 for CDC) to GMT+8 wall time."""
    from ..functions.scalar import epoch_ms, local_time_s
    e = _d(spark, sf).events
    secs = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)).cast("bigint")
    return e.select("event_id", local_time(epoch_ms("ts")).alias("local_time"),
                    local_time_s(secs, "yyyy-MM-dd").alias("local_day"))


@register("fn_date_add", with_ctes("""select order_id, recent_days,
  strftime(cast(dt as date) + cast(-recent_days + 1 as integer), '%Y-%m-%d') lo
from order_info, (values (1), (7), (30)) v(recent_days)""", "order_info"))
def f08(spark, sf):
    """F-08 ``date_add`` with a non-constant offset (``-recent_days + 1``), per order."""
    x = fan_out(D.order_info(_d(spark, sf)).select("order_id", "dt"), (1, 7, 30))
    return x.select("order_id", "recent_days",
                    F.date_format(F.date_add(F.col("dt").cast("date"), -F.col("recent_days") + 1),
                                  "yyyy-MM-dd").alias("lo"))


@register("fn_date_sub", with_ctes("""select order_id, strftime(cast(dt as date) - 7, '%Y-%m-%d') week_before
from order_info""", "order_info"))
def f09(spark, sf):
    """F-09 ``date_sub``."""
    return D.order_info(_d(spark, sf)).select("order_id", F.date_format(F.date_sub(F.col("dt").cast("date"), 7),
                                                                        "yyyy-MM-dd").alias("week_before"))


@register("fn_datediff", with_ctes("""select user_id, cast(datediff('day', cast(min(dt) as date), cast(max(dt) as date))
  as integer) span_days from order_info group by user_id""", "order_info"))
def f10(spark, sf):
    """F-10 days between two dates."""
    x = D.order_info(_d(spark, sf)).groupBy("user_id").agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    return x.select("user_id", F.datediff(F.col("b").cast("date"), F.col("a").cast("date")).alias("span_days"))


@register("fn_month", with_ctes("""select orderdate, cast(month(cast(orderdate as date)) as integer) m,
  cast(year(cast(orderdate as date)) as integer) y, cast(day(cast(orderdate as date)) as integer) d,
  cast(weekofyear(cast(orderdate as date)) as integer) w from business""", "business"))
def f11(spark, sf):
    """F-11 month / year / day / weekofyear."""
    b = WS.business(_d(spark, sf))
    d = F.col("orderdate").cast("date")
    return b.select("orderdate", F.month(d).alias("m"), F.year(d).alias("y"), F.dayofmonth(d).alias("d"),
                    F.weekofyear(d).alias("w"))


@register("fn_nvl", with_ctes("select order_id, coalesce(coupon_id, -1) coupon_or_default from order_detail",
                              "order_detail"))
def f12(spark, sf):
    """F-12 ``nvl``."""
    return D.order_detail(_d(spark, sf)).select("order_id", F.coalesce("coupon_id", F.lit(-1)).alias("coupon_or_default"))


@register("fn_if", with_ctes("""select order_id, case when order_status = '1002' then 'paid' else 'other' end kind
from order_info""", "order_info"))
def f13(spark, sf):
    """F-13 ``if(p, a, b)``."""
    return D.order_info(_d(spark, sf)).select(
        "order_id", F.when(F.col("order_status") == "1002", F.lit("paid")).otherwise(F.lit("other")).alias("kind"))


@register("fn_case", with_ctes("""select order_id, case order_status when '1002' then 'paid' when '1003' then 'cancelled'
  end kind from order_info""", "order_info"))
def f14(spark, sf):
    """F-14 ``case x when ...`` without ``else`` gives NULL."""
    s = F.col("order_status")
    return D.order_info(_d(spark, sf)).select(
        "order_id", F.when(s == "1002", F.lit("paid")).when(s == "1003", F.lit("cancelled")).alias("kind"))


@register("fn_cast", """select l_orderkey, l_linenumber, cast(l_linenumber as varchar) s, cast(l_quantity as integer) q,
  cast(l_quantity as bigint) qb, cast(l_extendedprice as decimal(16,2)) amount from lineitem""")
def f15(spark, sf):
    """F-15 casts to string, int, bigint, decimal(16,2)."""
    li = _d(spark, sf).lineitem
    return li.select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("string").alias("s"),
                     F.col("l_quantity").cast("int").alias("q"), F.col("l_quantity").cast("bigint").alias("qb"),
                     F.col("l_extendedprice").cast("decimal(16,2)").alias("amount"))


@register("fn_arith", with_ctes("""select data.id id,
  cast(data.sku_num * cast(10.50 as decimal(16,2)) as decimal(18,2)) amount,
  cast(10 * (1 - cast(0.15 as decimal(16,2))) as decimal(16,2)) discount_text_base,
  data.sku_num - cast(old['sku_num'] as bigint) delta
from cart_inc where type = 'update' and old['sku_num'] is not null""", "cart_inc"))
def f16(spark, sf):
    """F-16 bigint x decimal, ``10 * (1 - d)``, subtraction with a text operand (cast)."""
    x = cdc.cdc_rows(D.cart_inc(_d(spark, sf)), kinds=("update",)).where(cdc.old_value("sku_num").isNotNull())
    return x.select(F.col("data.id").alias("id"),
                    (F.col("data.sku_num") * F.lit(10.50).cast("decimal(16,2)")).cast("decimal(18,2)").alias("amount"),
                    (F.lit(10) * (F.lit(1) - F.lit(0.15).cast("decimal(16,2)"))).cast("decimal(16,2)")
                    .alias("discount_text_base"),
                    (F.col("data.sku_num") - cdc.old_value("sku_num", "bigint")).alias("delta"))


@register("fn_named_struct", """select p_partkey, struct_pack(brand := p_brand, size := p_size) attrs from part""")
def f17(spark, sf):
    """F-17 ``named_struct``."""
    return _d(spark, sf).part.select("p_partkey", F.struct(F.col("p_brand").alias("brand"),
                                                           F.col("p_size").alias("size")).alias("attrs"))


@register("fn_array", """select p_partkey, [p_type, p_brand] tags from part""")
def f18(spark, sf):
    """F-18 literal / column array."""
    return _d(spark, sf).part.select("p_partkey", F.array("p_type", "p_brand").alias("tags"))


@register("fn_array_contains", """select p_partkey, list_contains(string_split(p_name, ' '), 'ring') has_ring
from part""")
def f19(spark, sf):
    """F-19 array membership."""
    return _d(spark, sf).part.select("p_partkey", F.array_contains(F.split("p_name", " "), "ring").alias("has_ring"))


@register("fn_map_keys", with_ctes("""select data.id id, ts, list_sort(map_keys(old)) changed from user_inc
where old is not null""", "user_inc"))
def f20(spark, sf):
    """F-20 keys of a map."""
    x = D.user_inc(_d(spark, sf), TDAY).where(F.col("old").isNotNull())
    return x.select(F.col("data.id").alias("id"), "ts", F.sort_array(F.map_keys("old")).alias("changed"))


@register("fn_compare_dates_as_text", with_ctes(f"""select user_id, min(dt) first_day, max(dt) last_day,
  max(dt) >= '{add_days(DAY, -364)}' active_last_year from order_info group by user_id""", "order_info"))
def f21(spark, sf):
    """F-21 min / max / >= on ISO day strings."""
    x = D.order_info(_d(spark, sf)).groupBy("user_id").agg(F.min("dt").alias("first_day"), F.max("dt").alias("last_day"))
    return x.withColumn("active_last_year", F.col("last_day") >= F.lit(add_days(DAY, -364)))
