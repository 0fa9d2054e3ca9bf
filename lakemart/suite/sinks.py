"""Registered source / sink queries: data derived from the driver tables is landed in
the shared checkpoint folder in the reference's formats, then read back (S-01..S-11)
or loaded through the table-management operators (K-*) and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import add_days
from ..oracle.domain import with_ctes
from ..plans import dims as DM
from ..plans import facts_trade as T
from ..plans import reports as P
from ..plans import rollups as R
from ..registry import register
from ..sinks import writers as K
from ..sinks.publish import Published
from ..sources import domain as D
from ..sources import readers as S
from ..sources import snapshots as SN
from ..sources import worked as WS
from ..sources.dictionary import dictionary
from ..sources.driver import Driver
from .reports import buyer_frames, trade_by_sql

DAY = D.TRADE_DAY


def _d(spark, sf):
    return Driver(spark, sf)


def _name(key):
    return f"lakemart_{key}_{uuid.uuid4().hex[:8]}"


# ----------------------------------------------------------------- sources
@register("scan_json", with_ctes("select common.mid mid_id, page.page_id page_id, actions, ts, dt from page_log",
                                 "page_log"))
def s01(spark, sf):
    """S-01: app log landed as JSON lines (NULL fields omitted), read with the declared
    schema — absent fields come back as NULL."""
    path = K.shared_path(spark, "landing", "log_json")
    D.page_log(_d(spark, sf)).write.mode("overwrite").partitionBy("dt").json(path)
    log = S.read_json(spark, path, schemas.LOG_WITH_DT)
    return log.select(F.col("common.mid").alias("mid_id"), F.col("page.page_id").alias("page_id"), "actions", "ts",
                      "dt")


@register("scan_delimited", with_ctes("select * from business", "business"))
def s02(spark, sf):
    """S-02: comma-delimited text with a declared schema."""
    path = K.shared_path(spark, "landing", "business_csv")
    WS.business(_d(spark, sf)).write.mode("overwrite").option("sep", ",").csv(path)
    return S.read_delimited(spark, path, schemas.BUSINESS, sep=",")


@register("scan_null_as_empty", with_ctes("select * from emp", "emp"))
def s03(spark, sf):
    """S-03: tab-delimited with NULL written as the empty field and read back as NULL."""
    path = K.shared_path(spark, "landing", "emp_tsv")
    WS.emp(_d(spark, sf)).write.mode("overwrite").option("sep", "\t").option("nullValue", "").csv(path)
    return S.read_delimited(spark, path, schemas.EMP, sep="\t")


@register("scan_nested_text", """
select c_name name, ['f' || cast(c_custkey + 1 as varchar), 'f' || cast(c_custkey + 2 as varchar)] friends,
  list_sort(['c' || cast(c_nationkey as varchar), 'd' || cast(c_custkey % 3 as varchar)]) child_names,
  cast(c_nationkey % 5 + 1 as bigint) child_total, 'street ' || cast(c_custkey as varchar) street,
  'city ' || cast(n_nationkey as varchar) city
from customer join nation on c_nationkey = n_nationkey""")
def s04(spark, sf):
    """S-04: array / map / struct in delimited text (',' fields, '_' items, ':' keys)."""
    d = _d(spark, sf)
    c = d.customer.join(d.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat_ws(",", "c_name",
                       F.concat_ws("_", F.concat(F.lit("f"), (F.col("c_custkey") + 1).cast("string")),
                                   F.concat(F.lit("f"), (F.col("c_custkey") + 2).cast("string"))),
                       F.concat_ws("_", F.concat(F.lit("c"), F.col("c_nationkey").cast("string"), F.lit(":"),
                                                 (F.col("c_nationkey") % 5).cast("string")),
                                   F.concat(F.lit("d"), (F.col("c_custkey") % 3).cast("string"), F.lit(":1"))),
                       F.concat_ws("_", F.concat(F.lit("street "), F.col("c_custkey").cast("string")),
                                   F.concat(F.lit("city "), F.col("n_nationkey").cast("string"))))
    path = K.shared_path(spark, "landing", "test_text")
    c.select(line.alias("value")).write.mode("overwrite").text(path)
    t = S.read_nested_text(spark, path, [("name", "string"), ("friends", "array"), ("children", "map<int>"),
                                         ("address", "struct:street,city")])
    return t.select("name", "friends", F.sort_array(F.map_keys("children")).alias("child_names"),
                    F.aggregate(F.map_values("children"), F.lit(0).cast("bigint"),
                                lambda a, v: a + v).alias("child_total"),
                    F.col("address.street").alias("street"), F.col("address.city").alias("city"))


LI_SQL = """select l_returnflag, count(*) n, cast(sum(cast(l_quantity as bigint)) as bigint) qty from lineitem
{where} group by l_returnflag"""


def _lines(spark, sf):
    return _d(spark, sf).lineitem.select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")


@register("scan_orc", LI_SQL.format(where="where l_linestatus = 'F'"))
def s05(spark, sf):
    """S-05: ORC (snappy) read with a pushed-down filter."""
    path = K.shared_path(spark, "landing", "lines_orc")
    K.write_compressed(_lines(spark, sf), path, "orc", "snappy")
    x = S.read_orc(spark, path).where(F.col("l_linestatus") == "F")
    return x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))


@register("scan_parquet", LI_SQL.format(where=""))
def s06(spark, sf):
    """S-06: Parquet (snappy)."""
    path = K.shared_path(spark, "landing", "lines_parquet")
    K.write_compressed(_lines(spark, sf), path, "parquet", "snappy")
    x = S.read_parquet(spark, path)
    return x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))


_LANDED: dict[tuple[str, str], str] = {}


def _landed_orders(spark, sf):
    """Order headers landed once per session as a dt-partitioned Parquet folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LANDED:
        path = K.shared_path(spark, "landing", "order_info")
        K.partition_layout(D.order_info(_d(spark, sf)), ["dt"]).write.mode("overwrite").partitionBy("dt").parquet(path)
        _LANDED[key] = path
    return S.read_parquet(spark, _LANDED[key], schemas.ORDER_INFO)


OI = "select order_id, user_id, total_amount, dt from order_info where {w}"


@register("scan_partition", with_ctes(OI.format(w=f"dt = '{DAY}'"), "order_info"))
def s07(spark, sf):
    """S-07: one day of a dt-partitioned table (partition pruning)."""
    return S.scan_partition(_landed_orders(spark, sf), DAY).select("order_id", "user_id", "total_amount", "dt")


@register("scan_partition_range", with_ctes(OI.format(w=f"dt >= '{add_days(DAY, -29)}' and dt <= '{DAY}'"),
                                            "order_info"))
def s08(spark, sf):
    """S-08: a 30-day range with literal bounds."""
    x = S.scan_range(_landed_orders(spark, sf), add_days(DAY, -29), DAY)
    return x.select("order_id", "user_id", "total_amount", "dt")


@register("scan_two_days", with_ctes(OI.format(w=f"dt in ('{DAY}', '{add_days(DAY, -1)}')"), "order_info"))
def s09(spark, sf):
    """S-09: D and D-1."""
    x = S.scan_days(_landed_orders(spark, sf), [DAY, add_days(DAY, -1)])
    return x.select("order_id", "user_id", "total_amount", "dt")


_TABLES: dict[tuple[str, str], str] = {}


def _new_orders_table(spark, sf, key):
    """The landed orders as a catalog table whose partitions are registered."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _landed_orders(spark, sf).schema)
    t = _name(key)
    K.create_partitioned(spark, t, columns, ["dt"], _LANDED[(spark.sparkContext.applicationId, sf)])
    K.partition_repair(spark, t)
    return t


def _orders_table(spark, sf):
    """That table, made once per session for the queries that only read it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TABLES:
        _TABLES[key] = _new_orders_table(spark, sf, "orders")
    return _TABLES[key]


@register("scan_latest_partition", with_ctes(OI.format(w=f"dt = '{add_days(DAY, -1)}'"), "order_info"))
def s10(spark, sf):
    """S-10: the latest partition up to yesterday, found in the catalog without a scan."""
    return S.scan_latest(spark, _orders_table(spark, sf), add_days(DAY, -1)).select("order_id", "user_id", "total_amount", "dt")


@register("scan_latest_partition_gap", with_ctes(OI.format(
    w=f"dt = (select max(dt) from order_info where dt < '{add_days(DAY, -1)}')"), "order_info"))
def s10_gap(spark, sf):
    """S-10 where yesterday's partition was never loaded: the one before it is read, not an empty day."""
    t = _new_orders_table(spark, sf, "gap")
    K.partition_drop(spark, t, {"dt": add_days(DAY, -1)})
    return S.scan_latest(spark, t, add_days(DAY, -1)).select("order_id", "user_id", "total_amount", "dt")


@register("scan_days_from_table", with_ctes("""select order_id, user_id, total_amount, dt from order_info
where dt in (select strftime(d, '%Y-%m-%d') from (select distinct cast(o_orderdate as date) d from orders) t
             where isodow(d) = 1 and quarter(d) = 2)""", "order_info"))
def s09_joined(spark, sf):
    """S-09 with the days in a table (the Mondays of second quarters, from the date dimension): dynamic partition pruning reads
    only the partitions that the joined days name."""
    days = K.landed(DM.dim_date(SN.date_seed(_d(spark, sf))), "dim_date")
    mondays = days.where((F.col("week_day") == "1") & (F.col("quarter") == "2")).select(F.col("date_id").alias("dt"))
    x = spark.table(_orders_table(spark, sf))
    return x.join(F.broadcast(mondays), "dt").select("order_id", "user_id", "total_amount", "dt")  # one row a calendar day


@register("bucket_sample_files", "select c_custkey, c_name from customer where c_custkey % 4 = 0")
def p14_files(spark, sf):
    """P-14 read from a table kept by bucket: only the files of bucket 1 of 4 are opened."""
    t = _name("sampled")
    K.create_sampled(_d(spark, sf).customer.select("c_custkey", "c_name"), t, "c_custkey", 4, K.shared_path(spark, "tables", t))
    return S.sample_bucket(spark, t, 1)


@register("select_star", with_ctes("select * from order_info", "order_info"))
def s11(spark, sf):
    """S-11: ``select *`` of a table in the shared folder."""
    t = _name("ctas")
    K.ctas(spark, t, D.order_info(_d(spark, sf)), K.shared_path(spark, "tables", t))
    return S.select_star(spark, t)


# ----------------------------------------------------------------- sinks / table management
CART_COLS = "user_id bigint, cart_add_count_1d bigint, cart_add_num_1d bigint, dt string"
TDAY = D.TRAFFIC_DAY


def _cart_table(spark, key):
    t = _name(key)
    K.create_partitioned(spark, t, CART_COLS, ["dt"], K.shared_path(spark, "tables", t))
    return t


def _cart_1d(spark, sf):
    """The daily rollup that the partition loads here write: cart adds by user and day."""
    return R.user_cart_add_1d(T.cart_add(D.cart_inc(_d(spark, sf)), dictionary(spark)))


def _corrupt(df):
    return df.withColumn("cart_add_count_1d", F.col("cart_add_count_1d") * 10)


@register("create_partitioned", with_ctes("select * from ca1d", "ca1d"))
def k01(spark, sf):
    """K-01: a table declared ``PARTITIONED BY (dt)``, loaded, read back whole."""
    t = _cart_table(spark, "created")
    K.overwrite_dynamic_partition(spark, _cart_1d(spark, sf), t)
    return spark.table(t)


@register("overwrite_static_partition_carts", with_ctes("select * from ca1d", "ca1d"))
def k05_carts(spark, sf):
    """K-05 over the event days: a wrong day D is replaced by ``INSERT OVERWRITE ... PARTITION (dt='D')``;
    the other days are untouched."""
    x = _cart_1d(spark, sf)
    t = _cart_table(spark, "static")
    K.overwrite_dynamic_partition(spark, x.where(F.col("dt") != TDAY).unionByName(_corrupt(x.where(F.col("dt") == TDAY))), t)
    K.overwrite_static_partition(spark, x.where(F.col("dt") == TDAY).drop("dt"), t, {"dt": TDAY})
    return spark.table(t)


@register("overwrite_dynamic_partition_carts", with_ctes("select * from ca1d", "ca1d"))
def k06_carts(spark, sf):
    """K-06 over the event days: the last 7 days are corrupted, then a dynamic ``PARTITION (dt)`` load
    replaces exactly those days."""
    x = _cart_1d(spark, sf)
    lo = add_days(TDAY, -6)
    t = _cart_table(spark, "dynamic")
    K.overwrite_dynamic_partition(spark, x.where(F.col("dt") < lo).unionByName(_corrupt(x.where(F.col("dt") >= lo))), t)
    K.overwrite_dynamic_partition(spark, x.where(F.col("dt") >= lo), t)
    return spark.table(t)


@register("insert_append_carts", with_ctes("select * from ca1d", "ca1d"))
def k07_carts(spark, sf):
    """K-07 over the event days: ``INSERT INTO`` the last day after the history."""
    x = _cart_1d(spark, sf)
    t = _cart_table(spark, "append")
    K.insert_append(spark, x.where(F.col("dt") < TDAY), t)
    K.insert_append(spark, x.where(F.col("dt") == TDAY), t)
    return spark.table(t)


@register("partition_list_carts", with_ctes('select distinct \'dt=\' || dt "partition" from ca1d', "ca1d"))
def k16_carts(spark, sf):
    """K-16 over the event days: ``SHOW PARTITIONS`` of a dynamically loaded dt-partitioned table."""
    t = _cart_table(spark, "parts")
    K.overwrite_dynamic_partition(spark, _cart_1d(spark, sf), t)
    return K.partition_list(spark, t)


@register("partition_repair_carts", with_ctes("select * from ca1d", "ca1d"))
def k17_carts(spark, sf):
    """K-17 over the event days: partition folders written by path, table declared over them, ``MSCK
    REPAIR TABLE`` discovers the days."""
    t = _name("repair")
    loc = K.shared_path(spark, "tables", t)
    K.partition_layout(_cart_1d(spark, sf), ["dt"]).write.mode("overwrite").partitionBy("dt").parquet(loc)
    K.create_partitioned(spark, t, CART_COLS, ["dt"], loc)
    K.partition_repair(spark, t)
    return spark.table(t)


# The surveyed loads: the order rollup by user and day, over all order days (thousands of partitions).
ORDER_COLS = ("user_id bigint, order_count_1d bigint, order_num_1d bigint, order_original_amount_1d decimal(16,2), "
              "activity_reduce_amount_1d decimal(16,2), coupon_reduce_amount_1d decimal(16,2), "
              "order_total_amount_1d decimal(16,2), dt string")


def _order_table(spark, key):
    t = _name(key)
    K.create_partitioned(spark, t, ORDER_COLS, ["dt"], K.shared_path(spark, "tables", t))
    return t


def _order_1d(spark, sf):
    return R.user_order_1d(D.order_detail(_d(spark, sf)))


def _corrupt_orders(df):
    return df.withColumn("order_count_1d", F.col("order_count_1d") * 10)


@register("overwrite_static_partition", with_ctes("select * from uo1d", "uo1d"))
def k05(spark, sf):
    """K-05, all order days: a wrong day D is replaced, the other days are untouched."""
    x = _order_1d(spark, sf)
    t = _order_table(spark, "static_orders")
    K.overwrite_dynamic_partition(spark, x.where(F.col("dt") != DAY).unionByName(_corrupt_orders(x.where(F.col("dt") == DAY))), t)
    K.overwrite_static_partition(spark, x.where(F.col("dt") == DAY).drop("dt"), t, {"dt": DAY})
    return spark.table(t)


@register("overwrite_dynamic_partition", with_ctes("select * from uo1d", "uo1d"))
def k06(spark, sf):
    """K-06, all order days: the last 7 are corrupted and replaced, the others are untouched."""
    x = _order_1d(spark, sf)
    lo = add_days(DAY, -6)
    t = _order_table(spark, "dynamic_orders")
    K.overwrite_dynamic_partition(spark, x.where(F.col("dt") < lo).unionByName(_corrupt_orders(x.where(F.col("dt") >= lo))), t)
    K.overwrite_dynamic_partition(spark, x.where(F.col("dt") >= lo), t)
    return spark.table(t)


@register("insert_append", with_ctes("select * from uo1d", "uo1d"))
def k07(spark, sf):
    """K-07, all order days: ``INSERT INTO`` the last day after the history."""
    x = _order_1d(spark, sf)
    t = _order_table(spark, "append_orders")
    K.insert_append(spark, x.where(F.col("dt") < DAY), t)
    K.insert_append(spark, x.where(F.col("dt") == DAY), t)
    return spark.table(t)


@register("partition_list", with_ctes('select distinct \'dt=\' || dt "partition" from uo1d', "uo1d"))
def k16(spark, sf):
    """K-16, all order days: ``SHOW PARTITIONS`` of a table of thousands of days."""
    t = _order_table(spark, "parts_orders")
    K.overwrite_dynamic_partition(spark, _order_1d(spark, sf), t)
    return K.partition_list(spark, t)


@register("partition_repair", with_ctes("select * from uo1d", "uo1d"))
def k17(spark, sf):
    """K-17, all order days: ``MSCK REPAIR TABLE`` discovers thousands of day folders."""
    t = _name("repair_orders")
    loc = K.shared_path(spark, "tables", t)
    K.partition_layout(_order_1d(spark, sf), ["dt"]).write.mode("overwrite").partitionBy("dt").parquet(loc)
    K.create_partitioned(spark, t, ORDER_COLS, ["dt"], loc)
    K.partition_repair(spark, t)
    return spark.table(t)


@register("write_compressed", "select event_id, user_id, event_type from events")
def k04(spark, sf):
    """K-04: ORC with zlib, read back whole."""
    path = K.shared_path(spark, "landing", "events_orc")
    K.write_compressed(_d(spark, sf).events.select("event_id", "user_id", "event_type"), path, "orc", "zlib")
    return S.read_orc(spark, path)


@register("ctas", with_ctes("select order_id, user_id, total_amount, dt from order_info", "order_info"))
def k10(spark, sf):
    """K-10: ``CREATE TABLE ... AS SELECT`` as ORC."""
    t = _name("ctas")
    x = D.order_info(_d(spark, sf)).select("order_id", "user_id", "total_amount", "dt")
    K.ctas(spark, t, x, K.shared_path(spark, "tables", t), "orc")
    return spark.table(t)


@register("append_distinct", with_ctes(trade_by_sql(["tm_id", "tm_name"]), "od1d", "odnd", "rf1d", "rfnd"))
def k09(spark, sf):
    """K-09: a report loaded twice through ``old ∪ new`` without duplicates stays
    unchanged (the load is idempotent)."""
    rows = P.trade_by_brand(*buyer_frames(_d(spark, sf), P.BRAND), DAY)
    t = _name("report")
    loc = K.shared_path(spark, "tables", t)
    spark.sql(f"CREATE TABLE {t} (dt string, recent_days int, tm_id string, tm_name string, order_count bigint, "
              f"order_user_count bigint, order_refund_count bigint, order_refund_user_count bigint) "
              f"USING parquet LOCATION '{loc}'")
    rows = K.landed(rows, "report_rows")
    K.append_distinct(spark, t, rows, "dt")
    K.append_distinct(spark, t, rows, "dt")  # writes nothing
    return spark.table(t)


UO_COLS = ORDER_COLS


@register("publish_partitions", with_ctes("select * from uo1d", "uo1d"))
def k05_k06_atomic(spark, sf):
    """K-05 / K-06 with several partitions published in one step: a first version with the last 7 days corrupted, then these
    days replaced together; readers of the first version keep it."""
    x = K.landed(_order_1d(spark, sf), "order_days")
    lo = add_days(DAY, -6)
    p = Published(spark, K.shared_path(spark, "published", "orders"), UO_COLS)
    p.publish(x.where(F.col("dt") < lo).unionByName(_corrupt_orders(x.where(F.col("dt") >= lo))), tag=add_days(DAY, -1))
    p.publish(x.where(F.col("dt") >= lo), replaced=[add_days(DAY, -k) for k in range(7)], tag=DAY)
    return p.read()


@register("merge_report", with_ctes(trade_by_sql(["tm_id", "tm_name"]), "od1d", "odnd", "rf1d", "rfnd"))
def k09_keyed(spark, sf):
    """K-09 as a keyed merge into published partitions: half of the rows are loaded, then all; the second load writes only the
    stat day, the third nothing."""
    rows = K.landed(P.trade_by_brand(*buyer_frames(_d(spark, sf), P.BRAND), DAY), "report_rows")
    p = Published(spark, K.shared_path(spark, "published", "report"), rows.schema)
    for part in (rows.where("recent_days = 1"), rows, rows):
        p.merge(part, ["dt", "recent_days", *P.BRAND])
    return p.read()


@register("create_bucketed", with_ctes("select * from uo1d", "uo1d"))
def k03(spark, sf):
    """K-03: 4 hash buckets on the user key (bucketed reads of the same key skip the
    shuffle)."""
    t = _name("bucketed")
    K.create_bucketed(R.user_order_1d(D.order_detail(_d(spark, sf))), t, 4, "user_id",
                      K.shared_path(spark, "tables", t))
    return spark.table(t)


@register("bucketed_join_aggregate", with_ctes("""select o.user_id, o.order_days, r.refund_days
from (select user_id, count(*) order_days from uo1d group by user_id) o
join (select user_id, count(*) refund_days from ur1d group by user_id) r on o.user_id = r.user_id""", "uo1d", "ur1d"))
def k03_used(spark, sf):
    """K-03 used: two tables with the same buckets are aggregated on the key and joined, all without an exchange."""
    d = _d(spark, sf)
    tables = []
    for key, df in (("ob", R.user_order_1d(D.order_detail(d))), ("rb", R.user_refund_1d(D.refund_info(d)))):
        t = _name(key)
        K.create_bucketed(df, t, 8, "user_id", K.shared_path(spark, "tables", t))
        tables.append(spark.table(t))
    orders, refunds = (t.groupBy("user_id").agg(F.count(F.lit(1)).alias(n)) for t, n in zip(tables, ("order_days", "refund_days"), strict=True))
    return orders.hint("merge").join(refunds, "user_id")


@register("create_partitioned_multi", """select event_id, event_type, strftime(ts, '%Y-%m-%d') "day",
  strftime(ts, '%H') "hour" from events""")
def k02(spark, sf):
    """K-02: two partition levels (day, hour), every hour read back."""
    t = _name("multi")
    K.create_partitioned(spark, t, "event_id bigint, event_type string, day string, hour string", ["day", "hour"],
                         K.shared_path(spark, "tables", t))
    e = _d(spark, sf).events.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"),
                                    F.date_format("ts", "HH").alias("hour"))
    K.overwrite_dynamic_partition(spark, e, t)
    return spark.table(t)


@register("export_dir", with_ctes("select name || chr(9) || dept_id || chr(9) || sex value from emp_sex", "emp_sex"))
def k13(spark, sf):
    """K-13: query result exported as tab-delimited text, read back as lines."""
    path = K.shared_path(spark, "export", "emp_sex")
    K.export_dir(WS.emp_sex(_d(spark, sf)), path, "\t")
    return spark.read.text(path)


LOG_FIELDS = ("track_time string, url string, session_id string, referer string, ip string, end_user_id string, "
              "city_id string")


@register("format_roundtrip", " union all ".join(
    f"select '{f}' fmt, count(*) n, cast(sum(user_id % 25) as bigint) city_sum from events"
    for f in ("orc-none", "orc-zlib", "orc-snappy", "parquet-snappy")))
def q21(spark, sf):
    """Q-21 + K-04 + K-11: a text log table copied to ORC (none / zlib / snappy) and
    Parquet (snappy), each copy read back."""
    e = _d(spark, sf).events
    log = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("track_time"),
                   F.concat(F.lit("/"), F.col("event_type")).alias("url"), F.col("user_id").cast("string").alias("session_id"),
                   F.lit(None).cast("string").alias("referer"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 250)
                                                                          .cast("string")).alias("ip"),
                   F.col("user_id").cast("string").alias("end_user_id"),
                   (F.col("user_id") % 25).cast("string").alias("city_id"))
    text = K.shared_path(spark, "landing", "log_text")
    log.write.mode("overwrite").option("sep", "\t").option("nullValue", "").csv(text)
    src = S.read_delimited(spark, text, LOG_FIELDS, sep="\t")
    outs = []
    for fmt, codec in (("orc", "none"), ("orc", "zlib"), ("orc", "snappy"), ("parquet", "snappy")):
        path = K.shared_path(spark, "formats", f"{fmt}_{codec}")
        K.write_compressed(src, path, fmt, codec)
        back = spark.read.format(fmt).load(path)
        outs.append(back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("city_id").cast("bigint")).alias("city_sum"))
                    .select(F.lit(f"{fmt}-{codec}").alias("fmt"), "n", "city_sum"))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


NATION_COLS = "deptno int, dname string, loc string"
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")  # as a statement would name them


def _dept_table(spark, key):
    t = _name(key)
    K.create_partitioned(spark, t, NATION_COLS + ", region string", ["region"], K.shared_path(spark, "tables", t))
    return t


def _depts(spark, sf):
    d = _d(spark, sf)
    j = d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("n_nationkey").alias("deptno"), F.col("n_name").alias("dname"),
                    F.concat(F.lit("loc "), F.col("n_regionkey").cast("string")).alias("loc"),
                    F.col("r_name").alias("region"))


@register("partition_add", """select 'region=' || r_name "partition" from region
union all select 'region=' || r_name || '_NEXT' from region""")
def k14(spark, sf):
    """K-14: register empty partitions next to the loaded ones (several at once)."""
    t = _dept_table(spark, "add")
    K.overwrite_dynamic_partition(spark, _depts(spark, sf), t)
    K.partition_add(spark, t, *[{"region": f"{n}_NEXT"} for n in REGIONS])
    return K.partition_list(spark, t)


@register("partition_drop", """select deptno, dname, loc, region from (
  select n_nationkey deptno, n_name dname, 'loc ' || cast(n_regionkey as varchar) loc, r_name region, r_regionkey
  from nation join region on n_regionkey = r_regionkey) t
where r_regionkey <> (select min(r_regionkey) from region)""")
def k15(spark, sf):
    """K-15: drop one partition; the other partitions' rows remain."""
    t = _dept_table(spark, "drop")
    K.overwrite_dynamic_partition(spark, _depts(spark, sf), t)
    K.partition_drop(spark, t, {"region": REGIONS[0]})
    return spark.table(t)


@register("overwrite_table", "select s_suppkey, s_name, s_nationkey from supplier")
def k08(spark, sf):
    """K-08: replace a whole unpartitioned table."""
    t = _name("overwrite")
    spark.sql(f"CREATE TABLE {t} (s_suppkey bigint, s_name string, s_nationkey int) USING parquet "
              f"LOCATION '{K.shared_path(spark, 'tables', t)}'")
    sup = _d(spark, sf).supplier.select("s_suppkey", "s_name", "s_nationkey")
    K.insert_append(spark, sup.withColumn("s_name", F.lit("stale")), t)
    K.overwrite_table(spark, sup, t)
    return spark.table(t)


@register("load_files", "select s_suppkey, s_name, s_nationkey from supplier union all "
                        "select s_suppkey, s_name, s_nationkey from supplier")
def k11(spark, sf):
    """K-11: tab-delimited files loaded into a table twice (append), after an
    overwrite load of a stale copy."""
    path = K.shared_path(spark, "landing", "supplier_tsv")
    sup = _d(spark, sf).supplier.select("s_suppkey", "s_name", "s_nationkey")
    sup.write.mode("overwrite").option("sep", "\t").csv(path)
    files = S.read_delimited(spark, path, "s_suppkey bigint, s_name string, s_nationkey int")
    t = _name("load")
    spark.sql(f"CREATE TABLE {t} (s_suppkey bigint, s_name string, s_nationkey int) USING parquet "
              f"LOCATION '{K.shared_path(spark, 'tables', t)}'")
    K.load_files(spark, t, files.withColumn("s_name", F.lit("stale")), overwrite=True)
    K.load_files(spark, t, files, overwrite=True)
    K.load_files(spark, t, files, overwrite=False)
    return spark.table(t)


@register("load_partition", f"""select event_id, event_type, '{D.TRAFFIC_DAY}' dt from events
where strftime(ts, '%Y-%m-%d') = '{D.TRAFFIC_DAY}'""")
def k12(spark, sf):
    """K-12: one day's landed file loaded into partition ``dt='D'`` (overwrite)."""
    day = D.TRAFFIC_DAY
    path = K.shared_path(spark, "landing", "events_day")
    ts = F.col("ts")  # a range on the column itself reaches the scan
    e = _d(spark, sf).events.where((ts >= F.lit(day).cast("timestamp_ntz")) & (ts < F.lit(add_days(day, 1)).cast("timestamp_ntz"))) \
        .select("event_id", "event_type")
    e.write.mode("overwrite").option("sep", "\t").csv(path)
    t = _name("loadpart")
    K.create_partitioned(spark, t, "event_id bigint, event_type string, dt string", ["dt"],
                         K.shared_path(spark, "tables", t))
    files = S.read_delimited(spark, path, "event_id bigint, event_type string")
    K.load_partition(spark, t, files, {"dt": day})
    K.load_partition(spark, t, files, {"dt": day})  # overwrite: loading twice keeps one copy
    return spark.table(t)


@register("truncate_drop", "select s_suppkey, s_name from supplier")
def k18(spark, sf):
    """K-18: create and use a database, truncate a table, reload it, drop another."""
    db = _name("db")
    K.create_database(spark, db)
    try:
        t = f"{db}.sup"
        spark.sql(f"CREATE TABLE {t} (s_suppkey bigint, s_name string) USING parquet "
                  f"LOCATION '{K.shared_path(spark, 'tables', db)}'")
        sup = _d(spark, sf).supplier.select("s_suppkey", "s_name")
        K.insert_append(spark, sup, t)
        K.truncate(spark, t)
        K.insert_append(spark, sup, t)
        K.drop_table(spark, f"{db}.never_created")
        return spark.table(t)
    finally:
        spark.sql("USE default")
