"""Full-snapshot (``_full``) landed tables derived from the driver tables.

Product snapshots come from ``part`` (brand = p_brand; category path = type / size /
name; spu = name); attribute sets from the distinct (part, supplier) and
(part, return flag) pairs of ``lineitem``; coupons and activities from the supplier
keys the order lines use (``l_suppkey % 10`` / ``% 7``); the date seed from the order
days.  All are pure DataFrame derivations over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import money
from .driver import Driver


def _c2(p="p_type", s="p_size"):
    return F.concat_ws("/", F.col(p), F.col(s).cast("string"))


def _c3():
    return F.concat_ws("/", F.col("p_type"), F.col("p_size").cast("string"), F.col("p_name"))


def sku_info(drv: Driver) -> DataFrame:
    return drv.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("spu_id"), money("p_retailprice").alias("price"),
        F.col("p_name").alias("sku_name"), F.concat_ws(" ", "p_name", "p_type").alias("sku_desc"),
        F.col("p_size").cast("decimal(16,2)").alias("weight"), F.col("p_brand").alias("tm_id"),
        _c3().alias("category3_id"),
        F.when(F.col("p_partkey") % 10 == 0, F.lit("0")).otherwise(F.lit("1")).alias("is_sale"),
        F.lit("2001-01-01 00:00:00").alias("create_time"))


def spu_info(drv: Driver) -> DataFrame:
    return drv.part.select(F.col("p_name").alias("id"), F.concat(F.lit("spu "), F.col("p_name")).alias("spu_name")) \
        .distinct()


def base_category1(drv: Driver) -> DataFrame:
    return drv.part.select(F.col("p_type").alias("id"), F.col("p_type").alias("name")).distinct()


def base_category2(drv: Driver) -> DataFrame:
    return drv.part.select(_c2().alias("id"), _c2().alias("name"), F.col("p_type").alias("category1_id")).distinct()


def base_category3(drv: Driver) -> DataFrame:
    return drv.part.select(_c3().alias("id"), _c3().alias("name"), _c2().alias("category2_id")).distinct()


def base_trademark(drv: Driver) -> DataFrame:
    return drv.part.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("tm_name")).distinct()


def sku_attr_value(drv: Driver) -> DataFrame:
    pairs = drv.lineitem.select("l_partkey", "l_suppkey").distinct()
    s = drv.supplier.select("s_suppkey", "s_name")
    j = pairs.join(s, pairs.l_suppkey == s.s_suppkey, "left")
    return j.select(F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
                    F.lit("1").alias("attr_id"), F.col("l_suppkey").cast("string").alias("value_id"),
                    F.col("l_partkey").alias("sku_id"), F.lit("supplier").alias("attr_name"),
                    F.col("s_name").alias("value_name"))


def sku_sale_attr_value(drv: Driver) -> DataFrame:
    pairs = drv.lineitem.select("l_partkey", "l_returnflag").distinct()
    return pairs.select(F.concat_ws("-", F.col("l_partkey").cast("string"), "l_returnflag").alias("id"),
                        F.col("l_partkey").alias("sku_id"), F.lit("1").alias("sale_attr_id"),
                        F.col("l_returnflag").alias("sale_attr_value_id"), F.lit("return flag").alias("sale_attr_name"),
                        F.col("l_returnflag").alias("sale_attr_value_name"))


def coupon_info(drv: Driver) -> DataFrame:
    c = drv.supplier.select((F.col("s_suppkey") % 10).alias("id")).distinct()
    start = F.date_add(F.lit("2001-06-20").cast("date"), (F.col("id") * 5).cast("int"))
    return c.select(
        "id", F.concat(F.lit("coupon "), F.col("id").cast("string")).alias("coupon_name"),
        F.concat(F.lit("320"), (F.col("id") % 3 + 1).cast("string")).alias("coupon_type"),
        ((F.col("id") + 1) * 100).cast("decimal(16,2)").alias("condition_amount"),
        (F.col("id") % 3 + 1).cast("bigint").alias("condition_num"),
        F.lit(None).cast("bigint").alias("activity_id"),
        ((F.col("id") + 1) * 10).cast("decimal(16,2)").alias("benefit_amount"),
        ((F.col("id") % 5 + 1) / 10).cast("decimal(16,2)").alias("benefit_discount"),
        F.lit("2001-01-01 00:00:00").alias("create_time"),
        F.concat(F.lit("330"), (F.col("id") % 3 + 1).cast("string")).alias("range_type"),
        F.lit(1).cast("bigint").alias("limit_num"), (F.col("id") * 7).cast("bigint").alias("taken_count"),
        F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        F.date_format(F.date_add(start, 60), "yyyy-MM-dd HH:mm:ss").alias("end_time"),
        F.lit(None).cast("string").alias("operate_time"), F.lit(None).cast("string").alias("expire_time"))


def activity_info(drv: Driver) -> DataFrame:
    a = drv.supplier.select((F.col("s_suppkey") % 7).alias("id")).distinct()
    start = F.date_add(F.lit("2001-06-25").cast("date"), (F.col("id") * 6).cast("int"))
    return a.select(
        "id", F.concat(F.lit("activity "), F.col("id").cast("string")).alias("activity_name"),
        F.concat(F.lit("310"), (F.col("id") % 3 + 1).cast("string")).alias("activity_type"),
        F.concat(F.lit("promotion "), F.col("id").cast("string")).alias("activity_desc"),
        F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        F.date_format(F.date_add(start, 30), "yyyy-MM-dd HH:mm:ss").alias("end_time"),
        F.lit("2001-01-01 00:00:00").alias("create_time"))


def activity_rule(drv: Driver) -> DataFrame:
    a = activity_info(drv).select(F.col("id").alias("activity_id"), "activity_type")
    r = a.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return r.select(
        (F.col("activity_id") * 10 + F.col("level")).alias("id"), "activity_id", "activity_type",
        ((F.col("level") + 1) * 100).cast("decimal(16,2)").alias("condition_amount"),
        (F.col("level") + 1).cast("bigint").alias("condition_num"),
        ((F.col("level") + 1) * 10).cast("decimal(16,2)").alias("benefit_amount"),
        ((F.col("level") + 1) / 20).cast("decimal(16,2)").alias("benefit_discount"),
        (F.col("level") + 1).cast("bigint").alias("benefit_level"))


def date_seed(drv: Driver) -> DataFrame:
    """Calendar rows for every order day (the text seed of the date dimension)."""
    d = drv.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select(
        F.date_format("d", "yyyy-MM-dd").alias("date_id"), F.weekofyear("d").cast("string").alias("week_id"),
        ((F.dayofweek("d") + 5) % 7 + 1).cast("string").alias("week_day"), F.dayofmonth("d").cast("string").alias("day"),
        F.month("d").cast("string").alias("month"), F.quarter("d").cast("string").alias("quarter"),
        F.year("d").cast("string").alias("year"),
        F.when(F.dayofweek("d").isin(1, 7), F.lit("0")).otherwise(F.lit("1")).alias("is_workday"),
        F.lit(None).cast("string").alias("holiday_id"))
