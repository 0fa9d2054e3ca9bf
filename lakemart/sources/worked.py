"""Driver tables -> the worked-query tables (emp, emp_sex, person_info, movie_info,
business, score, video, video_user).

FIXED VALUES: the gender literals of ``emp_sex`` are '男' (male) and '女' (female),
as the worked query compares against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .driver import Driver

MALE, FEMALE = "男", "女"


def emp(drv: Driver) -> DataFrame:
    c = drv.customer
    return c.select(F.col("c_custkey").cast("int").alias("empno"), F.col("c_name").alias("ename"),
                    F.col("c_mktsegment").alias("job"), F.lit(None).cast("int").alias("mgr"),
                    F.lit("2001-01-01").alias("hiredate"), F.col("c_acctbal").alias("sal"),
                    F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("comm"),
                    F.col("c_nationkey").alias("deptno"))


def emp_sex(drv: Driver) -> DataFrame:
    c = drv.customer
    return c.select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("dept_id"),
                    F.when(F.col("c_custkey") % 2 == 0, F.lit(MALE)).otherwise(F.lit(FEMALE)).alias("sex"))


def person_info(drv: Driver) -> DataFrame:
    p = drv.part
    return p.select(F.col("p_name").alias("name"), F.col("p_type").alias("constellation"),
                    F.concat(F.lit("B"), (F.col("p_size") % 4).cast("string")).alias("blood_type"))


def movie_info(drv: Driver) -> DataFrame:
    p = drv.part
    return p.select(F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("movie"),
                    F.concat_ws(",", "p_type", "p_brand", F.concat(F.lit("size"), (F.col("p_size") % 5).cast("string")))
                    .alias("category"))


def business(drv: Driver) -> DataFrame:
    o = drv.orders
    return o.select(F.col("o_custkey").cast("string").alias("name"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("orderdate"),
                    F.floor("o_totalprice").cast("int").alias("cost"))


def score(drv: Driver) -> DataFrame:
    p = drv.part
    return p.select(F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("name"),
                    F.col("p_type").alias("subject"), (F.col("p_size") * 2).cast("int").alias("score"))


def video(drv: Driver) -> DataFrame:
    """Videos from parts; the uploader is the part's lowest-key supplier in lineitem."""
    up = drv.lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("suppkey"))
    s = drv.supplier.select("s_suppkey", "s_name")
    p = drv.part
    j = p.join(up, p.p_partkey == up.l_partkey, "left").join(s, F.col("suppkey") == s.s_suppkey, "left")
    vid = F.concat(F.lit("v"), F.col("p_partkey").cast("string"))
    return j.select(
        vid.alias("videoId"), F.col("s_name").alias("uploader"), (F.col("p_size") % 30).cast("int").alias("age"),
        F.array("p_type", "p_brand").alias("category"), (F.col("p_size") * 10).cast("int").alias("length"),
        F.floor(F.col("p_retailprice") * 10).cast("int").alias("views"),
        (F.col("p_size") / 10).cast("float").alias("rate"), (F.col("p_partkey") % 100).cast("int").alias("ratings"),
        (F.col("p_partkey") % 37).cast("int").alias("comments"),
        F.array(*[F.concat(F.lit("v"), (F.col("p_partkey") + i).cast("string")) for i in (1, 2, 3)]).alias("relatedId"))


def video_user(drv: Driver) -> DataFrame:
    """Uploaders: every supplier, its video count from the part/supplier mapping."""
    v = video(drv).groupBy("uploader").agg(F.count(F.lit(1)).cast("int").alias("videos"))
    s = drv.supplier.select(F.col("s_name").alias("uploader"), F.col("s_nationkey").cast("int").alias("friends"))
    return s.join(v, "uploader", "left").select("uploader", F.coalesce("videos", F.lit(0)).alias("videos"), "friends")
