"""Worked queries Q-01..Q-21 (plain SELECTs over small warehouse tables).

Global orderings avoid one-task windows: top-n is ``orderBy().limit()``
(TakeOrderedAndProject), per-group top-k is a rank filter (WindowGroupLimit runs before
the shuffle), ``count(*) over ()`` becomes a 1-row aggregate joined back, whole-group
totals become a partial aggregate joined back, and rank / ntile over everything use the
histogram helpers in ``lakemart.operators.ranking``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import one_row_join
from ..operators.ranking import first_ntile, partition_total, rank_family
from ..operators.scan import lag, moving_sum, running
from ..operators.topk import top_k_per_group, top_n
from ..sources.worked import FEMALE, MALE


# Q-01
def null_default(emp: DataFrame) -> DataFrame:
    return emp.select("comm", F.coalesce("comm", F.lit(-1.0)).alias("comm_or_default"))


# Q-02 (case form and if form give the same answer)
def dept_gender_pivot(emp_sex: DataFrame, form: str = "case") -> DataFrame:
    if form == "case":
        m = F.when(F.col("sex") == MALE, 1).otherwise(0)
        f = F.when(F.col("sex") == FEMALE, 1).otherwise(0)
        return emp_sex.groupBy("dept_id").agg(F.sum(m).cast("bigint").alias("male_count"),
                                              F.sum(f).cast("bigint").alias("female_count"))
    # pivot form: one aggregate per listed value (A-04 via groupBy().pivot())
    p = emp_sex.groupBy("dept_id").pivot("sex", [MALE, FEMALE]).agg(F.count(F.lit(1)))
    return p.select("dept_id", F.coalesce(F.col(MALE), F.lit(0)).cast("bigint").alias("male_count"),
                    F.coalesce(F.col(FEMALE), F.lit(0)).cast("bigint").alias("female_count"))


# Q-03
def group_names(person: DataFrame) -> DataFrame:
    t = person.select("name", F.concat_ws(",", "constellation", "blood_type").alias("c_b"))
    return t.groupBy("c_b").agg(F.concat_ws("|", F.sort_array(F.collect_set("name"))).alias("names"))


# Q-04 (split-then-explode, two forms)
def movie_explode(movie: DataFrame, form: str = "lateral") -> DataFrame:
    if form == "lateral":
        return movie.select("movie", F.explode(F.split("category", ",")).alias("category_name"))
    mi = movie.select("movie", F.split("category", ",").alias("category"))
    return mi.select("movie", F.explode("category").alias("category_name"))


# Q-05 (join form and window form)
def month_buyers(business: DataFrame, month: str, form: str = "join") -> DataFrame:
    b = business.where(F.substring("orderdate", 1, 7) == month)
    names = b.select("name").distinct()
    total = b.agg(F.count_distinct("name").alias("num"))
    if form == "join":
        return one_row_join(names, total).select("name", "num")
    # count(*) over () on the grouped rows == number of groups, joined back as one row
    return one_row_join(names, names.agg(F.count(F.lit(1)).alias("num"))).select("name", "num")


# Q-06
def month_total(business: DataFrame) -> DataFrame:
    x = business.withColumn("_m", F.month(F.col("orderdate").cast("date")))
    return partition_total(x, ["_m"], "cost", "month_cost") \
        .select("name", "orderdate", "cost", F.col("month_cost").cast("bigint").alias("month_cost"))


# Q-07
def prev_purchase(business: DataFrame) -> DataFrame:
    """``lag(orderdate, 1, '1970-01-01') over (partition by name order by orderdate)``,
    a segmented scan, so one heavy buyer is not one task."""
    return lag(business, ["name"], ["orderdate", "cost"], "orderdate", "time1", "1970-01-01")


# Q-08
def running_cost(business: DataFrame, frame: str = "rows") -> DataFrame:
    """ROWS frame ordered by (date, cost), or the default RANGE frame ordered by date
    (same-day rows share the value); a segmented scan."""
    x = running(business, ["name"], ["orderdate", "cost"] if frame == "rows" else ["orderdate"], "cost", "running_cost", "sum", frame)
    return x.withColumn("running_cost", F.col("running_cost").cast("bigint"))


# Q-09
def moving_cost(business: DataFrame) -> DataFrame:
    """3-row moving sum per buyer, a segmented scan."""
    x = moving_sum(business, ["name"], ["orderdate", "cost"], "cost", "moving_cost")
    return x.withColumn("moving_cost", F.col("moving_cost").cast("bigint"))


# Q-10
def first_20pct(business: DataFrame) -> DataFrame:
    return first_ntile(business, "orderdate", ["name", "cost"], 5).withColumn("sorted", F.lit(1))


# Q-11
def subject_rank(score: DataFrame) -> DataFrame:
    return rank_family(score, ["subject"], "score", desc=True, tiebreak=["name"])


# Q-12
def subject_top3(score: DataFrame) -> DataFrame:
    """``row_number <= 3`` first (WindowGroupLimit bounds every task to 3 rows per
    subject), then rank / dense_rank on the survivors: every row that outranks a
    survivor is itself a survivor, so the ranks equal the full-partition ones."""
    top = top_k_per_group(score, ["subject"], [F.col("score").desc(), F.col("name")], 3, ties="row_number",
                          out="rmp")
    w = Window.partitionBy("subject").orderBy(F.col("score").desc())
    return top.select("name", "subject", "score", F.rank().over(w).alias("rp"), F.dense_rank().over(w).alias("drp"),
                      F.col("rmp").cast("int").alias("rmp"))


# Q-13
def top10_views(video: DataFrame) -> DataFrame:
    return top_n(video.select("videoId", "views"), [F.col("views").desc(), F.col("videoId")], 10)


# Q-14
def category_heat(video: DataFrame) -> DataFrame:
    t = video.select("videoId", F.explode("category").alias("category_name"))
    agg = t.groupBy("category_name").agg(F.count("videoId").alias("hot"))
    return top_n(agg, [F.col("hot").desc(), F.col("category_name")], 10)


def _top_videos(video: DataFrame, n: int, cols) -> DataFrame:
    return top_n(video.select("videoId", "views", *cols), [F.col("views").desc(), F.col("videoId")], n)


# Q-15
def top20_categories(video: DataFrame) -> DataFrame:
    t = _top_videos(video, 20, ["category"]).select(F.explode("category").alias("category_name"))
    return t.groupBy("category_name").agg(F.count(F.lit(1)).alias("cnt"))


# Q-16
def top50_related_rank(video: DataFrame) -> DataFrame:
    rel = _top_videos(video, 50, ["relatedId"]).select(F.explode("relatedId").alias("videoId"))
    j = video.select("videoId", "category").join(rel, "videoId")
    cats = j.select(F.explode("category").alias("category_name"))
    agg = cats.groupBy("category_name").agg(F.count("category_name").alias("num"))
    return rank_family(agg, [], "num", desc=True, names=("rk", "_d", None), rows=video.count()) \
        .select("category_name", "num", "rk")


# Q-17
def music_top10(video: DataFrame, category: str) -> DataFrame:
    t = video.select("videoId", "views", F.explode("category").alias("category_name")) \
             .where(F.col("category_name") == category)
    return top_n(t, [F.col("views").desc(), F.col("videoId")], 10)


# Q-18
def category_top10(video: DataFrame) -> DataFrame:
    t = video.select("videoId", "views", F.explode("category").alias("category_name"))
    return top_k_per_group(t, ["category_name"], [F.col("views").desc()], 10, ties="rank", out="rk") \
        .select("category_name", "videoId", "views")


# Q-19
def uploader_top20(video: DataFrame, video_user: DataFrame) -> DataFrame:
    top = top_n(video_user.select("uploader", "videos"), [F.col("videos").desc(), F.col("uploader")], 10)
    j = video.select("uploader", "videoId", "views").join(F.broadcast(top.select("uploader")), "uploader")
    return top_k_per_group(j, ["uploader"], [F.col("views").desc()], 20, ties="rank", out="rk") \
        .select("uploader", "videoId", "views", F.col("rk").cast("int").alias("rk"))


# Q-20
def avg_salary(emp: DataFrame) -> DataFrame:
    return emp.groupBy("deptno").agg(F.avg("sal").cast("decimal(16,2)").alias("monery"))
