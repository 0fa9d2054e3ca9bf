"""Registered worked queries Q-01..Q-20 with DuckDB oracles."""

from __future__ import annotations

from ..oracle.domain import cte, with_ctes
from ..plans import worked as Q
from ..registry import register
from ..sources import worked as WS
from ..sources.driver import Driver

MONTH = "2001-07"
MUSIC = "ECONOMY"  # the category standing in for "Music"


def _d(spark, sf):
    return Driver(spark, sf)


cte("emp", """select cast(c_custkey as integer) empno, c_name ename, c_mktsegment job, cast(null as integer) mgr,
  '2001-01-01' hiredate, c_acctbal sal, case when c_custkey % 3 <> 0 then c_acctbal end comm, c_nationkey deptno
from customer""")
cte("emp_sex", """select c_name name, cast(c_nationkey as varchar) dept_id,
  case when c_custkey % 2 = 0 then '男' else '女' end sex from customer""")
cte("person_info", """select p_name name, p_type constellation, 'B' || cast(p_size % 4 as varchar) blood_type
from part""")
cte("movie_info", """select concat_ws('#', p_name, cast(p_partkey as varchar)) movie,
  concat_ws(',', p_type, p_brand, 'size' || cast(p_size % 5 as varchar)) category from part""")
cte("business", """select cast(o_custkey as varchar) name, strftime(o_orderdate, '%Y-%m-%d') orderdate,
  cast(floor(o_totalprice) as integer) cost from orders""")
cte("score", """select concat_ws('#', p_name, cast(p_partkey as varchar)) name, p_type subject,
  cast(p_size * 2 as integer) score from part""")
cte("video", """select 'v' || cast(p_partkey as varchar) videoId, s_name uploader, cast(p_size % 30 as integer) age,
  [p_type, p_brand] category, cast(p_size * 10 as integer) length, cast(floor(p_retailprice * 10) as integer) views,
  cast(p_size / 10 as float) rate, cast(p_partkey % 100 as integer) ratings, cast(p_partkey % 37 as integer) comments,
  ['v' || cast(p_partkey + 1 as varchar), 'v' || cast(p_partkey + 2 as varchar), 'v' || cast(p_partkey + 3 as varchar)]
    relatedId
from part left join (select l_partkey, min(l_suppkey) suppkey from lineitem group by l_partkey) u
  on p_partkey = u.l_partkey
left join supplier on suppkey = s_suppkey""")
cte("video_user", """select s_name uploader, coalesce(videos, 0) videos, cast(s_nationkey as integer) friends
from supplier left join (select uploader, cast(count(*) as integer) videos from video group by uploader) v
  on s_name = v.uploader""", ("video",))


@register("q_null_default", with_ctes("select comm, coalesce(comm, -1.0) comm_or_default from emp", "emp"))
def q01(spark, sf):
    """Q-01: nvl with a default."""
    return Q.null_default(WS.emp(_d(spark, sf)))


PIVOT_SQL = """select dept_id, cast(sum(case sex when '男' then 1 else 0 end) as bigint) male_count,
  cast(sum(case sex when '女' then 1 else 0 end) as bigint) female_count from emp_sex group by dept_id"""


@register("q_dept_gender_pivot", with_ctes(PIVOT_SQL, "emp_sex"))
def q02(spark, sf):
    """Q-02 case form (A-04 sum(case ...))."""
    return Q.dept_gender_pivot(WS.emp_sex(_d(spark, sf)), "case")


@register("q_dept_gender_pivot_if", with_ctes(PIVOT_SQL, "emp_sex"))
def q02b(spark, sf):
    """Q-02 second form, as groupBy().pivot() — must equal the case form."""
    return Q.dept_gender_pivot(WS.emp_sex(_d(spark, sf)), "pivot")


@register("q_group_names", with_ctes("""
select c_b, array_to_string(list_sort(list(distinct name)), '|') names
from (select name, concat_ws(',', constellation, blood_type) c_b from person_info) t group by c_b""",
    "person_info"))
def q03(spark, sf):
    """Q-03: distinct names per group joined by a pipe (sorted set)."""
    return Q.group_names(WS.person_info(_d(spark, sf)))


EXPLODE_SQL = "select movie, unnest(string_split(category, ',')) category_name from movie_info"


@register("q_movie_explode", with_ctes(EXPLODE_SQL, "movie_info"))
def q04(spark, sf):
    """Q-04 lateral view explode(split(...))."""
    return Q.movie_explode(WS.movie_info(_d(spark, sf)), "lateral")


@register("q_movie_explode_subquery", with_ctes(EXPLODE_SQL, "movie_info"))
def q04b(spark, sf):
    """Q-04 split in a subquery, explode outside."""
    return Q.movie_explode(WS.movie_info(_d(spark, sf)), "subquery")


MB_SQL = f"""select b1.name, b2.num
from (select distinct name from business where substr(orderdate, 1, 7) = '{MONTH}') b1,
     (select count(distinct name) num from business where substr(orderdate, 1, 7) = '{MONTH}') b2"""


@register("q_month_buyers", with_ctes(MB_SQL, "business"))
def q05(spark, sf):
    """Q-05 join form: distinct buyers ⋈ 1-row buyer count."""
    return Q.month_buyers(WS.business(_d(spark, sf)), MONTH, "join")


@register("q_month_buyers_window", with_ctes(MB_SQL, "business"))
def q05b(spark, sf):
    """Q-05 window form: count(*) over () after group by."""
    return Q.month_buyers(WS.business(_d(spark, sf)), MONTH, "window")


@register("q_month_total", with_ctes("""select name, orderdate, cost,
  cast(sum(cost) over (partition by month(cast(orderdate as date))) as bigint) month_cost from business""",
    "business"))
def q06(spark, sf):
    """Q-06: detail + month total (partial aggregate joined back, 12-row broadcast)."""
    return Q.month_total(WS.business(_d(spark, sf)))


@register("q_prev_purchase", with_ctes("""select name, orderdate, cost,
  lag(orderdate, 1, '1970-01-01') over (partition by name order by orderdate, cost) time1 from business""",
    "business"))
def q07(spark, sf):
    """Q-07: lag with default."""
    return Q.prev_purchase(WS.business(_d(spark, sf)))


@register("q_running_cost", with_ctes("""select name, orderdate, cost,
  cast(sum(cost) over (partition by name order by orderdate, cost rows between unbounded preceding and current row)
       as bigint) running_cost from business""", "business"))
def q08(spark, sf):
    """Q-08 explicit ROWS frame."""
    return Q.running_cost(WS.business(_d(spark, sf)), "rows")


@register("q_running_cost_range", with_ctes("""select name, orderdate, cost,
  cast(sum(cost) over (partition by name order by orderdate) as bigint) running_cost from business""", "business"))
def q08b(spark, sf):
    """Q-08 default RANGE frame (same-day rows share the running value)."""
    return Q.running_cost(WS.business(_d(spark, sf)), "range")


@register("q_moving_cost", with_ctes("""select name, orderdate, cost,
  cast(sum(cost) over (partition by name order by orderdate, cost rows between 1 preceding and 1 following)
       as bigint) moving_cost from business""", "business"))
def q09(spark, sf):
    """Q-09: 3-row moving sum."""
    return Q.moving_cost(WS.business(_d(spark, sf)))


@register("q_first_20pct", with_ctes("""select name, orderdate, cost, cast(sorted as integer) sorted from (
  select name, orderdate, cost, ntile(5) over (order by orderdate, name, cost) sorted from business) t
where sorted = 1""", "business"))
def q10(spark, sf):
    """Q-10: ntile(5) = 1 without a single-partition window over the rows."""
    return Q.first_20pct(WS.business(_d(spark, sf)))


RANK_SQL = """select name, subject, score,
  cast(rank() over (partition by subject order by score desc) as integer) rp,
  cast(dense_rank() over (partition by subject order by score desc) as integer) drp,
  cast(row_number() over (partition by subject order by score desc, name) as integer) rmp
from score"""


@register("q_subject_rank", with_ctes(RANK_SQL, "score"))
def q11(spark, sf):
    """Q-11: rank / dense_rank / row_number side by side (histogram ranks)."""
    return Q.subject_rank(WS.score(_d(spark, sf)))


@register("q_subject_top3", with_ctes(f"select * from ({RANK_SQL}) s where rmp <= 3", "score"))
def q12(spark, sf):
    """Q-12: top 3 per subject, ties cut."""
    return Q.subject_top3(WS.score(_d(spark, sf)))


@register("q_top10_views", with_ctes("select videoId, views from video order by views desc, videoId limit 10",
                                     "video"))
def q13(spark, sf):
    """Q-13: order by + limit."""
    return Q.top10_views(WS.video(_d(spark, sf)))


@register("q_category_heat", with_ctes("""select category_name, count(videoId) hot
from (select videoId, unnest(category) category_name from video) t
group by category_name order by hot desc, category_name limit 10""", "video"))
def q14(spark, sf):
    """Q-14: explode + count + top 10."""
    return Q.category_heat(WS.video(_d(spark, sf)))


@register("q_top20_categories", with_ctes("""select category_name, count(*) cnt
from (select unnest(category) category_name
      from (select category from video order by views desc, videoId limit 20) t1) t2
group by category_name""", "video"))
def q15(spark, sf):
    """Q-15: categories of the 20 most viewed videos."""
    return Q.top20_categories(WS.video(_d(spark, sf)))


@register("q_top50_related_rank", with_ctes("""select category_name, count(category_name) num,
  cast(rank() over (order by count(category_name) desc) as integer) rk
from (select unnest(t3.category) category_name
      from (select unnest(relatedId) videoId
            from (select relatedId from video order by views desc, videoId limit 50) t1) t2
      join video t3 on t2.videoId = t3.videoId) t4
group by category_name""", "video"))
def q16(spark, sf):
    """Q-16: related videos of the top 50, their categories ranked."""
    return Q.top50_related_rank(WS.video(_d(spark, sf)))


@register("q_music_top10", with_ctes(f"""select videoId, views, category_name
from (select videoId, views, unnest(category) category_name from video) t
where category_name = '{MUSIC}' order by views desc, videoId limit 10""", "video"))
def q17(spark, sf):
    """Q-17: top 10 in one category."""
    return Q.music_top10(WS.video(_d(spark, sf)), MUSIC)


@register("q_category_top10", with_ctes("""select category_name, videoId, views
from (select category_name, videoId, views, rank() over (partition by category_name order by views desc) rk
      from (select videoId, views, unnest(category) category_name from video) t) t1
where rk <= 10""", "video"))
def q18(spark, sf):
    """Q-18: top 10 per category, ties kept."""
    return Q.category_top10(WS.video(_d(spark, sf)))


@register("q_uploader_top20", with_ctes("""select uploader, videoId, views, cast(rk as integer) rk
from (select t1.uploader, t2.videoId, t2.views,
        rank() over (partition by t1.uploader order by t2.views desc) rk
      from (select uploader, videos from video_user order by videos desc, uploader limit 10) t1
      join video t2 on t1.uploader = t2.uploader) t
where rk <= 20""", "video", "video_user"))
def q19(spark, sf):
    """Q-19: top 20 videos of the 10 largest uploaders (ranked descending, §7.4 #22)."""
    d = _d(spark, sf)
    return Q.uploader_top20(WS.video(d), WS.video_user(d))


@register("q_avg_salary", with_ctes("""select deptno, cast(cast(avg(sal) as varchar) as decimal(16,2)) monery
from emp group by deptno""", "emp"))
def q20(spark, sf):
    """Q-20: mean salary per department."""
    return Q.avg_salary(WS.emp(_d(spark, sf)))


@register("q_category_heat_count", with_ctes("""select category_name, count(videoId) count_video_id
from video, unnest(category) t(category_name)
group by category_name order by count_video_id desc, category_name limit 10""", "video"))
def q14b(spark, sf):
    """Q-14 second form (lateral view alias, counted column named differently); must
    rank the same categories as ``q_category_heat``."""
    heat = Q.category_heat(WS.video(_d(spark, sf)))
    return heat.select("category_name", heat["hot"].alias("count_video_id"))
