"""Operator tests on small hand fixtures (shapes the driver tables lack) and
equivalence tests of the skew-safe rewrites against the plain window forms."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakemart.functions.scalar import ratio
from lakemart.operators.cdc import cdc_rows, decode, old_value
from lakemart.operators import scan
from lakemart.operators.joins import full_outer_coalesce, one_row_join
from lakemart.operators.ranking import first_ntile, rank_family
from lakemart.operators.sessions import first_per_group, last_per_group, sessionize
from lakemart.operators.topk import top_k_per_group
from lakemart.plans import dims as DM
from lakemart.plans import facts_trade as T
from lakemart.sinks import writers as K
from lakemart.sources import readers as S
from lakemart.sources.dictionary import dictionary


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: [(v is not None, v) for v in t])


def test_sessionize_matches_plain_window(spark, monkeypatch):
    random.seed(7)
    data = []
    for dev in ("a", "b", "c"):
        t = 0
        for _ in range(300):
            t += random.randint(1, 400_000)
            data.append((dev, t, random.random() < 0.1, "2024-01-01"))
    df = spark.createDataFrame(data, "mid string, ts long, start boolean, dt string")
    monkeypatch.setattr(scan, "SLICE_ROWS", 100)
    got = sessionize(df, "mid", "ts", F.col("start"))
    w = Window.partitionBy("dt", "mid").orderBy("ts")
    want = df.withColumn("session_id", F.concat("mid", F.lit("-"), F.last(F.when(F.col("start"), F.col("ts")), True)
                                                 .over(w).cast("string")))
    assert rows(got, "mid", "ts", "session_id") == rows(want, "mid", "ts", "session_id")
    # rows before a device's first start have no session (concat with NULL)
    assert got.where(F.col("session_id").isNull()).count() > 0


def test_rank_family_matches_windows(spark, monkeypatch):
    random.seed(3)
    data = [(random.choice("xyz"), random.randint(0, 9), f"n{i}") for i in range(500)]
    df = spark.createDataFrame(data, "subject string, score int, name string")
    got = rank_family(df, ["subject"], "score", tiebreak=["name"])
    monkeypatch.setattr(scan, "SLICE_ROWS", 6)
    got2 = rank_family(df, ["subject"], "score", tiebreak=["name"])
    w = Window.partitionBy("subject").orderBy(F.col("score").desc())
    want = df.select("*", F.rank().over(w).alias("rp"), F.dense_rank().over(w).alias("drp"),
                     F.row_number().over(Window.partitionBy("subject").orderBy(F.col("score").desc(), "name"))
                     .alias("rmp"))
    cols = ("subject", "score", "name", "rp", "drp", "rmp")
    assert rows(got, *cols) == rows(want, *cols)
    assert rows(got2, *cols) == rows(want, *cols)


def test_first_ntile_matches_ntile(spark):
    random.seed(5)
    for n in (1, 4, 5, 23, 101):
        data = [(f"2001-01-{random.randint(1, 9):02d}", f"u{random.randint(0, 5)}", random.randint(0, 3))
                for _ in range(n)]
        df = spark.createDataFrame(data, "orderdate string, name string, cost int")
        got = first_ntile(df, "orderdate", ["name", "cost"], 5)
        want = df.withColumn("s", F.ntile(5).over(Window.orderBy("orderdate", "name", "cost"))).where("s = 1")
        assert rows(got, "orderdate", "name", "cost") == rows(want, "orderdate", "name", "cost")


def test_topk_keeps_ties_at_the_cut(spark):
    df = spark.createDataFrame([("c", "s1", 9), ("c", "s2", 7), ("c", "s3", 7), ("c", "s4", 7), ("c", "s5", 1)],
                               "cat string, sku string, n int")
    got = top_k_per_group(df, ["cat"], [F.col("n").desc()], 2, ties="rank")
    assert got.count() == 4
    got = top_k_per_group(df, ["cat"], [F.col("n").desc(), F.col("sku")], 2, ties="row_number")
    assert rows(got, "sku") == [("s1",), ("s2",)]


def test_full_outer_null_keys_do_not_match(spark):
    a = spark.createDataFrame([(None, 1), ("b", 2)], "k string, x int")
    b = spark.createDataFrame([(None, 10), ("b", 20), ("c", 30)], "k string, y int")
    got = full_outer_coalesce(a, b, ["k"], {"x": 0, "y": 0})
    assert rows(got, "k", "x", "y") == [(None, 0, 10), (None, 1, 0), ("b", 2, 20), ("c", 0, 30)]


def test_one_row_join_and_ratio(spark):
    df = spark.createDataFrame([(1, 0), (2, 4)], "a int, b int")
    got = one_row_join(df, df.agg(F.sum("a").alias("tot"))).select("a", "tot", ratio("a", "b").alias("r"))
    assert rows(got, "a", "tot", "r")[0][2] is None  # zero denominator -> NULL (Hive semantics)
    assert str(rows(got, "a", "tot", "r")[1][2]) == "0.50"


def test_cart_add_cdc_rules(spark):
    schema = ("type string, ts long, data struct<id:long,user_id:long,sku_id:long,sku_num:long,source_id:long,"
              "source_type:string>, old map<string,string>, dt string")
    d = lambda n: (1, 1, 1, n, 1, "2401")
    inc = spark.createDataFrame([
        ("insert", 0, d(2), None, "2024-01-30"),
        ("update", 60, d(5), {"sku_num": "2"}, "2024-01-30"),       # up by 3: kept, delta 3
        ("update", 120, d(4), {"sku_num": "5"}, "2024-01-30"),      # down: dropped
        ("update", 180, d(4), {"is_checked": "0"}, "2024-01-30"),   # sku_num unchanged: dropped
        ("insert", 0, d(9), None, "2024-01-29"),                    # other landing day
    ], schema)
    got = T.cart_add(inc, dictionary(spark), "2024-01-30")
    assert rows(got, "sku_num") == [(2,), (3,)]
    assert set(r.source_type_name for r in got.collect()) == {"search"}
    assert cdc_rows(inc, "2024-01-30", ("update",), changed="sku_num").count() == 2
    assert inc.select(old_value("missing")).where(F.col("old").isNotNull()).first()[0] is None


def test_scd2_invariants(spark):
    schema = ("type string, ts long, data struct<id:long,login_name:string,nick_name:string,name:string,"
              "phone_num:string,email:string,user_level:string,birthday:string,gender:string,create_time:string,"
              "operate_time:string>, old map<string,string>, dt string")

    def u(i, lvl, op=None):
        return (i, f"l{i}", f"n{i}", f"name{i}", "1", "e", lvl, "1990-01-01", "F", "2024-01-01 08:00:00", op)

    inc = spark.createDataFrame([
        ("bootstrap-insert", 1, u(1, "1"), None, "2024-01-29"),
        ("bootstrap-insert", 1, u(2, "1"), None, "2024-01-29"),
        ("update", 5, u(1, "2", "t1"), {"user_level": "1"}, "2024-01-30"),
        ("update", 6, u(1, "3", "t2"), {"user_level": "2"}, "2024-01-30"),
        ("insert", 4, u(3, "1"), None, "2024-01-30"),
    ], schema)
    init = DM.user_zip_init(inc, "2024-01-29")
    assert init.where(F.col("name") == "name1").count() == 0  # PII masked
    out = DM.user_zip_apply(init.drop("dt"), inc, "2024-01-30")
    open_rows = out.where(F.col("dt") == "9999-12-31")
    assert open_rows.count() == 3 and open_rows.select("id").distinct().count() == 3
    assert rows(open_rows.where("id = 1"), "user_level", "start_date") == [("3", "2024-01-30")]
    closed = out.where(F.col("dt") == "2024-01-29")
    assert rows(closed, "id", "user_level", "start_date", "end_date") == [(1, "1", "2024-01-29", "2024-01-29")]


def test_latest_and_first_per_group(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 5, "z")], "k string, ts int, v string")
    assert rows(last_per_group(df, ["k"], ["ts"], ["v"]), "k", "v") == [("j", "z"), ("k", "c")]
    assert rows(first_per_group(df, ["k"], ["ts"], ["v"]), "k", "v") == [("j", "z"), ("k", "a")]


def test_decode_broadcasts_dictionary(spark):
    df = spark.createDataFrame([("1101",), ("9999",)], "code string")
    got = decode(df, "code", dictionary(spark), "11", "name")
    assert rows(got, "code", "name") == [("1101", "alipay"), ("9999", None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan


def test_nested_text_reader(spark, tmp_path):
    p = tmp_path / "test.txt"
    p.write_text("songsong,bingbing_lili,xiao song:18_xiaoxiao song:19,hui long guan_beijing\n"
                 "yangyang,caicai_susu,xiao yang:18,chao yang_\n")
    t = S.read_nested_text(spark, str(p), [("name", "string"), ("friends", "array"), ("children", "map<int>"),
                                           ("address", "struct:street,city")])
    r = {x.name: x for x in t.collect()}
    assert r["songsong"].friends == ["bingbing", "lili"]
    assert r["songsong"].children == {"xiao song": 18, "xiaoxiao song": 19}
    assert r["songsong"].address.city == "beijing"
    assert r["yangyang"].address.city in ("", None)


def test_json_absent_fields_are_null(spark, tmp_path):
    from lakemart import schemas
    p = tmp_path / "log.json"
    p.write_text('{"common": {"mid": "m1"}, "ts": 1}\n{"common": {"mid": "m2"}, "start": {"entry": "icon"}, "ts": 2}\n')
    log = S.read_json(spark, str(p), schemas.LOG)
    assert log.where(F.col("page").isNull()).count() == 2
    assert log.where(F.col("start").isNotNull()).count() == 1


def test_partition_management(spark, tmp_path):
    t = "lakemart_test_parts"
    K.drop_table(spark, t)
    K.create_partitioned(spark, t, "deptno int, dname string, day string", ["day"], str(tmp_path / "t"))
    df = spark.createDataFrame([(10, "ACCOUNTING", "20200401"), (20, "RESEARCH", "20200402")],
                               "deptno int, dname string, day string")
    K.overwrite_dynamic_partition(spark, df, t)
    K.partition_add(spark, t, {"day": "20200403"}, {"day": "20200404"})
    assert K.partition_list(spark, t).count() == 4
    K.partition_drop(spark, t, {"day": "20200403"}, {"day": "20200404"})
    assert K.partition_list(spark, t).count() == 2
    K.overwrite_static_partition(spark, df.where("day = '20200401'").drop("day"), t, {"day": "20200402"})
    assert rows(spark.table(t), "deptno", "day") == [(10, "20200401"), (10, "20200402")]
    K.truncate(spark, t)
    assert spark.table(t).count() == 0
    K.drop_table(spark, t)


def test_append_distinct_is_idempotent(spark, tmp_path):
    t = "lakemart_test_report"
    K.drop_table(spark, t)
    spark.sql(f"CREATE TABLE {t} (dt string, n bigint) USING parquet LOCATION '{tmp_path / 'r'}'")
    new = spark.createDataFrame([("2020-06-14", 1), ("2020-06-14", 1)], "dt string, n bigint")
    K.append_distinct(spark, t, new)
    K.append_distinct(spark, t, new, "dt")
    assert spark.table(t).count() == 1
    K.drop_table(spark, t)


def test_layered_daily_load_matches_direct_report(spark, sf, tmp_path):
    """First-day load for D-1 then a daily load for D through dt-partitioned layers;
    the report rows of D equal the report composed directly from the driver tables."""
    from lakemart.functions.scalar import add_days
    from lakemart.plans.layers import Layers, load_day
    from lakemart.sources import domain as Dm
    from lakemart.sources.driver import Driver
    from lakemart.suite.reports import q_trade_by_brand

    day = Dm.TRADE_DAY
    layers = Layers(spark, str(tmp_path / "wh"))
    drv = Driver(spark, sf)
    load_day(layers, drv, add_days(day, -1), first=True)
    load_day(layers, drv, day)
    report = load_day(layers, drv, day)  # rerun: idempotent
    got = report.where(F.col("dt") == day)
    want = q_trade_by_brand(spark, sf)
    cols = want.columns
    assert rows(got, *cols) == rows(want, *cols)


def test_invariants_nd_and_daily_partitioning(spark, sf):
    """30-day sums dominate 7-day sums; the all-days fact load equals the union of
    the per-day loads (the daily loads partition the CDC rows)."""
    from lakemart.plans import rollups as R
    from lakemart.sources import domain as Dm
    from lakemart.sources.driver import Driver

    drv = Driver(spark, sf)
    nd = R.user_order_nd(R.user_order_1d(Dm.order_detail(drv)), Dm.TRADE_DAY)
    assert nd.where((F.col("order_count_30d") < F.col("order_count_7d"))
                    | (F.col("order_total_amount_30d") < F.col("order_total_amount_7d"))).count() == 0
    inc = Dm.cart_inc(drv)
    dic = dictionary(spark)
    days = [r.dt for r in inc.select("dt").distinct().collect()][:5]
    whole = T.cart_add(inc, dic).where(F.col("dt").isin(*days))
    parts = None
    for d in days:
        x = T.cart_add(inc, dic, d)
        parts = x if parts is None else parts.unionByName(x)
    cols = whole.columns
    assert rows(whole, *cols) == rows(parts, *cols)


def _with_nulls(spark, n=900):
    """Rows with NULL keys, order values and measures; ``id`` is total."""
    random.seed(23)
    data = [(random.choice(["hot"] * 6 + ["a", "b", None]), i, random.choice([None, *range(0, 60, 5)]),
             random.choice([None, None, *range(9)])) for i in range(n)]
    return spark.createDataFrame(data, "u string, id int, ts int, v int")


def test_scan_windows_keep_nulls(spark, monkeypatch):
    df = _with_nulls(spark)
    w = Window.partitionBy("u").orderBy("ts", "id")
    cols = ("u", "id", "ts", "v")
    monkeypatch.setattr(scan, "SLICE_ROWS", 50)
    assert rows(scan.running(df, ["u"], ["ts", "id"], "v", "s"), *cols, "s") == \
        rows(df.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))), *cols, "s")
    assert rows(scan.running(df, ["u"], ["ts"], "v", "s", frame="range"), *cols, "s") == \
        rows(df.withColumn("s", F.sum("v").over(Window.partitionBy("u").orderBy("ts"))), *cols, "s")
    assert rows(scan.moving_sum(df, ["u"], ["ts", "id"], "v", "m"), *cols, "m") == \
        rows(df.withColumn("m", F.sum("v").over(w.rowsBetween(-1, 1))), *cols, "m")
    # a NULL between two values, alone in its slice
    monkeypatch.setattr(scan, "SLICE_ROWS", 1)
    probe = spark.createDataFrame([("k", 1, 5), ("k", 11, None), ("k", 21, 2)], "u string, ts int, v int")
    got = scan.running(probe, ["u"], ["ts"], "v", "s")
    assert rows(got, "ts", "s") == [(1, 5), (11, 5), (21, 7)]
    got = scan.moving_sum(probe, ["u"], ["ts"], "v", "m")
    assert rows(got, "ts", "m") == [(1, 5), (11, 7), (21, 2)]


def test_ranking_keeps_nulls(spark, monkeypatch):
    from lakemart.operators.ranking import partition_total
    df = _with_nulls(spark)
    for desc in (True, False):
        o = F.col("v").desc() if desc else F.col("v").asc()
        w = Window.partitionBy("u").orderBy(o)
        want = df.select("u", "id", "v", F.rank().over(w).alias("rp"), F.dense_rank().over(w).alias("drp"),
                         F.row_number().over(Window.partitionBy("u").orderBy(o, "id")).alias("rmp"))
        cols = ("u", "id", "v", "rp", "drp", "rmp")
        for size in (1 << 20, 7):
            monkeypatch.setattr(scan, "SLICE_ROWS", size)
            got = rank_family(df.select("u", "id", "v"), ["u"], "v", desc=desc, tiebreak=["id"])
            assert rows(got, *cols) == rows(want, *cols)
        got = rank_family(df.select("u", "id", "v"), ["u"], "v", desc=desc, names=("rp", "drp", None))
        assert rows(got, *cols[:-1]) == rows(want, *cols[:-1])
    assert rows(partition_total(df, ["u"], "v", "t"), "id", "t") == \
        rows(df.withColumn("t", F.sum("v").over(Window.partitionBy("u"))), "id", "t")
    for n in (1, 2, 5, 23, 101):
        x = df.limit(n)
        want = x.withColumn("s", F.ntile(5).over(Window.orderBy("ts", "id"))).where("s = 1")
        assert rows(first_ntile(x, "ts", ["id"], 5), "id", "ts") == rows(want, "id", "ts")
    with pytest.raises(ValueError):
        rank_family(df, ["u"], "v")


def test_a_rerun_without_rows_empties_the_day(spark, tmp_path):
    from lakemart.plans.layers import Layers
    layers = Layers(spark, str(tmp_path / "wh"))
    df = spark.createDataFrame([(1, "d1"), (2, "d2")], "x int, dt string")
    layers.write(df, "t", None)
    layers.write(df.where("dt = 'd1'"), "t", "d1")
    assert rows(layers.read("t", df.schema, "d1", "d2"), "x", "dt") == [(1, "d1"), (2, "d2")]
    layers.write(df.where("dt = 'none'"), "t", "d1")
    assert rows(layers.read("t", df.schema, "d1", "d2"), "x", "dt") == [(2, "d2")]
    layers.write(df.where("dt = 'none'"), "t", None)
    assert rows(layers.read("t", df.schema, "d1", "d2"), "x", "dt") == []


def test_layered_log_and_user_loads_match_direct_queries(spark, sf, tmp_path):
    """First load at D-1 and a daily load at D (run twice) give what the reports give when
    composed from the driver tables."""
    from lakemart import registry
    from lakemart.functions.scalar import add_days
    from lakemart.plans.layers import Layers, load_log_day, load_user_day
    from lakemart.sources import domain as Dm
    from lakemart.sources.driver import Driver

    day, drv, layers = Dm.TRAFFIC_DAY, Driver(spark, sf), Layers(spark, str(tmp_path / "wh"))
    load_log_day(layers, drv, add_days(day, -1), first=True)
    load_log_day(layers, drv, day)
    reports = load_log_day(layers, drv, day)
    queries = registry.load_all()[0]
    for name, key in (("ads_traffic_by_channel", "rpt_traffic_by_channel"), ("ads_page_path", "rpt_page_path"),
                      ("ads_user_retention", "rpt_retention"), ("ads_user_stats", "rpt_user_stats"), ("ads_user_change", "rpt_user_change")):
        want = queries[key](spark, sf)
        assert rows(reports[name].where(F.col("dt") == day), *want.columns) == rows(want, *want.columns), name
    load_user_day(layers, drv, add_days(day, -1), first=True)
    got = load_user_day(layers, drv, day)
    want = queries["dim_user_zip_apply"](spark, sf)
    assert rows(got, *want.columns) == rows(want, *want.columns)
