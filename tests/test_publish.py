"""Partitions published together, keyed merges, and bucketed state."""

import pytest
from pyspark.sql import functions as F

from lakemart.functions.scalar import add_days
from lakemart.plans.layers import Layers, load_user_day
from lakemart.sinks import writers as K
from lakemart.sinks.publish import Published
from lakemart.sinks.state import BucketedState, compare


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


def frame(spark, data):
    return spark.createDataFrame(data, "k long, v string, dt string")


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    p = Published(spark, str(tmp_path / "t"), "k long, v string, dt string")
    assert p.read().collect() == [] and p.latest() is None
    p.publish(frame(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-02"), (3, None, "2024-01-03")]))
    first = rows(p.read())
    held = p.read()  # a reader of the first version
    # lost between the data and the pointer: nothing has changed
    with monkeypatch.context() as m:
        m.setattr(Published, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            p.publish(frame(spark, [(9, "x", "2024-01-02"), (9, "y", "2024-01-04")]))
    assert rows(p.read()) == first and p.versions() == [1]
    # the rerun, made from a partition that it replaces
    p.publish(p.read(days=["2024-01-02"]).withColumn("v", F.upper("v")), replaced=["2024-01-03"])
    assert rows(p.read()) == [(1, "a", "2024-01-01"), (2, "B", "2024-01-02")]
    assert rows(held) == first and rows(p.read(version=1)) == first
    assert len(p.recover()) == 1 and rows(p.read()) == [(1, "a", "2024-01-01"), (2, "B", "2024-01-02")]
    assert p.latest("2024-01-01") == "2024-01-01" and p.latest("2023-12-31") is None and p.latest() == "2024-01-02"
    p.vacuum(1)
    assert p.versions() == [2] and rows(p.read()) == [(1, "a", "2024-01-01"), (2, "B", "2024-01-02")]


def test_two_loads_cannot_become_one_version(spark, tmp_path):
    p = Published(spark, str(tmp_path / "t"), "k long, v string, dt string")
    p.publish(frame(spark, [(1, "a", "2024-01-01")]))
    with pytest.raises(FileExistsError):
        p._commit(1, {"tag": "", "folders": {}})
    assert rows(p.read()) == [(1, "a", "2024-01-01")]


def test_only_wanted_partitions_are_listed(spark, tmp_path):
    p = Published(spark, str(tmp_path / "t"), "k long, v string, dt string")
    p.publish(frame(spark, [(k, "a", f"2024-01-{k:02d}") for k in range(1, 21)]))
    assert len(p.read(days=["2024-01-07"]).inputFiles()) == 1
    plan = p.read().where("dt = '2024-01-07'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_keyed_merge_writes_only_what_is_new(spark, tmp_path):
    p = Published(spark, str(tmp_path / "t"), "k long, v string, dt string")
    load = frame(spark, [(1, "a", "2024-01-01"), (1, "a", "2024-01-01"), (None, "n", "2024-01-01"), (2, "b", "2024-01-02")])
    assert p.merge(load, ["k", "dt"]) == 1 and p.read().count() == 3
    assert p.merge(load, ["k", "dt"]) is None and p.versions() == [1]
    before = p.folders()
    assert p.merge(frame(spark, [(3, "c", "2024-01-02"), (1, "other", "2024-01-01")]), ["k", "dt"]) == 2
    assert rows(p.read()) == sorted([(1, "a", "2024-01-01"), (None, "n", "2024-01-01"), (2, "b", "2024-01-02"), (3, "c", "2024-01-02")], key=str)
    assert p.folders()["2024-01-01"] == before["2024-01-01"] and p.folders()["2024-01-02"] != before["2024-01-02"]


def test_append_distinct_writes_nothing_twice(spark, tmp_path):
    t = "lakemart_test_merge"
    K.drop_table(spark, t)
    spark.sql(f"CREATE TABLE {t} (dt string, n bigint) USING parquet LOCATION '{tmp_path / 'r'}'")
    new = spark.createDataFrame([("2020-06-14", 1), ("2020-06-14", 1), ("2020-06-14", None)], "dt string, n bigint")
    assert K.append_distinct(spark, t, new, "dt").count() == 2
    files = sorted(spark.table(t).inputFiles())
    assert K.append_distinct(spark, t, new, "dt").count() == 2 and sorted(spark.table(t).inputFiles()) == files
    K.append_distinct(spark, t, spark.createDataFrame([("2020-06-15", 1)], "dt string, n bigint"), "dt")
    assert spark.table(t).count() == 3 and set(files) < set(spark.table(t).inputFiles())  # the old files stay
    K.drop_table(spark, t)


def test_a_lost_user_load_is_rerun_from_the_same_state(spark, sf, tmp_path, monkeypatch):
    from lakemart.sources import domain as D
    from lakemart.sources.driver import Driver

    drv, day = Driver(spark, sf), D.TRAFFIC_DAY
    whole = Layers(spark, str(tmp_path / "a"))
    load_user_day(whole, drv, add_days(day, -1), first=True)
    want = rows(load_user_day(whole, drv, day))
    lost = Layers(spark, str(tmp_path / "b"))
    load_user_day(lost, drv, add_days(day, -1), first=True)
    with monkeypatch.context() as m:
        m.setattr(Published, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            load_user_day(lost, drv, day)
    assert rows(load_user_day(lost, drv, day)) == want
    assert rows(load_user_day(lost, drv, day)) == want  # and once more: the day's result replaces itself


def test_bucketed_state_joins_without_exchange(spark):
    s = BucketedState(spark, "lakemart_test_state", "u", 4)
    one = spark.createDataFrame([(k, k * 2) for k in range(100)] + [(None, 1)], "u long, n long")
    s.write(one, "2024-01-01")
    step = lambda old, new: old.alias("o").join(new.alias("n"), F.col("o.u") == F.col("n.u"), "full").select(
        F.coalesce("o.u", "n.u").alias("u"), (F.coalesce("o.n", F.lit(0)) + F.coalesce("n.n", F.lit(0))).alias("n"))
    inc = spark.createDataFrame([(k, 1) for k in range(90, 130)], "u long, n long")
    plan = s.joined("2024-01-01", inc, "2024-01-02", step)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
    got = s.advance("2024-01-01", inc, "2024-01-02", step)
    want = {k: k * 2 for k in range(100)}
    for k in range(90, 130):
        want[k] = want.get(k, 0) + 1
    assert rows(got) == sorted([*want.items(), (None, 1)], key=str)
    assert len(got.inputFiles()) <= 4  # still one file a bucket, without a shuffle of the state
    both = compare(s.read("2024-01-02"), s.read("2024-01-01"), "u")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 100
    for t in ("20240101", "20240102", "20240102_inc"):
        K.drop_table(spark, f"lakemart_test_state_{t}")


def test_a_cluster_needs_a_shared_folder():
    """Staged tables never go to one machine's disk."""
    from types import SimpleNamespace

    from lakemart.session import checkpoint_dir

    def session(master, warehouse, own=None):
        conf = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": own}
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k) or default), sparkContext=context)

    assert checkpoint_dir(session("local[4]", "/w")) == "/w/_lakemart_checkpoints"
    assert checkpoint_dir(session("yarn", "hdfs://n/w")) == "hdfs://n/w/_lakemart_checkpoints"
    assert checkpoint_dir(session("yarn", "/w", "hdfs://n/c")) == "hdfs://n/c"
    for master, warehouse in (("yarn", "/w"), ("spark://h:7077", "file:/w"), ("local-cluster[2,1,512]", "/w")):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(session(master, warehouse))
