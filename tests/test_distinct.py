"""Mergeable distinct sets against count(distinct)."""

import random

import pytest
from pyspark.sql import functions as F

from lakemart import registry
from lakemart.operators import distinct as S
from lakemart.operators import scan


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(9)
    data = [(f"2024-01-{rng.randint(1, 30):02d}", rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(50), *range(32760, 32780), 5_000_000_000]),
             rng.choice([None, 0, 1, 5])) for _ in range(2000)]
    data += [("2024-01-30", "hot", 7, 1)] * 1000  # one user, one group: a third of the rows
    return spark.createDataFrame(data, "dt string, g string, u long, n long").cache()


def test_period_counts_match_count_distinct(spark, frame):
    day, periods = "2024-01-30", (1, 7, 30)
    state = S.day_sets(frame, ["g"], "u", {"n": F.col("n")}, F.col("n") > 0)
    got = S.period_counts(state, ["g"], day, periods, "users", {"total": "n"})
    want = None
    for p in periods:
        x = frame.where(F.col("dt") >= f"2024-01-{31 - p:02d}").groupBy("g").agg(
            F.count_distinct(F.when(F.col("n") > 0, F.col("u"))).alias("users"), F.sum("n").alias("total")).withColumn("recent_days", F.lit(p))
        want = x if want is None else want.unionByName(x)
    cols = ("recent_days", "g", "users", "total")
    assert rows(got, *cols) == rows(want, *cols)
    assert rows(S.latest_counts(frame, ["g"], "u", day, periods, "users", {"total": F.col("n")}, F.col("n") > 0), *cols) == rows(want, *cols)
    some = frame.where("dt < '2024-01-20'")  # no rows in the last 7 days
    for found in (S.period_counts(S.day_sets(some, ["g"], "u", {"n": F.col("n")}), ["g"], day, periods, "users", {"total": "n"}, (7, 30)),
                  S.latest_counts(some, ["g"], "u", day, periods, "users", {"total": F.col("n")}, F.col("n") > 0, (7, 30))):
        assert {(r["recent_days"], r["users"] > 0) for r in found.collect()} == {(7, False), (30, True)}
    assert rows(S.distinct_counts(frame, ["g"], "u", "users"), "g", "users") == rows(frame.groupBy("g").agg(F.count_distinct("u").alias("users")), "g", "users")


def test_states_merge(spark, frame):
    one, two = frame.where("u % 2 = 0 or u is null"), frame.where("u % 2 = 1")
    whole = S.day_sets(frame, ["g"], "u", {"n": F.col("n")})
    both = S.merge(S.day_sets(one, ["g"], "u", {"n": F.col("n")}), S.day_sets(two, ["g"], "u", {"n": F.col("n")}), ["g"], ["n"])
    hexed = [F.hex("bits").alias("bits"), "dt", "g", "bucket", "n"]
    assert rows(both, *hexed) == rows(whole, *hexed)
    # merging a state with itself adds no user
    again = S.period_counts(S.merge(whole, whole, ["g"]), ["g"], "2024-01-30", (30,), "users")
    assert rows(again, "g", "users") == rows(S.period_counts(whole, ["g"], "2024-01-30", (30,), "users"), "g", "users")


def test_dictionary_is_dense_and_keeps_numbers(spark, monkeypatch):
    monkeypatch.setattr(scan, "SLICE_ROWS", 10)
    first = spark.createDataFrame([(f"m{i % 40}",) for i in range(100)] + [(None,)], "mid string")
    ids = S.number_ids(first, "mid")
    assert sorted(r["pos"] for r in ids.collect()) == list(range(40)) and ids.where("mid is null").count() == 0
    kept = spark.createDataFrame([tuple(r) for r in ids.collect()], "mid string, pos long")
    later = S.number_ids(spark.createDataFrame([("m3",), ("new1",), ("new2",), ("new1",)], "mid string"), "mid", kept)
    assert sorted(r["pos"] for r in later.collect()) == list(range(42))
    assert {(r["mid"], r["pos"]) for r in kept.collect()} <= {(r["mid"], r["pos"]) for r in later.collect()}


@pytest.mark.parametrize("key", ["rpt_trade_by_brand", "rpt_trade_by_category", "rpt_traffic_by_channel", "rpt_traffic_by_channel_sets", "agg_count_distinct",
                                 "agg_cond_count_distinct"])
def test_plans_neither_fan_out_nor_shuffle_users_for_the_count(spark, sf, key):
    plan = registry.load_all()[0][key](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and ("bitmap_construct_agg" in plan or key in ("rpt_trade_by_category", "rpt_traffic_by_channel"))
    # the only generator turns the groups' results into a row a period
    for line in plan.splitlines():
        if "Generate" in line:
            assert "recent_days" in line or "explode(array(struct" in line
