"""The segmented scan against plain windows, with slices cut small, hot keys, equal rows and NULLs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakemart.operators import scan


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(scan, "SLICE_ROWS", 200)


@pytest.fixture(scope="module")
def frame(spark):
    """A third of the rows: one key in one second."""
    rng = random.Random(4)
    data = []
    for i in range(3000):
        hot = i % 3 == 0
        key = "hot" if hot else rng.choice([None, *"abcdefgh"])
        ts = 1000 if hot else rng.choice([None, *range(950, 1050)])
        data.append((i, key, ts, rng.choice([None, *range(9)]), rng.choice([None, "x", "y", "z"])))
    return spark.createDataFrame(data, "id long, k string, ts long, v long, name string").cache()


def test_no_slice_of_a_key_is_more_than_its_share(frame, small):
    cut = scan.Cut(frame, ["k"], ["ts", "id"])
    assert cut.n == 15
    sizes = [r["count"] for r in cut.x.groupBy("k", "_s").count().collect()]
    assert max(sizes) <= 3 * scan.SLICE_ROWS and sum(sizes) == 3000
    # slices follow the order of (key, order)
    spans = cut.x.groupBy("_s").agg(F.min(F.struct("k", "ts", "id")).alias("a"), F.max(F.struct("k", "ts", "id")).alias("b")).orderBy("_s")
    assert spans.select((F.lag("b").over(Window.orderBy("_s")) < F.col("a")).alias("ok")).where("not ok").count() == 0
    # what is carried is a row a slice, not a row a row
    assert cut.carried({"t": F.sum("v")}, lambda w: {"c": F.sum("t").over(w)}).count() <= 2 * cut.n


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("desc", [False, True])
def test_running_matches_the_window(frame, small, keys, desc):
    o = [F.col(c).desc() if desc else F.col(c).asc() for c in ("ts", "id")]
    for kind in ("sum", "max", "min", "count") if keys and not desc else ("sum",):
        w = Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        want = frame.withColumn("out", getattr(F, kind)("v").over(w))
        assert rows(scan.running(frame, keys, ["ts", "id"], "v", "out", kind, desc=desc), "id", "out") == rows(want, "id", "out")
        w = Window.partitionBy(*keys).orderBy(o[0])
        want = frame.withColumn("out", getattr(F, kind)("v").over(w))
        assert rows(scan.running(frame, keys, ["ts"], "v", "out", kind, "range", desc), "id", "out") == rows(want, "id", "out")


@pytest.mark.parametrize("keys", [["k"], []])
def test_neighbours_and_numbers_match_the_window(frame, small, keys):
    order = ["ts", "id"]
    w = Window.partitionBy(*keys).orderBy(*order)
    want = frame.select("*", F.lag("name", 1, "none").over(w).alias("prev"), F.lead("name").over(w).alias("next"), F.row_number().over(w).alias("rn"),
                        F.sum("v").over(w.rowsBetween(-1, 1)).alias("moving"))
    assert rows(scan.lag(frame, keys, order, "name", "prev", "none"), "id", "prev") == rows(want, "id", "prev")
    assert rows(scan.lead(frame, keys, order, "name", "next"), "id", "next") == rows(want, "id", "next")
    assert rows(scan.row_number(frame, keys, order, "rn"), "id", "rn") == rows(want, "id", "rn")
    assert rows(scan.moving_sum(frame, keys, order, "v", "moving"), "id", "moving") == rows(want, "id", "moving")
    got = scan.steps(frame, keys, order, "name", "rn", "next")
    assert rows(got, "id", "rn", "next") == rows(want, "id", "rn", "next")


@pytest.mark.parametrize("buckets", [1, 4, 7, 5000])
def test_ntile_with_all_values_distinct(frame, small, buckets):
    x = frame.where("id < 1003")
    want = x.withColumn("q", F.ntile(buckets).over(Window.orderBy("id")))
    got = scan.ntile(x, ["id"], buckets, "q")
    assert rows(got, "id", "q") == rows(want, "id", "q")


def test_empty_and_one_slice(frame):
    none = frame.where("false")
    assert scan.row_number(none, ["k"], ["ts", "id"], "rn").collect() == []
    assert scan.ntile(none, ["id"], 4, "q").collect() == []
    got = scan.lag(frame, ["k"], ["ts", "id"], "name", "prev")  # below SLICE_ROWS: the plain window
    assert scan.Cut(frame, ["k"], ["ts", "id"]).n == 1
    want = frame.withColumn("prev", F.lag("name").over(Window.partitionBy("k").orderBy("ts", "id")))
    assert rows(got, "id", "prev") == rows(want, "id", "prev")


def test_one_shuffle_of_the_rows(frame, small):
    """The rows are shuffled once, for the window; carried rows are broadcast (bounded by the number of slices)."""
    x = scan.row_number(frame, ["k"], ["ts", "id"], "rn")
    x.collect()
    p = x._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
