"""Physical-plan properties of the registered queries (planning only, no execution)."""

import pytest
from pyspark.sql import functions as F

from lakemart import registry

QUERIES = registry.load_all()[0]
SIDE_EFFECTS = ("scan_", "overwrite_", "insert_append", "partition_", "append_distinct", "create_", "export_dir",
                "format_roundtrip", "load_", "truncate_drop", "select_star", "stream_", "publish_", "merge_", "bucket")
PURE = sorted(k for k in QUERIES if not k.startswith(SIDE_EFFECTS))


def plan(spark, sf, key):
    return QUERIES[key](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", PURE)
def test_no_cross_or_nested_loop_join(spark, sf, key):
    p = plan(spark, sf, key)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_day_bounds_reach_the_scan(spark, sf):
    p = QUERIES["user_sku_order_nd"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" in p and "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p


def test_topk_limits_before_the_shuffle(spark, sf):
    df = QUERIES["rpt_cart_top3_by_category"](spark, sf)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert p.count("WindowGroupLimit") >= 2  # partial (map side) + final


def test_dictionary_is_broadcast(spark, sf):
    assert "BroadcastHashJoin" in plan(spark, sf, "join_dim_decode")


@pytest.mark.parametrize("key", ["user_order_td_state", "user_payment_td_state", "join_self_state_bucketed", "bucketed_join_aggregate"])
def test_bucketed_joins_exchange_nothing(spark, sf, key):
    p = plan(spark, sf, key)
    assert "SortMergeJoin" in p and "Exchange" not in p and "Bucketed: true" in p


def test_joined_days_prune_partitions(spark, sf):
    df = QUERIES["scan_days_from_table"](spark, sf)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in p.split("PartitionFilters:")[1]


def test_latest_partition_reads_one_partition(spark, sf):
    for key in ("scan_latest_partition", "scan_latest_partition_gap"):
        df = QUERIES[key](spark, sf)
        assert len({f.split("/dt=")[1].split("/")[0] for f in df.inputFiles()}) == 1
        assert len(df.select("dt").distinct().collect()) == 1



def test_a_bucket_sample_opens_its_files_only(spark, sf):
    df = QUERIES["bucket_sample_files"](spark, sf)
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in scan.split("PartitionFilters:")[1].split("]")[0]
    files = {r[0].split("/")[-2] for r in df.withColumn("f", F.input_file_name()).select("f").distinct().collect()}
    assert files == {"_bucket=0"}



def test_bloom_filter_of_a_filtered_side_reaches_the_fact_scan(spark, sf):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
            "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = QUERIES["join_star_filtered"](spark, sf)
        p = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "might_contain" in p and "bloom_filter_agg" in p
    # the filter stands on the scan of the lines, below every join
    fact = [line for line in p.splitlines() if "might_contain" in line and "Filter" in line]
    assert fact and any("l_partkey" in line or "l_orderkey" in line for line in fact)
