"""Session construction and the few settings every job relies on."""

from __future__ import annotations

import os
import re
from urllib.parse import urlparse

from pyspark.sql import SparkSession

# Settings the jobs assume.  Timestamps are rendered in UTC so that local-time
# conversion (``from_utc_timestamp(..., 'GMT+8')``) is explicit in the job, dynamic
# partition overwrite makes ``PARTITION (dt)`` loads replace only the days they emit,
# and AQE re-plans joins / coalesces partitions from runtime statistics.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.orc.filterPushdown": "true",
}

# AQE joins small shuffle partitions up to this many bytes (compressed).  Sorts and hash maps take some twenty times
# as much memory for narrow rows, and a task of a join and an aggregate has several: Spark's 64 MB would be gigabytes.
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
MOST_ADVISORY_MB = 16


def _mb(size: str) -> float:
    """A size setting (``64MB``, ``64m``, ``67108864b``, ``67108864``) in MB."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([bkmgtp]?)(?:i?b)?\s*", size.lower()).groups()
    return int(number) * 1024.0 ** ("bkmgtp".index(unit or "b") - 2)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the jobs need to an existing session.  All of them are
    runtime settings of a session: one that cannot be set is an error, since a job that ran
    on without it could shift days or keep stale partitions.  A session's own smaller
    partition size stays."""
    for k, v in JOB_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    if _mb(spark.conf.get(ADVISORY)) > MOST_ADVISORY_MB:
        spark.conf.set(ADVISORY, f"{MOST_ADVISORY_MB}m")
    return spark


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "lakemart") -> SparkSession:
    """Build (or reuse) a session.  On a cluster pass nothing: master and sizing come
    from spark-submit; locally ``master='local[8]'`` is typical."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.driver.memory", os.environ.get("LAKEMART_DRIVER_MEM", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in JOB_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and staged writes.

    The cluster's ``spark.checkpoint.dir`` wins.  Only where it is unset is one chosen, the
    same way in every mode: a folder under the warehouse location.  On a cluster that must be in a
    store that driver and executors share; a local path there is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local" and urlparse(warehouse).scheme in ("", "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is on one machine's disk")
        d = warehouse.rstrip("/") + "/_lakemart_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d
