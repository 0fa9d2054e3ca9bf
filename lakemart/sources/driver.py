"""Driver tables: the TPC-H-like parquet files under one scale-factor folder.

Only ``spark.read.parquet`` is used, so column pruning and filter pushdown reach
the scan.  Nothing is cached here; jobs decide what to reuse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


_FRAMES: dict[tuple[str, str, str], DataFrame] = {}


class Driver:
    """Lazy handle on ``{sf_dir}/{table}.parquet``.

    The DataFrame of each table is kept per (application, folder): it is only a plan
    (file listing + footer schema), so reusing it saves a listing and a footer read per
    query without holding any data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        df = _FRAMES.get(key)
        if df is None or df.sparkSession is not self.spark:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            _FRAMES[key] = df
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
