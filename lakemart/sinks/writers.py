"""Writers and table management (K-01..K-18).

Tables are created with an explicit LOCATION inside a shared folder (the cluster's
``spark.checkpoint.dir`` or a warehouse path), never a machine-local one.  Partition
overwrites follow the reference: a static ``PARTITION (dt='D')`` replaces exactly that
day, a dynamic ``PARTITION (dt)`` replaces exactly the days present in the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def partition_layout(df: DataFrame, cols: list[str], salt_buckets: int = 1) -> DataFrame:
    """Layout before a partitioned write: the ``REBALANCE`` hint on the partition columns.
    AQE then splits a large day into advisory-size files
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``) and merges small days, so there is
    neither one huge task per day nor thousands of tiny files.  ``salt_buckets`` > 1 forces
    a day to be spread over that many files."""
    if salt_buckets > 1:
        keys = [F.col(c) for c in cols]
        return df.repartition(*keys, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets)))
    return df.hint("rebalance", *cols)


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return "/".join([checkpoint_dir(spark).rstrip("/"), "lakemart", *parts, uuid.uuid4().hex[:12]])


def stored(df: DataFrame, name: str) -> DataFrame:
    """A fact written by day to a fresh shared folder and read back, for jobs that read it
    several times: they scan the stored days instead of building the fact again."""
    spark = df.sparkSession
    path = shared_path(spark, "facts", name)
    partition_layout(df, ["dt"]).write.partitionBy("dt").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def landed(df: DataFrame, name: str) -> DataFrame:
    """A frame written to a fresh shared folder and read back, for loads that use it more than once."""
    path = shared_path(df.sparkSession, "landing", name)
    df.hint("rebalance").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_partitioned(spark: SparkSession, table: str, columns: str, partitions: list[str], location: str,
                       fmt: str = "parquet", options: dict[str, str] | None = None) -> None:
    """K-01 / K-02 ``PARTITIONED BY (dt)`` or ``(day, hour)``; K-04 codec in OPTIONS."""
    opts = ""
    if options:
        opts = " OPTIONS (" + ", ".join(f"'{k}' '{v}'" for k, v in options.items()) + ")"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING {fmt}{opts} "
              f"PARTITIONED BY ({', '.join(partitions)}) LOCATION '{location}'")


def create_bucketed(df: DataFrame, table: str, buckets: int, col: str, location: str, fmt: str = "parquet") -> None:
    """K-03 hash-bucketed table: later joins / aggregations on ``col`` skip the shuffle.  The
    rows are dealt by the same hash first, so each bucket is one file, not one per task."""
    (df.repartition(buckets, col).write.format(fmt).bucketBy(buckets, col).sortBy(col).option("path", location)
     .mode("overwrite").saveAsTable(table))


def create_sampled(df: DataFrame, table: str, key: str, buckets: int, location: str) -> None:
    """A table kept by ``pmod(key, buckets)`` (the bucket of an integer key), for samples of single buckets.  Spark's own
    buckets go by another hash, and no filter selects one of their files."""
    x = df.withColumn("_bucket", F.pmod(F.col(key), F.lit(buckets)).cast("int"))
    (partition_layout(x, ["_bucket"]).write.partitionBy("_bucket").option("path", location).mode("overwrite").saveAsTable(table))


def write_compressed(df: DataFrame, path: str, fmt: str = "orc", codec: str = "snappy") -> None:
    """K-04 ORC none / zlib / snappy, Parquet snappy."""
    df.write.mode("overwrite").format(fmt).option("compression", codec).save(path)


def _select_in_table_order(spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
    return df.select(*spark.table(table).columns)


def overwrite_static_partition(spark: SparkSession, df: DataFrame, table: str, spec: dict[str, str]) -> None:
    """K-05 ``INSERT OVERWRITE t PARTITION (dt='D') SELECT ...``: that partition is
    replaced (emptied when ``df`` is empty); the others are untouched."""
    view = f"_lakemart_src_{uuid.uuid4().hex[:8]}"
    cols = [c for c in spark.table(table).columns if c not in spec]
    df.select(*cols).createOrReplaceTempView(view)
    part = ", ".join(f"{k} = '{v}'" for k, v in spec.items())
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({part}) SELECT {', '.join(cols)} FROM {view}")
    spark.catalog.dropTempView(view)


def _partition_cols(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def overwrite_dynamic_partition(spark: SparkSession, df: DataFrame, table: str, salt_buckets: int = 1) -> None:
    """K-06 replace exactly the partitions present in ``df`` (partition columns last)."""
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    x = _select_in_table_order(spark, df, table)
    parts = _partition_cols(spark, table)
    if parts:
        x = partition_layout(x, parts, salt_buckets)
    x.write.insertInto(table, overwrite=True)


def insert_append(spark: SparkSession, df: DataFrame, table: str, salt_buckets: int = 1) -> None:
    """K-07 ``INSERT INTO``."""
    x = _select_in_table_order(spark, df, table)
    parts = _partition_cols(spark, table)
    if parts:
        x = partition_layout(x, parts, salt_buckets)
    x.write.insertInto(table, overwrite=False)


def overwrite_table(spark: SparkSession, df: DataFrame, table: str) -> None:
    """K-08 replace a whole unpartitioned table."""
    _select_in_table_order(spark, df, table).write.insertInto(table, overwrite=True)


def append_distinct(spark: SparkSession, table: str, new_rows: DataFrame, part: str | None = None) -> DataFrame:
    """K-09 idempotent report append: ``old ∪ new`` without exact duplicates.

    The reference rewrites the whole report with each load.  Here only rows that the table does not have are appended: an
    anti-join by a digest of the whole row (NULLs compare equal), against the partitions ``part`` of the new rows alone where the
    report has such a column.  A load of the same rows writes nothing; files that readers hold stay.  A load lost half-way
    is mended by its rerun, which appends what is missing."""
    columns = spark.table(table).columns
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    held = spark.table(table)
    fresh = new_rows.select(*columns)
    if part is not None:
        days = [r[0] for r in fresh.select(part).distinct().collect()]  # the stat days of one load
        held = held.where(F.col(part).isin(days) | F.col(part).isNull()) if days else held.limit(0)
    fresh = fresh.withColumn("_d", digest).dropDuplicates(["_d"]).join(held.select(digest.alias("_d")), "_d", "left_anti").drop("_d")
    if not fresh.isEmpty():
        fresh.hint("rebalance").write.insertInto(table)
        spark.catalog.refreshTable(table)
    return spark.table(table)


class Store:
    """Folders of the store that a path is in, by Hadoop's file system API: the one place that needs the session's JVM."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm = spark._jvm
        self._fs = self._path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        """Entries of a folder; none where it is missing."""
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self._fs.exists(self._path(path)) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """A whole file or none: written aside, then renamed.  An error if the file is there already."""
        aside = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(self._path(path)) or not self._fs.rename(aside, self._path(path)):
            self._fs.delete(aside, False)
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        """Remove a file or a folder, if it is there."""
        self._fs.delete(self._path(path), True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder in the store it is in, if it is there."""
    Store(spark, path).delete(path)


def ctas(spark: SparkSession, table: str, df: DataFrame, location: str, fmt: str = "parquet") -> None:
    """K-10 ``CREATE TABLE ... AS SELECT``."""
    df.write.format(fmt).option("path", location).mode("errorifexists").saveAsTable(table)


def load_files(spark: SparkSession, table: str, files: DataFrame, overwrite: bool = False) -> None:
    """K-11 ingest already-read files into a table (append or overwrite)."""
    (overwrite_table if overwrite else insert_append)(spark, files, table)


def load_partition(spark: SparkSession, table: str, files: DataFrame, spec: dict[str, str],
                   overwrite: bool = True) -> None:
    """K-12 ingest files into a given partition."""
    if overwrite:
        overwrite_static_partition(spark, files, table, spec)
    else:
        insert_append(spark, files.select("*", *[F.lit(v).alias(k) for k, v in spec.items()]), table)


def export_dir(df: DataFrame, path: str, sep: str = "\t") -> None:
    """K-13 ``INSERT OVERWRITE [LOCAL] DIRECTORY``: delimited text, NULL as empty."""
    df.write.mode("overwrite").option("sep", sep).option("nullValue", "").csv(path)


def partition_add(spark: SparkSession, table: str, *specs: dict[str, str]) -> None:
    """K-14 register empty partitions (one or several)."""
    parts = " ".join("PARTITION (" + ", ".join(f"{k} = '{v}'" for k, v in s.items()) + ")" for s in specs)
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {parts}")


def partition_drop(spark: SparkSession, table: str, *specs: dict[str, str]) -> None:
    """K-15."""
    parts = ", ".join("PARTITION (" + ", ".join(f"{k} = '{v}'" for k, v in s.items()) + ")" for s in specs)
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {parts}")


def partition_list(spark: SparkSession, table: str) -> DataFrame:
    """K-16 ``SHOW PARTITIONS`` as a DataFrame."""
    return spark.sql(f"SHOW PARTITIONS {table}")


def partition_repair(spark: SparkSession, table: str) -> None:
    """K-17 discover partition folders written by path."""
    spark.sql(f"MSCK REPAIR TABLE {table}")


def truncate(spark: SparkSession, table: str) -> None:
    """K-18 ``TRUNCATE TABLE``.  Spark refuses TRUNCATE on tables declared with a
    LOCATION (external); those are emptied by a static-mode overwrite with no rows."""
    try:
        spark.sql(f"TRUNCATE TABLE {table}")
    except Exception as e:  # noqa: BLE001
        if "external" not in str(e).lower():
            raise
        mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
        try:
            empty = spark.createDataFrame([], spark.table(table).schema)
            empty.write.insertInto(table, overwrite=True)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def drop_table(spark: SparkSession, table: str) -> None:
    """K-18 ``DROP TABLE IF EXISTS``."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def create_database(spark: SparkSession, name: str) -> None:
    """K-18 ``CREATE DATABASE IF NOT EXISTS`` + ``USE``."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    spark.sql(f"USE {name}")
