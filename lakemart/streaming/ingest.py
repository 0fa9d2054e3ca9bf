"""Incremental fact loads from a landing folder (see package docstring)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def landing_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "json",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of landed files with a declared schema (partition folders such as
    ``dt=...`` are discovered from the path when the schema names them)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def run_fact_stream(stream: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                    partition_by: Sequence[str] = ("dt",), available_now: bool = True):
    """Apply a stateless fact job to the stream and append to a partitioned Parquet
    folder.  ``available_now`` processes everything landed so far and stops (a
    scheduled daily run); otherwise the query keeps running."""
    w = (job(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .partitionBy(*partition_by).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
