"""Sessionization (W-02 then W-03) without one task per device.

The reference assigns each page row the last session-start timestamp seen so far on
its device: ``last_value(start, true) over (partition by mid order by ts)``.  Because a
start point *is* the row's own ``ts``, that value equals the running ``max`` of start
points, an associative prefix: a segmented scan (``operators/scan.py``) over range slices of
(device, ts) computes it, so a device holding a third of all rows is spread over many tasks.
Rows of one ``ts`` share their value: a start goes before the other rows of its ``ts``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Cut


def session_start(df: DataFrame, device: str, ts: str, is_start: Column, part: Sequence[str] = ("dt",), out: str = "session_start",
                  tie: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """``tie``: columns that tell rows of one (device, ts) apart, so that many of them can lie in several slices; ``rows``: the
    number of rows or a bound on it, where one is known without reading ``df``."""
    x = df.withColumn("_start", F.when(is_start, F.col(ts))).withColumn("_late", F.col("_start").isNull())
    cut = Cut(x, [*part, device], [ts, "_late", *tie], rows=rows)
    cut.running("_start", out, "max")
    return cut.result().drop("_start", "_late")


def sessionize(df: DataFrame, device: str, ts: str, is_start: Column,
               part: Sequence[str] = ("dt",), out: str = "session_id", **kw) -> DataFrame:
    """``session_id = device-<last session start ts>``; NULL before the first start
    (``concat`` with NULL), as in the reference."""
    s = session_start(df, device, ts, is_start, part, **kw)
    return s.withColumn(out, F.concat(F.col(device), F.lit("-"), F.col("session_start").cast("string"))) \
            .drop("session_start")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """W-03 / W-01 as an aggregate: the row with the smallest ``order`` per group
    (``row_number() ... = 1``).  ``min(struct(order..., cols...))`` is partially
    aggregated map-side, so a hot group never lands whole on one task.  Ties on
    ``order`` resolve by the following struct fields (deterministic)."""
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c).alias(c) for c in cols])
    agg = df.groupBy(*keys).agg(F.min(packed).alias("_m"))
    return agg.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in cols])


def last_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """W-01 latest row per key (``row_number() over (... order by ts desc) = 1``)."""
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c).alias(c) for c in cols])
    agg = df.groupBy(*keys).agg(F.max(packed).alias("_m"))
    return agg.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in cols])
