"""Exact distinct counts as mergeable sets: a bitmap of dense ids for each day and group.

``count(distinct user)`` over 1, 7 and 30 days either fans every row out to its periods or shuffles the users once a period.
Here a day's users of a group are a set that is kept: rows ``(dt, group, bucket, bits)``, ``bits`` a bitmap of the 32,768 ids
of that bucket (``bitmap_construct_agg``), built map-side from the rows, so no user is shuffled.  A period's set is the OR of
its days' bitmaps (``bitmap_or_agg``), all periods in one pass over the few state rows; counts are the bits that are set.
Sums ride along by day, group and bucket.  The state of a past day never changes, so a daily load adds one day's rows.

Ids are non-negative integers; the denser, the fewer buckets.  Ids of other kinds get dense numbers from a ``dictionary``, a
table that a daily load extends: known ids keep their number, new ones follow the largest.  NULL ids are not counted, as in
``count(distinct)``; their rows' sums are kept (under a NULL bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import add_days
from .scan import row_number


def number_ids(ids: DataFrame, key: str, known: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """``key, pos``: a dense number from 0 for each distinct non-NULL id; those in ``known`` keep theirs.  ``rows``: a bound on
    the rows, where one is known without reading them."""
    new = ids.select(key).where(F.col(key).isNotNull()).distinct()
    after = F.lit(0)
    if known is not None:
        new = new.join(known, key, "left_anti")
        after = F.coalesce(known.agg(F.max("pos") + 1).scalar(), F.lit(0))
    numbered = row_number(new, [], [key], "pos", rows=rows).select(key, (F.col("pos") - 1 + after).cast("long").alias("pos"))
    return numbered if known is None else known.select(key, "pos").unionByName(numbered)


def with_positions(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` with its id's number: the one shuffle on the id; a NULL id has none."""
    return df.join(ids.select(F.col(key).alias("_id"), "pos"), F.col(key) == F.col("_id"), "left").drop("_id")


def _bucket(pos: str | Column):
    return F.bitmap_bucket_number(F.col(pos) if isinstance(pos, str) else pos)


def _bits(pos: Column):
    return F.bitmap_construct_agg(F.bitmap_bit_position(pos))


def day_sets(df: DataFrame, group: Sequence[str], pos: str, sums: dict[str, Column] | None = None, where: Column | None = None,
             dt: str = "dt") -> DataFrame:
    """The state: ``dt, group, bucket, bits`` and the sums.  ``where``: only rows for which it is true are in the set (their
    sums count anyway)."""
    held = F.col(pos) if where is None else F.when(where, F.col(pos))
    return df.groupBy(dt, *group, _bucket(pos).alias("bucket")).agg(_bits(held).alias("bits"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()])


def distinct_counts(df: DataFrame, keys: Sequence[str], pos: str, out: str, where: Column | None = None) -> DataFrame:
    """``count(distinct pos)`` (of rows with ``where``) by ``keys``, through bitmaps."""
    held = F.col(pos) if where is None else F.when(where, F.col(pos))
    per = df.groupBy(*keys, _bucket(pos).alias("_bucket")).agg(_bits(held).alias("_bits"))
    return per.groupBy(*keys).agg(F.sum(F.bitmap_count("_bits")).alias(out))


def period_counts(state: DataFrame, group: Sequence[str], day: str, periods: Sequence[int], out: str, sums: dict[str, str] | None = None,
                  always: Sequence[int] = (), dt: str = "dt") -> DataFrame:
    """From the states of the last ``max(periods)`` days: a row for each group and period that has rows, with the distinct
    ids as ``out`` and the sums; ``sums`` maps an output to its column in the state.  Periods in ``always`` have a row for
    every group of the longest period (0 ids, NULL sums), as n-day tables do.  The days are OR-ed in one pass of
    conditional aggregates, and only the groups' results are turned into a row a period."""
    sums = sums or {}
    lo = {p: add_days(day, -(p - 1)) for p in periods}
    x = state.where((F.col(dt) >= F.lit(min(lo.values()))) & (F.col(dt) <= F.lit(day)))
    inside = {p: F.col(dt) >= F.lit(lo[p]) for p in periods}
    aggs = []
    for p in periods:
        aggs += [F.bitmap_or_agg(F.when(inside[p], F.col("bits"))).alias(f"_b{p}"), F.count_if(inside[p]).alias(f"_n{p}")]
        aggs += [F.sum(F.when(inside[p], F.col(c))).alias(f"_{n}{p}") for n, c in sums.items()]
    per = x.groupBy(*group, "bucket").agg(*aggs)
    whole = []
    for p in periods:
        whole += [F.sum(F.bitmap_count(f"_b{p}")).alias(f"_b{p}"), F.sum(f"_n{p}").alias(f"_n{p}"), *[F.sum(f"_{n}{p}").alias(f"_{n}{p}") for n in sums]]
    wide = per.groupBy(*group).agg(*whole)
    rows = [F.struct(F.lit(p).alias("recent_days"), F.col(f"_n{p}").alias("_n"), F.col(f"_b{p}").alias(out), *[F.col(f"_{n}{p}").alias(n) for n in sums]) for p in periods]
    return wide.select(*group, F.explode(F.array(*rows)).alias("_r")).where((F.col("_r._n") > 0) | F.col("_r.recent_days").isin(*always)).select("_r.recent_days", *group, f"_r.{out}", *[f"_r.{n}" for n in sums])


def latest_counts(df: DataFrame, group: Sequence[str], key: str, day: str, periods: Sequence[int], out: str, sums: dict[str, Column],
                  where: Column | None = None, always: Sequence[int] = (), dt: str = "dt") -> DataFrame:
    """``period_counts`` straight from the rows, for ids without numbers or for groups that are many and small, where a bitmap
    would be mostly zeros: the periods all end on ``day``, so the last day of each (group, id) (with ``where``) tells every
    period that counts it.  One shuffle by (group, id), summed up map-side; no row is fanned out."""
    lo = {p: add_days(day, -(p - 1)) for p in periods}
    x = df.where((F.col(dt) >= F.lit(min(lo.values()))) & (F.col(dt) <= F.lit(day)))
    counted = F.col(key).isNotNull() if where is None else F.col(key).isNotNull() & where
    per = x.groupBy(*group, key).agg(F.max(dt).alias("_any"), F.max(F.when(counted, F.col(dt))).alias("_last"),
                                     *[F.sum(F.when(F.col(dt) >= lo[p], c)).alias(f"_{n}{p}") for p in periods for n, c in sums.items()])
    wide = per.groupBy(*group).agg(F.max("_any").alias("_any"), *[F.count_if(F.col("_last") >= lo[p]).alias(f"_c{p}") for p in periods],
                                   *[F.sum(f"_{n}{p}").alias(f"_{n}{p}") for p in periods for n in sums])
    rows = [F.struct(F.lit(p).alias("recent_days"), ((F.col("_any") >= lo[p]) | F.lit(p in always)).alias("_n"), F.col(f"_c{p}").alias(out),
                     *[F.col(f"_{n}{p}").alias(n) for n in sums]) for p in periods]
    return wide.select(*group, F.explode(F.array(*rows)).alias("_r")).where("_r._n").select("_r.recent_days", *group, f"_r.{out}", *[f"_r.{n}" for n in sums])


def merge(one: DataFrame, other: DataFrame, group: Sequence[str], sums: Sequence[str] = (), dt: str = "dt") -> DataFrame:
    """Two states of the same days as one: bitmaps OR-ed, sums added."""
    return one.unionByName(other).groupBy(dt, *group, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), *[F.sum(s).alias(s) for s in sums])

