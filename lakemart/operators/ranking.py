"""Ranking without a single-partition window.

``rank() over (order by x)`` with no partition sends every row to one task.  These
helpers compute the same numbers from a *histogram* of the ordering value (a partial
aggregate: one row per distinct value per group), a segmented scan over that histogram
(``operators/scan.py``: range slices, carried sums, no task per group), and a join back; rows
that tie on the value are numbered among themselves by the same scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import null_safe_join
from .scan import Cut, row_number


def rank_family(df: DataFrame, part: Sequence[str], value: str, desc: bool = True,
                tiebreak: Sequence[str] = (), names=("rp", "drp", "rmp"), rows: int | None = None) -> DataFrame:
    """rank / dense_rank / row_number over ``partition by part order by value``.

    NULL groups and NULL values are groups and values like any other (NULLs come last in
    descending order, first in ascending), as in the window.  The row number needs a
    ``tiebreak`` that orders the rows of a tie; where ``names[2]`` is None no row is numbered
    and no tie group is sorted.  ``rows``: the number of rows or a bound, where one is known more cheaply than by counting."""
    part = list(part)
    r, d, n = names
    if n is not None and not tiebreak:
        raise ValueError("a row number needs a tiebreak; pass names=(rank, dense_rank, None) for the ranks alone")
    rows = df.count() if rows is None else rows
    cut = Cut(df.groupBy(*part, value).agg(F.count(F.lit(1)).alias("_n")), part, [value], desc, rows)
    cut.running("_n", "_upto")
    cut.running(F.lit(1), "_dense", "count")
    hist = cut.result().select(*part, value, (F.col("_upto") - F.col("_n") + 1).alias("_rank"), "_dense")
    j = null_safe_join(df, hist, [*part, value])
    if n is not None:
        j = row_number(j, [*part, value], list(tiebreak), "_tie", rows=rows)
        j = j.withColumn(n, (F.col("_rank") + F.col("_tie") - 1).cast("int")).drop("_tie")
    return (j.withColumn(r, F.col("_rank").cast("int")).withColumn(d, F.col("_dense").cast("int"))
            .drop("_rank", "_dense"))


def first_ntile(df: DataFrame, order: str, tiebreak: Sequence[str], buckets: int, rows: int | None = None) -> DataFrame:
    """Rows of ``ntile(buckets) over (order by order, tiebreak...) = 1``.

    Bucket 1 holds the first ``ceil(N / buckets)`` rows.  The counts of the values, scanned in order, give each
    value's running start; values wholly inside the bucket are kept by a join, and
    only the one boundary value numbers its rows.  Right also where all values differ: then the scan has as many
    rows as the data, in slices."""
    counts = df.groupBy(order).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.ceil(F.sum("_n") / F.lit(buckets)).alias("_m")).scalar()
    rows = df.count() if rows is None else rows
    cut = Cut(counts, [], [order], rows=rows)
    cut.running("_n", "_upto")
    hist = cut.result().withColumn("_m", most).where(F.col("_upto") - F.col("_n") < F.col("_m"))  # values that start inside bucket 1
    j = null_safe_join(df, hist, [order])  # NULLs sort first and fill the bucket like other values
    whole = j.where(F.col("_upto") <= F.col("_m"))
    edge = row_number(j.where(F.col("_upto") > F.col("_m")), [order], list(tiebreak), "_rn", rows=rows)
    edge = edge.where(F.col("_upto") - F.col("_n") + F.col("_rn") <= F.col("_m")).drop("_rn")
    return whole.unionByName(edge).drop("_n", "_upto", "_m")


def partition_total(df: DataFrame, keys: Sequence[str], measure: str, out: str) -> DataFrame:
    """``sum(m) over (partition by keys)`` (no ordering) as a partial aggregate joined
    back; rows with NULL keys form groups of their own.  A few totals are broadcast by AQE
    from their measured size."""
    tot = df.groupBy(*keys).agg(F.sum(measure).alias(out))
    return null_safe_join(df, tot, list(keys))
