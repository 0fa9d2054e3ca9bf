"""Rollup operators: 1-day aggregates, trailing n-day windows, to-date state.

``trailing`` answers 7 and 30 days from ONE scan of the last 30 daily partitions with
conditional sums (A-03), instead of one scan per window; the bound is folded to
literal day strings so it prunes partitions / pushes to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import add_days, col


def daily(df: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """1-day grain rollup: ``group by keys`` with named aggregates (A-01/A-02/A-15)."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def daily_distinct(df: DataFrame, keys: Sequence[str], distinct: str, count_name: str,
                   sums: dict[str, Column]) -> DataFrame:
    """``count(distinct d)`` plus sums per ``keys`` without Spark's Expand rewrite:
    aggregate per (keys, d) first, then count those groups.  Exact for any input
    (NULL ``d`` is not counted, its sums still are); both levels are ordinary partial
    aggregates, so neither a hot key nor a hot ``d`` concentrates in one task."""
    inner = df.groupBy(*keys, distinct).agg(*[c.alias(n) for n, c in sums.items()])
    return inner.groupBy(*keys).agg(F.count(distinct).alias(count_name),
                                    *[F.sum(n).alias(n) for n in sums])


def in_window(df: DataFrame, day: str, days: int, dt: str = "dt") -> DataFrame:
    """S-08: keep ``[day-days+1, day]`` with literal bounds (always with the upper bound)."""
    return df.where((F.col(dt) >= F.lit(add_days(day, -(days - 1)))) & (F.col(dt) <= F.lit(day)))


def trailing(df: DataFrame, keys: Sequence[str], measures: dict[str, str], day: str,
             windows: Iterable[int] = (7, 30), dt: str = "dt",
             casts: dict[str, str] | None = None) -> DataFrame:
    """n-day rollup from a 1-day table: ``sum(if(dt >= day-w+1, m, 0))`` per window.

    ``measures`` maps an output stem to the 1-day column; outputs are
    ``{stem}_{w}d``.  ``casts`` optionally casts a stem's sums (declared types).
    """
    windows = sorted(windows)
    casts = casts or {}
    src = in_window(df, day, windows[-1], dt)
    aggs = []
    for w in windows:
        lo = add_days(day, -(w - 1))
        for stem, c in measures.items():
            v = col(c)
            e = F.sum(v) if w == windows[-1] else F.sum(F.when(F.col(dt) >= F.lit(lo), v).otherwise(F.lit(0)))
            if stem in casts:
                e = e.try_cast(casts[stem])
            aggs.append(e.alias(f"{stem}_{w}d"))
    return src.groupBy(*keys).agg(*aggs)


def to_date_first(df_1d: DataFrame, key: str, measures: dict[str, str], first: str, last: str,
                  day: str, dt: str = "dt", casts: dict[str, str] | None = None) -> DataFrame:
    """First to-date load: aggregate every 1-day partition up to ``day`` (A-08)."""
    casts = casts or {}
    aggs = [F.min(dt).alias(first), F.max(dt).alias(last)]
    for out, c in measures.items():
        e = F.sum(col(c))
        aggs.append((e.try_cast(casts[out]) if out in casts else e).alias(out))
    return df_1d.where(F.col(dt) <= F.lit(day)).groupBy(key).agg(*aggs)


def to_date_step(state: DataFrame, today: DataFrame, key: str, measures: dict[str, str],
                 first: str | None, last: str | None, day: str,
                 casts: dict[str, str] | None = None) -> DataFrame:
    """Daily to-date load: ``state(D-1) ⊕ 1d(D)`` by full outer join on the key (N-04).

    ``measures`` maps a state column to the matching 1-day column.  ``first`` becomes
    ``day`` for keys new today, ``last`` becomes ``day`` for keys active today.
    """
    casts = casts or {}
    o = state.alias("old")
    n = today.select(key, *measures.values()).alias("new")
    j = o.join(n, F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    new_key = F.col(f"new.{key}")
    old_key = F.col(f"old.{key}")
    cols = [F.coalesce(old_key, new_key).alias(key)]
    if first:
        cols.append(F.when(new_key.isNotNull() & old_key.isNull(), F.lit(day))
                    .otherwise(F.col(f"old.{first}")).alias(first))
    if last:
        cols.append(F.when(new_key.isNotNull(), F.lit(day)).otherwise(F.col(f"old.{last}")).alias(last))
    for s, t in measures.items():
        e = F.coalesce(F.col(f"old.{s}"), F.lit(0)) + F.coalesce(F.col(f"new.{t}"), F.lit(0))
        cols.append((e.try_cast(casts[s]) if s in casts else e).alias(s))
    return j.select(*cols)
