"""Report periods: fan each row out to ``recent_days`` in (1, 7, 30) (O-09).

The reference leaves the upper bound off and cannot prune on a bound that depends
on the exploded column; here the widest literal window is applied before the fan-out
(partition pruning / pushdown), then the per-period bound after it.  Partial
aggregation runs after the fan-out, so the shuffle carries at most
``len(periods) x groups`` rows, not ``len(periods) x rows``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import PERIODS
from .rollup import in_window


def recent_days(df: DataFrame, day: str, periods: Sequence[int] = PERIODS, dt: str = "dt",
                name: str = "recent_days") -> DataFrame:
    src = in_window(df, day, max(periods), dt)
    fan = src.withColumn(name, F.explode(F.array(*[F.lit(p) for p in periods])))
    if periods == (1,):
        return fan
    lo = F.date_format(F.date_add(F.lit(day).cast("date"), -F.col(name) + 1), "yyyy-MM-dd")
    return fan.where(F.col(dt) >= lo)


def fan_out(df: DataFrame, periods: Sequence[int], name: str = "recent_days") -> DataFrame:
    """Plain fan-out over a literal array (no day filter) — for n-day tables."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(p) for p in periods])))


def choose_period(period: str, by_period: dict[int, str | Column]) -> Column:
    """``case recent_days when 7 then x_7d when 30 then x_30d end`` (F-14)."""
    e = None
    for p, c in by_period.items():
        c = F.col(c) if isinstance(c, str) else c
        e = F.when(F.col(period) == p, c) if e is None else e.when(F.col(period) == p, c)
    return e
