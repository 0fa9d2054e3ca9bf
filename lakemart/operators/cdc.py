"""CDC envelope operators: row selection (P-08/P-09), dictionary decode (N-06),
newest change per key (W-01) and the SCD2 zipper merge (J-07).

A CDC frame has the envelope ``type, ts, data struct, old map<string,string>, dt``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import add_days


def cdc_rows(df: DataFrame, days: str | Iterable[str] | None = None, kinds: Sequence[str] = ("insert",),
             changed: str | None = None) -> DataFrame:
    """Rows of the given landing day(s) and kinds; with ``changed``, only updates whose
    ``old`` map names that column (``array_contains(map_keys(old), c)``)."""
    x = df
    if days is not None:
        days = [days] if isinstance(days, str) else list(days)
        x = x.where(F.col("dt") == days[0]) if len(days) == 1 else x.where(F.col("dt").isin(*days))
    x = x.where(F.col("type") == kinds[0]) if len(kinds) == 1 else x.where(F.col("type").isin(*kinds))
    if changed is not None:
        x = x.where(F.array_contains(F.map_keys("old"), changed))
    return x


def two_days(day: str) -> list[str]:
    """S-09: D and D-1 (lines created yesterday, event today)."""
    return [day, add_days(day, -1)]


def old_value(c: str, cast: str | None = None) -> Column:
    """P-03 ``old['c']`` (NULL when absent), optionally cast (Spark rejects text-number
    mixing).  ``try_cast``: a malformed previous value reads as NULL instead of
    failing the load."""
    v = F.col("old")[c]
    return v.try_cast(cast) if cast else v


def decode(df: DataFrame, code: str, dic: DataFrame, parent: str, out: str) -> DataFrame:
    """N-06: left join the dictionary slice ``parent_code = parent`` to turn a code into a
    name.  The dictionary is a fixed code table, so it is broadcast."""
    d = dic.where(F.col("parent_code") == parent).select(F.col("dic_code").alias(f"_{out}_code"),
                                                         F.col("dic_name").alias(out))
    return df.join(F.broadcast(d), F.col(code) == F.col(f"_{out}_code"), "left").drop(f"_{out}_code")
