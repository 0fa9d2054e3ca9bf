"""Top-k operators.

``top_k_per_group`` filters a rank window (W-15/W-16).  Catalyst turns the
``rank <= k`` filter into a WindowGroupLimit that also runs *before* the shuffle,
so each map task forwards at most k rows per group (plus ties for ``rank``) — a
group holding a third of the data never travels whole.  ``top_n`` is
``orderBy().limit()`` which plans as TakeOrderedAndProject (per-task top-n, then a
merge of n x tasks rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKERS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    ties: str = "rank", out: str | None = "rk") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    name = out or "_rk"
    r = df.withColumn(name, RANKERS[ties]().over(w)).where(F.col(name) <= k)
    return r if out else r.drop(name)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
