"""Join helpers.

Only two decisions are made here; everything else is left to Catalyst/AQE:
* ``small_lookup`` broadcasts a side whose size is bounded by construction (a code
  dictionary, a top-n list); a 1-row aggregate is attached as a scalar subquery.  Data-sized sides are never hinted:
  AQE converts them to broadcast only when runtime statistics are below
  ``spark.sql.autoBroadcastJoinThreshold``.
* ``full_outer_coalesce`` is the reference's ``full outer join`` + ``nvl`` pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small_lookup(df: DataFrame) -> DataFrame:
    return F.broadcast(df)


def full_outer_coalesce(left: DataFrame, right: DataFrame, keys: Sequence[str],
                        defaults: dict[str, object] | None = None) -> DataFrame:
    """N-04: full outer on ``keys`` (plain ``=``, NULL keys never match), coalesced keys;
    measures keep their side's value, or ``defaults[col]`` when that side is missing."""
    defaults = defaults or {}
    l, r = left.alias("l"), right.alias("r")
    cond = None
    for k in keys:
        c = F.col(f"l.{k}") == F.col(f"r.{k}")
        cond = c if cond is None else cond & c
    j = l.join(r, cond, "full")
    out = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    for side, df in (("l", left), ("r", right)):
        for c in df.columns:
            if c in keys:
                continue
            e = F.col(f"{side}.{c}")
            if c in defaults:
                e = F.coalesce(e, F.lit(defaults[c]))
            out.append(e.alias(c))
    return j.select(*out)


def one_row_join(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """N-05 / W-07: attach the columns of a 1-row aggregate to every row.

    Each column becomes a scalar subquery (``DataFrame.scalar()``): the aggregate runs
    once as its own small job and its value is projected into the rows — no join, no
    nested loop, nothing broadcast."""
    out = df
    for c in one_row.columns:
        out = out.withColumn(c, one_row.select(c).scalar())
    return out


def null_safe_join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``other``, joined on equal keys where NULL equals NULL:
    for joining back an aggregate of ``df`` itself, whose every row has its group there."""
    named = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(named, cond).drop(*[f"_k_{k}" for k in keys])
