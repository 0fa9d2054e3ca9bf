"""Scalar helpers (F-01..F-21) as Column expressions.

All of them are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import LOCAL_TZ

MONEY = "decimal(16,2)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """DECIMAL(16,2), the declared money type."""
    return col(c).cast(MONEY)


def nvl0(c) -> Column:
    """F-12 ``nvl(x, 0)`` keeping the column type."""
    return F.coalesce(col(c), F.lit(0))


def ratio(num, den, scale: str = MONEY) -> Column:
    """A-13 ``cast(a / b as decimal(16,2))``; NULL on a zero denominator (Hive's answer)."""
    return F.try_divide(col(num), col(den)).cast(scale)


def epoch_ms(ts) -> Column:
    """Epoch milliseconds of a timestamp (sub-ms digits dropped)."""
    return F.floor(F.unix_micros(col(ts).cast("timestamp")) / F.lit(1000)).cast("bigint")


def local_time(ms, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """F-07 + F-06: epoch ms -> wall time in the log's zone, formatted."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(col(ms)), LOCAL_TZ), fmt)


def local_time_s(sec, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """CDC ``ts`` is in seconds: ``from_utc_timestamp(ts*1000, ...)``."""
    return local_time(col(sec) * F.lit(1000), fmt)


def day_of(ts) -> Column:
    """yyyy-MM-dd text of a timestamp or date string."""
    return F.date_format(col(ts), "yyyy-MM-dd")


def add_days(day: str, n: int) -> str:
    """F-08 folded on the driver: literal day arithmetic, so partition filters stay plain."""
    return (_dt.date.fromisoformat(day) + _dt.timedelta(days=n)).isoformat()


def day_bounds(day: str, days: int) -> tuple[str, str]:
    """Inclusive ``[D-days+1, D]`` window (S-08)."""
    return add_days(day, -(days - 1)), day


def mask(c) -> Column:
    """F-05 one-way masking of PII."""
    return F.md5(col(c).cast("string"))


def benefit_rule_coupon(kind, cond_amount, cond_num, benefit_amount, benefit_discount) -> Column:
    """F-14/F-01 coupon benefit text: ``case`` without ``else`` gives NULL."""
    k = col(kind)
    return (F.when(k == "3201", F.concat(F.lit("满"), col(cond_amount).cast("string"), F.lit("元减"),
                                         col(benefit_amount).cast("string"), F.lit("元")))
            .when(k == "3202", F.concat(F.lit("满"), col(cond_num).cast("string"), F.lit("件打"),
                                        (F.lit(10) * (F.lit(1) - col(benefit_discount))).cast("string"), F.lit("折")))
            .when(k == "3203", F.concat(F.lit("减"), col(benefit_amount).cast("string"), F.lit("元"))))


def benefit_rule_activity(kind, cond_amount, cond_num, benefit_amount, benefit_discount) -> Column:
    k = col(kind)
    return (F.when(k == "3101", F.concat(F.lit("满"), col(cond_amount).cast("string"), F.lit("元减"),
                                         col(benefit_amount).cast("string"), F.lit("元")))
            .when(k == "3102", F.concat(F.lit("满"), col(cond_num).cast("string"), F.lit("件打"),
                                        (F.lit(10) * (F.lit(1) - col(benefit_discount))).cast("string"), F.lit("折")))
            .when(k == "3103", F.concat(F.lit("打"),
                                        (F.lit(10) * (F.lit(1) - col(benefit_discount))).cast("string"), F.lit("折"))))
