"""Declared schemas of landed tables (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, LongType, MapType, StringType, StructField, StructType)

S, L = StringType(), LongType()


def _struct(*fields):
    return StructType([StructField(n, t) for n, t in fields])


# App log line (one page or start event per JSON line).
LOG = _struct(
    ("common", _struct(*[(n, S) for n in ("ar", "ba", "ch", "is_new", "md", "mid", "os", "uid", "vc")])),
    ("page", _struct(("during_time", L), ("item", S), ("item_type", S), ("last_page_id", S), ("page_id", S),
                     ("source_type", S))),
    ("actions", ArrayType(_struct(("action_id", S), ("item", S), ("item_type", S), ("ts", L)))),
    ("displays", ArrayType(_struct(("display_type", S), ("item", S), ("item_type", S), ("order", S), ("pos_id", S)))),
    ("start", _struct(("entry", S), ("loading_time", L), ("open_ad_id", L), ("open_ad_ms", L), ("open_ad_skip_ms", L))),
    ("err", _struct(("error_code", L), ("msg", S))),
    ("ts", L),
)
LOG_WITH_DT = StructType(LOG.fields + [StructField("dt", S)])

# CDC envelope around a table's row struct.
def cdc(data: StructType) -> StructType:
    return _struct(("type", S), ("ts", L), ("data", data), ("old", MapType(S, S)))


ORDER_INFO = "order_id bigint, user_id bigint, province_id int, order_status string, payment_type string, " \
             "total_amount decimal(16,2), create_time string, dt string"
BUSINESS = "name string, orderdate string, cost int"
EMP = "empno int, ename string, job string, mgr int, hiredate string, sal double, comm double, deptno int"

CART_DATA = _struct(("id", L), ("user_id", L), ("sku_id", L), ("sku_num", L), ("source_id", L), ("source_type", S))
CART_INC_WITH_DT = StructType(cdc(CART_DATA).fields + [StructField("dt", S)])
