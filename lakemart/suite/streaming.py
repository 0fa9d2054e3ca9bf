"""Registered streaming query: the cart-add fact (J-08) loaded incrementally."""

from __future__ import annotations

from .. import schemas
from ..oracle.domain import CTES  # noqa: F401
from ..plans import facts_trade as T
from ..registry import ORACLE, register
from ..sinks import writers as K
from ..sources import domain as D
from ..sources.dictionary import dictionary
from ..sources.driver import Driver
from ..streaming.ingest import landing_stream, run_fact_stream


@register("stream_cart_add")
def q_stream_cart_add(spark, sf):
    """J-08 on a file stream: cart CDC landed as JSON per day, consumed with
    ``availableNow``, appended through the exactly-once file sink, read back.  Must
    equal the batch load (same oracle)."""
    landing = K.shared_path(spark, "landing", "cart_inc")
    D.cart_inc(Driver(spark, sf)).write.mode("overwrite").partitionBy("dt").json(landing)
    out = K.shared_path(spark, "facts", "cart_add")
    dic = dictionary(spark)
    run_fact_stream(landing_stream(spark, landing, schemas.CART_INC_WITH_DT, max_files_per_trigger=8),
                    lambda s: T.cart_add(s, dic), out, K.shared_path(spark, "checkpoints", "cart_add"))
    return spark.read.parquet(out).select("id", "user_id", "sku_id", "date_id", "create_time", "source_id",
                                          "source_type_code", "source_type_name", "sku_num", "dt")


def _share_oracle():
    from . import facts  # noqa: F401
    ORACLE["stream_cart_add"] = ORACLE["fact_cart_add"]


_share_oracle()
