"""Day-by-day materialisation of the trade layers (the production path).

Each layer is a ``dt``-partitioned Parquet folder in a shared location.  A daily run
for day D replaces exactly the partition ``dt=D`` (also with nothing: a rerun that yields
no rows empties the day), the first load replaces the whole layer, and both read only
the partitions they need:

    detail(D), refund(D)            <- landed rows of day D (pushed-down day bounds)
    order_1d(D), refund_1d(D)       <- detail(D) / refund(D) ⋈ sku   (aggregate first)
    order_nd(D), refund_nd(D)       <- 1d(D-29..D)                    (literal partition bounds)
    report_by_brand[dt=D] = rows(D) <- 1d(D), nd(D)                   (partition replace, idempotent)
    page_view(D), login(D)          <- app log of day D
    session_1d(D), login_td(D)      <- page_view(D) / login_td(D-1) ⊕ login(D)
    user[open], user[D-1]           <- user[open] ⊕ user changes of D (staged, then replaced)
    log reports[dt=D]               <- session_1d, page_view (D-29..D), login_td (D-1, D)

At 100 TB this is what keeps a daily job proportional to one day of data instead of
the whole history: every read above is a partition-pruned scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import OPEN_END
from ..functions.scalar import add_days
from ..operators.distinct import number_ids
from ..sinks.publish import Published
from ..sinks.writers import partition_layout
from ..sources import domain as D
from ..sources.driver import Driver
from . import dims as DM
from . import facts_log as L
from . import reports as P
from . import rollups as R


@dataclass
class Layers:
    spark: SparkSession
    base: str

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    def write(self, df: DataFrame, name: str, day: str | None) -> None:
        """Replace the partition ``dt=day`` by the rows of ``df`` (all of that day), or with
        ``day`` None the whole layer.  A static overwrite: what is not written again is gone."""
        if day is None:
            x, path = partition_layout(df, ["dt"]).write.partitionBy("dt"), self.path(name)
        else:
            x, path = df.where(F.col("dt") == F.lit(day)).drop("dt").hint("rebalance").write, f"{self.path(name)}/dt={day}"
        x.option("partitionOverwriteMode", "static").mode("overwrite").parquet(path)

    def read(self, name: str, schema, lo: str, hi: str) -> DataFrame:
        df = self.spark.read.schema(schema).parquet(self.path(name))
        return df.where((F.col("dt") >= F.lit(lo)) & (F.col("dt") <= F.lit(hi)))


def load_day(layers: Layers, drv: Driver, day: str, first: bool = False) -> DataFrame:
    """Run the trade layers for ``day``; ``first=True`` is the first-day load that
    fills every earlier partition of the 1-day layers from the whole history."""
    lo = None if first else day
    sku = D.sku(drv)
    detail = D.order_detail(drv, lo, day)
    refund = D.refund_info(drv, lo, day)
    own = None if first else day
    layers.write(detail, "dwd_order_detail", own)
    layers.write(refund, "dwd_order_refund", own)
    det_schema, ref_schema = detail.schema, refund.schema
    detail = layers.read("dwd_order_detail", det_schema, lo or "0000-00-00", day)
    refund = layers.read("dwd_order_refund", ref_schema, lo or "0000-00-00", day)
    od1d = R.user_sku_order_1d(detail, sku)
    rf1d = R.user_sku_refund_1d(refund, sku)
    layers.write(od1d, "dws_user_sku_order_1d", own)
    layers.write(rf1d, "dws_user_sku_refund_1d", own)
    lo30 = add_days(day, -29)
    od1d = layers.read("dws_user_sku_order_1d", od1d.schema, lo30, day)
    rf1d = layers.read("dws_user_sku_refund_1d", rf1d.schema, lo30, day)
    states = {}
    layers.write(R.user_sku_order_nd(od1d, day), "dws_user_sku_order_nd", day)
    layers.write(R.user_sku_refund_nd(rf1d, day), "dws_user_sku_refund_nd", day)
    for name, src, count in (("dws_brand_buyers_1d", od1d, "order_count_1d"), ("dws_brand_refunders_1d", rf1d, "order_refund_count_1d")):
        state = P.buyer_sets(src if first else src.where(F.col("dt") == day), P.BRAND, count)
        layers.write(state, name, own)
        states[name] = layers.read(name, state.schema, lo30, day)
    rows = P.trade_by_brand(*states.values(), day)
    return append_report(layers, rows, "ads_trade_stats_by_tm", day)


def append_report(layers: Layers, rows: DataFrame, name: str, day: str) -> DataFrame:
    """Report rows are keyed by their stat day, so the report folder is partitioned by
    ``dt`` and a day's load replaces exactly its own partition (other days untouched, a
    rerun is idempotent)."""
    layers.write(rows, name, day)
    return layers.spark.read.schema(rows.schema).parquet(layers.path(name))


def load_log_day(layers: Layers, drv: Driver, day: str, first: bool = False) -> dict[str, DataFrame]:
    """Run the app-log layers and their reports for ``day``; ``first=True`` fills every earlier
    day of the log facts and starts the to-date login state.  Returns the report tables."""
    lo, own = (None, None) if first else (day, day)
    log, province = D.page_log(drv, lo, day), D.province(drv)
    views = L.page_view(log, province)
    logins = L.user_login(log, province).withColumn("user_id", F.col("user_id").cast("bigint"))
    layers.write(views, "dwd_page_view", own)
    layers.write(logins, "dwd_user_login", own)
    since = lo or "0000-00-00"
    sessions = R.session_page_view_1d(layers.read("dwd_page_view", views.schema, since, day))
    layers.write(sessions, "dws_session_page_view_1d", own)
    login = layers.read("dwd_user_login", logins.schema, since, day)
    state = R.user_login_td_first(D.users(drv), login, day)
    before = layers.read("dws_user_login_td", state.schema, add_days(day, -1), add_days(day, -1)) if not first else None
    layers.write(state if before is None else R.user_login_td_step(before.drop("dt"), login, day), "dws_user_login_td", day)
    state = layers.read("dws_user_login_td", state.schema, day, day)
    month = add_days(day, -29)
    registered = R.registrations(D.user_inc(drv, day))
    visits = layers.read("dws_session_page_view_1d", sessions.schema, since, day)
    # devices that are new today get the next numbers; a rerun of the day finds the same ones
    known = None if first else layers.read("dim_device", "mid_id string, pos long, dt string", "0000-00-00", add_days(day, -1)).drop("dt")
    ids = number_ids(visits, "mid_id", known)
    layers.write((ids if known is None else ids.join(known, "mid_id", "left_anti")).withColumn("dt", F.lit(day)), "dim_device", day)
    state_1d = P.visitor_sets(visits, layers.read("dim_device", "mid_id string, pos long, dt string", "0000-00-00", day).drop("dt"))
    layers.write(state_1d, "dws_channel_visitors_1d", own)
    rows = {"ads_traffic_by_channel": P.traffic_report(layers.read("dws_channel_visitors_1d", state_1d.schema, month, day), day),
            "ads_page_path": P.page_path(layers.read("dwd_page_view", views.schema, month, day), day),
            "ads_user_retention": P.retention(registered, state, day), "ads_user_stats": P.user_stats(state, registered, day)}
    if before is not None:
        rows["ads_user_change"] = P.user_change(state, before, day)
    return {name: append_report(layers, x, name, day) for name, x in rows.items()}


def load_user_day(layers: Layers, drv: Driver, day: str, first: bool = False) -> DataFrame:
    """The slowly changing user dimension: open rows in the partition ``OPEN_END``, rows closed
    on day D-1 in that day's.  Both are published in one step, from the version before day D: a load lost anywhere leaves
    that version, and a rerun, also of a day that is loaded already, gives the same rows."""
    changes = D.user_inc(drv, day if not first else add_days(day, 1))
    init = DM.user_zip_init(changes, day)
    users = Published(layers.spark, layers.path("dim_user"), init.schema)
    if first:
        users.publish(init, replaced=users.folders(), tag=day)
    else:
        before = users.before(day)
        rows = DM.user_zip_apply(users.read(before, [OPEN_END]).drop("dt"), changes, day)
        users.publish(rows, replaced=[OPEN_END, add_days(day, -1)], tag=day, onto=before)
    return users.read()
