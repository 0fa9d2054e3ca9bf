"""App-log transaction facts J-20..J-26.

Each job is the reference's daily load for ``day``; ``day=None`` runs every landed day
at once with the same answer as running the days one by one (windows partition by
``dt`` as well as by device).  The province lookup is a broadcast of a fixed
geography list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import local_time
from ..operators.sessions import first_per_group, sessionize

COMMON = [("ar", "area_code"), ("ba", "brand"), ("ch", "channel"), ("is_new", "is_new"), ("md", "model"),
          ("mid", "mid_id"), ("os", "operate_system"), ("uid", "user_id"), ("vc", "version_code")]
PAGE = [("during_time", "during_time"), ("item", "page_item"), ("item_type", "page_item_type"),
        ("last_page_id", "last_page_id"), ("page_id", "page_id"), ("source_type", "source_type")]
DEVICE_OUT = ["province_id", "brand", "channel", "is_new", "model", "mid_id", "operate_system", "user_id",
              "version_code"]
PAGE_OUT = ["page_item", "page_item_type", "last_page_id", "page_id", "source_type"]


def _day(log: DataFrame, day: str | None) -> DataFrame:
    return log if day is None else log.where(F.col("dt") == day)


def _flat(log: DataFrame, page: bool = True) -> list:
    cols = [F.col(f"common.{a}").alias(b) for a, b in COMMON]
    if page:
        cols += [F.col(f"page.{a}").alias(b) for a, b in PAGE]
    return cols


def _province(df: DataFrame, province: DataFrame, how: str = "left") -> DataFrame:
    p = province.select(F.col("id").alias("province_id"), F.col("area_code").alias("_ac"))
    return df.join(p, df.area_code == p._ac, how).drop("_ac")


# J-20
def page_view(log: DataFrame, province: DataFrame, day: str | None = None, rows: int | None = None) -> DataFrame:
    """Page views with their session; ``ts`` (milliseconds) and ``event_id`` stay with them, for
    ``view_time`` has seconds only and does not order the pages of one second.  ``rows``: a bound on the log's rows."""
    x = _day(log, day).where(F.col("page").isNotNull()).select(*_flat(log), "ts", "event_id", "dt")
    x = sessionize(x, "mid_id", "ts", F.col("last_page_id").isNull(), part=("dt",), tie=("event_id",), rows=rows)
    x = _province(x, province)
    return x.select(*DEVICE_OUT, *PAGE_OUT,
                    local_time("ts", "yyyy-MM-dd").alias("date_id"),
                    local_time("ts").alias("view_time"),
                    "session_id", "during_time", "ts", "event_id", "dt")


# J-21
def app_start(log: DataFrame, province: DataFrame, day: str | None = None) -> DataFrame:
    x = _day(log, day).where(F.col("start").isNotNull()).select(
        *_flat(log, page=False), F.col("start.entry").alias("entry"),
        F.col("start.loading_time").alias("loading_time_ms"), F.col("start.open_ad_id").alias("open_ad_id"),
        F.col("start.open_ad_ms").alias("open_ad_ms"), F.col("start.open_ad_skip_ms").alias("open_ad_skip_ms"),
        "ts", "dt")
    x = _province(x, province)
    return x.select(*DEVICE_OUT, "entry", "open_ad_id", local_time("ts", "yyyy-MM-dd").alias("date_id"),
                    local_time("ts").alias("start_time"), "loading_time_ms", "open_ad_ms", "open_ad_skip_ms", "dt")


# J-22
def action(log: DataFrame, province: DataFrame, day: str | None = None) -> DataFrame:
    x = (_day(log, day).where(F.col("page").isNotNull() & F.col("actions").isNotNull())
         .select(*_flat(log), F.explode("actions").alias("a"), "dt"))
    x = _province(x, province)
    return x.select(*DEVICE_OUT, "during_time", *PAGE_OUT,
                    F.col("a.action_id").alias("action_id"), F.col("a.item").alias("action_item"),
                    F.col("a.item_type").alias("action_item_type"),
                    local_time("a.ts", "yyyy-MM-dd").alias("date_id"), local_time("a.ts").alias("action_time"), "dt")


# J-23
def display(log: DataFrame, province: DataFrame, day: str | None = None) -> DataFrame:
    x = (_day(log, day).where(F.col("page").isNotNull() & F.col("displays").isNotNull())
         .select(*_flat(log), F.explode("displays").alias("d"), "ts", "dt"))
    x = _province(x, province)
    return x.select(*DEVICE_OUT, "during_time", *PAGE_OUT,
                    local_time("ts", "yyyy-MM-dd").alias("date_id"), local_time("ts").alias("display_time"),
                    F.col("d.display_type").alias("display_type"), F.col("d.item").alias("display_item"),
                    F.col("d.item_type").alias("display_item_type"), F.col("d.order").alias("display_order"),
                    F.col("d.pos_id").alias("display_pos_id"), "dt")


# J-24
def error(log: DataFrame, province: DataFrame, day: str | None = None) -> DataFrame:
    x = _day(log, day).where(F.col("err").isNotNull()).select(
        *_flat(log), F.col("start.entry").alias("entry"), F.col("start.loading_time").alias("loading_time"),
        F.col("start.open_ad_id").alias("open_ad_id"), F.col("start.open_ad_ms").alias("open_ad_ms"),
        F.col("start.open_ad_skip_ms").alias("open_ad_skip_ms"), "actions", "displays",
        F.col("err.error_code").alias("error_code"), F.col("err.msg").alias("error_msg"), "ts", "dt")
    x = _province(x, province, "inner")  # the reference drops rows without a province here
    return x.select(*DEVICE_OUT, *PAGE_OUT, "entry", "loading_time", "open_ad_id", "open_ad_ms",
                    "open_ad_skip_ms", "actions", "displays", local_time("ts", "yyyy-MM-dd").alias("date_id"),
                    local_time("ts").alias("error_time"), "error_code", "error_msg", "dt")


# J-25
def user_register(user_inc: DataFrame, log: DataFrame, province: DataFrame, day: str | None = None,
                  register_page: str = "signup") -> DataFrame:
    ui = _day(user_inc, day).where(F.col("type") == "insert").select(
        F.col("data.id").alias("user_id"), F.col("data.create_time").alias("create_time"), "dt")
    lg = (_day(log, day).where((F.col("page.page_id") == register_page) & F.col("common.uid").isNotNull())
          .select(F.col("common.ar").alias("area_code"), F.col("common.ba").alias("brand"),
                  F.col("common.ch").alias("channel"), F.col("common.md").alias("model"),
                  F.col("common.mid").alias("mid_id"), F.col("common.os").alias("operate_system"),
                  F.col("common.uid").cast("bigint").alias("_uid"), F.col("common.vc").alias("version_code"),
                  F.col("dt").alias("_ldt")))
    j = ui.join(lg, (ui.user_id == lg._uid) & (ui.dt == lg._ldt), "left")
    j = _province(j, province)
    return j.select("user_id", F.date_format("create_time", "yyyy-MM-dd").alias("date_id"), "create_time",
                    "channel", "province_id", "version_code", "mid_id", "brand", "model", "operate_system", "dt")


# J-26
def user_login(log: DataFrame, province: DataFrame, day: str | None = None, rows: int | None = None) -> DataFrame:
    x = _day(log, day).where(F.col("page").isNotNull()).select(
        F.col("common.uid").alias("user_id"), F.col("common.ch").alias("channel"),
        F.col("common.ar").alias("area_code"), F.col("common.vc").alias("version_code"),
        F.col("common.mid").alias("mid_id"), F.col("common.ba").alias("brand"), F.col("common.md").alias("model"),
        F.col("common.os").alias("operate_system"), "ts", "event_id", F.col("page.last_page_id").alias("last_page_id"), "dt")
    x = sessionize(x, "mid_id", "ts", F.col("last_page_id").isNull(), part=("dt",), tie=("event_id",), rows=rows)
    # rows before a device's first session start have no session: left out
    x = x.where(F.col("user_id").isNotNull() & F.col("session_id").isNotNull())
    cols = ["user_id", "channel", "area_code", "version_code", "mid_id", "brand", "model", "operate_system"]
    first = first_per_group(x, ["dt", "session_id"], ["ts"], ["ts", *cols])
    first = _province(first, province)
    return first.select("user_id", local_time("ts", "yyyy-MM-dd").alias("date_id"),
                        local_time("ts").alias("login_time"), "channel", "province_id", "version_code",
                        "mid_id", "brand", "model", "operate_system", "dt")
