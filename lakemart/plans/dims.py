"""Dimensions J-01..J-07.

The snowflake joins of J-01 are chained left joins over small dimension snapshots;
the attribute sets are built by ``collect_set`` over *distinct* (sku, attribute) pairs
and sorted, so the set is deterministic and never larger than the distinct pairs.
The SCD2 merge (J-07) left-joins the open rows to the ids that changed; each fans out to one
output row, kept or closed yesterday, through a single ``explode``, and the day's newest
changes are added as the new open rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import OPEN_END
from ..functions.scalar import add_days, benefit_rule_activity, benefit_rule_coupon, mask
from ..operators.cdc import cdc_rows, decode
from ..operators.sessions import last_per_group


# J-01
def dim_sku(sku, spu, c3, c2, c1, tm, attr, sale_attr) -> DataFrame:
    attrs = (attr.select("sku_id", "attr_id", "value_id", "attr_name", "value_name").distinct()
             .groupBy("sku_id")
             .agg(F.sort_array(F.collect_set(F.struct("attr_id", "value_id", "attr_name", "value_name")))
                  .alias("sku_attr_values")))
    sales = (sale_attr.select("sku_id", "sale_attr_id", "sale_attr_value_id", "sale_attr_name",
                              "sale_attr_value_name").distinct()
             .groupBy("sku_id")
             .agg(F.sort_array(F.collect_set(F.struct("sale_attr_id", "sale_attr_value_id", "sale_attr_name",
                                                      "sale_attr_value_name"))).alias("sku_sale_attr_values")))
    s = sku.alias("sku")
    j = (s.join(spu.select(F.col("id").alias("_spu"), "spu_name"), F.col("sku.spu_id") == F.col("_spu"), "left")
         .join(c3.select(F.col("id").alias("_c3"), F.col("name").alias("category3_name"), "category2_id"),
               F.col("sku.category3_id") == F.col("_c3"), "left")
         .join(c2.select(F.col("id").alias("_c2"), F.col("name").alias("category2_name"), "category1_id"),
               F.col("category2_id") == F.col("_c2"), "left")
         .join(c1.select(F.col("id").alias("_c1"), F.col("name").alias("category1_name")),
               F.col("category1_id") == F.col("_c1"), "left")
         .join(tm.select(F.col("id").alias("_tm"), "tm_name"), F.col("sku.tm_id") == F.col("_tm"), "left")
         .join(attrs, F.col("sku.id") == attrs.sku_id, "left")
         .join(sales, F.col("sku.id") == sales.sku_id, "left"))
    return j.select(F.col("sku.id").alias("id"), "price", "sku_name", "sku_desc", "weight",
                    (F.col("is_sale") == "1").alias("is_sale"), "spu_id", "spu_name",
                    F.col("sku.category3_id").alias("category3_id"), "category3_name", "category2_id", "category2_name",
                    "category1_id", "category1_name", F.col("sku.tm_id").alias("tm_id"), "tm_name",
                    "sku_attr_values", "sku_sale_attr_values", "create_time")


# J-02
def dim_coupon(coupon: DataFrame, dic: DataFrame) -> DataFrame:
    x = decode(coupon, "coupon_type", dic, "32", "coupon_type_name")
    x = decode(x, "range_type", dic, "33", "range_type_name")
    return x.select("id", "coupon_name", F.col("coupon_type").alias("coupon_type_code"), "coupon_type_name",
                    "condition_amount", "condition_num", "activity_id", "benefit_amount", "benefit_discount",
                    benefit_rule_coupon("coupon_type", "condition_amount", "condition_num", "benefit_amount",
                                        "benefit_discount").alias("benefit_rule"),
                    "create_time", F.col("range_type").alias("range_type_code"), "range_type_name", "limit_num",
                    "taken_count", "start_time", "end_time", "operate_time", "expire_time")


# J-03
def dim_activity(rule: DataFrame, info: DataFrame, dic: DataFrame) -> DataFrame:
    i = info.select(F.col("id").alias("_aid"), "activity_name", "activity_desc", "start_time", "end_time",
                    "create_time")
    x = rule.join(i, rule.activity_id == i._aid, "left")
    x = decode(x, "activity_type", dic, "31", "activity_type_name")
    return x.select(F.col("id").alias("activity_rule_id"), "activity_id", "activity_name",
                    F.col("activity_type").alias("activity_type_code"), "activity_type_name", "activity_desc",
                    "start_time", "end_time", "create_time", "condition_amount", "condition_num", "benefit_amount",
                    "benefit_discount",
                    benefit_rule_activity("activity_type", "condition_amount", "condition_num", "benefit_amount",
                                          "benefit_discount").alias("benefit_rule"), "benefit_level")


# J-04
def dim_province(province: DataFrame, region: DataFrame) -> DataFrame:
    r = region.select(F.col("id").alias("_rid"), "region_name")
    j = province.join(r, province.region_id == r._rid, "left")
    return j.select("id", F.col("name").alias("province_name"), "area_code", "iso_code", "iso_3166_2", "region_id",
                    "region_name")


# J-05
def dim_date(seed: DataFrame) -> DataFrame:
    return seed.select("date_id", "week_id", "week_day", "day", "month", "quarter", "year", "is_workday",
                       "holiday_id")


ZIP = ["id", "login_name", "nick_name", "name", "phone_num", "email", "user_level", "birthday", "gender",
       "create_time", "operate_time"]
PII = {"name", "phone_num", "email"}


def _user_cols(prefix: str = "data."):
    return [(mask(f"{prefix}{c}") if c in PII else F.col(f"{prefix}{c}")).alias(c) for c in ZIP]


# J-06
def user_zip_init(user_inc: DataFrame, day: str) -> DataFrame:
    x = cdc_rows(user_inc, day, ("bootstrap-insert",))
    return x.select(*_user_cols(), F.lit(day).alias("start_date"), F.lit(OPEN_END).alias("end_date"),
                    F.lit(OPEN_END).alias("dt"))


# J-07
def user_zip_apply(open_rows: DataFrame, user_inc: DataFrame, day: str) -> DataFrame:
    """Newest change per user on ``day`` (max-struct aggregate, W-01); open rows of
    changed users are closed on ``day-1``, the changes become the new open rows, all
    other open rows pass through.

    Same answer as the full outer join of open rows with changes, but the dimension is
    only *left*-joined to the set of changed ids: when a day's changes are small AQE
    broadcasts them and the (large) dimension is never shuffled; otherwise it falls
    back to a sort-merge join.  One scan of the open rows feeds both the kept and the
    closed output through a single ``explode``."""
    changes = user_inc.where(F.col("dt") == day).select("ts", "data", F.col("data.id").alias("_k"))
    newest = last_per_group(changes, ["_k"], ["ts"], ["data"])
    cols = ZIP + ["start_date", "end_date"]
    current_new = newest.select(*_user_cols(), F.lit(day).alias("start_date"), F.lit(OPEN_END).alias("end_date"),
                                F.lit(OPEN_END).alias("dt"))
    changed = newest.select(F.col("_k").alias("_chg_id"))
    j = open_rows.join(changed, open_rows.id == changed._chg_id, "left")
    closed_day = add_days(day, -1)
    keep = F.when(F.col("_chg_id").isNull(), F.struct(*[F.col(c).alias(c) for c in cols],
                                                      F.lit(OPEN_END).alias("dt")))
    closed = F.when(F.col("_chg_id").isNotNull(), F.struct(
        *[F.col(c).alias(c) for c in ZIP], F.col("start_date").alias("start_date"),
        F.lit(closed_day).alias("end_date"), F.lit(closed_day).alias("dt")))
    old = j.select(F.explode(F.array(keep, closed)).alias("r")).where(F.col("r").isNotNull()).select("r.*")
    return old.unionByName(current_new)
