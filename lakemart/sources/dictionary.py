"""The code dictionary (ods_base_dic_full) as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.codes import DICTIONARY


def dictionary(spark: SparkSession) -> DataFrame:
    """A JVM-side VALUES relation (no Python serialisation; a tiny LocalRelation that
    broadcasts trivially)."""
    rows = ", ".join(f"('{c}', '{n}', '{p}')" for c, n, p in DICTIONARY)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS d(dic_code, dic_name, parent_code)")


def dictionary_sql() -> str:
    rows = ", ".join(f"('{c}', '{n}', '{p}')" for c, n, p in DICTIONARY)
    return f"select * from (values {rows}) d(dic_code, dic_name, parent_code)"
