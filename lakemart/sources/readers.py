"""Readers for landed files (S-01..S-11).  Every reader takes an explicit schema:
nothing is inferred, JSON fields bind by name and absent fields read as NULL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import add_days


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """S-01 JSON lines."""
    return spark.read.schema(schema).json(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = "\t",
                   null_as_empty: bool = True) -> DataFrame:
    """S-02 delimited text (tab or comma); S-03 an empty field is NULL."""
    r = spark.read.schema(schema).option("sep", sep).option("header", "false").option("mode", "PERMISSIVE")
    if null_as_empty:
        r = r.option("nullValue", "").option("emptyValue", "")
    return r.csv(path)


def read_nested_text(spark: SparkSession, path: str, fields: list[tuple[str, str]], sep: str = ",",
                     items: str = "_", keys: str = ":") -> DataFrame:
    """S-04 nested types in delimited text.  ``fields`` is ``[(name, kind)]`` with kind
    ``string`` | ``array`` | ``map<int>`` | ``map`` | ``struct:a,b``; the CSV reader has
    no nested types, so columns are read as text and rebuilt with built-in functions
    (``split``, ``str_to_map``, ``struct``)."""
    raw = read_delimited(spark, path, ", ".join(f"`{n}` string" for n, _ in fields), sep, null_as_empty=True)
    cols = []
    for n, kind in fields:
        c = F.col(n)
        if kind == "array":
            cols.append(F.split(c, _re(items)).alias(n))
        elif kind.startswith("map"):
            m = F.str_to_map(c, F.lit(_re(items)), F.lit(_re(keys)))
            if kind == "map<int>":
                m = F.transform_values(m, lambda _k, v: v.cast("int"))
            cols.append(m.alias(n))
        elif kind.startswith("struct:"):
            parts = F.split(c, _re(items))
            names = kind.split(":", 1)[1].split(",")
            cols.append(F.struct(*[parts.getItem(i).alias(x) for i, x in enumerate(names)]).alias(n))
        else:
            cols.append(c.alias(n))
    return raw.select(*cols)


def _re(sep: str) -> str:
    return "\\" + sep if sep in ".|*+?^$()[]{}\\" else sep


def read_orc(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """S-05 ORC (vectorised reader, predicate pushdown)."""
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.orc(path)


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """S-06 Parquet."""
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.parquet(path)


def scan_partition(df: DataFrame, day: str, col: str = "dt") -> DataFrame:
    """S-07 one day (partition pruning on a literal)."""
    return df.where(F.col(col) == F.lit(day))


def scan_range(df: DataFrame, lo: str, hi: str, col: str = "dt") -> DataFrame:
    """S-08 a day range; bounds are literal strings so they stay partition filters."""
    return df.where((F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi)))


def scan_days(df: DataFrame, days: Iterable[str], col: str = "dt") -> DataFrame:
    """S-09 a set of days (D and D-1)."""
    return df.where(F.col(col).isin(*list(days)))


def scan_previous(df: DataFrame, day: str, col: str = "dt") -> DataFrame:
    """S-10 yesterday's state."""
    return scan_partition(df, add_days(day, -1), col)


def latest_partition(spark: SparkSession, table: str, day: str | None = None) -> str | None:
    """The greatest partition of a catalog table partitioned by one text column, at or before ``day``: from the catalog's
    list, without reading any data."""
    value = F.regexp_extract("partition", "=(.*)$", 1)
    found = spark.sql(f"SHOW PARTITIONS {table}").select(value.alias("v"))
    return (found if day is None else found.where(F.col("v") <= day)).agg(F.max("v")).first()[0]


def scan_latest(spark: SparkSession, table: str, day: str | None = None, col: str = "dt") -> DataFrame:
    """S-10 the rows of the latest partition at or before ``day``; none if there is no such partition."""
    found = latest_partition(spark, table, day)
    return spark.table(table).where(F.lit(False) if found is None else F.col(col) == F.lit(found))


def sample_bucket(spark: SparkSession, table: str, x: int) -> DataFrame:
    """P-14 ``tablesample (bucket x out of n)`` of a table written by ``create_sampled``: its files alone."""
    return spark.table(table).where(F.col("_bucket") == x - 1).drop("_bucket")


def select_star(spark: SparkSession, table: str) -> DataFrame:
    """S-11 whole-table read."""
    return spark.table(table)
