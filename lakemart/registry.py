"""Registry of named queries: Spark callable + DuckDB oracle SQL per SURVEY §2 key."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    """Decorator: ``@register("J-27 user_sku_order_1d"-key, oracle_sql)``."""

    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)  # UTC rendering, dynamic partition overwrite, AQE
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return deco


def load_all():
    # Import for side effects: each suite module registers its queries.
    import importlib
    for m in SUITES:
        importlib.import_module(f"{__package__}.suite.{m}")
    return QUERIES, ORACLE


SUITES = ("rollups", "facts", "facts_cdc", "reports", "dims", "worked", "primitives", "sinks", "streaming")
