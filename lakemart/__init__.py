"""lakemart: a layered retail data warehouse written as Spark DataFrame jobs.

Layers follow the usual warehouse split: landed rows (sources) -> dimensions and
transaction facts -> 1-day / n-day / to-date rollups -> report tables.  Every job is
a pure function ``(frames..., day) -> DataFrame``; only ``lakemart.sinks`` writes.
"""

__version__ = "0.1.0"
