"""To-date state as bucketed tables: a day's step joins state and increment without shuffling the state.

State(D-1) and the increment of day D are tables with the same buckets on the key, one file a bucket.  A full outer join of
the two reads bucket by bucket, so no row of either is exchanged; only the increment was shuffled, when it was aggregated and
written.  The joined rows are still dealt by bucket, so the new state is written without a shuffle, too.

Every day's state is a table of its own (``name_D``): a lost step leaves the day before as it was, and a rerun starts from it.
A key is one row, so no key is hot; NULL keys share one bucket (they never match, as in the reference's join).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .writers import drop_table, shared_path


@dataclass
class BucketedState:
    spark: SparkSession
    name: str
    key: str
    buckets: int

    def table(self, day: str) -> str:
        return f"{self.name}_{day.replace('-', '')}"

    def write(self, df: DataFrame, day: str, dealt: bool = False, sub: str = "") -> DataFrame:
        """Replace the day's table; ``dealt``: the rows lie by bucket already (a join of two such tables)."""
        t = self.table(day) + sub
        x = df if dealt else df.repartition(self.buckets, self.key)
        drop_table(self.spark, t)
        (x.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
         .option("path", shared_path(self.spark, "state", t)).saveAsTable(t))
        return self.spark.table(t)

    def read(self, day: str) -> DataFrame:
        return self.spark.table(self.table(day))

    def joined(self, prev: str, today: DataFrame, day: str, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """``step(state(prev), increment)``, both bucketed: the plan has no exchange below its join."""
        return step(self.read(prev), self.write(today, day, sub="_inc"))

    def advance(self, prev: str, today: DataFrame, day: str, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """The step's result as the state of ``day``, again bucketed."""
        return self.write(self.joined(prev, today, day, step), day, dealt=True)


def compare(one: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Two states on their key, columns of ``other`` named ``prev_*``: both lie by bucket, so a merge join needs no exchange
    (neither side is small)."""
    named = other.select(F.col(key).alias("_key"), *[F.col(c).alias(f"prev_{c}") for c in other.columns if c != key])
    return one.hint("merge").join(named, F.col(key) == F.col("_key"), how).drop("_key")
