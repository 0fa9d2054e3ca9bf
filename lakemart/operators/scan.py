"""Ordered windows per key as a segmented scan: no bucket from the caller, no task per key.

``sum(x) over (partition by k order by o)`` puts every row of a key into one task, and a key with a third of the rows makes
that task the job.  Here the rows are cut into range slices of (keys, order), each about ``SLICE_ROWS`` rows long, whatever
the keys are:

1. ``Cut`` takes bounds for the slices from a sample that Spark range-partitions (a few hundred rows a slice), and gives each
   row its slice by a binary search over them, so a row's slice depends on its values alone;
2. the window runs inside (keys, slice), one hash shuffle as for the plain window;
3. only the keys that a bound falls into go on in another slice.  Their state (sum, maximum, last row) is one row a slice;
   a window over these rows carries it across the borders, and it is joined back to the first rows concerned.

A frame of fewer than ``SLICE_ROWS`` rows is one slice, and the scan is the plain window.  ``order`` must tell the rows of a
key apart for ROWS frames; the rows that a RANGE frame treats as equal are summed up before the scan and joined back after
it, so equal rows need not fit a task either.  NULL keys are a key, NULL order values come first.  Orders are ascending, or
all descending (``desc``: then NULLs come last).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe_join

#: Rows of a slice on average, slices at most (beyond it they grow longer), and sampled rows for each slice.
SLICE_ROWS, MAX_SLICES, SAMPLED = 1 << 20, 1 << 14, 200


def bounds_of(df: DataFrame, columns: Sequence[str], rows: int) -> DataFrame | None:
    """The smallest sampled row of each slice but the first, ascending (at most ``MAX_SLICES`` rows, held by the driver as
    Spark's own range partitioner does); None where one slice holds everything."""
    n = min(MAX_SLICES, -(-rows // SLICE_ROWS))
    if n < 2:
        return None
    some = df.select(*columns)
    if rows > SAMPLED * n:
        some = some.sample(False, SAMPLED * n / rows, seed=11)
    ranged = some.repartitionByRange(n, *columns)
    least = ranged.groupBy(F.spark_partition_id().alias("_p")).agg(F.min(F.struct(*columns)).alias("_k")).orderBy("_p").collect()
    return df.sparkSession.createDataFrame([(r["_k"],) for r in least[1:]], _one("_k", df.select(F.struct(*columns)).schema[0].dataType)) if len(least) > 1 else None


def _one(name: str, kind):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(name, kind)])


class Cut:
    """``df`` cut into slices; ``x`` has the rows with their slice, to which the methods add columns.  ``rows`` is their number,
    or a bound on it (then slices are shorter); unless given, they are counted."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], desc: bool = False, rows: int | None = None):
        self.keys, self.order, self.desc = list(keys), list(order), desc
        columns = list(dict.fromkeys([*self.keys, *self.order]))
        bounds = bounds_of(df, columns, df.count() if rows is None else rows)
        self.n = 1 if bounds is None else bounds.count() + 1
        self.x = df.withColumn("_s", F.lit(0))
        if bounds is not None:
            held = bounds.agg(F.sort_array(F.collect_list("_k")).alias("_b")).scalar()
            row = F.struct(*columns)
            step = 1 << (self.n - 1).bit_length()
            while step := step >> 1:  # how many bounds are not above the row
                self.x = self.x.withColumn("_s", F.col("_s") + F.when(F.get(held, F.col("_s") + (step - 1)) <= row, step).otherwise(0))
            self.across = bounds.select(*[F.col(f"_k.{k}").alias(k) for k in self.keys]).distinct() if self.keys else None
        self.base = self.x

    def _sorted(self, back: bool = False) -> list[Column]:
        return [F.col(c).desc() if self.desc != back else F.col(c).asc() for c in self.order]

    def window(self):
        return Window.partitionBy(*self.keys, "_s").orderBy(*self._sorted())

    def carried(self, state: dict[str, Column], over: Callable[[Window], dict[str, Column]]) -> DataFrame:
        """A row for each slice of a key that lies in several: its ``state`` (aggregates), then ``over`` the key's slices in
        the scan's direction."""
        rows = self.base
        if self.across is not None:  # at most as many keys as bounds
            named = F.broadcast(self.across.select(*[F.col(k).alias(f"_a_{k}") for k in self.keys]))
            cond = F.lit(True)
            for k in self.keys:
                cond = cond & F.col(k).eqNullSafe(F.col(f"_a_{k}"))
            rows = rows.join(named, cond, "left_semi")
        per = rows.groupBy(*self.keys, "_s").agg(*[c.alias(n) for n, c in state.items()])
        # as many rows as slices and keys across them, however many rows the keys have
        w = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(F.col("_s").desc() if self.desc else F.col("_s"))
        return per.select(*self.keys, "_s", *[c.alias(n) for n, c in over(w).items()])

    def attach(self, carry: DataFrame) -> None:
        named = F.broadcast(carry.select(*[F.col(k).alias(f"_c_{k}") for k in [*self.keys, "_s"]], *carry.columns[len(self.keys) + 1:]))
        cond = F.col("_s") == F.col("_c__s")
        for k in self.keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        self.x = self.x.join(named, cond, "left").drop(*[f"_c_{k}" for k in [*self.keys, "_s"]])

    def running(self, value: str | Column, out: str, kind: str = "sum") -> None:
        """``sum`` / ``count`` / ``max`` / ``min`` of the key's rows up to this one."""
        value = F.col(value) if isinstance(value, str) else value
        func = getattr(F, kind)
        self.x = self.x.withColumn(out, func(value).over(self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        if self.n == 1:
            return
        merge = F.sum if kind == "count" else func
        self.attach(self.carried({"_t": func(value)}, lambda w: {"_carry": merge("_t").over(w.rowsBetween(Window.unboundedPreceding, -1))}))
        local, carry = F.col(out), F.col("_carry")
        total = {"max": F.greatest, "min": F.least}.get(kind, lambda a, b: F.coalesce(a + b, a, b))(local, carry)
        self.x = self.x.withColumn(out, total).drop("_carry")

    def shift(self, value: str, out: str, by: int = 1, default=None) -> None:
        """The value of the row before (``by`` 1) or after (-1); ``default`` only where there is no such row."""
        kind = self.base.schema[value].dataType
        func = F.lag if by > 0 else F.lead
        self.x = self.x.withColumn(out, func(F.struct(F.col(value).alias("v")), 1).over(self.window()))  # null: no such row here
        if self.n > 1:
            row = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(self.order)], F.col(value).alias("v"))
            edge = F.max(row) if (by > 0) != self.desc else F.min(row)  # the neighbour slice's row next to this one
            self.attach(self.carried({"_m": edge}, lambda w: {"_near": func(F.struct(F.col("_m.v").alias("v")), 1).over(w)}))
            self.x = self.x.withColumn(out, F.coalesce(out, "_near")).drop("_near")
        d = F.lit(default).cast(kind)
        self.x = self.x.withColumn(out, F.when(F.col(out).isNotNull(), F.col(f"{out}.v")).otherwise(d))

    def result(self) -> DataFrame:
        return self.x.drop("_s")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, kind: str = "sum", frame: str = "rows",
            desc: bool = False, rows: int | None = None) -> DataFrame:
    """``kind(value) over (partition by keys order by order)`` with a ROWS frame (unbounded preceding .. current row) or the
    default RANGE frame, where rows of equal order share the value."""
    if frame == "rows":
        cut = Cut(df, keys, order, desc, rows)
        cut.running(value, out, kind)
        return cut.result()
    # the peers are fewer than the rows: their number bounds the peers', without aggregating twice
    rows = df.count() if rows is None else rows
    columns = list(dict.fromkeys([*keys, *order]))
    peers = df.groupBy(*columns).agg(getattr(F, kind)(value).alias("_v"))
    scanned = running(peers, keys, order, "_v", out, "sum" if kind == "count" else kind, desc=desc, rows=rows).drop("_v")
    return null_safe_join(df, scanned, columns)


def lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, default=None) -> DataFrame:
    """``lag(value, 1, default) over (partition by keys order by order)``."""
    cut = Cut(df, keys, order)
    cut.shift(value, out, 1, default)
    return cut.result()


def lead(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, default=None) -> DataFrame:
    """``lead(value, 1, default) over (partition by keys order by order)``."""
    cut = Cut(df, keys, order)
    cut.shift(value, out, -1, default)
    return cut.result()


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, desc: bool = False, rows: int | None = None) -> DataFrame:
    """``row_number() over (partition by keys order by order)``: numbers inside slices and the rows of the slices before."""
    cut = Cut(df, keys, order, desc, rows)
    cut.running(F.lit(1), out, "count")
    return cut.result()


def steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rn: str, nxt: str, rows: int | None = None) -> DataFrame:
    """``row_number()`` and ``lead(value)`` over the same order, in one cut."""
    cut = Cut(df, keys, order, rows=rows)
    cut.running(F.lit(1), rn, "count")
    cut.shift(value, nxt, -1)
    return cut.result().withColumn(rn, F.col(rn).cast("int"))


def moving_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], measure: str, out: str) -> DataFrame:
    """``sum(m) over (... rows between 1 preceding and 1 following)``: previous + current + next row."""
    cut = Cut(df, keys, order)
    cut.shift(measure, "_prev_m", 1)
    cut.shift(measure, "_next_m", -1)
    near = [F.col(c) for c in ("_prev_m", measure, "_next_m")]
    total = sum((F.coalesce(c, F.lit(0)) for c in near), F.lit(0))
    return cut.result().withColumn(out, F.when(F.coalesce(*near).isNotNull(), total)).drop("_prev_m", "_next_m")  # NULL only where all are


def ntile(df: DataFrame, order: Sequence[str], buckets: int, out: str) -> DataFrame:
    """``ntile(buckets) over (order by order)`` over all rows: the global row number, and the bucket by arithmetic (the first
    ``N mod buckets`` buckets have one row more).  ``order`` must tell the rows apart."""
    rows = df.count()
    cut = Cut(df, [], order, rows=rows)
    cut.running(F.lit(1), "_rn", "count")
    small, larger = rows // buckets, rows % buckets
    at = F.col("_rn") - 1
    split = larger * (small + 1)
    tail = F.lit(larger) + F.floor((at - split) / max(1, small))
    bucket = F.when(at < split, F.floor(at / (small + 1))).otherwise(tail)
    return cut.result().withColumn(out, (bucket + 1).cast("int")).drop("_rn")
