"""Partitions published together: versioned folders and one pointer.

A load writes all its partitions below a folder of its own, ``load=<id>/dt=<day>``, which no reader knows yet.  Then one file
``_versions/<n>.json``, put in place by one rename, names the folder of every partition; readers take the highest ``n``.  A
load that is lost at any moment before the rename changes nothing, and its rerun starts from the same old version, also where
the new partitions are made from old ones that they replace.  Two loads at once can't both become version ``n``: a rename
onto an existing file fails, and the loser starts again.  Old versions stay for their readers until ``vacuum``.

The driver holds one line a partition; data is read and written by Spark alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .writers import Store, partition_layout


class Published:
    """A dataset below ``base``, partitioned by the string column ``part``."""

    def __init__(self, spark: SparkSession, base: str, schema: str | T.StructType, part: str = "dt"):
        self.spark, self.base, self.part = spark, base.rstrip("/"), part
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.store = Store(spark, self.base)

    # -- versions
    def versions(self) -> list[int]:
        names = self.store.names(f"{self.base}/_versions")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def folders(self, version: int | None = None) -> dict[str, str]:
        """Partition value -> folder (relative to ``base``) of a version, by default the newest."""
        version = max(self.versions(), default=0) if version is None else version
        return self._file(version)["folders"] if version else {}

    def _file(self, version: int) -> dict:
        return json.loads(self.store.read(f"{self.base}/_versions/{version}.json"))

    def before(self, tag: str) -> int:
        """The newest version of an earlier load than ``tag`` (0: none): what a load, or its rerun, starts from."""
        return next((v for v in reversed(self.versions()) if self._file(v)["tag"] < tag), 0)

    def read(self, version: int | None = None, days: Iterable[str] | None = None) -> DataFrame:
        """The rows of a version; with ``days``, only these partitions are listed."""
        own = self.folders(version)
        wanted = sorted(own) if days is None else sorted(set(days) & own.keys())
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        inner = T.StructType([*[f for f in self.schema.fields if f.name != self.part], T.StructField("load", T.StringType()),
                              T.StructField(self.part, T.StringType())])
        x = self.spark.read.schema(inner).option("basePath", self.base).parquet(*[f"{self.base}/{own[d]}" for d in wanted])
        return x.select(*self.schema.names)

    def latest(self, day: str | None = None) -> str | None:
        """The greatest partition at or before ``day``, from the version file alone."""
        return max((d for d in self.folders() if day is None or d <= day), default=None)

    # -- loads
    def publish(self, df: DataFrame, replaced: Iterable[str] = (), tag: str = "", onto: int | None = None) -> int:
        """Replace the partitions that ``df`` has rows of, and those in ``replaced`` (without rows: they go), all at once.
        The others are those of version ``onto`` (by default the newest).  ``tag`` names the load, e.g. by its day."""
        number = max(self.versions(), default=0) + 1
        old = self.folders(onto)
        load = f"load={uuid.uuid4().hex}"
        x = df.select(*self.schema.names)
        partition_layout(x, [self.part]).write.partitionBy(self.part).parquet(f"{self.base}/{load}")
        new = {n.partition("=")[2]: f"{load}/{n}" for n in self.store.names(f"{self.base}/{load}") if n.startswith(f"{self.part}=")}
        gone = set(replaced) - new.keys()
        return self._commit(number, {"tag": tag, "folders": {**{d: f for d, f in old.items() if d not in gone}, **new}})

    def _commit(self, version: int, content: dict) -> int:
        self.store.write_new(f"{self.base}/_versions/{version}.json", json.dumps(content, sort_keys=True))
        return version

    def merge(self, new_rows: DataFrame, keys: Iterable[str]) -> int | None:
        """Add the rows whose digest of ``keys`` the table does not have; only partitions with such rows are written, and with
        none nothing is.  Returns the new version, if there is one."""
        digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
        x = new_rows.select(*self.schema.names).withColumn("_d", digest)
        days = [r[0] for r in x.select(self.part).distinct().collect()]  # the load's partitions
        held = self.read(days=days)
        fresh = x.dropDuplicates(["_d"]).join(held.select(digest.alias("_d")), "_d", "left_anti").drop("_d")
        touched = [r[0] for r in fresh.select(self.part).distinct().collect()]
        if not touched:
            return None
        return self.publish(self.read(days=touched).unionByName(fresh))

    # -- cleaning
    def recover(self) -> list[str]:
        """Remove folders that no version names (lost loads); returns them.  Not while a load runs."""
        named = {f.split("/")[0] for v in self.versions() for f in self.folders(v).values()}
        lost = [n for n in self.store.names(self.base) if n.startswith("load=") and n not in named]
        for n in lost:
            self.store.delete(f"{self.base}/{n}")
        return lost

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the last ``keep`` versions, and the folders that only they name."""
        for v in self.versions()[:-keep]:
            self.store.delete(f"{self.base}/_versions/{v}.json")
        self.recover()
        own = set(self.folders().values())
        for v in self.versions():
            own |= set(self.folders(v).values())
        for load in {f.split("/")[0] for f in own}:
            for n in self.store.names(f"{self.base}/{load}"):
                if n.startswith(f"{self.part}=") and f"{load}/{n}" not in own:
                    self.store.delete(f"{self.base}/{load}/{n}")
