"""A keyed table of versions on plain Parquet: merges rewrite only the partitions they touch, and a manifest commits them.

    data/<version>-<id>/part=<p>/...   the rows of the partitions that a version rewrote
    manifests/<version>                which folder holds each partition, written last and whole

A version is the number of a batch. A merge reads the greatest committed version below its own, so a batch that is run again
after a failure starts from the same table, and one that is already committed changes nothing; neither depends on
what a driver remembers. Folders that no manifest names are left-overs of failed merges and are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quorumlake.plans.storage import Files

Merge = Callable[[DataFrame, DataFrame], DataFrame]
PART = "part"


class VersionedTable:
    """part: an integer expression over the key columns, 0 or more, with few values (a manifest lists them all)."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, part: Column):
        self.spark, self.path, self.part = spark, path, part
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.files = Files(spark, path)

    def versions(self) -> list[int]:
        return [int(n) for n in self.files.names(f"{self.path}/manifests") if n.isdigit()]

    def manifest(self, version: int | None) -> dict[str, str]:
        return {} if version is None else self.files.read(f"{self.path}/manifests/{version:012d}")

    def latest(self, below: int | None = None) -> int | None:
        return max((v for v in self.versions() if below is None or v < below), default=None)

    def _frame(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the last one committed."""
        held = self.manifest(self.latest() if version is None else version)
        return self._frame([f"{self.path}/{folder}/{PART}={p}" for p, folder in held.items()])

    def merge(self, incoming: DataFrame, version: int, combine: Merge) -> bool:
        """Commit version = combine(current, incoming) over the partitions of incoming; False if it was committed before."""
        if version in self.versions():
            return False
        held = self.manifest(self.latest(below=version))
        dealt = incoming.withColumn(PART, self.part.cast("int"))
        touched = sorted(r[0] for r in dealt.select(PART).distinct().collect())  # few by the table's contract
        current = self._frame([f"{self.path}/{held[str(p)]}/{PART}={p}" for p in touched if str(p) in held])
        name = f"data/{version:012d}-{uuid.uuid4().hex}"
        merged = combine(current, incoming).select(*self.schema.fieldNames()).withColumn(PART, self.part.cast("int"))
        merged.repartition(PART, F.pmod(F.hash(*self.schema.fieldNames()), F.lit(8))).write.partitionBy(PART).parquet(f"{self.path}/{name}")
        written = {n.removeprefix(f"{PART}=") for n in self.files.names(f"{self.path}/{name}") if n.startswith(f"{PART}=")}
        kept = {p: folder for p, folder in held.items() if int(p) not in touched}
        return self.files.publish(f"{self.path}/manifests/{version:012d}", kept | dict.fromkeys(sorted(written), name))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the folders that none of the last `keep` manifests names, and the older manifests; not while a merge runs."""
        versions = sorted(self.versions())
        live = {folder for v in versions[-keep:] for folder in self.manifest(v).values()}
        gone = [f"data/{n}" for n in self.files.names(f"{self.path}/data") if f"data/{n}" not in live]
        for name in [*gone, *[f"manifests/{v:012d}" for v in versions[:-keep]]]:
            self.files.delete(f"{self.path}/{name}")
        return gone


def summed(keys: list[str], sums: list[str]) -> Merge:
    """Adds incoming sums to the current ones of the same keys."""

    def combine(current: DataFrame, incoming: DataFrame) -> DataFrame:
        return current.select(*keys, *sums).unionByName(incoming.select(*keys, *sums)).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])

    return combine
