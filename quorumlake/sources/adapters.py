"""User-supplied sources as a Spark data source: an adapter lists partitions and reads them, filters prune them.

    spark.dataSource.register(AdapterSource)
    spark.read.format("civic_adapter").option("adapter", "package.module:Class").option(...).load()

An adapter class takes the options and has `schema` (DDL), `partitions(filters)` and `read(partition)`. filters are triples
(column, operator, value) with the operators =, <, <=, >, >= and in; they come as JSON in the option `where`, which `adapted` sets
and also applies to the rows. Filters only prune partitions, so an adapter that ignores them is right, and one that uses them is
fast. They are an option of the load, and not taken from Spark's own push-down, since Spark 4.1 plans the partitions of a loaded
frame once: the filters of its first query would hold for all later ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from importlib import import_module
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quorumlake.model import Civic
from quorumlake.plans.registry import query

Triple = tuple[str, str, Any]


class Adapter(Protocol):
    schema: str

    def __init__(self, options: dict[str, str]): ...

    def partitions(self, filters: list[Triple]) -> list[Any]: ...

    def read(self, partition: Any) -> Iterator: ...


class AdapterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "civic_adapter"

    def adapter(self) -> Adapter:
        module, _, name = self.options["adapter"].partition(":")
        return getattr(import_module(module), name)(dict(self.options))

    def schema(self) -> str:
        return self.adapter().schema

    def reader(self, schema) -> DataSourceReader:
        return AdapterReader(self.adapter(), [tuple(f) for f in json.loads(self.options.get("where", "[]"))])


class AdapterReader(DataSourceReader):
    def __init__(self, adapter: Adapter, filters: list[Triple]):
        self.adapter, self.filters = adapter, filters

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.adapter.partitions(self.filters)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator:
        if partition.value is not None:
            yield from self.adapter.read(partition.value)


def may_hold(low: Any, high: Any, operator: str, value: Any) -> bool:
    """Whether a range of values can hold one that passes the filter."""
    if operator == "in":
        return any(low <= v <= high for v in value)
    return {"=": low <= value <= high, "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value}[operator]


class ParquetPages:
    """An adapter over Parquet files of pages: a partition a row group, pruned by the statistics of page_id."""

    schema = "page_id long, url string"

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self, filters: list[Triple]) -> list[tuple[str, int]]:
        import pyarrow.dataset as ds

        kept = []
        for fragment in ds.dataset(self.path, format="parquet").get_fragments():
            for group in fragment.split_by_row_group():
                held = group.row_groups[0].statistics.get("page_id")
                if not held or all(may_hold(held["min"], held["max"], op, v) for column, op, v in filters if column == "page_id"):
                    kept.append((fragment.path, group.row_groups[0].id))
        return kept

    def read(self, partition: tuple[str, int]) -> Iterator:
        import pyarrow.parquet as pq

        yield from pq.ParquetFile(partition[0]).read_row_group(partition[1], columns=["page_id", "url"]).to_batches()


def adapted(spark: SparkSession, adapter: str, where: Sequence[Triple] = (), **options: str) -> DataFrame:
    """The rows of an adapter class, named as module:Class, that pass all filters of where; values are numbers or strings."""
    spark.dataSource.register(AdapterSource)
    rows = spark.read.format("civic_adapter").options(adapter=adapter, where=json.dumps(list(where)), **options).load()
    for column, operator, value in where:
        x = F.col(column)
        rows = rows.filter(x.isin(*value) if operator == "in" else {"=": x == value, "<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}[operator])
    return rows


@query("src_custom_adapter", "SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages WHERE page_id >= 10 AND page_id < 200")
def src_custom_adapter(c: Civic) -> DataFrame:
    pages = adapted(c.spark, "quorumlake.sources.adapters:ParquetPages", [("page_id", ">=", 10), ("page_id", "<", 200)], path=f"{c.sf_dir}/pages.parquet")
    return pages.select("page_id", F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host"))
