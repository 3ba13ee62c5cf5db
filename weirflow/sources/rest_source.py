"""REST pages as a Spark data source: ``spark.read.format("weirflow_rest")``.

Options: ``params``, the JSON of ``fetch.Acquire``; or ``urls``, a JSON list, to read several
starts in parallel, one task each. The schema is the reader's own: fields are taken by name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

from weirflow.contracts import ContractError
from weirflow.sources import fetch


class Start(InputPartition):
    def __init__(self, url: str):
        self.url = url


def _fit(value, kind):
    """A JSON value as a column of this type."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    return float(value) if isinstance(kind, (DoubleType, FloatType)) else value


class RestReader(DataSourceReader):
    def __init__(self, params: dict, urls: list[str], schema: StructType):
        self.params, self.urls, self.schema = params, urls, schema

    def partitions(self) -> list[Start]:
        return [Start(u) for u in self.urls]

    def read(self, partition: Start) -> Iterator[tuple]:
        for item in fetch.acquire(self.params | {"url": partition.url}).records:
            yield tuple(_fit(item.get(f.name), f.dataType) for f in self.schema.fields)


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weirflow_rest"

    def schema(self):
        raise ContractError("a schema is needed")

    def reader(self, schema: StructType) -> RestReader:
        params = json.loads(self.options.get("params", "{}"))
        urls = json.loads(self.options.get("urls", "[]")) or [params.get("url")]
        for url in urls:
            fetch.Acquire.of(params | {"url": url})  # raises on the driver
        return RestReader(params, urls, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RestSource)
