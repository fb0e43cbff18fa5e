"""JSON lines behind addresses as a batch source for ``spark.read``: a partition for each address."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class JsonLinesSource(DataSource):
    """``spark.read.format("json_lines").option("urls", "a b").option("limit", 10).load()`` gives ``url, ord, value``;
    reading an address stops at ``limit`` lines."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return "url string, ord bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("urls", "").split(), int(self.options.get("limit", "-1")), float(self.options.get("timeout", "60")))


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], limit: int, timeout: float):
        self.urls, self.limit, self.timeout = urls, limit, timeout

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url = partition.value
        with urlopen(url, timeout=self.timeout) as lines:  # noqa: S310
            n = 0
            for raw in lines:
                if 0 <= self.limit <= n:
                    return
                line = raw.decode("utf-8").strip()
                if line:
                    yield url, n, line
                    n += 1
