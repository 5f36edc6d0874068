"""The source contract as a Python data source: assembly groups from a listing of JSON lines.

Register with ``spark.dataSource.register(AssemblyGroups)`` and read with
``spark.read.format("assembly_groups").option("listing", json_text)``; other acquisition
front ends give the same columns.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class AssemblyGroups(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assembly_groups"

    def schema(self) -> str:
        return "tfm string, paths array<string>, fallback map<string,string>, broadcast_tfms array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("listing", ""))


class _Reader(DataSourceReader):
    def __init__(self, listing: str):
        self.lines = [x for x in listing.splitlines() if x.strip()]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in self.lines] or [InputPartition("")]

    def read(self, partition: InputPartition):
        if partition.value:
            x = json.loads(partition.value)
            yield (x["tfm"], x.get("paths", []), x.get("fallback", {}), x.get("broadcast_tfms", []))
