"""A table read region by region as a Spark data source: spark.read.format("region_scan").

Options: path of a Parquet file or folder, key, and bounds (comma-separated, rising): regions end and
begin at these, the first and the last being open. Each region is a partition of its own, whose task
reads only row groups that its range can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

NAME = "region_scan"


def _dataset(path: str) -> ds.Dataset:
    store, at = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return ds.dataset(at, format="parquet", filesystem=store)


class Region(InputPartition):
    def __init__(self, start: int | None, end: int | None):
        super().__init__((start, end))
        self.start, self.end = start, end


class RegionReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.key, self.columns = options["path"], options["key"], schema.fieldNames()
        self.bounds = [int(x) for x in options.get("bounds", "").split(",") if x.strip()]

    def partitions(self) -> list[Region]:
        return [Region(a, b) for a, b in zip([None, *self.bounds], [*self.bounds, None], strict=True)]

    def read(self, partition: Region) -> Iterator[pa.RecordBatch]:
        key, held = ds.field(self.key), None
        for cond in ([] if partition.start is None else [key >= partition.start]) + ([] if partition.end is None else [key < partition.end]):
            held = cond if held is None else held & cond
        if partition.start is None:  # rows without a key are in the first region
            held = key.is_null() if held is None else held | key.is_null()
            held = None if partition.end is None else held
        yield from _dataset(self.path).to_batches(columns=self.columns, filter=held, batch_size=1 << 16)


class RegionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return from_arrow_schema(_dataset(self.options["path"]).schema, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> RegionReader:
        return RegionReader(self.options, schema)


def scan(spark: SparkSession, path: str, key: str, bounds: list[int]) -> DataFrame:
    """The table at path, a partition for each region that the bounds make."""
    spark.dataSource.register(RegionSource)
    return spark.read.format(NAME).option("path", path).option("key", key).option("bounds", ",".join(map(str, bounds))).load()
