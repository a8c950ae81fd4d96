"""User-written sources: an object with open, next_rows and close, run as a Spark data source."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandline.session import ship


class Spout(Protocol):
    """One instance per partition: ``open`` gets its number and their count, ``next_rows`` yields tuples until done."""

    def open(self, part: int, parts: int) -> None: ...
    def next_rows(self) -> Iterator[tuple]: ...
    def close(self) -> None: ...


class _Reader(DataSourceReader):
    def __init__(self, make: type, parts: int):
        self.make, self.parts = make, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        spout = self.make()
        spout.open(partition.value, self.parts)
        try:
            yield from spout.next_rows()
        finally:
            spout.close()


def read_spout(spark: SparkSession, make: type, schema: str | StructType, parts: int = 1) -> DataFrame:
    """The rows of ``parts`` instances of a spout class."""
    ship(spark)
    name = f"spout_{make.__name__.lower()}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str | StructType:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(make, parts)

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
