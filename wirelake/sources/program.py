"""A dissector program's output as a Spark source: ``spark.read.format("wirelake_program")`` with the option ``argv`` (JSON)."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wirelake.sources.process import lines


class _Run(InputPartition):
    def __init__(self, argv: list[str]):
        self.argv = argv


class _Reader(DataSourceReader):
    def __init__(self, runs: list[list[str]]):
        self.runs = runs

    def partitions(self) -> list[_Run]:
        return [_Run(a) for a in self.runs]

    def read(self, partition: _Run) -> Iterator[tuple[str]]:
        for line in lines(partition.argv):
            yield (line,)


class ProgramSource(DataSource):
    """``argv``: a JSON list of command lines, one task for each."""

    @classmethod
    def name(cls) -> str:
        return "wirelake_program"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> _Reader:
        return _Reader(json.loads(self.options["argv"]))


def run_program(spark: SparkSession, *argv: list[str]) -> DataFrame:
    spark.dataSource.register(ProgramSource)
    return spark.read.format("wirelake_program").option("argv", json.dumps(argv)).load()
