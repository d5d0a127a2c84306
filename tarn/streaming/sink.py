"""Streams into and out of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.commit import CommitProperties
from ..table import Table, write_table


def append_batches(spark: SparkSession, path: str, app_id: str, **how) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is one append, committed with (app_id, batch id), so that one that comes again is left out."""

    def write(batch: DataFrame, number: int) -> None:
        if Table.exists(spark, path):
            last = Table(spark, path).transaction_version(app_id)
            if last is not None and last >= number:
                return
        write_table(spark, path, batch, mode="append", commit_properties=CommitProperties(app_transactions=((app_id, number),)), **{"operation": "STREAMING UPDATE", "parameters": {"outputMode": "Append", "queryId": app_id, "epochId": str(number)}, **how})

    return write


def merge_batches(spark: SparkSession, path: str, app_id: str, build: Callable) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: ``build(table, batch, properties)`` merges each batch, once."""

    def write(batch: DataFrame, number: int) -> None:
        table = Table(spark, path)
        last = table.transaction_version(app_id)
        if last is None or last < number:
            build(table, batch, CommitProperties(app_transactions=((app_id, number),)))

    return write


class ChangeReader:
    """Polls a table's change feed: each call of ``read`` returns what came since the call before."""

    def __init__(self, spark: SparkSession, path: str, starting_version: int = 0):
        self.spark, self.path, self.next = spark, path, starting_version

    def read(self) -> DataFrame | None:
        table = Table(self.spark, self.path)
        if table.version() < self.next:
            return None
        out = table.load_cdf(self.next, table.version())
        self.next = table.version() + 1
        return out
