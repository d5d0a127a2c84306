"""A writer that takes batches, writes them as files, and commits when told to."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.values import merge_schema
from ..operators.writer import check_schema_allowed, checked, conform, protocol_for, session, write_files
from .snapshot import Metadata


class BatchWriter:
    """Buffers Arrow tables, record batches, pandas frames, DataFrames and JSON rows for a table.

    ``flush`` writes what is buffered and returns the add actions; ``flush_and_commit`` commits them and those of
    flushes before, in one version.
    """

    def __init__(self, table, merge_schema: bool = False):
        self.table, self.merges = table, merge_schema
        self._frames: list = []
        self._adds: list[dict] = []
        self._metadata: Metadata = table.snapshot.metadata

    def write(self, data) -> None:
        from ..table import frame_of

        if type(data).__name__ == "RecordBatch":
            import pyarrow as pa

            data = pa.Table.from_batches([data])
        self._frames.append(frame_of(self.table.spark, data))

    def write_json(self, rows) -> None:
        """Rows as JSON text or dicts, read with the table's schema."""
        texts = [(r if isinstance(r, str) else json.dumps(r, default=str),) for r in rows]
        df = self.table.spark.createDataFrame(texts, "j string").select(F.from_json("j", self._metadata.schema, {"mode": "FAILFAST"}).alias("r"))
        self._frames.append(df.select("r.*"))

    def flush(self) -> list[dict]:
        out, spark = [], self.table.spark
        with session(spark):
            for df in self._frames:
                if self.merges:
                    self._metadata = Metadata(**{**self._metadata.__dict__, "schema": merge_schema(self._metadata.schema, df.schema)})
                check_schema_allowed(df, self._metadata)
                out += write_files(spark, self.table.store, checked(conform(df, self._metadata.schema), self._metadata), self._metadata)
        self._frames = []
        self._adds += out
        return out

    def flush_and_commit(self, commit_properties=None) -> int | None:
        """The version that was made; None where there was nothing to commit."""
        self.flush()
        if not self._adds:
            return None
        now, head = self.table.snapshot, []
        if self._metadata != now.metadata:
            wanted = protocol_for(self._metadata, now.protocol)
            head = ([wanted.action()] if wanted != now.protocol else []) + [self._metadata.action()]
        self.table.commit(head + self._adds, "WRITE", {"mode": "Append", "partitionBy": list(self._metadata.partition_columns)}, props=commit_properties)
        self._adds = []
        return self.table.version()
