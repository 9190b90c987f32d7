"""A table of Parquet files whose batches count only once they are committed: failed tasks and repeated batches leave no row."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tamarack.sources import store


@dataclass
class Written(WriterCommitMessage):
    """What a task says on success: its file (none for no rows) and how many rows it has."""

    file: str
    rows: int


def manifests(path: str) -> list[dict]:
    """Committed batches in order of their names."""
    return [json.loads(store.read(f"{path}/batches/{n}")) for n in store.names(f"{path}/batches") if n.endswith(".json")]


def files(path: str) -> list[str]:
    return [f for m in manifests(path) for f in m["files"]]


def orphans(path: str) -> list[str]:
    """Files that no committed batch has: what killed tasks and aborted batches left. No writer may be at work."""
    held = set(files(path))
    return [n for n in store.names(f"{path}/data") if n not in held]


def vacuum(path: str) -> int:
    """Delete the orphans; how many there were."""
    found = orphans(path)
    for n in found:
        store.delete(f"{path}/data/{n}")
    return len(found)


class _Writing:
    """Each task writes one file under a name of its own, and the driver's manifest of a batch makes its files count.

    A task that fails, or runs twice, leaves a file that no manifest has. A batch that is repeated after its manifest was
    written (the query died before it noted that) is dropped: its rows are there already.
    """

    def __init__(self, path: str, writer: str, schema: str) -> None:
        self.path, self.writer, self.kind = path.rstrip("/"), writer, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, rows, out, stream = f"{uuid.uuid4().hex}.parquet", 0, None, None
        try:
            for batch in iterator:
                if out is None:
                    fs, at = store.opened(f"{self.path}/data/{name}")
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    stream = fs.open_output_stream(at)
                    out = pq.ParquetWriter(stream, batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
                stream.close()
        return Written(name if out is not None else "", rows)

    def _commit(self, messages: list, batch: str) -> None:
        at, own = f"{self.path}/batches/{batch}.json", [m for m in messages if m is not None]
        if store.exists(at):
            self._abort([m for m in own if m.file not in json.loads(store.read(at))["files"]])
            return
        body = {"batch": batch, "files": [m.file for m in own if m.file], "rows": sum(m.rows for m in own), "schema": self.kind}
        store.write(at, json.dumps(body).encode())

    def _abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.file:
                store.delete(f"{self.path}/data/{m.file}")


class _Batch(_Writing, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, f"{self.writer}-{uuid.uuid4().hex}")

    def abort(self, messages: list) -> None:
        self._abort(messages)


class _Stream(_Writing, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"{self.writer}-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._abort(messages)


class CommittedTable(DataSource):
    """format("committed") with the option `path`, to write (append), to write a stream, and to read.

    The option `writer` names a stream's query; two queries into one table need two names. Reading a table without a
    committed batch needs a schema.
    """

    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> str:
        found = manifests(self.options["path"])
        if not found:
            raise ValueError(f"no batch is committed in {self.options['path']}")
        return found[0]["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> _Batch:
        if overwrite:
            raise ValueError("a committed table is only appended to")
        return _Batch(self.options["path"], self.options.get("writer", "rows"), ddl(schema))

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Stream:
        return _Stream(self.options["path"], self.options.get("writer", "stream"), ddl(schema))


def ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in files(self.path)] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value:
            fs, at = store.opened(f"{self.path}/data/{partition.value}")
            with fs.open_input_file(at) as f:
                yield from pq.ParquetFile(f).iter_batches(columns=self.columns)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommittedTable)
