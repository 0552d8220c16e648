"""A queue of jobs as a Spark data source: batches of a stream, published once each in a folder, and read again as a stream.

Tasks write Parquet parts under names of their own; a batch is published by one file that lists its parts, named by the batch's number and moved into place. A batch
that runs again after a stop, because the stream died between writing and its own commit, finds its file and changes nothing: no job is lost, none comes twice. An offset of a reader is a
number of batches. A folder has one writer; any number of streams read it, each from its own offsets.

    spark.dataSource.register(JobLog)
    jobs.writeStream.format("joblog").option("path", folder).option("checkpointLocation", ...).start()
    spark.readStream.format("joblog").option("path", folder).load()
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.files import _opened

SCHEMA = "document_id string, published_at timestamp, attempt int"
BATCH = "batch-"


class JobLog(DataSource):
    """Options: path, the folder. The schema is SCHEMA, or the one that is given on reading and was written."""

    @classmethod
    def name(cls) -> str:
        return "joblog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> JobReader:
        return JobReader(self.options["path"], schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> JobWriter:
        return JobWriter(self.options["path"], schema)


def _batches(path: str) -> list[int]:
    """The numbers of the published batches."""
    system, base = _opened(path)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(int(f.base_name[len(BATCH) : -5]) for f in found if f.base_name.startswith(BATCH) and f.base_name.endswith(".json"))


@dataclass
class Part(InputPartition):
    file: str


class JobReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        return {"batches": max(_batches(self.path), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        system, base = _opened(self.path)
        out = []
        for number in _batches(self.path):
            if start["batches"] <= number < end["batches"]:
                with system.open_input_stream(f"{base}/{BATCH}{number:012d}.json") as source:
                    out += [Part(f) for f in json.loads(source.read())]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, base = _opened(self.path)
        kind = to_arrow_schema(self.schema)
        for batch in pq.ParquetFile(system.open_input_file(f"{base}/{partition.file}")).iter_batches(columns=self.schema.fieldNames()):
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in kind], schema=kind)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class JobWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A part of a task's own; what a task that failed has left is in no list."""
        system, base = _opened(self.path)
        name, writer = f"part-{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if batch.num_rows:
                if writer is None:
                    system.create_dir(base, recursive=True)
                    writer = pq.ParquetWriter(system.open_output_stream(f"{base}/{name}"), batch.schema)
                writer.write_batch(batch)
        if writer is not None:
            writer.close()
        return Written(name if writer else None)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, base = _opened(self.path)
        if batchId in _batches(self.path):  # published before the stream died
            self.abort(messages, batchId)
            return
        system.create_dir(base, recursive=True)
        new = f"{base}/.{uuid.uuid4().hex}"
        with system.open_output_stream(new) as out:
            out.write(json.dumps([m.file for m in messages if m and m.file]).encode())
        system.move(new, f"{base}/{BATCH}{batchId:012d}.json")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        system, base = _opened(self.path)
        for m in messages:
            if m and m.file and system.get_file_info(f"{base}/{m.file}").type == fs.FileType.File:
                system.delete_file(f"{base}/{m.file}")
