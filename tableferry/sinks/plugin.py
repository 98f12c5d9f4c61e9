"""Plug-in sink: the Python data source API takes the place of a two-method serialize/write interface."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import open_store, publish

MAX_FILE_BYTES = 64 << 20


@dataclass
class TaskFolder(WriterCommitMessage):
    """The folder of one task's attempt, with as many files as its rows needed."""

    name: str
    rows: int


class BlockFileWriter(DataSourceArrowWriter):
    """Arrow IPC files of bounded size.

    A task's attempt writes to a folder of its own, at once under the files' final names. The job is committed by one
    manifest that names the folders of the attempts that count; readers follow the manifests, so nothing that a
    lost, repeated or failed task left behind is seen, and the driver touches no data file.
    """

    def __init__(self, location: str, schema, max_file_bytes: int) -> None:
        self.location = location
        self.arrow_schema = to_arrow_schema(schema)
        self.max_file_bytes = max_file_bytes
        self.job = f"job-{uuid.uuid4().hex}"  # of this job alone; other jobs may write beside it

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFolder:
        filesystem, root = open_store(self.location)
        done = TaskFolder(f"{self.job}/task-{uuid.uuid4().hex}", 0)
        filesystem.create_dir(f"{root}/{done.name}", recursive=True)
        batches = (batch.cast(self.arrow_schema) for batch in iterator)
        for number, first in enumerate(batches):
            with (
                filesystem.open_output_stream(f"{root}/{done.name}/part-{number:05d}.arrow") as out,
                pa.ipc.new_file(out, self.arrow_schema) as sink,
            ):
                size = 0
                for batch in itertools.chain([first], batches):
                    sink.write_batch(batch)
                    done.rows += batch.num_rows
                    size += batch.nbytes
                    if size >= self.max_file_bytes:
                        break
        return done

    def commit(self, messages: list[TaskFolder | None]) -> None:
        folders = [done.name for done in messages if done is not None and done.rows]
        publish(self.location, self.job, folders)

    def abort(self, messages: list[TaskFolder | None]) -> None:
        filesystem, root = open_store(self.location)
        if filesystem.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            filesystem.delete_dir(f"{root}/{self.job}")


class BlockFileSink(DataSource):
    """``df.write.format("block_files").save(location)`` after ``spark.dataSource.register(BlockFileSink)``.

    The location must name its file system (``storage.qualified`` does): a bare path would be each executor's own disk.
    """

    @classmethod
    def name(cls) -> str:
        return "block_files"

    def writer(self, schema, overwrite: bool) -> BlockFileWriter:
        if overwrite:
            raise ValueError("block_files only appends; write to a new folder instead")
        open_store(self.options["path"])  # refuses a bare path
        limit = int(self.options.get("max_file_bytes", MAX_FILE_BYTES))
        return BlockFileWriter(self.options["path"], schema, limit)
