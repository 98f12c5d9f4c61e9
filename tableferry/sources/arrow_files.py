"""Arrow IPC files as a source: files are cut into ranges of record batches, read where they are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import list_committed, open_store, qualified

PART_BYTES = 64 << 20  # of a file, read by one task


def _column_as(column: pa.Array, wanted: pa.DataType) -> pa.Array:
    kind = column.type
    if pa.types.is_fixed_size_binary(kind):
        return column.cast(pa.binary()).cast(wanted)
    if pa.types.is_int64(kind) and pa.types.is_int64(wanted):
        return column
    if pa.types.is_int32(kind) or pa.types.is_float64(kind) or pa.types.is_string(kind):
        return column.cast(wanted)
    raise TypeError(f"unsupported Arrow column type {kind}")


@dataclass
class BatchRange(InputPartition):
    """Share ``part`` of ``parts`` of a file's record batches."""

    file: str
    part: int
    parts: int


class ArrowFileReader(DataSourceReader):
    """The driver only lists files and their sizes; how many batches a file has is read from its footer by the tasks.

    A task seeks to the batches of its share, and reads the wanted columns of them alone.
    """

    def __init__(self, location: str, schema: T.StructType, part_bytes: int) -> None:
        self.location, self.part_bytes = location, part_bytes
        self.target = to_arrow_schema(schema)

    def partitions(self) -> list[BatchRange]:
        out = []
        for file, size in list_committed(self.location):
            parts = max(1, -(-size // self.part_bytes))
            out += [BatchRange(file, part, parts) for part in range(parts)]
        return out or [BatchRange("", 0, 0)]

    def read(self, partition: BatchRange) -> Iterator[pa.RecordBatch]:
        if not partition.parts:
            return
        store, path = open_store(partition.file)
        with store.open_input_file(path) as source:
            with pa.ipc.open_file(source) as reader:
                there, batches = reader.schema, reader.num_record_batches
            wanted = sorted({there.get_field_index(n) for n in self.target.names if n in there.names})
            if len(wanted) < len(self.target.names):
                raise KeyError(f"{partition.file} lacks columns: {sorted(set(self.target.names) - set(there.names))}")
            own = range(batches * partition.part // partition.parts, batches * (partition.part + 1) // partition.parts)
            source.seek(0)
            with pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=wanted)) as reader:
                for i in own:
                    block = reader.get_batch(i)
                    columns = [_column_as(block.column(f.name), f.type) for f in self.target]
                    yield pa.RecordBatch.from_arrays(columns, schema=self.target)


class ArrowFiles(DataSource):
    """``spark.read.format("arrow_files").schema(schema).load(path)``; ``part_bytes`` is a task's share of a file."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> T.StructType:
        raise ValueError("arrow_files needs a schema")

    def reader(self, schema: T.StructType) -> ArrowFileReader:
        return ArrowFileReader(self.options["path"], schema, int(self.options.get("part_bytes", PART_BYTES)))


def read_arrow_files(spark: SparkSession, path: str, schema: T.StructType, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of all IPC files at or below ``path``; int32, double, string and fixed-size binary are accepted
    (and int64 where the schema was made with ``wide_ints``).

    A file of any size is read by as many tasks as it has shares of ``part_bytes``, each with whole
    record batches. The projection is by the schema's names.
    """
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format("arrow_files").schema(schema).option("part_bytes", part_bytes)
    return reader.load(qualified(spark, path))
