"""Numbered lines of text files, in file order, without copying the text first.

Files are cut into byte ranges of a fixed size. A first pass counts the line feeds of each range; their
prefix sum, one row a range, says what number the first line of a range has. A second pass reads each range and
numbers its lines: a line belongs to the range its first byte is in and is read to its end. The ranges depend on
the files' sizes alone, so both passes, and a repeated task, cut the files in the same places.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_dir
from ..storage import list_files, open_store, qualified

RANGE_BYTES = 64 << 20
PIECE = 1 << 20  # bytes held at once
ROWS = 4_096  # lines handed on at once
RANGES = "file string, start long, end long, size long"


def _ranges(spark: SparkSession, location: str, range_bytes: int) -> DataFrame:
    """One row per byte range. Files come from the driver's listing; their ranges are made by the tasks."""
    files = spark.createDataFrame(list_files(location) or [("", 0)], "file string, size long").filter("size > 0")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    cut = files.select("file", "size", start.alias("start"))
    return cut.select("file", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("end"), "size")


def _pieces(source, start: int, end: int) -> Iterator[bytes]:
    source.seek(start)
    while start < end:
        piece = source.read(min(PIECE, end - start))
        if not piece:
            raise EOFError("a file became shorter while it was read")
        start += len(piece)
        yield piece


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that begin in each range: one for each line feed before its last byte, and a file's first line."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            store, path = open_store(row["file"])
            with store.open_input_file(path) as source:
                # a line begins behind each line feed of the bytes from start - 1 to end - 2
                feeds = sum(p.count(b"\n") for p in _pieces(source, max(row["start"] - 1, 0), row["end"] - 1))
            found.append(feeds + (row["start"] == 0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "lines"])


def _lines(source, start: int, end: int, size: int) -> Iterator[bytes]:
    """Lines whose first byte lies from ``start`` to ``end - 1``, without their line feeds."""
    at, rest = max(start - 1, 0), b""
    skipping, begun = start > 0, start  # the first line of a range begins behind a line feed
    for piece in _pieces(source, at, size):
        parts = (rest + piece).split(b"\n")
        rest = parts.pop()
        for part in parts:
            if skipping:
                skipping = False
                begun = at + len(part) + 1
            else:
                if begun >= end:
                    return
                yield part
                begun += len(part) + 1
            at += len(part) + 1
        if begun >= end and not skipping:
            return
        if skipping and at + len(rest) >= end:
            return  # no line begins in this range
    if not skipping and begun < min(end, size):
        yield rest


def _read(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["file"])
                number, held = row["first"], []

                def made() -> pa.RecordBatch:
                    values = pa.array([x.decode("utf-8", "replace") for x in held], pa.string())
                    return pa.RecordBatch.from_arrays([values, pa.array(range(number, number + len(held)), pa.int64())], [column, "line_no"])

                with store.open_input_file(path) as source:
                    for line in _lines(source, row["start"], row["end"], row["size"]):
                        held.append(line)
                        if len(held) == ROWS:
                            yield made()
                            number, held = number + len(held), []
                if held:
                    yield made()

    return run


def split_text_file(
    spark: SparkSession, path: str, parts: int, column: str = "value", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Lines of the file(s) with their number and contiguous part, ``ceil(total / parts)`` lines per part.

    File order is (name, place). The line feed is the only line end; bytes that are no UTF-8 become U+FFFD.
    """
    ranges = _ranges(spark, qualified(spark, path), range_bytes)
    number = spark.sparkContext.defaultParallelism * 4
    kept = work_dir(spark, "line-ranges")
    counted = ranges.repartition(number, "file", "start").mapInArrow(_count, RANGES + ", lines long")
    counted.write.parquet(kept)
    counted = spark.read.schema(counted.schema).parquet(kept)
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    total = counted.agg(F.sum("lines")).first()[0] or 0  # one number
    placed = counted.withColumn("first", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    lines = placed.repartition(number, "file", "start").mapInArrow(_read(column), f"{column} string, line_no long")
    return lines.withColumn("part", F.floor(F.col("line_no") / max(1, -(-total // parts))).cast("int"))
