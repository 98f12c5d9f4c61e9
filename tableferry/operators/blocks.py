"""Fixed-size blocks of rows, and their row and column layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.footers import in_file_order
from .ordering import with_position


def _placed(numbered: DataFrame, columns: Sequence[str], rows_per_block: int, writers: int) -> DataFrame:
    block = F.floor(F.col("_position") / F.lit(rows_per_block)).cast("bigint")
    return numbered.select(
        *columns,
        block.alias("block"),
        F.pmod(F.col("_position"), F.lit(rows_per_block)).cast("int").alias("slot"),
        F.pmod(block, F.lit(writers)).cast("int").alias("writer"),
    )


def file_blocks(spark: SparkSession, path: str, rows_per_block: int, writers: int = 1) -> DataFrame:
    """The Parquet table at ``path`` with ``block``, ``slot`` (0-based row in the block) and ``writer``.

    Blocks are cut from the rows as they stand in the files, files by name, so a row's place is known from the footers and
    its number in the file: nothing is sorted, shuffled or written. Every block but the last is full, and blocks are
    dealt to the writers in turn.
    """
    numbered = in_file_order(spark, path, "_position")
    return _placed(numbered, [c for c in numbered.columns if c != "_position"], rows_per_block, writers)


def assign_blocks(df: DataFrame, rows_per_block: int, order: Sequence[str], writers: int = 1) -> DataFrame:
    """The same for any rows in a wanted order, which costs a sort of the whole table.

    Blocks are cut from the global order and dealt to the writers in turn, so every block but the
    last is full and no key can overload a writer.
    """
    return _placed(with_position(df, order, "_position"), df.columns, rows_per_block, writers)


def to_column_blocks(blocks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per block with one array per attribute, in slot order.

    A group is one block, whose row count is fixed by ``rows_per_block``.
    """
    rows = F.sort_array(F.collect_list(F.struct("slot", *columns)))
    packed = blocks.groupBy("block").agg(rows.alias("_rows"), F.count("*").cast("int").alias("tuples"))
    return packed.select("block", "tuples", *[F.col(f"_rows.{c}").alias(c) for c in columns])


def to_row_blocks(column_blocks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The inverse: one row per tuple with its block and slot."""
    zipped = F.arrays_zip(*columns)
    exploded = column_blocks.select("block", F.posexplode(zipped).alias("slot", "_row"))
    return exploded.select("block", "slot", *[F.col(f"_row.{c}").alias(c) for c in columns])
