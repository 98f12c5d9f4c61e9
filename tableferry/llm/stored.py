"""Tables written between steps, and the one place where a broadcast is decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.session import work_dir

BROADCAST_ROWS = 200_000  # of narrow rows: tens of MB at most


def written(df: DataFrame, purpose: str, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe when executors are lost."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has few enough rows to be sent to every executor; counted, not guessed."""
    return table.limit(rows + 1).count() <= rows


def sent_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The written table, marked for broadcast if it is small; else it joins by a shuffle."""
    return F.broadcast(table) if small_enough(table, rows) else table
