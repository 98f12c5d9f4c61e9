"""Append rows whose id is new, with work that follows the batch and not the history.

Rows are stored by day of their id and by batch. Beside each such folder lies a Bloom filter of its ids, a table of
64-bit words. A batch looks at the filters of its own days only, and opens a stored folder only if a filter says that one
of the batch's ids may be in it; then the ids themselves decide, so the result is exact. A repeated
batch replaces its own folders and compares with earlier batches alone, so it gives the same rows.
A day's rows go to as many tasks as they fill files, so a batch writes some files a day and not one per task and day.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import open_store, qualified

BITS_PER_ID = 16  # with four probes one id in some 400 is looked up in vain
PROBES = 4
ROWS_PER_FILE = 1_000_000  # of one day and batch
NO_DAY = "1970-01-01"  # of ids that are null; no such row is ever taken for a stored one


def day_of_epoch(value: Column) -> Column:
    return F.to_date(F.timestamp_seconds(value))


def _places(value: Column, bits: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(i)), bits) for i in range(PROBES)])


class UnseenRows:
    """The store below ``path``: ``rows`` and ``filters``, each by day and batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, id_column: str,
                 day_of: Callable[[Column], Column] = day_of_epoch) -> None:
        self.spark, self.schema, self.id = spark, schema, id_column
        self.path = qualified(spark, path).rstrip("/")
        self.day_of = day_of
        store, root = open_store(self.path)
        store.create_dir(f"{root}/rows", recursive=True)
        self.opened: list[tuple[str, int]] = []  # (day, batch) folders that the last batch opened

    def _there(self, kind: str, days: list[str]) -> list[str]:
        store, root = open_store(self.path)
        found = store.get_file_info([f"{root}/{kind}/day={d}" for d in days])
        return [d for d, info in zip(days, found) if info.type == fs.FileType.Directory]

    def rows(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields]).add("day", "date").add("batch_id", "long")
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows").select(*self.schema.names)

    def _filters(self, days: list[str], batch_id: int) -> DataFrame | None:
        there = [f"{self.path}/filters/day={d}" for d in self._there("filters", days)]
        if not there:
            return None
        schema = "bits long, slot long, word long, day date, batch_id long"
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/filters").parquet(*there)
        return found.filter(F.col("batch_id") < batch_id)

    def _maybe_in(self, ids: DataFrame, filters: DataFrame) -> list[tuple[str, int]]:
        """(day, batch) folders of which a filter may hold one of the ids: no more than there are for these days."""
        kept = filters.select("day", "batch_id", "bits").distinct()
        places = F.array_distinct(_places(F.col("id"), F.col("bits")))
        probes = ids.join(kept, "day").select("day", "batch_id", "id", F.size(places).alias("wanted"), F.explode(places).alias("place"))
        probes = probes.withColumn("slot", F.shiftright("place", 6))
        words = filters.select("day", "batch_id", "slot", "word")
        bit = F.getbit(F.col("word"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
        held = probes.join(words, ["day", "batch_id", "slot"]).filter(bit == 1)
        full = held.groupBy("day", "batch_id", "id", "wanted").agg(F.count("*").alias("n")).filter("n = wanted")
        return [(str(r["day"]), r["batch_id"]) for r in full.select("day", "batch_id").distinct().collect()]

    def _stored_ids(self) -> DataFrame:
        folders = [f"{self.path}/rows/day={d}/batch_id={b}" for d, b in self.opened]
        return self.spark.read.schema(T.StructType([self.schema[self.id]])).parquet(*folders).distinct()

    def _replace(self, df: DataFrame, kind: str) -> None:
        """Rows of one day and ``_piece`` are written by one task."""
        writer = df.repartition("day", "_piece").drop("_piece").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch_id").parquet(f"{self.path}/{kind}")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        day = F.coalesce(self.day_of(F.col(self.id)), F.to_date(F.lit(NO_DAY)))
        own = batch.select(*self.schema.names).dropDuplicates([self.id]).withColumn("day", day).persist()
        try:
            sizes = {str(r["day"]): r["count"] for r in own.groupBy("day").count().collect()}  # one row a day
            filters = self._filters(list(sizes), batch_id)
            ids = own.select("day", F.col(self.id).alias("id"))
            self.opened = sorted(self._maybe_in(ids, filters)) if filters is not None else []
            fresh = own.join(self._stored_ids(), self.id, "left_anti").select(*own.columns) if self.opened else own
            days = [(datetime.date.fromisoformat(day), n) for day, n in sizes.items()]
            per_day = F.broadcast(self.spark.createDataFrame(days, "day date, _n long"))
            fresh = fresh.withColumn("batch_id", F.lit(batch_id).cast("long"))
            pieces = F.ceil(F.col("_n") / F.lit(ROWS_PER_FILE))
            placed = fresh.join(per_day, "day").withColumn("_piece", F.pmod(F.xxhash64(self.id), pieces))
            self._replace(placed.drop("_n"), "rows")
            if sizes:
                words = self._filter_of(fresh, per_day)
                self._replace(words.withColumn("_piece", F.floor(F.col("slot") / F.lit(ROWS_PER_FILE))), "filters")
        finally:
            own.unpersist()

    def _filter_of(self, fresh: DataFrame, per_day: DataFrame) -> DataFrame:
        bits = (F.ceil(F.col("_n") * BITS_PER_ID / F.lit(64)) * 64).cast("long").alias("bits")
        sized = fresh.join(per_day, "day").select("day", "batch_id", F.col(self.id).alias("id"), bits)
        each = sized.select("day", "batch_id", "bits", F.explode(_places(F.col("id"), F.col("bits"))).alias("place"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
        return each.groupBy("day", "batch_id", "bits", F.shiftright("place", 6).alias("slot")).agg(F.bit_or(bit).alias("word"))
