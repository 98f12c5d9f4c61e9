"""Running aggregates of a stream without state: partial results by batch, merged level by level.

Each micro-batch is aggregated on its own and written as one folder of partial results. As soon as there are ``FAN``
folders of one level, they are merged into one of the next, so after n batches there are at most
``FAN - 1`` folders on each of about log(n) levels, and a row takes part in as many merges as there are levels. A
manifest per batch names the folders that count. A repeated batch starts from the manifest before its own and gives
the same folders again; folders that neither of the last two manifests names are deleted.

Nothing is kept between batches but these folders, so nothing has to expire: a row counts whenever it comes, however
late, and results are exact.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..storage import open_store, qualified

FAN = 4
MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


class MergedLog:
    """Partial aggregates below ``path``: ``keys`` and ``measures`` (column: sum, min or max)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], measures: dict[str, str]) -> None:
        self.spark, self.keys, self.measures = spark, list(keys), measures
        self.path = qualified(spark, path).rstrip("/")
        self.store, self.root = open_store(self.path)
        self.store.create_dir(f"{self.root}/_manifests", recursive=True)

    def _manifests(self) -> dict[int, list[list]]:
        """(batch: folders) of the manifests that are there; two at most stay."""
        out = {}
        for info in self.store.get_file_info(fs.FileSelector(f"{self.root}/_manifests")):
            if info.base_name.endswith(".json") and not info.base_name.startswith("."):
                with self.store.open_input_stream(info.path) as source:
                    out[int(info.base_name.removesuffix(".json"))] = json.loads(source.read())
        return out

    def _merge(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(*[MERGE[how](c).alias(c) for c, how in self.measures.items()])

    def _read(self, folders: list[str]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{f}") for f in folders]
        return reduce(DataFrame.unionByName, parts)

    def _write(self, df: DataFrame, folder: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{folder}")

    def save(self, partial: DataFrame, batch_id: int) -> None:
        """Adds a batch's rows: one for each key it has, or several that merge into it."""
        known = self._manifests()
        earlier = [b for b in known if b < batch_id]
        entries = list(known[max(earlier)]) if earlier else []
        own = f"level0-{batch_id}"
        self._write(self._merge(partial), own)
        entries.append([0, own])
        while len(entries) >= FAN and len({level for level, _ in entries[-FAN:]}) == 1:
            level = entries[-1][0] + 1
            merged = f"level{level}-{batch_id}"
            self._write(self._merge(self._read([f for _, f in entries[-FAN:]])), merged)
            entries[-FAN:] = [[level, merged]]
        hidden = f"{self.root}/_manifests/.{uuid.uuid4().hex}"
        with self.store.open_output_stream(hidden) as out:
            out.write(json.dumps(entries).encode())
        self.store.move(hidden, f"{self.root}/_manifests/{batch_id}.json")
        self._drop_unused(batch_id)

    def _drop_unused(self, batch_id: int) -> None:
        known = self._manifests()
        kept = {b: known[b] for b in sorted(b for b in known if b <= batch_id)[-2:]}
        named = {folder for entries in kept.values() for _, folder in entries}
        for b in known.keys() - kept.keys():
            self.store.delete_file(f"{self.root}/_manifests/{b}.json")
        for info in self.store.get_file_info(fs.FileSelector(self.root)):
            if info.base_name.startswith("level") and info.base_name not in named:
                self.store.delete_dir(info.path)

    def folders(self) -> list[str]:
        """What the newest manifest names."""
        known = self._manifests()
        return [folder for _, folder in known[max(known)]] if known else []

    def now(self) -> DataFrame:
        """One row per key: everything saved so far."""
        return self._merge(self._read(self.folders()))

    def follow(self, rows: DataFrame, partial: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataStreamWriter:
        """Saves ``partial`` of every micro-batch of a stream."""
        return rows.writeStream.foreachBatch(lambda batch, n: self.save(partial(batch), n)).option("checkpointLocation", checkpoint)


def _window_start(time: str, length_us: int) -> Column:
    us = F.unix_micros(F.col(time))
    return (F.floor(us / length_us) * length_us).cast("bigint")


def event_counts(spark: SparkSession, path: str) -> MergedLog:
    return MergedLog(spark, path, ["window_start_us", "component", "event"], {"events": "sum"})


def counted_events(events: DataFrame, time: str = "ts", every_us: int = 2_000_000) -> DataFrame:
    """Events per window, component and kind, of the rows that are there."""
    start = _window_start(time, every_us).alias("window_start_us")
    return events.groupBy(start, "component", "event").agg(F.count("*").alias("events"))


def queue_loads(spark: SparkSession, path: str, queues: Sequence[str]) -> MergedLog:
    return MergedLog(spark, path, ["window_start_us"], {**dict.fromkeys(queues, "sum"), "samples": "sum"})


def summed_loads(samples: DataFrame, queues: Sequence[str], time: str = "ts", every_us: int = 600_000_000) -> DataFrame:
    """Sums of the queues' lengths per window, and how many samples they are of."""
    start = _window_start(time, every_us).alias("window_start_us")
    return samples.groupBy(start).agg(*[F.sum(q).alias(q) for q in queues], F.count("*").alias("samples"))


def mean_loads(log: MergedLog, queues: Sequence[str]) -> DataFrame:
    return log.now().select("window_start_us", *[(F.col(q) / F.col("samples")).alias(q) for q in queues], "samples")


def transfer_progress(spark: SparkSession, path: str) -> MergedLog:
    return MergedLog(spark, path, ["transfer_id"], {"first_us": "min", "last_us": "max", "bufTransferred": "sum"})


def progress_parts(log: DataFrame) -> DataFrame:
    pushed: Column = (F.col("component") == "write") & (F.col("event") == "push")
    return log.groupBy("transfer_id").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count_if(pushed).alias("bufTransferred")
    )


def progress_now(log: MergedLog) -> DataFrame:
    """Elapsed milliseconds and blocks written per transfer."""
    elapsed = F.floor((F.col("last_us") - F.col("first_us")) / 1000).cast("bigint")
    return log.now().select("transfer_id", elapsed.alias("totalTime_ms"), "bufTransferred")
