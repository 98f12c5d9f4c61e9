"""The transfer log: write, audit, publish. A call that is repeated leaves one copy.

Records are staged in a folder of their own, checked there, and then published by one small marker file that appears
as a whole. Readers follow the markers, so what a failed or repeated call has staged is never seen. A batch is
known by its id; without one, by the content of its rows.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audit import LANES, ROW, fingerprint
from ..storage import list_files, open_store, qualified

PUBLISHED = "_published"


class RejectedBatch(ValueError):
    """Staged records did not pass the audit; nothing was published."""


def _markers(location: str) -> dict[str, dict]:
    store, root = open_store(location)
    if store.get_file_info(f"{root}/{PUBLISHED}").type != fs.FileType.Directory:
        return {}
    out = {}
    for file, _ in list_files(f"{location}/{PUBLISHED}"):
        own, path = open_store(file)
        with own.open_input_stream(path) as source:
            marker = json.loads(source.read())
        out[marker["batch"]] = marker
    return out


def _read(spark: SparkSession, location: str, markers: dict[str, dict]) -> DataFrame:
    folders = sorted(f"{location}/{m['folder']}" for m in markers.values())
    return spark.read.option("basePath", location).parquet(*folders).drop("batch")


def read_transfer_log(spark: SparkSession, path: str) -> DataFrame:
    """Every published record, with its day."""
    location = qualified(spark, path)
    markers = _markers(location)
    if not markers:
        raise FileNotFoundError(f"no batch is published in {location}")
    return _read(spark, location, markers)


def _audit(spark: SparkSession, location: str, staged: DataFrame, id_column: str, markers: dict[str, dict]) -> None:
    ids = staged.select(F.col(id_column).alias("id"), "transfer_day")
    wrong = ids.groupBy("id").count().filter("id is null or count > 1").limit(5).collect()
    if wrong:
        raise RejectedBatch(f"ids missing or repeated in the batch, such as {[r['id'] for r in wrong]}")
    if markers:
        ends = ids.agg(F.min("transfer_day"), F.max("transfer_day")).first()
        # only the days of the batch are opened; an id has one day
        stored = _read(spark, location, markers).filter(F.col("transfer_day").between(*ends)).select(F.col(id_column).alias("id"))
        known = ids.join(stored, "id", "left_semi").limit(5).collect()
        if known:
            raise RejectedBatch(f"ids stored by an earlier batch, such as {[r['id'] for r in known]}")


def append_transfer_record(record: DataFrame, path: str, id_column: str = "transfer_id", batch_id: str | None = None) -> bool:
    """Append finished transfers to the log, one folder per day of the transfer (epoch seconds id).

    False if this batch is published already; nothing is written then. Ids must be new to the log and differ.
    """
    spark = record.sparkSession
    location = qualified(spark, path).rstrip("/")
    if batch_id is not None and batch_id in _markers(location):
        return False
    store, root = open_store(location)
    folder = f"batch={uuid.uuid4().hex}"
    day = F.to_date(F.timestamp_seconds(F.col(id_column)))
    record.withColumn("transfer_day", day).write.partitionBy("transfer_day").parquet(f"{location}/{folder}")
    try:
        staged = spark.read.schema(T.StructType([*record.schema.fields, T.StructField("transfer_day", T.DateType())]))
        staged = staged.parquet(f"{location}/{folder}")
        if batch_id is None:
            whole = fingerprint(staged).filter(F.col("column") == ROW).first()
            batch_id = "-".join(f"{whole[n]:x}" for n in ("rows", *LANES)) if whole else "empty"
        markers = _markers(location)
        done = batch_id in markers
        if not done and not staged.isEmpty():
            _audit(spark, location, staged, id_column, markers)
            store.create_dir(f"{root}/{PUBLISHED}", recursive=True)
            marker = f"{root}/{PUBLISHED}/{folder.removeprefix('batch=')}.json"
            hidden = f"{root}/{PUBLISHED}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                out.write(json.dumps({"batch": batch_id, "folder": folder}).encode())
            store.move(hidden, marker)
            return True
    except Exception:
        store.delete_dir(f"{root}/{folder}")
        raise
    store.delete_dir(f"{root}/{folder}")
    return False
