"""Inputs on which positions, lines or rows were once lost or mixed up."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tableferry.functions.rates import normalised_cpu
from tableferry.plans import search
from tableferry.session import work_dir
from tableferry.sinks.plugin import BlockFileWriter
from tableferry.sinks.writers import copy_files
from tableferry.sources import SERVER_TIMINGS, read_timing_files, split_text_file
from tableferry.sources.runlogs import rejected_timing_lines
from tableferry.storage import list_committed, qualified
from tableferry.streaming import live


def test_split_size_may_change_between_call_and_action(spark, tmp_path):
    wanted = [f"line {i}" for i in range(5_000)]
    (tmp_path / "t.txt").write_text("\n".join(wanted) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        lines = split_text_file(spark, str(tmp_path / "t.txt"), 4)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        found = lines.orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in found] == wanted and [r.line_no for r in found] == list(range(5_000))


def test_carriage_returns_stay_inside_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_bytes(b"1,a\rb\n2,c\r\n")
    copy_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), "csv")
    found = sorted(r.value for r in spark.read.text(str(tmp_path / "out"), lineSep="\n").collect())
    assert found == ["1,a\rb", "2,c\r"]


def test_rejected_timing_lines_are_told(spark, tmp_path):
    header, good = ",".join(SERVER_TIMINGS.names), ",".join(["5"] + ["1.5"] * 21)
    bad = ",".join(["6"] + ["x"] * 21)
    (tmp_path / "a_server_timings.csv").write_text("\n".join([header, good, bad, "7,1.0", good]) + "\n")
    rows = read_timing_files(spark, str(tmp_path), "server")
    assert rows.count() == len(rows.collect()) == rows.select("transfer_id").count() == 2
    told = rejected_timing_lines(spark, str(tmp_path), "server").collect()
    assert sorted(r.line for r in told) == sorted([bad, "7,1.0"])
    assert {r.source_file for r in told} == {"a_server_timings.csv"}


def test_jobs_do_not_touch_each_others_files(spark, tmp_path):
    import pyarrow as pa

    schema, location = spark.range(1).schema, qualified(spark, str(tmp_path))
    first, second = (BlockFileWriter(location, schema, 1 << 20) for _ in range(2))

    def written(writer):
        return writer.write(iter([pa.record_batch({"id": [1, 2]}, pa.schema([pa.field("id", pa.int64(), False)]))]))

    staged, lost, other = written(first), written(first), written(second)
    second.abort([other])
    assert list_committed(location) != []  # nothing was published yet: every file there is
    first.commit([staged, None])
    assert [f for f, _ in list_committed(location)] == [f"{location}/{staged.name}/part-00000.arrow"]
    assert os.path.exists(f"{tmp_path}/{lost.name}") and not os.path.exists(f"{tmp_path}/{second.job}")


def test_batches_of_one_thread_may_come_apart_or_mixed(spark):
    log = "transfer_id long, component string, thread int, event string, ts_us long, seq long"
    rows = [(1, "rcv", 0, e, t * 1000, s) for s, (e, t) in enumerate([("start", 0), ("pop", 5), ("push", 9), ("pop", 12), ("push", 20), ("end", 21)])]
    from tableferry.operators.stage_metrics import chunk_of, chunk_summaries

    for parts in ((rows[:3], rows[3:]), (rows[::2], rows[1::2])):
        path = work_dir(spark, "runs")
        for i, part in enumerate(parts):
            events = spark.createDataFrame(part, log).withColumn("chunk", chunk_of("seq", 10))
            events.write.parquet(f"{path}/events/batch_id={i}")
            chunk_summaries(events, 10).write.parquet(f"{path}/chunks/batch_id={i}")
        assert live.stage_metrics_so_far(spark, path, 10).first().waiting_ms == 8


def test_no_plan_without_a_bound(spark):
    from tableferry.fixed_values import STAGES

    rates = ", ".join(f"100.0D AS {s}" for s in STAGES)
    df = spark.sql(f"SELECT {rates}, CAST(null AS DOUBLE) AS bound, 12 AS server_cap, 12 AS client_cap")
    plan = search.allocate_workers(df).first()
    assert all(plan[f"{s}_par"] is None for s in STAGES)


def test_two_decimals_of_the_binary_value(spark):
    found = spark.sql("SELECT 2.675D AS a, 1.0D AS c").select(normalised_cpu(F.col("a") , F.col("c"))).first()[0]
    assert found == round(2.675 / (1.0 * 100) * 100, 2)
