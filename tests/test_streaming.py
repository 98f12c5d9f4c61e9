import os
import random

import pytest
from pyspark.sql import functions as F

from tableferry import struct_of, work_dir
from tableferry.operators import stage_metrics as m
from tableferry.streaming import ingest, live, merged, seen

LOG = "transfer_id bigint, component string, thread bigint, event string, ts_us bigint, seq bigint"


def test_metrics_across_batches_in_any_file_order(spark):
    events = [("start", 0), ("pop", 5), ("push", 9), ("pop", 12), ("push", 20), ("push", 26), ("pop", 30), ("end", 41)]
    rows = [(1, "ser", 0, kind, at * 1000, i) for i, (kind, at) in enumerate(events)]
    log = spark.createDataFrame(rows, LOG)
    source, out = work_dir(spark, "log"), work_dir(spark, "metrics")
    for low, high in ((3, 6), (0, 3), (6, 8)):  # the middle arrives first
        log.filter(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = live.running_stage_metrics(stream, out, work_dir(spark, "checkpoint"), 2)
    got = live.run_available(writer, lambda: live.stage_metrics_so_far(spark, out, 2))
    assert got.collect() == m.combine_summaries(m.chunk_summaries(log)).collect()
    assert got.first()["waiting_ms"] == 5 + 3 + 4


@pytest.mark.parametrize("chunk_rows", [3, 10, 1_000])
def test_interleaved_batches_equal_the_batch_form(spark, chunk_rows):
    chance = random.Random(chunk_rows)
    rows = []
    for thread in range(3):
        kinds = ["start", *(chance.choice(["pop", "push", "other"]) for _ in range(60)), "end"]
        rows += [(1, "ser", thread, kind, i * 1_000 + chance.randint(0, 900), i) for i, kind in enumerate(kinds)]
    batches = [[r for r in rows if (r[5] * 7 + r[2]) % 4 == part] for part in range(3)]  # overlapping runs
    batches += [[r for r in rows if (r[5] * 7 + r[2]) % 4 == 3 and r[5] < 30], [r for r in rows if (r[5] * 7 + r[2]) % 4 == 3 and r[5] >= 30]]
    source, out = work_dir(spark, "log"), work_dir(spark, "metrics")
    for batch in batches:
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(source)
    log = spark.createDataFrame(rows, LOG)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = live.running_stage_metrics(stream, out, work_dir(spark, "checkpoint"), chunk_rows)
    got = live.run_available(writer, lambda: live.stage_metrics_so_far(spark, out, chunk_rows))
    assert sorted(got.collect()) == sorted(m.combine_summaries(m.chunk_summaries(log)).collect())


def test_restart_continues_where_it_stopped(spark):
    schema = struct_of([("k", "INT", 4), ("s", "STRING", 3)])
    source, target, checkpoint = (work_dir(spark, n) for n in ("source", "target", "checkpoint"))
    for batch in ([(1, "abcd")], [(2, "x"), (3, "y")]):
        spark.createDataFrame(batch, "k int, s string").coalesce(1).write.mode("append").parquet(source)
        stream = ingest.new_files(spark, source, schema, "parquet")
        writer = ingest.continuous_transfer(stream, schema, "csv", target, checkpoint)
        done = live.run_available(writer, lambda: spark.read.text(target))
    assert sorted(r[0] for r in done.collect()) == ["1,abc", "2,x", "3,y"]


def test_csv_stream_to_parquet(spark):
    schema = struct_of([("k", "INT", 4), ("s", "STRING", 3)])
    source, target = work_dir(spark, "source"), work_dir(spark, "target")
    spark.createDataFrame([("7,q",), ("8,r",)], "value string").write.text(source)
    writer = ingest.continuous_transfer(
        ingest.new_files(spark, source, schema, "csv"), schema, "parquet", target, work_dir(spark, "checkpoint")
    )
    done = live.run_available(writer, lambda: spark.read.parquet(target))
    assert sorted(map(tuple, done.collect())) == [(7, "q"), (8, "r")]


def test_repeated_ids_are_stored_once(spark):
    source, path = work_dir(spark, "records"), work_dir(spark, "stored")
    for batch in ([(1,), (2,), (2,)], [(2,), (3,)], [(1,), (3,)]):
        spark.createDataFrame(batch, "transfer_id bigint").coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = ingest.append_unseen(stream, "transfer_id", path, work_dir(spark, "checkpoint"), schema)
    stored = live.run_available(writer, seen.UnseenRows(spark, path, schema, "transfer_id").rows)
    assert sorted(r.transfer_id for r in stored.collect()) == [1, 2, 3]


def test_batches_open_only_folders_they_can_hit(spark):
    """20 batches, a day each, that repeat one id of the batch before and one of ten days ago."""
    schema = spark.createDataFrame([], "transfer_id bigint, v string").schema
    store = seen.UnseenRows(spark, work_dir(spark, "stored"), schema, "transfer_id")
    day, wanted = 86_400, set()
    for b in range(20):
        own = [b * day + i for i in range(300)]
        batch = own + ([(b - 1) * day + 7] if b else []) + ([(b - 10) * day + 8] if b >= 10 else [])
        rows = spark.createDataFrame([(i, str(b)) for i in batch], schema)
        store.append(rows, b)
        assert len(store.opened) == (b > 0) + (b >= 10) and all(n < b for _, n in store.opened)
        if b == 12:
            store.append(rows, b)  # a repeated batch
        wanted |= {(i, str(b)) for i in own}
    assert sorted(map(tuple, store.rows().collect())) == sorted(wanted)


def test_ids_of_one_day_in_many_batches(spark):
    schema = spark.createDataFrame([], "transfer_id bigint").schema
    store = seen.UnseenRows(spark, work_dir(spark, "stored"), schema, "transfer_id")
    for b in range(4):
        store.append(spark.createDataFrame([(i,) for i in range(b * 50, b * 50 + 100)], schema), b)
    store.append(spark.createDataFrame([], schema), 4)
    store.append(spark.createDataFrame([(None,), (None,), (3,)], schema), 5)
    found = [r.transfer_id for r in store.rows().collect()]
    assert sorted(x for x in found if x is not None) == list(range(250)) and found.count(None) == 1


def test_changelog_keeps_the_newest_version(spark):
    path = work_dir(spark, "log")
    for batch, value in ((0, 1), (1, 5), (10, 7)):
        spark.createDataFrame([("a", value)], "k string, v int").write.parquet(f"{path}/batch_id={batch}")
    assert [tuple(r) for r in live.current_state(spark, path, ["k"]).collect()] == [("a", 7)]


def test_levels_stay_few_over_many_batches(spark):
    log = merged.transfer_progress(spark, work_dir(spark, "progress"))
    chance, rows = random.Random(3), []
    for b in range(21):
        batch = [(chance.randint(1, 4), "write", 0, chance.choice(["push", "pop"]), chance.randint(0, 10**9), b) for _ in range(15)]
        rows += batch
        part = merged.progress_parts(spark.createDataFrame(batch, LOG))
        for _ in range(1 + (b in (3, 10, 15))):  # some batches are repeated, one of them where levels are merged
            log.save(part, b)
        assert len(log.folders()) <= 3 * 3 and len(log._manifests()) <= 2
    there = [f for f in os.listdir(log.root) if f.startswith("level")]
    assert len(there) <= 2 * 3 * 3
    found = sorted(map(tuple, merged.progress_now(log).collect()))
    assert found == sorted(map(tuple, live.running_progress(spark.createDataFrame(rows, LOG)).collect()))


def test_late_rows_count(spark):
    log = merged.event_counts(spark, work_dir(spark, "events"))
    for n, seconds in enumerate(([100, 101, 103], [500], [100])):  # the last comes long after its window
        rows = spark.createDataFrame([("ser", "pop", s) for s in seconds], "component string, event string, s long")
        log.save(merged.counted_events(rows.withColumn("ts", F.timestamp_seconds("s"))), n)
    assert {(r.window_start_us // 1_000_000, r.events) for r in log.now().collect()} == {(100, 3), (102, 1), (500, 1)}
    log.save(merged.counted_events(rows.limit(0).withColumn("ts", F.timestamp_seconds("s"))), 3)
    assert log.now().count() == 3
