"""Queries that must do the whole of their job."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableferry import struct_of
from tableferry.plans import calibration
from tableferry.queries import QUERIES, stages
from tableferry.session import work_dir
from tableferry.sinks import writers
from tableferry.storage import list_files, qualified
from tableferry.streaming import seen


def test_each_environment_has_one_set_of_pairs(spark, small):
    found = QUERIES["agg13_distinct_pairs"](spark, small).collect()
    keys = [(r.server_cpu, r.client_cpu, r.network) for r in found]
    assert len(keys) == len(set(keys))
    rows = QUERIES["agg13_pair_rows"](spark, small).collect()
    wanted = {}
    for r in rows:
        wanted.setdefault((r.server_cpu, r.client_cpu, r.network), []).append(f"{r.source_system}>{r.target_system}")
    assert {k: r.pairs for k, r in zip(keys, found)} == {k: ";".join(sorted(v)) for k, v in wanted.items()}


def test_blocks_follow_the_wanted_order(spark, small, tmp_path):
    given = spark.read.parquet(f"{small}/lineitem.parquet")
    backwards = sorted(given.collect(), reverse=True)
    stored = spark.createDataFrame(backwards, given.schema).coalesce(1)
    stored.write.parquet(str(tmp_path / "lineitem.parquet"))
    keys = [str(r.l_orderkey) for r in reversed(backwards)]

    packed = {r.block: r["keys"].split(",") for r in QUERIES["blk2_column_blocks"](spark, str(tmp_path)).collect()}
    assert [k for b in sorted(packed) for k in packed[b]] == keys
    rows = QUERIES["blk3_row_blocks"](spark, str(tmp_path)).orderBy("block", "slot").collect()
    assert [str(r.l_orderkey) for r in rows] == keys
    for name in ("blk1_assign_blocks", "aud1_block_manifest", "aud2_manifest_violations"):
        given_order = QUERIES[name](spark, small).collect()
        assert sorted(given_order) == sorted(QUERIES[name](spark, str(tmp_path)).collect())


def test_a_sweep_is_generated_by_all_tasks(spark):
    bases = spark.range(0, 400, 1, 1)
    grid = calibration.sweep_grid(bases, (1, 2))
    per_task = grid.groupBy(F.spark_partition_id().alias("task")).count().collect()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(per_task) == tasks > 1
    assert sum(r["count"] for r in per_task) == 400 * 2**6 * 5
    assert max(r["count"] for r in per_task) <= 1.1 * 400 * 2**6 * 5 / tasks


def test_a_batch_writes_each_day_once(spark):
    """Not one file per task and day; and nothing of a task is planned day by day."""
    schema = spark.createDataFrame([], "transfer_id bigint").schema
    store = seen.UnseenRows(spark, work_dir(spark, "stored"), schema, "transfer_id")
    ids = spark.range(0, 40 * 2_000, 1, 4).select((F.col("id") * 43).alias("transfer_id"))  # 40 days of some 2,000 ids
    store.append(ids, 0)
    for kind in ("rows", "filters"):
        names = [f for f, _ in list_files(f"{store.path}/{kind}") if f.endswith(".parquet")]
        days = {f.split("day=")[1].split("/")[0] for f in names}
        assert len(days) == 40 and len(names) == 40
    store.append(ids.filter("transfer_id % 2 = 0").union(ids.selectExpr("transfer_id + 1")), 1)
    found = [r.transfer_id for r in store.rows().collect()]
    assert sorted(found) == sorted([43 * i + j for i in range(80_000) for j in (0, 1)])


def test_arrivals_are_as_many_files_as_the_table_has_splits(spark, small, tmp_path, monkeypatch):
    rows = spark.read.parquet(f"{small}/lineitem.parquet")
    rows.repartition(6).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen_files = []
    given = stages.ingest.new_files

    def new_files(spark, folder, *args, **options):
        seen_files.append(len(list_files(qualified(spark, folder))))
        return given(spark, folder, *args, **options)

    monkeypatch.setattr(stages.ingest, "new_files", new_files)
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", str(256 << 20))  # a split a file
        found = QUERIES["str5_continuous_transfer"](spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
    assert found == rows.count() and seen_files == [18]


def test_writers_read_packed_shares(spark, tmp_path):
    schema = struct_of([("k", "INT", 4), ("s", "STRING", 8)])
    rows = spark.range(40_000).selectExpr("cast(id as int) k", "concat('v', id % 7) s")
    before = writers.work_dir
    made = []
    writers.work_dir = lambda *a: made.append(before(*a)) or made[-1]
    try:
        writers.write_csv_lines(rows, str(tmp_path / "csv"), schema, write_par=4)
    finally:
        writers.work_dir = before
    assert len(made) == 1
    sizes = [r["tuples"] for r in writers.file_manifest(spark, str(tmp_path / "csv"), "csv").collect()]
    assert len(sizes) == 4 and sum(sizes) == 40_000 and max(sizes) - min(sizes) <= 4
