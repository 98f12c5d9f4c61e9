import glob
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableferry import struct_of, work_dir
from tableferry.functions.fixed_text import csv_line
from tableferry.operators import audit, blocks
from tableferry.operators.ranking import latest_record
from tableferry.sinks import (
    BlockFileSink,
    RejectedBatch,
    append_transfer_record,
    copy_files,
    read_transfer_log,
    rows_per_file,
    transfer,
    write_csv_lines,
    writer_codec,
)
from tableferry.sources import jdbc_options, read_arrow_files, read_csv_table, read_timing_files, split_text_file
from tableferry.storage import list_committed, qualified

SCHEMA = struct_of([("k", "INT", 4), ("x", "DOUBLE", 8), ("f", "CHAR", 1), ("s", "STRING", 6)])


@pytest.fixture(scope="module")
def rows(spark):
    """300 rows, a third of them copies of one row."""
    return spark.range(300).selectExpr(
        "cast(if(id % 3 = 0, 7, id) as int) k",
        "if(id % 3 = 0, 0.5D, id / 8) x",
        "if(id % 3 = 0, 'h', 'c') f",
        "if(id % 3 = 0, 'hot', concat('v', id)) s",
    )


def lines(spark, path):
    return sorted(r[0] for r in spark.read.text(path).collect())


@pytest.mark.parametrize("write_par", [None, 1, 3, 8])
def test_any_write_parallelism_gives_the_same_lines(spark, rows, write_par):
    path = work_dir(spark, "csv")
    write_csv_lines(rows, path, SCHEMA, write_par=write_par)
    assert lines(spark, path) == sorted(r[0] for r in rows.select(csv_line(SCHEMA)).collect())
    if write_par:
        assert len(glob.glob(f"{path}/part-*")) == write_par


def test_csv_and_parquet_round_trip(spark, rows):
    csv, parquet, back = (work_dir(spark, n) for n in ("csv", "parquet", "back"))
    write_csv_lines(rows, csv, SCHEMA)
    transfer(spark, ("csv", csv), ("parquet", parquet), "t", SCHEMA)
    transfer(spark, ("parquet", parquet), ("csv", back), "t", SCHEMA)
    assert [r for r in lines(spark, back)] == lines(spark, csv)


@pytest.mark.parametrize("codec", ["nocomp", "snappy", "lz4", "zlib"])
def test_text_codecs(spark, rows, codec):
    path = work_dir(spark, "csv")
    write_csv_lines(rows, path, SCHEMA, codec=codec)
    assert len(lines(spark, path)) == 300


@pytest.mark.parametrize("codec, fmt", [("lzo", "parquet"), ("lzo", "csv"), ("zstd", "csv")])
def test_unwritable_codecs_are_refused(codec, fmt):
    with pytest.raises(ValueError, match="cannot be written"):
        writer_codec(codec, fmt)


def test_same_format_copies(spark, rows):
    first, second = work_dir(spark, "csv"), work_dir(spark, "csv")
    write_csv_lines(rows, first, SCHEMA)
    manifest = transfer(spark, ("csv", first), ("csv", second), "t", SCHEMA, skip_ser=True)
    assert lines(spark, first) == lines(spark, second)
    assert manifest.agg(F.sum("tuples")).first()[0] == 300
    with pytest.raises(ValueError):
        copy_files(spark, first, second, "orc")


def test_file_size_limit(spark, rows):
    path = work_dir(spark, "csv")
    write_csv_lines(rows, path, SCHEMA, max_file_bytes=1000)
    assert max(os.path.getsize(f) for f in glob.glob(f"{path}/part-*")) <= 1000
    with pytest.raises(ValueError):
        rows_per_file(SCHEMA, 10)


def test_unknown_options_and_formats(spark):
    with pytest.raises(ValueError, match="unknown transfer options"):
        transfer(spark, ("csv", "a"), ("csv", "b"), "t", SCHEMA, speed=3)
    with pytest.raises(ValueError, match="unknown source format"):
        transfer(spark, ("avro", "a"), ("csv", "b"), "t", SCHEMA)


def test_jdbc_options():
    options = jdbc_options("jdbc:x", "t", "id", 0, 100, read_partitions=4)
    assert options["numPartitions"] == "4" and options["partitionColumn"] == "id"
    assert "numPartitions" not in jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", read_partitions=4)


def test_arrow_types(spark, tmp_path):
    batch = pa.record_batch(
        {
            "k": pa.array([1, 2], pa.int32()),
            "x": pa.array([0.5, 1.5]),
            "f": pa.array([b"a", b"b"], pa.binary(1)),
            "s": pa.array(["u", "v"]),
        }
    )
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as f, pa.ipc.new_file(f, batch.schema) as w:
        w.write_batch(batch)
        w.write_batch(batch)
    got = read_arrow_files(spark, str(tmp_path), SCHEMA).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, "a", "u")] * 2 + [(2, 1.5, "b", "v")] * 2


def test_unsupported_arrow_type_is_an_error(spark, tmp_path):
    batch = pa.record_batch({"k": pa.array([True])})
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as f, pa.ipc.new_file(f, batch.schema) as w:
        w.write_batch(batch)
    with pytest.raises(Exception, match="unsupported Arrow column type"):
        read_arrow_files(spark, str(tmp_path), struct_of([("k", "INT", 4)])).collect()


def test_plugin_keeps_committed_files_only(spark, rows):
    spark.dataSource.register(BlockFileSink)
    path = qualified(spark, work_dir(spark, "plugin"))
    for _ in range(2):
        rows.repartition(3).write.format("block_files").mode("append").save(path)
    assert read_arrow_files(spark, path, SCHEMA).count() == 600

    small = qualified(spark, work_dir(spark, "plugin"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows.coalesce(1).write.format("block_files").option("max_file_bytes", 1).mode("append").save(small)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(list_committed(small)) >= 6
    assert read_arrow_files(spark, small, SCHEMA).count() == 300

    failing = rows.repartition(3).withColumn("k", F.when(F.col("k") == 299, F.raise_error(F.lit("boom"))).otherwise(F.col("k")))
    with pytest.raises(Exception, match="boom"):
        failing.select(F.col("k").cast("int"), "x", "f", "s").write.format("block_files").mode("append").save(path)
    assert read_arrow_files(spark, path, SCHEMA).count() == 600

    with pytest.raises(Exception, match="names no file system"):
        rows.write.format("block_files").mode("append").save("/bare/path")


def test_csv_refuses_nulls_and_numbers_out_of_range(spark):
    schema = struct_of([("a", "INT", 4), ("x", "DOUBLE", 8)])
    for bad in ((None, 1.0), (3_000_000_000, 1.0)):
        with pytest.raises(Exception, match="column a: value is null or does not fit"):
            write_csv_lines(spark.createDataFrame([bad], "a long, x double"), work_dir(spark, "csv"), schema)
    path = work_dir(spark, "csv")
    write_csv_lines(spark.createDataFrame([(None, 1.0)], "a long, x double"), path, schema, null_as_empty=True)
    assert lines(spark, path) == [",1.00"]
    wide = spark.createDataFrame([(1, 1e19)], "a int, x double")
    write_csv_lines(wide, work_dir(spark, "csv"), schema)
    with pytest.raises(Exception, match="too wide"):
        write_csv_lines(wide, work_dir(spark, "csv"), schema, max_file_bytes=1_000)
    long = spark.createDataFrame([(-(2**31), -9999999999999999999.0 / 1.001)] * 40, "a int, x double")
    write_csv_lines(long, path, schema, max_file_bytes=100)
    assert all(os.path.getsize(f) <= 100 for f in glob.glob(f"{path}/part-*"))


def test_the_transfer_log_keeps_one_copy(spark):
    path = work_dir(spark, "log")
    record = spark.createDataFrame([(10, 1.5), (90_000, 2.5)], "transfer_id long, total_time double")
    with pytest.raises(FileNotFoundError):
        read_transfer_log(spark, path)
    assert append_transfer_record(record, path)
    assert not append_transfer_record(record.orderBy(F.desc("transfer_id")), path)  # the same rows again
    later = spark.createDataFrame([(90_001, 3.0)], "transfer_id long, total_time double")
    assert append_transfer_record(later, path, batch_id="b2") and not append_transfer_record(later, path, batch_id="b2")
    for bad in ([(90_001, 9.0), (5, 1.0)], [(6, 1.0), (6, 2.0)], [(None, 1.0)]):
        with pytest.raises(RejectedBatch):
            append_transfer_record(spark.createDataFrame(bad, record.schema), path)
    assert not append_transfer_record(record.limit(0), path)
    found = sorted((r.transfer_id, r.total_time, str(r.transfer_day)) for r in read_transfer_log(spark, path).collect())
    assert found == [(10, 1.5, "1970-01-01"), (90_000, 2.5, "1970-01-02"), (90_001, 3.0, "1970-01-02")]
    assert len(glob.glob(f"{path}/batch=*")) == 2


def test_fingerprints_add_up(spark, rows):
    whole = {r.column: r for r in audit.fingerprint(rows).collect()}
    parts = audit.merged(audit.fingerprint(rows.filter("k < 50")), audit.fingerprint(rows.filter("k >= 50")))
    assert {r.column: r for r in parts.collect()} == whole
    path = work_dir(spark, "table")
    rows.filter("k < 50").write.parquet(path)
    kept = audit.keep_fingerprint(spark.read.parquet(path), path)
    rows.filter("k >= 50").write.mode("append").parquet(path)
    now = audit.merged(kept, audit.fingerprint(rows.filter("k >= 50")))
    assert spark.read.parquet(path).count() == 300  # what is kept beside the table is no row of it
    checked = audit.compared(now, {"a": audit.fingerprint(rows), "b": kept}).collect()
    assert {(r.copy, r.accepted) for r in checked} == {("a", True), ("b", False)}


def test_many_copies_are_compared_with_one_reading(spark, rows):
    empty = rows.limit(0)
    found = audit.verify_copies(rows, {"same": rows.repartition(2), "none": empty, "other": rows.withColumn("x", F.col("x") + 1)})
    told = {(r.copy, r.column): (r.rows_a, r.rows_b, r.same_values, r.accepted) for r in found.collect()}
    assert len(told) == 12 and all(told["same", c] == (300, 300, True, True) for c in rows.columns)
    assert all(told["none", c][1:] == (0, False, False) for c in rows.columns)
    assert told["other", "x"][2] is False and told["other", "k"][2] is True and not told["other", "k"][3]
    assert all(r.accepted for r in audit.verify_copies(empty, {"e": empty}).collect())


def test_split_is_saved_by_one_job(spark, rows):
    from tableferry.operators.select import save_split

    holes = rows.withColumn("x", F.when(F.col("k") % 5 != 0, F.col("x")))
    path = work_dir(spark, "split")
    kept, rejected = save_split(holes, F.col("x") > 3, path)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, holes.filter("x > 3").collect()))
    assert rejected.count() == 300 - kept.count() and kept.columns == holes.columns
    assert {os.path.basename(p) for p in glob.glob(f"{path}/_kept=*")} == {"_kept=true", "_kept=false"}


def test_ceilings_follow_the_mode(spark):
    from tableferry.functions.labels import strict_lookup
    from tableferry.plans.rules import with_ceilings

    pairs = spark.createDataFrame([("csv", "csv"), ("csv", "postgres"), ("x", "y")], "target_system string, source_system string")

    def found(df):
        return {(r.target_system, r.source_system): (r.read_ceiling, r.write_ceiling) for r in df.collect()}

    assert found(with_ceilings(pairs)) == {("csv", "csv"): (5000, 3000), ("csv", "postgres"): (1000, 1400), ("x", "y"): (None, None)}
    assert found(with_ceilings(pairs, mode=1))["csv", "postgres"] == (1000, 5000)
    with pytest.raises(Exception, match="no ceilings for x_y"):
        with_ceilings(pairs, strict=True).collect()
    with pytest.raises(Exception, match="no entry for csv"):
        pairs.select(strict_lookup(F.col("target_system"), {"x": 1})).collect()


def test_text_parts_are_contiguous_runs_of_the_file(spark, tmp_path):
    wanted = [f"line {i} " + "x" * (i % 50) for i in range(1000)]
    (tmp_path / "t.csv").write_text("\n".join(wanted) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits of one file
    try:
        got = split_text_file(spark, str(tmp_path / "t.csv"), 7).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in got] == wanted
    assert [r.part for r in got] == [i // 143 for i in range(1000)]


def test_timing_files_skip_what_cannot_be_read(spark, tmp_path):
    from tableferry.sources import SERVER_TIMINGS

    header = ",".join(SERVER_TIMINGS.names)
    good = ",".join(["5"] + ["1.5"] * 21)
    (tmp_path / "a_server_timings.csv").write_text(f"{header}\n{good}\n")
    (tmp_path / "b_server_timings.csv").write_text(f"{header}\n{good}\nnot,a,row\n")
    (tmp_path / "a_client_timings.csv").write_text("other\n1\n")
    got = read_timing_files(spark, str(tmp_path), "server").collect()
    assert sorted(r.source_file for r in got) == ["a_server_timings.csv", "b_server_timings.csv"]
    assert {r.transfer_id for r in got} == {5}


def test_latest_record(spark):
    def log(*text):
        return spark.createDataFrame([(t,) for t in text], "value string")

    full = [",".join([str(i)] + ["0.0"] * 21) for i in (3, 12, 7)]
    assert latest_record(log("transfer_id,total_time", *full)).first()["transfer_id"] == 12
    with pytest.raises(Exception, match="expected 22 values, found 2"):
        latest_record(log(*full, "99,1.0")).collect()


@pytest.mark.parametrize("rows_per_block", [1, 7, 300, 1000])
def test_layouts_do_not_change_the_text(spark, rows, rows_per_block):
    cut = blocks.assign_blocks(rows, rows_per_block, rows.columns, writers=3)
    sizes = sorted(r[1] for r in cut.groupBy("block").count().collect())
    assert sum(sizes) == 300 and all(s == rows_per_block for s in sizes[1:])
    back = blocks.to_row_blocks(blocks.to_column_blocks(cut, rows.columns), rows.columns)
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_hot_copies_do_not_overload_a_writer(spark, rows):
    per_writer = blocks.assign_blocks(rows, 10, rows.columns, writers=3).groupBy("writer").count().collect()
    assert {r["count"] for r in per_writer} == {100}


def test_byte_checksum(spark):
    text = ["abc", "", "zz", "hello,1.00"]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    wanted = np.bitwise_xor.reduce(np.frombuffer("".join(text).encode(), dtype=np.uint8))
    assert df.agg(audit.byte_checksum(F.col("t"))).first()[0] == wanted


def test_verify_copy_finds_swaps_pairs_and_losses(spark, rows):
    assert all(r.accepted for r in audit.verify_copy(rows, rows.repartition(3)).collect())
    lost = rows.filter("k <> 299")
    assert not any(r.accepted for r in audit.verify_copy(rows, lost).collect())
    swapped = rows.withColumn("s", F.when(F.col("k") == 1, "v2").when(F.col("k") == 2, "v1").otherwise(F.col("s")))
    assert not any(r.accepted for r in audit.verify_copy(rows, swapped).collect())
    # two equal rows replaced by two other equal rows: an XOR alone would not see it
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    b = spark.createDataFrame([(3,), (3,), (2,)], "v int")
    assert not any(r.same_rows for r in audit.verify_copy(a, b).collect())


def test_row_differences_count_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    b = spark.createDataFrame([(1,), (2,), (3,), (None,)], "v int")
    assert {tuple(r) for r in audit.row_differences(a, b).collect()} == {(1, 1), (3, -1)}


def test_csv_text_with_quotes_stays_as_it_is(spark):
    schema = struct_of([("a", "INT", 4), ("s", "STRING", 20)])
    df = spark.createDataFrame([(1, 'say "x" \\ y'), (2, "")], "a int, s string")
    path = work_dir(spark, "csv")
    write_csv_lines(df, path, schema)
    assert sorted(map(tuple, read_csv_table(spark, path, schema).collect())) == [(1, 'say "x" \\ y'), (2, "")]
