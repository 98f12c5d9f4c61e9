"""Sources that read files in parts: footers, file order, Arrow batches and numbered lines."""

from __future__ import annotations

import glob
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tableferry.operators import blocks
from tableferry.schema import struct_of
from tableferry.sinks import file_manifest
from tableferry.sources import arrow_files, file_sizes, in_file_order, lines, read_arrow_files, read_footers, split_text_file
from tableferry.storage import list_files, open_store, qualified

SCHEMA = struct_of([("k", "INT", 4), ("x", "DOUBLE", 8), ("s", "STRING", 4)])


@pytest.fixture()
def table(spark, tmp_path):
    """Several files with several row groups each, in a folder whose name must be escaped."""
    path = str(tmp_path / "a b+c")
    os.makedirs(path)
    for i, size in enumerate([5_000, 1, 3_000]):
        own = pa.table({"k": pa.array(range(10_000 * i, 10_000 * i + size)), "s": pa.array([None if j % 3 == 1 else f"v{j % 7}" for j in range(size)], pa.string())})
        pq.write_table(own, f"{path}/part-{i}.parquet", row_group_size=700, compression=["zstd", "snappy", "none"][i])
    open(f"{path}/_SUCCESS", "w").close()
    return path


def test_footers_tell_of_every_chunk(spark, table):
    found = read_footers(spark, table).collect()
    wanted = []
    for file in sorted(glob.glob(f"{table}/*.parquet")):
        footer = pq.ParquetFile(file).metadata
        for g in range(footer.num_row_groups):
            for c in range(2):
                chunk = footer.row_group(g).column(c)
                wanted.append((f"file:{file}", os.path.getsize(file), g, footer.row_group(g).num_rows, chunk.path_in_schema,
                               chunk.compression, chunk.total_compressed_size, chunk.total_uncompressed_size,
                               chunk.statistics.null_count, str(chunk.statistics.min), str(chunk.statistics.max)))
    assert sorted(map(tuple, found)) == sorted(wanted)
    assert {r.codec for r in found} == {"ZSTD", "SNAPPY", "UNCOMPRESSED"}


def test_sizes_and_manifests_come_from_footers(spark, table):
    sizes = {os.path.basename(r.file): (r.tuples, r.bytes) for r in file_sizes(spark, table).collect()}
    wanted = {os.path.basename(f): (pq.ParquetFile(f).metadata.num_rows, os.path.getsize(f)) for f in glob.glob(f"{table}/*.parquet")}
    assert sizes == wanted
    manifest = file_manifest(spark, table, "parquet")
    assert {r.file: (r.tuples, r.bytes) for r in manifest.collect()} == wanted
    assert "FileScan" not in manifest._jdf.queryExecution().executedPlan().toString()


def test_places_in_files(spark, table):
    numbered = in_file_order(spark, table)
    rows = sorted((r.position, r.k) for r in numbered.collect())
    wanted = [k for f in sorted(glob.glob(f"{table}/*.parquet")) for k in pq.read_table(f)["k"].to_pylist()]
    assert rows == list(enumerate(wanted))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert " Exchange" not in plan and "Sort" not in plan


@pytest.mark.parametrize("rows_per_block", [1, 700, 8_001, 9_999])
def test_blocks_from_file_geometry(spark, table, rows_per_block):
    cut = blocks.file_blocks(spark, table, rows_per_block, writers=3)
    sizes = {r.block: r["count"] for r in cut.groupBy("block").count().collect()}
    last = -(-8_001 // rows_per_block) - 1
    assert sizes == {b: rows_per_block if b < last else 8_001 - last * rows_per_block for b in range(last + 1)}
    assert cut.filter("writer <> block % 3 or slot < 0").count() == 0
    back = blocks.to_row_blocks(blocks.to_column_blocks(cut, ["k", "s"]), ["k", "s"])
    assert sorted(map(repr, back.select("k", "s").collect())) == sorted(map(repr, cut.select("k", "s").collect()))


def test_an_empty_file_has_no_rows(spark, tmp_path):
    pq.write_table(pa.table({"k": pa.array([], pa.int64())}), str(tmp_path / "a.parquet"))
    pq.write_table(pa.table({"k": pa.array([7], pa.int64())}), str(tmp_path / "b.parquet"))
    assert [(r.position, r.k) for r in in_file_order(spark, str(tmp_path)).collect()] == [(0, 7)]
    with pytest.raises(Exception, match="nothing-here"):
        read_footers(spark, str(tmp_path / "nothing-here")).collect()


def _arrow_file(path, batches):
    made = [pa.record_batch({"s": [f"v{i}"] * 3, "unused": [[i]] * 3, "x": [i / 2] * 3, "k": pa.array([i] * 3, pa.int32())}) for i in batches]
    with pa.OSFile(path, "wb") as out, pa.ipc.new_file(out, made[0].schema) as sink:
        for batch in made:
            sink.write_batch(batch)


@pytest.mark.parametrize("part_bytes", [arrow_files.PART_BYTES, 1_500, 100])
def test_arrow_files_are_read_in_parts(spark, tmp_path, part_bytes):
    _arrow_file(str(tmp_path / "a.arrow"), range(40))
    _arrow_file(str(tmp_path / "b.arrow"), range(40, 41))
    rows = read_arrow_files(spark, str(tmp_path), SCHEMA, part_bytes)
    assert sorted(map(tuple, rows.collect())) == sorted((i, i / 2, f"v{i}") for i in range(41) for _ in range(3))
    location = qualified(spark, str(tmp_path))
    shares = arrow_files.ArrowFileReader(location, SCHEMA, part_bytes).partitions()
    size = os.path.getsize(tmp_path / "a.arrow")
    assert sum(s.file.endswith("a.arrow") for s in shares) == max(1, -(-size // part_bytes))
    one = struct_of([("k", "INT", 4)])
    assert read_arrow_files(spark, str(tmp_path), one, part_bytes).agg(F.sum("k")).first()[0] == 3 * sum(range(41))


def test_a_missing_arrow_column_is_an_error(spark, tmp_path):
    _arrow_file(str(tmp_path / "a.arrow"), range(2))
    with pytest.raises(Exception, match="lacks columns"):
        read_arrow_files(spark, str(tmp_path), struct_of([("other", "INT", 4)])).collect()


@pytest.mark.parametrize("range_bytes", [1, 2, 7, 64, lines.RANGE_BYTES])
def test_lines_are_numbered_across_ranges(spark, tmp_path, range_bytes):
    chance = random.Random(range_bytes)
    wanted = []
    for name in "abc":
        own = ["".join(chance.choice(["x", "é", "", "\r", " "]) for _ in range(chance.randint(0, 9))) for _ in range(12)]
        text = "\n".join(own) + ("\n" if name != "b" else "")
        if name == "b" and not own[-1]:
            own.pop()  # nothing stands behind the last line feed
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
        wanted += own
    (tmp_path / "d.txt").write_bytes(b"")
    (tmp_path / "e.txt").write_bytes(b"\n\n")
    wanted += ["", ""]
    found = split_text_file(spark, str(tmp_path), 5, range_bytes=range_bytes).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in found] == list(enumerate(wanted))
    size = -(-len(wanted) // 5)
    assert [r.part for r in found] == [i // size for i in range(len(wanted))]


def test_lines_longer_than_a_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "PIECE", 16)
    wanted = ["y" * n for n in (0, 15, 16, 17, 100, 1, 0, 333)]
    (tmp_path / "t.txt").write_text("\n".join(wanted) + "\n")
    for range_bytes in (5, 40, 1_000):
        found = split_text_file(spark, str(tmp_path / "t.txt"), 2, range_bytes=range_bytes).orderBy("line_no").collect()
        assert [r.value for r in found] == wanted


def test_no_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("")
    assert split_text_file(spark, str(tmp_path), 3).count() == 0


def test_locations_name_their_store(spark, tmp_path):
    with pytest.raises(ValueError):
        open_store(str(tmp_path))
    (tmp_path / "x").write_text("1")
    (tmp_path / ".hidden").write_text("1")
    assert list_files(qualified(spark, str(tmp_path))) == [(f"file:{tmp_path}/x", 1)]
