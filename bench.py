"""Headline queries, and moves alone, at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``queries`` are whole registered queries, which write their own inputs; ``moves`` start from inputs written before.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import pyspark
from pyspark.sql import functions as F

from tableferry import build_session, work_dir
from tableferry.queries import QUERIES
from tableferry.queries.derived import LINEITEM, lineitem
from tableferry.sinks import BlockFileSink, transfer, write_csv_lines
from tableferry.sources import read_csv_table
from tableferry.storage import qualified

HEADLINE = (
    "agg1_first_attribute_stats",
    "snk1_fixed_csv_line",
    "snk3_parquet_to_csv",
    "snk6_parquet_sink",
    "snk10_same_format_copy",
    "src3_csv_table",
    "blk1_assign_blocks",
    "aud1_block_manifest",
    "aud3_byte_checksum",
    "aud5_verify_copy",
    "met5_whole_milliseconds",
    "met7_component_rollup",
    "str2_running_stage_metrics",
    "agg2_mean_by_configuration",
    "agg10_distribution",
    "set3_first_per_configuration",
    "set4_duplicate_members",
    "fn2_one_at_a_time",
    "srt9_descending_curve",
    "joi1_stats_with_timings",
    "agg5_parallel_throughput",
    "pln1_base_rates",
    "pln4_grid_search",
    "pln6_worker_allocation",
)


TRIES = 3  # of each move; the median counts


def run(spark, name: str, folder: str) -> float:
    """Seconds to compute every row of the query; nothing is gathered in the driver."""
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def clocked(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def moves(spark, folder: str, cpus: int) -> dict[str, dict]:
    """The moves alone: their inputs are written before the clock starts, as several files of many row groups or lines."""
    rows = lineitem(spark, folder).repartition(2 * cpus)
    paths = {fmt: work_dir(spark, f"bench-{fmt}") for fmt in ("parquet", "csv", "arrow")}
    rows.write.option("parquet.block.size", 4 << 20).parquet(paths["parquet"])
    write_csv_lines(rows, paths["csv"], LINEITEM)
    spark.dataSource.register(BlockFileSink)
    rows.write.format("block_files").option("max_file_bytes", 4 << 20).mode("append").save(qualified(spark, paths["arrow"]))
    size = spark.read.text(paths["csv"]).agg(F.sum(F.octet_length("value") + 1)).first()[0]

    def move(source: str, target: str, **options):
        return lambda: transfer(spark, (source, paths[source]), (target, work_dir(spark, "moved")), "lineitem", LINEITEM, **options)

    def scan():
        read_csv_table(spark, paths["csv"], LINEITEM).write.format("noop").mode("overwrite").save()

    actions = {
        "csv_to_csv_copy": move("csv", "csv", skip_ser=True),
        "csv_to_rows": scan,
        "csv_to_parquet": move("csv", "parquet"),
        "parquet_to_csv": move("parquet", "csv"),
        "parquet_to_parquet": move("parquet", "parquet"),
        "arrow_to_csv": move("arrow", "csv"),
    }
    out = {}
    for name, action in actions.items():
        seconds = statistics.median(clocked(action) for _ in range(TRIES))
        out[name] = {"seconds": round(seconds, 3), "text_mb_per_sec_and_core": round(size / 1e6 / seconds / cpus, 2)}
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    rows = QUERIES["agg1_first_attribute_stats"](spark, folder).first()["totalcnt"]  # also warms the JVM up
    run(spark, "snk1_fixed_csv_line", folder)
    # the same work whatever the code, to tell a slower machine from slower code
    def fixed() -> None:
        spark.range(400_000_000).select(F.xxhash64("id").alias("h")).agg(F.bit_xor("h")).collect()

    calibration = statistics.median(clocked(fixed) for _ in range(TRIES))
    seconds = {name: round(run(spark, name, folder), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "moves": moves(spark, folder, int(cpus)),
                "calibration_sec": round(calibration, 3),
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "lineitem_rows": rows,
                "lineitem_rows_per_sec": {
                    name: round(rows / seconds[name])
                    for name in ("agg1_first_attribute_stats", "snk1_fixed_csv_line", "snk3_parquet_to_csv",
                                 "snk6_parquet_sink", "snk10_same_format_copy")
                },
                "cpus": int(cpus),
                "spark": pyspark.__version__,
            }
        )
    )


if __name__ == "__main__":
    main()
