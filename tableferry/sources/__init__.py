from .arrow_files import ArrowFiles, read_arrow_files
from .events import EVENT_FIELDS, read_event_log
from .footers import ParquetFooters, file_sizes, in_file_order, read_footers
from .lines import split_text_file
from .runlogs import CLIENT_TIMINGS, GENERAL_STATS, SERVER_TIMINGS, SWEEP_LOG, read_run_log, read_timing_files
from .tables import jdbc_options, read_csv_table, read_delimited, read_jdbc_table, read_parquet_table

__all__ = [
    "ArrowFiles",
    "CLIENT_TIMINGS",
    "EVENT_FIELDS",
    "GENERAL_STATS",
    "ParquetFooters",
    "SERVER_TIMINGS",
    "SWEEP_LOG",
    "file_sizes",
    "in_file_order",
    "jdbc_options",
    "read_arrow_files",
    "read_csv_table",
    "read_delimited",
    "read_event_log",
    "read_footers",
    "read_jdbc_table",
    "read_parquet_table",
    "read_run_log",
    "read_timing_files",
    "split_text_file",
]
