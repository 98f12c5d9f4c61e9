from .log import RejectedBatch, append_transfer_record, read_transfer_log
from .plugin import BlockFileSink
from .transfer import ENGINE_OPTIONS, transfer
from .writers import (
    copy_files,
    file_manifest,
    rows_per_file,
    write_csv_lines,
    write_jdbc_table,
    write_parquet_table,
    writer_codec,
)

__all__ = [
    "ENGINE_OPTIONS",
    "BlockFileSink",
    "RejectedBatch",
    "append_transfer_record",
    "copy_files",
    "file_manifest",
    "read_transfer_log",
    "rows_per_file",
    "transfer",
    "write_csv_lines",
    "write_jdbc_table",
    "write_parquet_table",
    "writer_codec",
]
