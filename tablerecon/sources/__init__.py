"""Readers and writers."""

from tablerecon.sources.files import (
    FileDataset,
    csv_options,
    drop_dataset,
    merge_params,
    read_csv_upload,
    read_files,
    read_folder,
    upload_dataset,
    write_files,
    write_table,
    write_with_schema,
)
from tablerecon.sources.foreign import read_foreign, resolve_name
from tablerecon.sources.jdbc import (
    Connection,
    Split,
    SqlDataset,
    read_jdbc_table,
    read_query,
)

__all__ = [
    "Connection",
    "FileDataset",
    "Split",
    "SqlDataset",
    "csv_options",
    "drop_dataset",
    "merge_params",
    "read_csv_upload",
    "read_files",
    "read_folder",
    "read_foreign",
    "read_jdbc_table",
    "read_query",
    "resolve_name",
    "upload_dataset",
    "write_files",
    "write_table",
    "write_with_schema",
]
