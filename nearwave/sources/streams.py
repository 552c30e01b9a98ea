"""Stored tables that tasks stream past their own rows, a bounded batch at a time.

What every task has to see, but no task can hold, is written as a table in the shared folder.  Tasks read its
files themselves; a table is only read after Spark has committed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


def _data_files(uri: str) -> tuple[fs.FileSystem, list[str]]:
    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    system, path = fs.FileSystem.from_uri(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return system, sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def stored_batches(uri: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The table's rows in batches of ``rows`` at most, file by file; nothing if there is no such folder."""
    system, files = _data_files(uri)
    for path in files:
        with system.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=rows, columns=columns, use_threads=False)
