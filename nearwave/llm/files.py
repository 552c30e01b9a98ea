"""Files that tasks write and read themselves, in a folder all executors reach.

A task writes under a name of its own and reports it; what counts is the report, which Spark
commits.  A file of a failed or repeated attempt is never named in one, so it is never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def new_file(uri: str, prefix: str, suffix: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path and name of a new file in the folder, which is made if need be."""
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
    name = f"{prefix}-{uuid.uuid4().hex}{suffix}"
    return system, f"{path}/{name}", name
