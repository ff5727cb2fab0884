"""Files that tasks write themselves, in the shared folder of the cluster.

A task writes under a name of its own attempt and returns it as a row; the rows are committed by Spark's writer, so the
files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder URI (a plain path is local); the folder is made."""
    system, path = fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
    system.create_dir(path, recursive=True)
    return system, path


def attempt_name(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex}"
