"""Files in the shared folder, opened from tasks by URI: local, HDFS or object stores, as Arrow's file systems know them."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("s3a://"):
        uri = "s3" + uri[3:]
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def attempt_name(suffix: str) -> str:
    """A file name that no other attempt of any task has, so a failed or repeated attempt never touches another's file."""
    task = TaskContext.get()
    return f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}{suffix}"


def output(folder: str, name: str):
    """An open stream, and the URI of the file."""
    where, path = opened(folder)
    where.create_dir(path, recursive=True)
    return where.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"
