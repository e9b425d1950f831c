"""Files that executors write and read in the shared folder: whole files, moved into place when complete."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def writer(uri: str):
    """A stream whose file appears at `uri` only when all is written; a second attempt replaces the first."""
    where, path = open_fs(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with where.open_output_stream(temp, compression=None, buffer_size=1 << 20) as out:
            yield out
    except BaseException:
        if where.get_file_info(temp).type != fs.FileType.NotFound:
            where.delete_file(temp)
        raise
    where.move(temp, path)


def reader(uri: str):
    where, path = open_fs(uri)
    return where.open_input_stream(path, compression=None, buffer_size=1 << 20)


def partition_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()
