"""Files that tasks write to and read from the shared folder, on any file system that pyarrow knows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


@contextmanager
def writing(uri: str) -> Iterator[pa.NativeFile]:
    """A stream to a file that appears under its name only when whole, so that a task may fail and run again."""
    system, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    try:
        with system.open_output_stream(part) as out:
            yield out
    except BaseException:
        system.delete_file(part)
        raise
    system.move(part, path)


@contextmanager
def reading(uri: str) -> Iterator[pa.NativeFile]:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as file:
        yield file
