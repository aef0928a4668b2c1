"""Files that tasks write and read in the shared folder, by any URI that pyarrow's file systems know."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str):
    """(file system, path) of a URI or of an absolute local path."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


class TaskFile:
    """A file that appears under its own name only when it is whole; each attempt of a task writes another one."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}{suffix}"
        self.fs, self.path = locate(self.uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part", compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends; returns where the data begin."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.uri


def read_range(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    return handle.read(length)


def open_input(uri: str):
    f, path = locate(uri)
    return f.open_input_file(path)
