"""Binary files that tasks write to and read from the shared folder, through whatever file system its address names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)


@contextmanager
def new_file(uri: str) -> Iterator:
    """A file that appears under its name only when complete.

    A repeated or speculative attempt of the task writes under another name and then replaces the file as a whole.
    """
    where, path = _open(uri)
    context = TaskContext.get()
    attempt = f"{path}.attempt-{context.taskAttemptId() if context else 0}"
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(attempt, compression=None) as out:
        yield out
    where.move(attempt, path)


@contextmanager
def stream(uri: str) -> Iterator:
    """Sequential reading."""
    where, path = _open(uri)
    with where.open_input_stream(path, compression=None) as source:
        yield source


@contextmanager
def random_access(uri: str) -> Iterator:
    where, path = _open(uri)
    with where.open_input_file(path) as source:
        yield source


def partition_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0
