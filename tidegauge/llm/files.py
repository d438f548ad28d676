"""Binary files in the shared folder, written and read by tasks.

A task writes under a name that holds its attempt id and reports that name in its
result rows. Only rows of committed attempts reach the manifest, so files that a lost
or speculative attempt left behind are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def attempt_name(folder: str, suffix: str) -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    at = f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else "0"
    return f"{folder.rstrip('/')}/part-{at}-{uuid.uuid4().hex[:8]}{suffix}"


@contextmanager
def writing(path: str) -> Iterator:
    system, local = _resolve(path)
    system.create_dir(local.rpartition("/")[0], recursive=True)
    with system.open_output_stream(local, compression=None) as out:  # bytes as given, whatever the name
        yield out


@contextmanager
def reading(path: str) -> Iterator:
    """A seekable file."""
    system, local = _resolve(path)
    with system.open_input_file(local) as source:
        yield source
