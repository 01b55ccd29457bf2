"""Files that tasks write and read in the shared folder, by URI (file, hdfs, s3, gs and so on)."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame

from loomwright.plans.store import cut, fresh_path


def open_out(uri: str):
    """Output stream at ``uri``; missing parent folders are made."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def open_in(uri: str, seekable: bool = False):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path) if seekable else system.open_input_stream(path)


def attempt_name(base: str, part: int, suffix: str) -> str:
    """A name of its own for every task attempt: a repeated attempt never touches another's file."""
    return f"{base}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def spread(manifest: DataFrame, n_files: int) -> DataFrame:
    """One file a task, as far as possible."""
    return manifest.repartition(max(1, n_files))


__all__ = ["open_out", "open_in", "attempt_name", "spread", "cut", "fresh_path"]
