"""Files of the data sources in the shared folder, by whatever file system their path names."""

from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import WriterCommitMessage

MANIFEST = "_files.json"
#: Read tasks that the driver plans at most, but for one more.
PARTITIONS = 20_000


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def new_name(suffix: str) -> str:
    """A name that no other attempt of any task uses."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    return f"part-{part:06d}-{uuid.uuid4().hex}{suffix}"


class Written(WriterCommitMessage):
    """The files of one task: (name, bytes)."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def commit(path: str, messages: list[Written | None]) -> None:
    """What the manifest names is the data; files of failed or repeated attempts are never read."""
    fs, folder = opened(path)
    fs.create_dir(folder, recursive=True)
    files = sorted(f for m in messages if m for f in m.files)
    with fs.open_output_stream(f"{folder}/{MANIFEST}") as out:
        out.write(json.dumps(files).encode())


def abort(path: str, messages: list[Written | None]) -> None:
    fs, folder = opened(path)
    for m in messages:
        for name, _ in m.files if m else []:
            fs.delete_file(f"{folder}/{name}")


def committed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(name, bytes) of the manifest's files; without a manifest, of all files with one of the suffixes."""
    fs, folder = opened(path)
    if fs.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
            return [(n, s) for n, s in json.loads(f.read())]
    found = fs.get_file_info(pafs.FileSelector(folder))
    return sorted((x.base_name, x.size) for x in found if x.is_file and x.base_name.endswith(suffixes))


def together(sizes: list[int], least: int, most: int | None = None) -> list[list[int]]:
    """The places of sizes in runs of `least` bytes or more, and of more where there would be more than `most` runs (PARTITIONS)."""
    target, runs, held = max(least, -(-sum(sizes) // (most or PARTITIONS))), [], 0
    for i, size in enumerate(sizes):
        if not runs or held >= target:
            runs.append([])
            held = 0
        runs[-1].append(i)
        held += size
    return runs
