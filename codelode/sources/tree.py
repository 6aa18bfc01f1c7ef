"""A source tree as a data source: directories that scans leave out are never entered, and only analysed files are read whole.

The driver lists names while it plans, as Spark does for its own files, and deals them to partitions of about
``partitionBytes``; tasks open the files. A pruned directory is not listed, so nothing below it is ever opened. Of files in
no known language only the lines are counted, a block at a time. What cannot be listed or read is left out.

The folder has to be one that driver and executors share. Links to directories are not followed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import LANGUAGE_OF_EXTENSION, PRUNED_DIRECTORIES

SCHEMA = "path string, language string, extension string, lines bigint, content string"
BLOCK = 1 << 20


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def suffix(name: str) -> str:
    """The extension with its dot; empty for dot files and names without one."""
    stem, dot, end = name.rpartition(".")
    return dot + end if stem else ""


def listed(root: str) -> Iterator[tuple[str, str, int]]:
    """(full path, path below the root, bytes) of the files below a folder, or of the one file."""
    if os.path.isfile(root):
        yield root, os.path.basename(root), os.path.getsize(root)
        return
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in PRUNED_DIRECTORIES)
        for name in sorted(names):
            full = os.path.join(folder, name)
            try:
                size = os.stat(full).st_size
            except OSError:
                continue
            if os.path.isfile(full):
                yield full, os.path.relpath(full, root).replace(os.sep, "/"), size


class TreeReader(DataSourceReader):
    def __init__(self, root: str, part_bytes: int):
        self.root, self.part_bytes = root, part_bytes

    def partitions(self) -> list[Part]:
        parts, held, size = [], [], 0
        for full, path, n in listed(self.root):
            held.append((full, path))
            # A file costs something whatever its size.
            size += n + (1 << 14)
            if size >= self.part_bytes:
                parts.append(Part(held))
                held, size = [], 0
        return [*parts, Part(held)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for full, path in partition.files:
            end = suffix(os.path.basename(path))
            language = LANGUAGE_OF_EXTENSION.get(end[1:])
            if language is None and not end:
                continue
            try:
                with open(full, "rb") as file:
                    if language:
                        content = file.read().decode("utf-8", "replace")
                        yield path, language, end, content.count("\n") + 1, content
                    else:
                        yield path, None, end, 1 + sum(block.count(b"\n") for block in iter(lambda: file.read(BLOCK), b"")), None
            except OSError:
                continue


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], int(self.options.get("partitionbytes", 32 << 20)))


def register(spark: SparkSession) -> None:
    """``spark.read.format("source_tree").load(folder)`` from here on."""
    spark.dataSource.register(TreeSource)
