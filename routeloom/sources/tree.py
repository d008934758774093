"""Source trees (S8, S9): a data source that lists directories and never enters what no extractor reads.

``source_tree`` yields the files of a tree, path (relative) and bytes, not their contents. Directories
that the skip rules name are not listed. Listing starts on the driver with many directories at a time
and stops at LISTED entries: what has been found until then is dealt into partitions of about
``partition_bytes``; directories still to be listed are handed to the executors, which walk them by the
same rules. Neither makes more than TASKS partitions, so a tree that fits is planned by bytes, and one
that does not costs the driver no more than LISTED entries and the names in the directories it was at.

``opened`` reads contents in the tasks, each file once, with an error instead of contents where a
file cannot be read. ``write_tree`` writes (path, content) rows as a tree.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from routeloom.scan.core import SKIPPED

LISTED = 200_000
PARTITION_BYTES = 16 << 20
FILE_COST = 64 << 10  # what opening a file is worth, in bytes
THREADS = 32
AT_ONCE = 8 * THREADS  # directories that the driver lists before it looks at the limit again
TASKS = 1000  # partitions at most; of files listed by the driver, and of directories handed on
READ_BYTES = 4 * PARTITION_BYTES  # what one task opens, where files are dealt for reading
SCHEMES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def opened_fs(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def readable(root: str) -> bool:
    """Whether tasks can open files there by themselves."""
    return "://" not in root or root.split("://", 1)[0] in SCHEMES


@dataclass
class Work(InputPartition):
    files: list[tuple[str, int]] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(None)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.skip = SKIPPED | {x for x in options.get("skip", "").split(",") if x}
        self.hidden = options.get("hidden", "true") == "true"
        self.limit, self.size = int(options.get("listed", LISTED)), int(options.get("partition_bytes", PARTITION_BYTES))
        self.tasks = int(options.get("tasks", TASKS))

    def listing(self, where: fs.FileSystem, base: str, folder: str) -> tuple[list[tuple[str, int]], list[str]]:
        """Files and folders to enter of one folder, relative to the tree."""
        files, folders = [], []
        for x in where.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), recursive=False)):
            path = f"{folder}/{x.base_name}".lstrip("/")
            if x.type == fs.FileType.Directory:
                if x.base_name not in self.skip and (self.hidden or not x.base_name.startswith(".")):
                    folders.append(path)
            elif x.type == fs.FileType.File:
                files.append((path, x.size or 0))
        return sorted(files), sorted(folders)

    def partitions(self) -> list[Work]:
        where, base = opened_fs(self.root)
        files, ahead = [], deque([""])
        with ThreadPoolExecutor(THREADS) as pool:
            while ahead and len(files) + len(ahead) <= self.limit:
                now = [ahead.popleft() for _ in range(min(AT_ONCE, len(ahead)))]
                for part, folders in pool.map(lambda d: self.listing(where, base, d), now):
                    files += part
                    ahead += folders
        size = max(self.size, 2 * sum(n + FILE_COST for _, n in files) / self.tasks)  # two neighbours hold more than one size
        out, load = [Work()], 0
        for f in files:
            if load + f[1] + FILE_COST > size and out[-1].files:
                out.append(Work())
                load = 0
            out[-1].files.append(f)
            load += f[1] + FILE_COST
        left, groups = list(ahead), min(len(ahead), self.tasks)
        return out + [Work(folders=left[k::groups]) for k in range(groups)]

    def read(self, partition: Work) -> Iterator[tuple[str, int]]:
        yield from partition.files
        where, base = opened_fs(self.root)
        todo = list(partition.folders)
        while todo:
            files, folders = self.listing(where, base, todo.pop())
            yield from files
            todo += folders


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, bytes bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(dict(self.options))


def tree(spark: SparkSession, root: str, skip: frozenset[str] = frozenset(), **options: object) -> DataFrame:
    """path (relative to root) and bytes of a tree's files."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("skip", ",".join(sorted(skip)))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(root)


def tasks_of(index: DataFrame) -> int:
    """Into how many tasks the files of an index (path, bytes) are dealt for reading."""
    (total,) = index.selectExpr(f"coalesce(sum(bytes + {FILE_COST}), 0)").first()
    return max(1, min(TASKS, ceil(total / READ_BYTES)))


def reader_of(root: str) -> Callable[[str], tuple[str | None, str | None]]:
    """path -> (text, error), for use in a task."""
    where, base = opened_fs(root)

    def read(path: str) -> tuple[str | None, str | None]:
        try:
            with where.open_input_stream(f"{base}/{path}") as f:
                return f.read().decode("utf-8", "replace"), None
        except Exception as x:  # one bad file must not end the scan
            return None, repr(x)

    return read


def opened(files: DataFrame, root: str) -> DataFrame:
    """files (path, ...) -> path, content, error; each file is read once, in the task that has its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader_of(root)
        for b in batches:
            for path in b.column(0).to_pylist():  # a batch for each file: contents are as large as they are
                text, error = read(path)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (path, text, error)], names=["path", "content", "error"])

    return files.select("path").mapInArrow(run, "path string, content string, error string")


def write_tree(files: DataFrame, root: str) -> None:
    """Rows (path, content) as files under root, written by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened_fs(root)
        n = 0
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with where.open_output_stream(f"{base}/{path}") as out:
                    out.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    files.select("path", "content").mapInArrow(run, "n long").agg({"n": "sum"}).collect()


__all__ = ["SourceTree", "opened", "readable", "reader_of", "tasks_of", "tree", "write_tree"]
